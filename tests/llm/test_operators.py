"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import collections
import gzip
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer, models

from tidemark.llm import bpe, common, decontaminate, fingerprints, lexer, near_dedup, quality, token_counts, token_files, toxicity, url_filter, warc
from tidemark.llm.encoder import Encoder, encoder, vocabulary_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, score double"
SHARED = " ".join(f"word{k} und wort{k * 7 % 31}," for k in range(400))
TEXTS = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (None, "a b c"), (None, None), (5, "it's <|endoftext|> DON'T we'll ́x"), (5, "it's <|endoftext|> DON'T we'll ́x"),
    (6, SHARED + " first"), (7, "lead " + SHARED), (8, SHARED + " first"), (9, "日本語 123 ４５ Ünï ﬁ"), (10, "   \n\t "), (11, "!!! ???"), (12, "x" * 30_000), (13, "One two three four, FIVE six seven."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None, "clash", "clash", 0.5) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text):
    return encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact():
    e = Encoder(vocabulary_path(), most=200)  # so small that the caches are emptied again and again
    texts = [t for _, t in TEXTS] + ["ΑΣ σας", "İstanbul ǅ", "\x00\x1c a\x85b", "don''t '' 's"]
    flat, at = e.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(t) for t in texts]


def thue_morse(n, flip):
    return "".join("ab"[(k.bit_count() & 1) ^ flip] for k in range(n))


def test_encoder_confirms_words_of_equal_hash(monkeypatch):
    """Words that polynomial hashes modulo 2**64 confuse; and any words under a hash that confuses half of them."""
    texts = [w for n in (64, 128, 256, 512, 1024, 2048, 4096) for w in (thue_morse(n, 0), thue_morse(n, 1), f"the {thue_morse(n, 0)} of {thue_morse(n, 1)}")]
    check = lambda e, ts: [x.tolist() for x in np.split(*(lambda f, at: (f, at[1:-1]))(*e.encode(ts)))] == [ids_of(t) for t in ts]
    assert check(Encoder(vocabulary_path()), texts)
    whole = lexer.hash_spans
    monkeypatch.setattr(lexer, "hash_spans", lambda d, a, b: np.where(b - a > 7, whole(d, a, b) % np.uint64(7) + np.uint64(1), whole(d, a, b)))
    assert check(Encoder(vocabulary_path()), [" ".join(f"wordnumber{k * k % 97}" for k in range(300)), *texts])


def test_long_texts_are_cut_at_white_space():
    text = " ".join(f"w{k * 7919 % 10007}" for k in range(250_000))
    flat, at = Encoder(vocabulary_path()).encode(["a", text, None])
    assert len(text) > 1 << 20 and flat[at[1] : at[2]].tolist() == ids_of(text) and at[3] == at[2]


def spaced_vocabulary():
    """A small model that merges across spaces, so that ids near a cut depend on both sides."""
    vocabulary, merges = {c: k for k, c in enumerate("abcd ")}, [("a", " "), ("a ", "b"), ("c", "d"), ("a b", "cd"), (" ", "c"), ("d", "a ")]
    for x, y in merges:
        vocabulary[x + y] = len(vocabulary)
    return Tokenizer(models.BPE(vocab=vocabulary, merges=merges))


def test_joins_are_repaired():
    t, rng, apart = spaced_vocabulary(), random.Random(1), 0

    def encode(parts):
        ids = [t.encode(p).ids for p in parts]
        return np.array([i for x in ids for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(int)

    for _ in range(300):
        text = "".join(rng.choice("aabbccdd   ") for _ in range(rng.randint(0, 400)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 6))))
        taken = [(a, b, np.array(t.encode(text[a:b]).ids, np.int64)) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        assert bpe.assemble(encode, [(text.encode(), taken)])[0].tolist() == t.encode(text).ids
        apart += sum((t.encode(text[a:b]).ids for a, b in zip([0, *cuts], [*cuts, len(text)])), []) != t.encode(text).ids
    assert apart > 50  # without repair the ids would differ


def test_bpe_chunks(spark, docs, empty):
    tokenizer = encoder(vocabulary_path()).tokenizer
    want = []
    for i, t in TEXTS:
        ids = ids_of(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = collections.Counter(tuple(r) for r in bpe.encode_documents(docs).collect())
    assert got == collections.Counter(want)
    assert bpe.encode_documents(empty).collect() == []


def test_chunks_repeat_where_content_does():
    a, b = SHARED.encode() * 4, b"some other start " + SHARED.encode() * 4
    cut = lambda raw: {d for _, _, d in bpe.chunks(raw)}
    assert len(cut(a) & cut(b)) >= 2
    assert b"".join(a[s:e] for s, e, _ in bpe.chunks(a)) == a


def test_token_counts(spark, docs, empty):
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(docs).collect())
    assert got == collections.Counter((i, len(ids_of(t))) for i, t in TEXTS)
    names = token_counts.write_flat(docs, f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/flat-test", vocabulary_path()).cache()
    one = names.filter("file_ids is not null").select("file", "file_ids")
    by = lambda block: sorted(map(tuple, token_counts.count_tokens(one, block=block).collect()))
    assert by(3) == by(1 << 20)  # blocks that cut documents anywhere
    assert token_counts.document_token_counts(empty).collect() == []


def test_token_files(spark, docs, empty):
    hashed = lambda t: 42 if t is None else (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = np.array([*ids_of(t), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.round_trip(docs).collect()), key=lambda r: r[1]) == want
    assert token_files.round_trip(empty).collect() == []


def test_repair_random_access():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 60)
    ids = rng.integers(0, 40, lengths.sum()).astype(np.uint16)
    raw = token_files.pack(list(range(60)), ids, lengths)
    shard, ends = token_files.Shard(raw), np.cumsum(lengths)
    assert len(shard.rules) > 10 and len(shard.symbols) < len(ids)
    assert all((shard.document(k) == ids[ends[k] - lengths[k] : ends[k]]).all() for k in range(60))
    assert (token_files.expansion_lengths(shard.rules) == shard.sizes[token_files.TERMINALS :]).all()


def test_repair_goes_on_until_no_pair_is_frequent(tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(0, 3000, (200, 6))
    ids = vocabulary[rng.integers(0, 200, 4000)].ravel().astype(np.uint16)
    lengths = np.full(400, 60)
    symbols, rules, spans = token_files.compress(ids, lengths, pairs=7)
    pairs = collections.Counter()
    stops = np.cumsum(spans)
    for a, b in zip(stops - spans, stops):
        pairs.update(zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist()))
    # Counts of pairs that overlap themselves (x x x) may stay.
    assert max(n for (x, y), n in pairs.items() if x != y) < token_files.LEAST_USES
    raw = token_files.pack(list(range(400)), ids, lengths)
    assert len(raw) < 2 * len(ids)
    (tmp_path / "x").write_bytes(raw)
    one = token_files.RandomAccess(str(tmp_path / "x"))
    assert all((one.document(k) == ids[60 * k : 60 * k + 60]).all() for k in (0, 7, 399))
    wide = token_files.Shard(token_files.pack([1], np.arange(50_000) % 49_000, np.array([50_000]), least=2))  # more rules than 16 bits name
    assert (wide.document(0) == np.arange(50_000) % 49_000).all()


def test_warc_of_others_and_damaged(spark, tmp_path):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nX-\xe9: \xff\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200\r\nodd\r\n\r\n"
    body = one + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"junk" + gzip.compress(body) + b"\x1f\x8b\x08" + gzip.compress(body))
    table = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), (tmp_path / "a.warc.gz").stat().st_size)], "file string, n_bytes long")
    assert [(r.page_id, r.payload_bytes) for r in warc.read_archives(table).collect()] == [(None, 0)] * 2
    due = table.selectExpr("*", "array(3) as starts")
    with pytest.raises(Exception, match="2 of 3 records"):
        warc.read_archives(due).collect()


def test_warc(spark):
    big, small = "y" * 200, "z" * 50
    pages = spark.createDataFrame([(1, None, None, 1), (2, "http://a b/é\n", big, 1), (3, "x", big, 1), (None, "x", big, 1), (4, "x", small, 1), (5, "x", small, 1), (2, "x", big, 1)], "page_id long, url string, html string, digest int")
    rows = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(pages).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 0, "response", None, sha("")), (2, 200, "response", None, sha(big)), (2, 200, "response", None, sha(big)), (3, 200, "revisit", 2, sha(big)), (None, 200, "revisit", 2, sha(big)), (4, 50, "response", None, sha(small)), (5, 50, "response", None, sha(small))]
    assert collections.Counter(rows) == collections.Counter(want)
    assert warc.round_trip(pages.filter("false")).collect() == []


def test_warc_splits_anywhere(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/warc-test"
    archives = warc.write_archives(pages, folder).cache()
    n = pages.count()
    for split in (777, 50_000):
        got = warc.read_archives(archives, split)
        assert got.count() == n and got.select("page_id").distinct().count() == n


def test_url_rules(spark):
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "NET", "/zz")], "verdict string, host string, path string")
    urls = ["http://a.example.NET/en/x?q#f", "https://example.net/fr/", "http://example.net", "xnet://notnet/", None, "nothing", "a://b.net/zz/y", "http://fakeexample.net/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/fr/", "net/", "block")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("net/zz", "block") and got[7][2:] == ("net/", "block")
    assert url_filter.judge(pages, rules.filter("false")).filter("verdict <> 'allow'").count() == 0
    assert url_filter.judge(pages.filter("false"), rules).collect() == []
    odd = rules.unionByName(spark.createDataFrame([("block", "a.com", "/x\ty"), ("block", "q.org", ""), (None, "b.net", "/")], rules.schema))
    more = spark.createDataFrame([(1, "http://a.com/x\tyz", "c", "c"), (1, "http://z.q.org", "c", "c"), (None, "http://.net/", "c", "c"), (3, "http://net./", "c", "c")], "page_id long, url string, host string, keys string")
    for part in (10**6, 1):  # one part, and as many as there are rules
        got = {(r.page_id, r.host): r.rule for r in url_filter.judge(more, odd, rules_a_part=part).collect()}
        assert got == {(1, "a.com"): "a.com/x\ty", (1, "z.q.org"): "q.org", (None, ".net"): "net/", (3, "net."): None}


def test_url_rules_match_brute_force(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "cc", "net"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["x", "yy", "é"]) for _ in range(rng.randint(0, 3)))
    held = {(host(), path()): rng.choice(["block", "allow"]) for _ in range(60)}
    urls = [(k, f"http://{host()}{path()}") for k in range(400)]
    rules = spark.createDataFrame([(v, h, p) for (h, p), v in held.items()], "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules, rules_a_part=9).collect()}
    for k, url in urls:
        h, p = re.match("http://([^/]*)(.*)", url).groups()
        fit = [(len(rh + rp), rh, rp) for rh, rp in held if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fit, default=None)
        assert got[k] == ((best[1] + best[2], held[best[1:]]) if best else (None, "allow"))


def test_fingerprints(spark, docs, empty):
    got = fingerprints.compared(docs).collect()
    assert len(got) == len(TEXTS) and fingerprints.compared(empty).collect() == []
    rows = sorted(((i, t or "") for i, t in TEXTS if i not in (None, 5)), key=lambda r: -r[0])
    nexts = {a[0]: b[1] for a, b in zip(rows, rows[1:])}
    for r in got:
        if r.doc_id in nexts and r.doc_id not in (6,):
            text = dict(rows)[r.doc_id]
            half = len(text) // 2
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256((text[: len(text) - half] + nexts[r.doc_id][:half]).encode()).hexdigest())
    of = {r.doc_id: r.fingerprint for r in got}
    # 7 differs from 6 in one word of 800, so that all samples may agree; 13 shares no word with it.
    assert of[6] == of[8] != of[13] and of[3] == of[10]


def stated_signature(text, samples=fingerprints.SAMPLES):
    """The signature as the method states it, term by term."""
    unsigned = lambda b, seed: xxhash.xxh64_intdigest(b, seed)
    counts = collections.Counter(w for w in text.lower().translate({ord(m): " " for m in fingerprints.MARKS}).split(" ") if w)
    out = []
    for k in range(samples if counts else 0):
        best = None
        for term, n in counts.items():
            h = unsigned(term.encode(), 42)
            a, b = (unsigned(struct.pack("<i", x), unsigned(struct.pack("<Q", h), 42)) for x in (2 * k, 2 * k + 1))
            u = lambda x, start, bits: ((x >> start & (1 << bits) - 1) + 0.5) * 2.0**-bits
            r, ln_c = -math.log(u(a, 0, 21) * u(a, 21, 21)), math.log(-math.log(u(b, 0, 32) * u(b, 32, 32)))
            t = math.floor(math.log(n) / r + u(a, 42, 22))
            value = math.floor((max(ln_c - r * (t - u(a, 42, 22) + 1), -250) + 256) * (1 << 18))
            name = (h ^ (t % (1 << 20)) << 16) & (1 << 36) - 1
            best = min(best or (value, name), (value, name))
        out.append(best[1])
    return out


def test_fingerprints_match_statement_row_by_row(spark):
    """Ids at both ends of long, repeated and null ids, ties, empty texts: every column."""
    big = 9_223_372_036_854_775_807
    rows = [(big, "one two two three"), (-big - 1, "four five six"), (5, "a b c, d"), (5, "a b c, d"), (5, "b a"), (None, "x y z"), (None, None), (None, ""), (0, "One TWO two; three four?"), (-7, "w " * 50), (12, "...")]
    hashed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1]), r[1]))
    shown = lambda s: "".join(f"{x:09x}" for x in s) if s else "f" * 9 * fingerprints.SAMPLES
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / fingerprints.SAMPLES if a and b else float(not a and not b)
    want = collections.Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, follows = (stated_signature(x) for x in (t, edited, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), like(own, other), like(own, follows)] += 1
    table = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, bucket string, place int")
    assert collections.Counter(tuple(r) for r in fingerprints.compared(table).collect()) == want


def test_following_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKETS_A_GROUP", 5)
    numbers = sorted(random.Random(1).sample(range(-100, 1000), 200))
    got = dict(map(tuple, fingerprints.following(spark.createDataFrame([(n,) for n in numbers], "bucket long")).collect()))
    assert got == dict(zip(numbers, numbers[1:] + numbers[:1]))


def test_fingerprints_estimate_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), reverse=True))
    order = list(texts)
    count = lambda t: collections.Counter(re.findall(r"[^\s.,;:!?()\"']+", t.lower()))
    off = []
    for r in fingerprints.compared(docs).collect():
        a, b = count(texts[r.doc_id]), count(texts[order[(order.index(r.doc_id) + 1) % len(order)]])
        off.append(r.near_next - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12


def test_fingerprints_of_long_texts(spark):
    """Texts of 6,000 distinct terms: neighbours share none of them, or 3,000, a third of their union."""
    text = lambda start: " ".join(f"w{k}" for k in range(start, start + 6000))
    apart = spark.createDataFrame([(k, text(6000 * k)) for k in range(8)], "doc_id long, text string")
    assert max(r.near_next for r in fingerprints.compared(apart).collect()) <= 1 / 32
    half = spark.createDataFrame([(k, text(3000 * k)) for k in range(9)], "doc_id long, text string")
    near = [r.near_next for r in fingerprints.compared(half).collect() if r.doc_id > 0]
    assert abs(np.mean(near) - 1 / 3) < 0.09


def test_fingerprints_before_and_after_texts_without_words(spark):
    """near_next is 0 between a text with words and one without, and 1 between two without, within a bucket as between buckets."""
    texts = {9: "a b c", 8: None, 7: "a b c", 6: " ,. ", 5: "", 4: "a b c", 3: "a b c", 2: "...", 1: "d e"}
    want = {9: 0.0, 8: 0.0, 7: 0.0, 6: 1.0, 5: 0.0, 4: 1.0, 3: 0.0, 2: 0.0, 1: 0.0}
    near = lambda d: {r.doc_id: r.near_next for r in fingerprints.compared(d).collect()}
    assert near(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == want
    # A thousand rows between the first and the others make more than one bucket of many rows.
    more = [(100 + k, None if k % 2 else f"x{k} y{k}") for k in range(1000)]
    got = near(spark.createDataFrame(more, "doc_id long, text string"))
    assert set(got.values()) == {0.0} and len(got) == 1000


def test_darts_estimate_weighted_jaccard():
    e = lexer.mix(np.arange(900, dtype=np.uint64))
    doc = np.repeat([0, 1], 900)
    wa, wb = np.linspace(0.2, 5, 900), np.linspace(4, 0.5, 900)
    s = near_dedup.dart_signatures(doc, np.concatenate([e, e]), np.concatenate([wa, wb]), 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append(collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and sets[j] and (sets[i] & sets[j]).total() >= threshold * (sets[i] | sets[j]).total()):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return root


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(2)
    base = [f"t{k}" for k in rng.integers(0, 5000, 120)]
    rows = list(TEXTS)
    for k in range(60):  # one group of near copies, in which far ends are linked only through others
        words = list(base)
        for p in range(k // 3):
            words[(p * 7) % 120] = f"new{p}"
        rows.append((100 + k, " ".join(words)))
    rows += [(300 + k, " ".join(base[:60] + [f"u{k}x{p}" for p in range(60)])) for k in range(40)]  # a shared passage, no near copies
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    ids = collections.defaultdict(list)
    for (i, _), r in zip(rows, want):
        ids[r].append(i)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    expected = collections.Counter((i, least[r], len(ids[r])) for (i, _), r in zip(rows, want))
    signed = near_dedup.signed(table)
    assert collections.Counter((r.doc_id, r.class_id, r.class_rows) for r in near_dedup.classes(table).collect()) == expected
    small = near_dedup.components(near_dedup.links(table, signed.cache(), local=4))  # forces many blocks
    assert small.select("root").distinct().count() == near_dedup.components(near_dedup.links(table, signed)).select("root").distinct().count()
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_classes(TEXTS)))
    assert near_dedup.classes(empty).collect() == [] and near_dedup.one_of_each(empty).collect() == []


def weighted_classes(texts, threshold=0.8):
    """Classes by the generalised Jaccard similarity of all pairs that share a shingle."""
    sets, index, common_weight = [], collections.defaultdict(list), collections.Counter()
    for k, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
        for shingle, n in sets[-1].items():
            for other, m in index[shingle]:
                common_weight[other, k] += min(n, m)
            index[shingle].append((k, n))
    size, root = [s.total() for s in sets], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = [(a, b) for (a, b), n in common_weight.items() if n >= threshold * (size[a] + size[b] - n)]
    first = {}
    pairs += [(first.setdefault(t or "", k), k) for k, t in enumerate(texts)]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(len(texts))]


def test_near_duplicates_of_2000_documents(spark):
    """Recall and precision of classes against all pairs; repeated lines make weights above 1."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("doc_id < 1900").collect()
    rng = random.Random(8)
    rows = [tuple(r) for r in rows]
    for k, (_, t) in enumerate(rng.sample(rows, 100)):  # near copies, a third of them with lines repeated more or less often
        words = (t or "").split(" ")
        words[rng.randrange(len(words))] = f"changed{k}"
        rows.append((10_000 + k, " ".join(words) + ("\nsaid the same thing again and again" * (k % 7) if k % 3 == 0 else "")))
    want = weighted_classes([t for _, t in rows])
    ids = [i for i, _ in rows]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for i, r in zip(ids, want):
        least[r] = min(i, least.get(r, i))
    wrong = [i for i, r in zip(ids, want) if got[i] != least[r]]
    assert len(rows) > 1900 and len(wrong) <= 0.002 * len(rows), wrong


def test_alike_texts_do_not_multiply(spark):
    """300 texts of similarity about 0.75: rows stay within bands times blocks, and classes are those of all pairs."""
    rng = np.random.default_rng(3)
    base, rows = [f"t{k}" for k in range(300)], []
    for k in range(300):
        words = list(base)
        for p in rng.choice(300, 5, replace=False):
            words[p] = f"u{k}x{p}"
        rows.append((k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    signatures = near_dedup.signed(table).cache()
    keyed = signatures.selectExpr("node", "doc_id", "explode(bands) as key", "node as label")
    sets = near_dedup.shingle_sets(table, signatures.select("doc_id", "node").distinct()).cache()
    sizes = near_dedup.bucket_sizes(keyed, sets, 60, 1 << 30).cache()
    assert sizes.agg({"blocks": "max"}).head()[0] <= 5
    assert near_dedup.deal(keyed, sizes).count() <= 300 * 30 * 5
    found = {r.doc_id: r.class_id for r in near_dedup.classes(table).collect()}
    want = weighted_classes([t for _, t in rows])
    assert sum(found[k] != r for k, r in enumerate(want)) <= 2 and len(set(want)) > 100
    small = near_dedup.components(near_dedup.links(table, signatures, local=60))
    whole = near_dedup.components(near_dedup.links(table, signatures))
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in whole.collect()}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_band_length_follows_threshold(threshold):
    rows = near_dedup.rows_of(threshold)
    assert (1 - threshold**rows) ** near_dedup.BANDS <= near_dedup.MISS < (1 - threshold ** (rows + 1)) ** near_dedup.BANDS


def test_templates(spark, docs, empty):
    bench = spark.createDataFrame([(1, "Tom paid 5 dollars for 3 apples and Sue paid 6 dollars for 3 pears at the old market in the town.", "x"), (2, None, "x"), (3, "", "x"), (4, "the short five words", "x")], "item_id long, text string, key string")
    say = "{} paid {} dollars for {} apples and {} paid {} dollars for {} pears at the old market in the town."
    rows = [(1, "Before. " + say.format("Tom", 5, 3, "Sue", 6, 3)), (2, say.format("Anna", "1,200", 4, "Lena", 9.5, 4)), (3, say.format("Anna", 12, 4, "Lena", 9, 5)), (4, None), (None, "so the short five words are there"), (6, "1 2 3 4 5 6 7 8 9 10 11 12")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    # 3: the two threes of the item are filled apart, which equal numbers may be. 7: two names for one.
    for lookup in (1000, 0):  # with the windows looked up in the scan, and with all windows shuffled
        got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(table, bench, lookup_windows=lookup).collect()}
        assert got == {(1, 1): "verbatim", (2, 1): "re-parameterised", (3, 1): "re-parameterised", (None, 4): "verbatim"}
    assert sorted((r.doc_id or 0) for r in decontaminate.without_leaks(table, bench).collect()) == [4, 6]
    assert decontaminate.without_leaks(docs, bench).columns == docs.columns
    assert decontaminate.leaks(empty, bench).collect() == [] and decontaminate.leaks(table, bench.filter("false")).collect() == []


def test_slots_of_one_name_hold_one_name(spark):
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k)) + "x"
    bench = spark.createDataFrame([(1, "then Tom saw Tom and Tom saw the dog at night"), (2, "12 7 9 33 5 8 apples 4"), (3, "here " + " ".join(map(word, range(120))))], "item_id long, text string")
    rows = [(1, "then Ann saw Ann and Ann saw the dog at night"), (2, "then Ann saw Bob and Cleo saw the dog at night"), (3, "x 12 7 9 33 5 8 apples 4 y"), (4, "x 12 7 9 33 5 8 apples 5 y"), (5, " ".join(map(word, range(50, 90)))), (6, " ".join(map(word, range(50, 70))))]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): "re-parameterised", (3, 2): "verbatim", (5, 3): "verbatim"}


def stated_leaks(docs, bench):
    """Leaks of simple texts (plain words, capitalised names, numbers, units after numbers, no sentence ends), window by window."""
    size = decontaminate.WINDOW

    def template(text):
        out, w = [], text.split()
        for k, x in enumerate(w):
            if x.isdigit():
                out.append(("number", x))
            elif x in decontaminate.UNITS and k and w[k - 1].isdigit():
                out.append(("unit", x))
            elif x[0].isupper() and k:
                out.append(("name", x))
            else:
                out.append((x.lower(), None))
        return out

    def key(window):
        poor = sum(v is None for _, v in window) < decontaminate.LEAST_LITERAL
        return tuple((k if v is None else v.lower()) if poor else k for k, v in window), poor

    found = {}
    for i, item in bench:
        t = template(item)
        keys = [key(t[p : p + size]) for p in range(len(t) - size + 1)]
        for d, doc in docs:
            u = template(doc)
            lines = collections.defaultdict(list)
            for q in range(len(u) - size + 1):
                for p, k in enumerate(keys):
                    if k == key(u[q : q + size]):
                        lines[q - p].append(p)
            kept, own, longest = set(), True, 0
            for off, places in lines.items():
                filled = collections.defaultdict(dict)
                covered = sorted({p + j for p in places for j in range(size) if not keys[p][1]})
                for j in covered:
                    if t[j][0] == "name":
                        filled[t[j][1]][j] = u[j + off][1]
                astray = set()
                for values in filled.values():
                    most = max(sorted(set(values.values())), key=list(values.values()).count)
                    astray |= {j for j, v in values.items() if v != most}
                same = lambda p, off=off: keys[p][1] or all(t[j][1] == u[j + off][1] for j in range(p, p + size))
                stay = [p for p in places if keys[p][1] or not astray & set(range(p, p + size))]
                kept |= set(stay)
                own &= all(same(p) for p in stay)
                longest = max(longest, sum(same(p) for p in places))
            enough = len(kept) >= decontaminate.COVERAGE * len(keys) and bool(lines)
            if enough or longest >= decontaminate.VERBATIM_WINDOWS:
                found[d, i] = (len(kept), len(keys), "verbatim" if own or not enough else "re-parameterised")
    return found


def test_leaks_match_statement(spark):
    rng = random.Random(6)
    plain, names, units = [f"word{chr(97 + k)}" for k in range(26)], ["Tom", "Ann", "Sue"], ["km", "dollars"]
    word = lambda: rng.choices([rng.choice(plain), rng.choice(names), f"{rng.randint(1, 3)}", f"{rng.randint(1, 3)} {rng.choice(units)}"], [6, 2, 1, 1])[0]
    bench = [(k, " ".join(word() for _ in range(rng.randint(10, 60)))) for k in range(25)]
    docs = []
    for d in range(150):
        parts = [word() for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(1, 2)):
            words = rng.choice(bench)[1].split()
            words = [rng.choice(names) if x in names and rng.random() < 0.3 else str(rng.randint(1, 9)) if x.isdigit() and rng.random() < 0.3 else x for x in words]
            a = rng.randint(0, len(words) // 2)
            parts += words[a : a + rng.randint(8, len(words))]
        docs.append((d, " ".join(["x", *parts])))
    want = stated_leaks(docs, bench)
    table = lambda rows, n: spark.createDataFrame(rows, f"{n} long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.kind) for r in decontaminate.leaks(table(docs, "doc_id"), table(bench, "item_id")).collect()}
    assert got == want and {v[2] for v in want.values()} == {"verbatim", "re-parameterised"} and len(want) > 30


def test_nnpu_risk_and_gradient():
    """The risk is the stated sum over texts; the direction is its gradient, reversed for the corrected part where that is negative."""
    rng = np.random.default_rng(2)
    x = rng.random((40, 6)) < 0.4
    positive = np.arange(40) < 15
    doc, feature = np.nonzero(x)
    loss = lambda z: math.log(1 + math.exp(-z))

    def risks(theta, prior):
        z = [theta[-1] + sum(theta[j] for j in range(6) if x[i, j]) for i in range(40)]
        mean = lambda rows, sign: sum(loss(sign * z[i]) for i in rows) / len(rows)
        pos, unl = range(15), range(15, 40)
        return prior * mean(pos, 1), mean(unl, -1) - prior * mean(pos, -1)

    signs = set()
    for seed, prior in ((1, 0.1), (2, 0.9), (3, 0.6)):
        theta = np.random.default_rng(seed).normal(0, 1.5, 7) - (3 if prior == 0.9 else 0)
        called, corrected, direction = toxicity.nnpu_step(theta, doc, feature, positive, prior, 0.01)
        assert np.allclose((called, corrected), risks(theta, prior))
        signs.add(corrected >= 0)
        target = lambda t, p=prior, c=corrected: (sum(risks(t, p)) if c >= 0 else -risks(t, p)[1]) + 0.005 * p * (t[:-1] ** 2).sum()
        step = 1e-6 * np.eye(7)
        assert np.allclose(direction, [(target(theta + e) - target(theta - e)) / 2e-6 for e in step], atol=1e-6)
    assert signs == {True, False}


def test_field_gradient_and_score():
    rng = np.random.default_rng(4)
    texts = ["Short line.\nAnother LINE here 12\n!!! ???", "one two three\n\nfour", "alone"]
    doc, length, measures = quality.line_measures(texts)
    field = quality.Field(np.quantile(measures, np.arange(1, quality.BINS) / quality.BINS, axis=0).T, rng.normal(size=3 * quality.MEASURES * (quality.BINS + 1)), rng.normal(size=(2, 2)), 0.4)
    features, label = field.bins(doc, measures), np.array([1, 0, 1, 0, 0, 1, 1])
    weight = np.array([0.2] * 3 + [0.5] * 3 + [1.0])

    def paths(first, n):
        e = field.emission[features].sum(1)
        for k in range(2**n):
            p = [(k >> j) & 1 for j in range(n)]
            yield p, sum(e[first + j] * p[j] for j in range(n)) + sum(field.transition[p[j - 1], p[j]] for j in range(1, n))

    def stated():
        out = 0
        for first, n in ((0, 3), (3, 3), (6, 1)):
            every = list(paths(first, n))
            own = next(v for p, v in every if p == label[first : first + n].tolist())
            out += weight[first] * (own - math.log(sum(math.exp(v) for _, v in every)))
        return out

    value, gradient = quality.likelihood(field, doc, features, label, weight)
    assert np.isclose(value, stated())
    flat = [(field.emission, k) for k in np.unique(features)[:40]] + [(field.transition.reshape(-1), k) for k in range(4)]
    for array, k in flat:
        held = array[k]
        ends = []
        for step in (1e-6, -1e-6):
            array[k] = held + step
            ends.append(stated())
        array[k] = held
        at = k if array is field.emission else len(field.emission) + k
        assert np.isclose((ends[0] - ends[1]) / 2e-6, gradient[at], atol=1e-6)
    # The score: marginals for good, weighted by line length, then the map that puts the cut at 0.7.
    for t, (first, n) in enumerate(((0, 3), (3, 3), (6, 1))):
        every = [(p, math.exp(v)) for p, v in paths(first, n)]
        total = sum(v for _, v in every)
        good = [sum(v for p, v in every if p[j]) / total for j in range(n)]
        mean = sum(length[first + j] * good[j] for j in range(n)) / length[first : first + n].sum()
        want = mean / 0.4 * 0.7 if mean < 0.4 else 0.7 + (mean - 0.4) / 0.6 * 0.3
        assert np.isclose(field.score(texts)[t], want)


def labelled(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = labelled(spark)
    rows = module.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_edges(spark, docs, empty, module):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (6, 0, 1), (7, 1, 0), (8, 1, 1), (9, 0, 0), (13, 1, None)], "doc_id long, quality int, toxic int")
    assert module.scored(docs, labels).count() == len(TEXTS)
    assert module.scored(docs, labels.filter("false")).count() == len(TEXTS)
    assert module.scored(empty, labels).collect() == []


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    doc, emit, move = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    got, pairs, _ = quality.chain_marginals(doc, emit, move)
    for first, n in ((0, 3), (3, 1), (4, 2)):
        paths = [[(s >> k) & 1 for k in range(n)] for s in range(2**n)]
        weight = np.exp([sum(emit[first + k, p[k]] for k in range(n)) + sum(move[p[k - 1], p[k]] for k in range(1, n)) for p in paths])
        weight /= weight.sum()
        assert np.allclose(got[first : first + n], [sum(w for w, p in zip(weight, paths) if p[k]) for k in range(n)])
        if n > 1:
            assert np.isclose(pairs[first + 1][1, 0], sum(w for w, p in zip(weight, paths) if (p[0], p[1]) == (1, 0)))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    documents, labels = labelled(spark)
    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == documents.columns, name
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len(left & toxic) < 0.1 * len(toxic) and len(left) > 600
    assert pipeline.run(spark, sf).count() == len(left)


CLASHES = ["quality_score", "toxicity_score", "kept_id", "kept_node", "leaked_key", "key", "node", "score", "text_key", "digest", "bucket", "Kept_ID_"]


def test_stages_on_odd_tables(spark, empty):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, extra columns with clashing names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    good = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(60).collect())]
    long = " ".join(good[3][1] + f" part {k}" for k in range(300))
    rows = [*good, *TEXTS, good[0], (None, good[5][1]), (good[7][0], good[8][1]), (900, long), (901, long), (None, long + " more")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    table = spark.createDataFrame([(i, t, None, None, None, *("c" for _ in CLASHES)) for i, t in rows], schema)
    for name, stage in pipeline.STAGES:
        got = [r.asDict() for r in stage(spark, table, sf).collect()]
        assert stage(spark, table.filter("false"), sf).collect() == [], name
        if name == "bpe":
            assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
            continue
        assert stage(spark, table, sf).columns == table.columns, name
        kept = collections.Counter((r["doc_id"], r["text"]) for r in got)
        judged = collections.Counter(rows)
        if name == "near_dedup":
            # Repeated rows leave one; every class of all pairs leaves its least id.
            want = weighted_classes([t for _, t in rows])
            of = collections.defaultdict(list)
            for (i, _), r in zip(rows, want):
                of[r].append(i)
            least = collections.Counter(min((i for i in v if i is not None), default=None) for v in of.values())
            assert collections.Counter(i for i, _ in kept.elements()) == least
        else:
            # Equal rows fare alike.
            assert all(kept[x] in (0, n) for x, n in judged.items()) and not kept - judged
            if name == "quality":
                assert not any((t or "").strip() == "" for _, t in kept)
            assert len(kept) > 10, name


def test_written_folders_go(spark, tmp_path):
    with common.scratch(spark) as made:
        one = common.written(spark.range(3), "gone")
        two = common.written(one, "kept")
        made.keep_last()
    assert two.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        one.count()
