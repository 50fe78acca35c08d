"""Source divergence, centroid clustering and nearest neighbours against plain statements of their results."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, divergence, neighbours, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- source divergence


def stated_divergence(rows, least, top):
    """All shares of all kept terms by group, compared one by one."""
    docs = collections.defaultdict(collections.Counter)
    counts, langs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
    out = []
    for lang, source in counts:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = share(counts[lang, source]), share(langs[lang])
        far = [(s, sum(abs(p[t] - o[t]) for t in kept)) for (other, s), c in counts.items() if other == lang and s != source for o in [share(c)]]
        near = [(t, p[t] - q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", far, None), ("term", near, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audited(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, 1, "clash", 0.5) for r in rows], "text string, lang string, source string, term long, item string, p double")
    return sorted(tuple(r) for r in divergence.audited(docs, **settings).collect())


def some_documents(seed, n=160, sources=7):
    rnd = random.Random(seed)
    common, rare = [f"w{chr(97 + k)}" for k in range(12)], [f"Selten{chr(65 + k)}é" for k in range(20)]
    rows = []
    for k in range(n):
        source = f"s{rnd.randrange(sources) if rnd.random() < 0.7 else 0}"
        own = [rare[(int(source[1:]) * 3 + j) % 20] for j in range(3)]
        words = [rnd.choice(common) for _ in range(rnd.randrange(40))] + [rnd.choice(own) for _ in range(rnd.randrange(4))]
        rows.append((" 7, ".join(words) + "!", rnd.choice(["en", "en", "de"]), source))
    return rows


@pytest.mark.parametrize("light", [0, 2, 3, 100])
def test_divergence_is_the_stated_one_wherever_terms_are_split(spark, light):
    rows = some_documents(1) + [("", "en", "empty"), (None, None, None), ("Straße STRASSE Æ 日本 ﬁ", None, ""), ("only here", "xx", "alone"), ("wa wa", "en", "s0"), ("wa wa", "en", "s0")]
    assert audited(spark, rows, least=5, light=light) == stated_divergence(rows, 5, 50)


def test_divergence_of_many_sources_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "TILE_TERMS", 4)
    rows = some_documents(2, n=300, sources=11)
    assert audited(spark, rows, least=3, light=2) == stated_divergence(rows, 3, 50)


def test_divergence_joined_without_a_broadcast_and_given_up_often(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = some_documents(3)
    assert audited(spark, rows, least=4, light=2, top=2) == stated_divergence(rows, 4, 2)


def test_divergence_without_kept_terms_documents_or_words(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("a b", "en", "x"), ("c", "en", "y"), (None, "de", None)]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    tie = [("same words here", "en", s) for s in ("b", "ä", "a")]
    assert audited(spark, tie, least=1) == stated_divergence(tie, 1, 50)


def test_very_long_texts_are_cut_between_terms_only():
    text = ("lorem " * 50_000 + "x" * 3_000_000 + " ipsum é").encode()
    pieces = list(divergence.term_pieces(text, piece=1000))
    assert collections.Counter(t for p in pieces for t in p) == collections.Counter(text.split())
    assert len(pieces) > 100


def test_shares_do_not_overflow(spark):
    row = spark.range(1).select((F.col("id") + 4_000_000_000_000_000).alias("n"), (F.col("id") + 9_000_000_000_000_000).alias("t"), (F.col("id") + 3).alias("v"))
    assert row.select(divergence.share("n", "t", "v")).head()[0] == 1 + 10**9 * (4_000_000_000_000_000 + 5) // (9_000_000_000_000_000 + 15)


# --- centroid clustering


def stated_clusters(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(cs)) for _, v in kept]
    for _ in range(rounds):
        at = [n for _, n in assign()]
        for n in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            cs[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else cs[n]
    last = assign()
    inertia = collections.Counter()
    for d, n in last:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=repr)


def clustered(spark, rows):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")
    return sorted((tuple(r) for r in centroids.clustered(table).collect()), key=repr)


def some_vectors(seed, n, spread=1.0):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(5, 64))
    return [(i, (centre[rnd.integers(5)] + spread * rnd.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_are_the_stated_ones(spark):
    rows = some_vectors(1, 150) + some_vectors(1, 20)
    odd = [(900, None), (901, [1.0] * 63), (902, [float("nan")] + [0.0] * 63), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (None, [0.25] * 64), (905, [])]
    assert clustered(spark, rows + odd) == stated_clusters(rows + odd)


def test_clusters_with_ties_empty_centroids_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(30)] + [(99, [-0.75] * 64)]
    assert clustered(spark, same) == stated_clusters(same)
    few = [(i, [float(i)] * 64) for i in range(3)] + [(None, [7.0] * 64)]
    assert clustered(spark, few) == stated_clusters(few)
    assert clustered(spark, []) == []


def test_components_too_large_for_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        clustered(spark, [(1, [1e30] + [0.0] * 63)])


def test_partial_distances_find_the_nearest_with_less_work():
    rnd = np.random.default_rng(4)
    cs = rnd.integers(-900, 900, (8, 64))
    x = cs[rnd.integers(0, 8, 3000)] + rnd.integers(-60, 60, (3000, 64))
    x[:200] = cs[3] + 5
    whole = ((x[:, None] - cs[None]) ** 2).sum(2)
    at, d, terms = centroids.nearest(x, cs)
    assert (at == whole.argmin(1)).all() and (d == whole.min(1)).all()
    assert terms < 0.5 * whole.size * 64  # abandoned early
    ties = np.zeros((40, 64), np.int64)
    at, d, _ = centroids.nearest(ties, np.array([[3] * 64, [-1] * 64, [1] * 64]))
    assert (at == 1).all() and (d == 64).all()


# --- nearest neighbours


def stated_neighbours(rows, every, k=5):
    """All candidates of each query by cosine."""
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, i, v in good:
        if i is not None and i % every == 0:
            near = [(-float((v / np.abs(v).max() * (w / np.abs(w).max())).sum() / math.sqrt(((v / np.abs(v).max()) ** 2).sum() * ((w / np.abs(w).max()) ** 2).sum())), math.inf if j is None else j) for m, j, w in good if m != n and len(w) == len(v)]
            out.setdefault(i, []).append(sorted((round(s, 12), j) for s, j in near)[:k])
    return out


def found_neighbours(spark, rows, every=50, kind="float"):
    table = spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, score double")
    out = collections.defaultdict(dict)
    for q, rank, j, s in sorted(neighbours.nearest(table, every).collect(), key=repr):
        out[q].setdefault(rank, []).append((-round(s, 12), math.inf if j is None else j))
    return {q: sorted([x[n] for r, x in sorted(ranks.items())] for n in range(len(ranks[1]))) for q, ranks in out.items()}


def test_neighbours_of_clear_groups_are_the_stated_ones(spark):
    rows = some_vectors(7, 120, 0.05)
    assert found_neighbours(spark, rows, 10) == stated_neighbours(rows, 10)


def test_neighbours_of_odd_rows(spark):
    base = some_vectors(8, 40, 0.05)
    rows = base + [(200 + i, base[10][1]) for i in range(9)] + [(0, base[0][1]), (50, base[3][1]), (None, base[10][1]), (-50, [2 * x for x in base[5][1]])]
    rows += [(300, None), (350, []), (400, [0.0] * 64), (450, [float("nan")] * 64), (500, [None] + [1.0] * 63), (550, [float("inf")] * 64), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (650, [3.0])]
    got, want = found_neighbours(spark, rows), stated_neighbours(rows, 50)
    assert want.pop(650) == [[]]  # no vector of one component besides
    assert got == {q: sorted(x) for q, x in want.items()}


def test_neighbours_of_huge_and_tiny_doubles(spark):
    rows = [(i, [s * x for x in v]) for (i, v), s in zip(some_vectors(9, 60, 0.05), [1e200, 1.0, 1e-200] * 20, strict=True)]
    assert found_neighbours(spark, rows, 10, "double") == stated_neighbours(rows, 10)
    assert found_neighbours(spark, []) == {}


def test_neighbours_over_many_cells_chunks_and_blocks_keep_their_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 64)
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    rows = some_vectors(11, 1200, 0.8)
    got, want = found_neighbours(spark, rows, 10), stated_neighbours(rows, 10)
    assert got.keys() == want.keys() and all(len(x[0]) == 5 for x in got.values())
    assert sum(len({j for _, j in got[q][0]} & {j for _, j in want[q][0]}) for q in want) >= 0.95 * 5 * len(want)


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found_neighbours(spark, rows), stated_neighbours(rows, 50)
    assert sum(len({j for _, j in got[q][0]} & {j for _, j in want[q][0]}) for q in want) >= 0.9 * 5 * len(want)


def test_search_verifies_in_order_until_the_test_holds():
    rnd = np.random.default_rng(12)
    v = np.concatenate([rnd.normal(size=(64,)) + 0.02 * rnd.normal(size=(50, 64)), rnd.normal(size=(3000, 64))])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    proj = unit @ neighbours.directions(64)
    ratio = neighbours.stopping_ratio()
    assert abs(neighbours.chi_square(ratio) - neighbours.TRUST) < 1e-9
    query, row, score, bound, verified = neighbours.search(v, proj, np.ones(len(v), int), v[:5], proj[:5], np.full(5, -np.inf), ratio)
    assert verified < 5 * 600  # neighbours in a tight group stop the search early
    for q in range(5):
        best = np.argsort(-(unit @ unit[q]))[:6]
        assert set(best) <= set(row[query == q]) and (score[query == q] >= bound[q]).all()


@pytest.mark.parametrize("name", ["op11_heavy_light_divergence", "op12_partial_distance_clusters"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.itertuples(index=False, name=None), key=repr)
