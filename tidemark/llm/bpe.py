"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks at the same places wherever the same content stands. Of
chunks that occur more than once, the first occurrence is encoded once, and the other documents take the ids
from there. Chunks are cut anywhere, inside words too, so ids near a cut may be wrong. Each join is repaired:
the last words of the chunk before it, what stands between, and the first words of the chunk after it are
encoded as one text, and again with twice as many words on both sides, until the new ids agree with those of the
chunks on a whole word at either end. A chunk that is used up without agreement is given up and encoded in place.

Only chunk digests are counted over all documents; texts move once, zstd-compressed one by one, to their documents'
plans, and only documents that take ids from others move again.

A null text counts as empty (no ids, empty decoded text). Repeated rows and equal or null ids each give their
own row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, lexer
from tidemark.llm.encoder import Encoder, encoder, vocabulary_path

WINDOW, MASK_BITS, LEAST, MOST = 48, 10, 512, 8192  # bytes
CONTEXT, LEAST_WORDS = 2, 8  # words on each side of a join to begin with; words of a chunk that can be shared
_SCHEMA = "kind string, doc_id long, text_key long, packed binary, whole string, digest binary, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string, plan array<struct<start:int,stop:int,digest:binary>>"


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks: where the hash of the last WINDOW bytes has MASK_BITS zero bits, LEAST to MOST bytes apart."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    data, block = np.frombuffer(raw, np.uint8), 1 << 20
    found = [a + WINDOW + np.flatnonzero((lexer.rolling_hash(data[a : a + block + WINDOW - 1], WINDOW) >> np.uint64(64 - MASK_BITS)) == 0) for a in range(0, n - WINDOW + 1, block)]
    marks = np.concatenate(found)
    marks = marks[(marks >= n) | ((data[np.minimum(marks, n - 1)] & 0xC0) != 0x80)]  # never inside a character
    ends, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, 128-bit digest) of each chunk with LEAST_WORDS words, for a join needs words on both sides."""
    at = 0
    for end in chunk_ends(raw):
        if raw.count(b" ", at, end) + raw.count(b"\n", at, end) >= LEAST_WORDS:
            yield at, end, hashlib.blake2b(raw[at:end], digest_size=16).digest()
        at = end


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def unpack(packed: bytes) -> bytes:
    return zstandard.decompress(packed)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, packed): each text compressed by itself, for the shuffles' own compression sees only short blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            packed = pa.array((press.compress(_raw(t.as_py())) for t in batch.column(2)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "text_key", "packed"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(pack, "doc_id long, text_key long, packed binary")


def chunk_refs(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, text_key, seq, start, stop) of every chunk of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows, out = batch.slice(a, 512), []
                for doc, key, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    out += [(digest, doc, key, seq, start, stop) for seq, (start, stop, digest) in enumerate(chunks(_raw(text)))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["digest", "doc_id", "text_key", "seq", "start", "stop"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(find, "digest binary, doc_id long, text_key long, seq int, start int, stop int")


def _digests(e: Encoder, ids: list[int]) -> tuple[int, str, str]:
    names, digits = e.names, e.digits
    return len(ids), hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest()


def _before(raw: bytes, low: int, stop: int, words: int) -> int:
    """Where the last ``words`` words of raw[low:stop] begin, with the white space in front; low if there are fewer."""
    at = stop
    for _ in range(words):
        at = max(raw.rfind(b" ", low, at), raw.rfind(b"\n", low, at))
        if at < 0:
            return low
    return at


def _after(raw: bytes, start: int, high: int, words: int) -> int:
    """Where the first ``words`` words of raw[start:high] end; high if there are fewer."""
    at = start
    for _ in range(words):
        found = [k for k in (raw.find(b" ", at + 1, high), raw.find(b"\n", at + 1, high)) if k >= 0]
        if not found:
            return high
        at = min(found)
    return at


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
Taken = list[tuple[int, int, np.ndarray]]


def assemble(encode: Encode, texts: list[tuple[bytes, Taken]], context: int = CONTEXT) -> list[np.ndarray]:
    """Ids of each text, of which chunks [start, stop), in order of place, have known ids: see the module on joins.

    encode gives the ids of many texts at once and their bounds. Join k of a text lies between its chunks k - 1 and k.
    """
    texts = [(raw, list(taken)) for raw, taken in texts]
    done: list[dict[int, tuple[int, np.ndarray, int]]] = [{} for _ in texts]
    width = [[context] * (len(taken) + 1) for _, taken in texts]

    def span(t: int, k: int) -> tuple[int, int]:
        raw, taken = texts[t]
        low = _before(raw, taken[k - 1][0], taken[k - 1][1], width[t][k]) if k else 0
        return low, _after(raw, taken[k][0], taken[k][1], width[t][k]) if k < len(taken) else len(raw)

    todo = [(t, k) for t, (_, taken) in enumerate(texts) for k in range(len(taken) + 1)]
    while todo:
        parts: list[str] = []
        for t, k in todo:
            raw, taken = texts[t]
            low, high = span(t, k)
            left, right = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(raw)
            first, last = _after(raw, low, left, 1), _before(raw, right, high, 1)
            parts += [raw[a:b].decode("utf-8", "surrogatepass") for a, b in ((low, high), (low, left), (right, high), (low, first), (last, high))]
        flat, at = encode(parts)
        of = lambda k: flat[at[k] : at[k + 1]]
        again = set()
        for n, (t, k) in enumerate(todo):
            taken = texts[t][1]
            whole, x, y, f, g = (of(5 * n + m) for m in range(5))
            agree_left = not k or (len(f) <= len(whole) and _ends(taken[k - 1][2], x) and _starts(x, f) and _starts(whole, f))
            agree_right = k == len(taken) or (_starts(taken[k][2], y) and _ends(y, g) and _ends(whole, g))
            if agree_left and agree_right:
                done[t][k] = (len(x), whole, len(y))
            else:
                width[t][k] *= 2
                again.add((t, k))
        for t in {t for t, _ in todo}:
            taken = texts[t][1]
            spent = [k for k in range(len(taken)) if span(t, k)[1] > span(t, k + 1)[0]]
            if spent:
                texts[t] = (texts[t][0], [c for k, c in enumerate(taken) if k not in spent])
                done[t], width[t] = {}, [context] * (len(taken) - len(spent) + 1)
                again = {x for x in again if x[0] != t} | {(t, k) for k in range(len(taken) - len(spent) + 1)}
        todo = sorted(again)
    out = []
    for (_, taken), joins in zip(texts, done, strict=True):
        pieces = [joins[0][1]]
        for k, (_, _, ids) in enumerate(taken):
            pieces += [ids[joins[k][2] : len(ids) - joins[k + 1][0]], joins[k + 1][1]]
        out.append(np.concatenate(pieces))
    return out


def _starts(ids: np.ndarray, part: np.ndarray) -> bool:
    return len(part) <= len(ids) and bool((ids[: len(part)] == part).all())


def _ends(ids: np.ndarray, part: np.ndarray) -> bool:
    return len(part) <= len(ids) and bool((ids[len(ids) - len(part) :] == part).all())


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    vocabulary = vocabulary or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))
    refs = common.written(chunk_refs(docs), "chunk-refs")
    shared = refs.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "seq")).alias("owner")).filter("n > 1").drop("n")
    used = refs.join(shared, "digest").withColumn("own", F.struct("doc_id", "text_key", "seq").eqNullSafe(F.col("owner")))
    # The key of the text spreads rows with a null id.
    plans = used.groupBy("text_key", "doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "digest", "own"))).alias("plan"))
    known = packed_texts(docs).alias("d").join(plans.alias("p"), (F.col("d.text_key") == F.col("p.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), "left")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                yield from encode_part(e, batch.slice(a, 256).to_pylist())

    def encode_part(e: Encoder, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        raws = [unpack(r["packed"]) for r in rows]
        own = [(raw, [p for p in r["plan"] or [] if p["own"]]) for raw, r in zip(raws, rows, strict=True)]
        bodies = [(p["digest"], raw[p["start"] : p["stop"]]) for raw, plan in own for p in plan]
        whole = [(r, raw) for raw, r in zip(raws, rows, strict=True) if all(p["own"] for p in r["plan"] or [])]
        flat, at = e.encode([b.decode("utf-8", "surrogatepass") for b in [b for _, b in bodies] + [raw for _, raw in whole]])
        out = [{"kind": "chunk", "digest": d, "ids": flat[at[k] : at[k + 1]].astype("<u2").tobytes()} for k, (d, _) in enumerate(bodies)]
        for k, (r, _) in enumerate(whole, len(bodies)):
            n, ids, decoded = _digests(e, flat[at[k] : at[k + 1]].tolist())
            out.append({"kind": "done", "doc_id": r["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})
        for raw, r in zip(raws, rows, strict=True):
            if plan := [{x: p[x] for x in ("start", "stop", "digest")} for p in r["plan"] or [] if not p["own"]]:
                out.append({"kind": "open", "doc_id": r["doc_id"], "text_key": r["text_key"], "packed": r["packed"], "whole": hashlib.sha256(raw).hexdigest(), "plan": plan})
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("packed", pa.binary()), ("whole", pa.string()), ("digest", pa.binary()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("plan", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary())])))])
    parts = common.written(known.select("d.doc_id", "d.text_key", "d.packed", "p.plan").mapInArrow(first, _SCHEMA), "encoded-once")
    done = parts.filter("kind = 'done'").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    # Equal open rows share one assembly, so that copies of a text carry its chunks' ids once.
    waiting = parts.filter("kind = 'open'")
    keys = waiting.select("doc_id", "whole")
    texts = waiting.select("whole", "packed", "plan").dropDuplicates(["whole"])
    wanted = texts.select("whole", F.explode("plan").alias("p")).select("whole", "p.digest").distinct()
    ids = wanted.join(parts.filter("kind = 'chunk'").select("digest", "ids").dropDuplicates(["digest"]), "digest")
    given = ids.groupBy("whole").agg(F.collect_list(F.struct("digest", "ids")).alias("given"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in common.slices(batches, 256):
            rows, texts = batch.to_pylist(), []
            for r in rows:
                ids_of = {g["digest"]: np.frombuffer(g["ids"], "<u2") for g in r["given"] or []}
                texts.append((unpack(r["packed"]), [(p["start"], p["stop"], ids_of[p["digest"]]) for p in r["plan"] if p["digest"] in ids_of]))
            out = []
            for r, ids in zip(rows, assemble(e.encode, texts), strict=True):
                n, ids_hash, decoded = _digests(e, ids.tolist())
                out.append({"whole": r["whole"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": decoded})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("whole", pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    assembled = texts.join(given, "whole", "left").select("whole", "packed", "plan", "given").mapInArrow(last, "whole string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.unionByName(keys.join(assembled, "whole").drop("whole"))
