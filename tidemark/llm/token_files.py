"""Token-id files with Re-Pair grammar compression and random access.

Documents stand in ascending id order (null ids first, equal ids by the text's hash, then the text). Each file is a
shard: within it the most frequent adjacent symbol pairs are replaced by nonterminals, PAIRS_A_ROUND of them a round,
never across the end of a document, until no pair occurs LEAST_USES times. The file stores the rules, the expansion
length of each, an index of documents, and the symbols, so that one document is read by its ranges alone.

Layout, little-endian: magic; u32 version, terminals, rules, documents, bytes a symbol (2, or 4 where the grammar needs
them), zero; u64 symbols, ids; rules u32 x 2; expansion lengths u32; document ids i64, null flags u8, id counts u64,
first symbols u64 (one more than documents); symbols.

A null text counts as empty; every document, empty ones too, ends with the end id. Repeated rows stay.
An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, files
from tidemark.llm.encoder import encoder, vocabulary_path

MAGIC, VERSION = b"TMREPAIR", 2
TERMINALS = 49408
END_ID = 1
SHARD_IDS = 1 << 21
PAIRS_A_ROUND, LEAST_USES, BINS = 4000, 12, 1 << 20


def compress(ids: np.ndarray, lengths: np.ndarray, terminals: int = TERMINALS, pairs: int = PAIRS_A_ROUND, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, symbols of each document). Rules number terminals, terminals + 1, ... and name two earlier symbols."""
    seq = ids.astype(np.uint32)
    ends = np.zeros(len(seq), bool)
    ends[np.cumsum(lengths) - 1] = True
    rules = np.zeros((0, 2), np.uint32)
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        # Count hashed pairs first; only pairs of well filled bins are then counted exactly. Pairs across documents have a bin of their own.
        bin_of = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(12)
        bin_of[ends[:-1]] = BINS
        filled = np.bincount(bin_of, minlength=BINS + 1)[:BINS]
        floor = max(least, int(np.partition(filled, -pairs)[-pairs]))
        at = np.flatnonzero(np.append(filled >= floor, False)[bin_of])
        if not len(at):
            break
        mine = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
        key, uses = np.unique(mine, return_counts=True)
        best = np.lexsort((key, -uses))[:pairs]
        key = np.sort(key[best[uses[best] >= least]])
        if not len(key):
            if floor == least:
                break
            # Every well filled bin held rare pairs only: all pairs are counted.
            at = np.flatnonzero(~ends[:-1])
            mine = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
            key, uses = np.unique(mine, return_counts=True)
            best = np.lexsort((key, -uses))[:pairs]
            key = np.sort(key[best[uses[best] >= least]])
            if not len(key):
                break
        rank = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        hit = key[rank] == mine
        at, rank = at[hit], rank[hit]
        # Of pairs that overlap in a chain, every second one is replaced, from the left.
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - head) % 2 == 0
        at, rank = at[keep], rank[keep]
        seq[at] = terminals + len(rules) + rank
        ends[at] = ends[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, ends = seq[stay], ends[stay]
        rules = np.concatenate([rules, np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)])
    return seq, rules, np.diff(np.concatenate([[0], np.flatnonzero(ends) + 1]))


def expansion_lengths(rules: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    size = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[terminals + k] = size[a] + size[b]
    return size[terminals:]


def pack(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, terminals: int = TERMINALS, least: int = LEAST_USES) -> bytes:
    symbols, rules, spans = compress(ids, lengths, terminals, least=least)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    head = np.array([VERSION, terminals, len(rules), len(lengths), width, 0], "<u4").tobytes() + np.array([len(symbols), len(ids)], "<u8").tobytes()
    index = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), lengths.astype("<u8"), np.concatenate([[0], np.cumsum(spans)]).astype("<u8")]
    return b"".join([MAGIC, head, rules.astype("<u4").tobytes(), expansion_lengths(rules, terminals).astype("<u4").tobytes(), *(x.tobytes() for x in index), symbols.astype(f"<u{width}").tobytes()])


HEAD = 48


class Layout:
    """Where the parts of a file stand, from its first HEAD bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        version, self.terminals, n_rules, self.n_docs, width, _ = np.frombuffer(raw, "<u4", 6, 8).tolist()
        if version != VERSION:
            raise ValueError(f"token file version {version}")
        n_symbols, self.n_ids = np.frombuffer(raw, "<u8", 2, 32).tolist()
        kinds = {"rules": ("<u4", 2 * n_rules), "sizes": ("<u4", n_rules), "doc_ids": ("<i8", self.n_docs), "null": ("u1", self.n_docs), "lengths": ("<u8", self.n_docs), "first": ("<u8", self.n_docs + 1), "symbols": (f"<u{width}", n_symbols)}
        self.parts, at = {}, HEAD
        for name, (kind, n) in kinds.items():
            self.parts[name] = (kind, n, at)
            at += n * np.dtype(kind).itemsize

    def grammar(self, rules: np.ndarray, sizes: np.ndarray) -> None:
        """Expand every rule once: ``flat`` holds the ids of symbol s from starts[s] on."""
        rules = rules.reshape(-1, 2)
        self.rules, self.sizes = rules, np.concatenate([np.ones(self.terminals, np.int64), sizes])
        held = self.sizes[self.terminals :]
        starts = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(held) - held])
        self.starts, self.flat = starts, np.arange(self.terminals + int(held.sum()), dtype=np.uint32)
        for k, (a, b) in enumerate(rules.tolist(), self.terminals):
            s, m = starts[k], self.sizes[a]
            self.flat[s : s + m] = self.flat[starts[a] : starts[a] + m]
            self.flat[s + m : s + self.sizes[k]] = self.flat[starts[b] : starts[b] + self.sizes[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes[symbols]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.starts[symbols] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


class Shard(Layout):
    """A whole file's contents, to decode all documents."""

    def __init__(self, raw: bytes):
        super().__init__(raw)
        part = {name: np.frombuffer(raw, kind, n, at) for name, (kind, n, at) in self.parts.items()}
        self.grammar(part["rules"], part["sizes"])
        self.doc_ids = [None if z else i for i, z in zip(part["doc_ids"].tolist(), part["null"].tolist(), strict=True)]
        self.lengths, self.first, self.symbols = part["lengths"].astype(np.int64), part["first"].astype(np.int64), part["symbols"]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])


class RandomAccess(Layout):
    """A file of which only the grammar is held: a document costs a read of its place and one of its symbols."""

    def __init__(self, uri: str):
        super().__init__(files.read_range(uri, 0, HEAD))
        self.uri = uri
        self.grammar(self._read("rules"), self._read("sizes"))

    def _read(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        kind, whole, at = self.parts[name]
        n = whole if n is None else n
        size = np.dtype(kind).itemsize
        return np.frombuffer(files.read_range(self.uri, at + first * size, n * size), kind) if n else np.zeros(0, kind)

    def document(self, k: int) -> np.ndarray:
        first, stop = self._read("first", k, 2).tolist()
        return self.expand(self._read("symbols", first, stop - first))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write shards in ascending document order; returns (part, shard, file, n_docs, n_ids, n_bytes) of each.

    Ids uncompressed take two bytes each, so n_bytes / (2 n_ids) is the ratio.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, e = TaskContext.get().partitionId(), 0, [], encoder(vocabulary)

        def flush() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{shard:05d}.tmr"
            ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            out = files.Output(name)
            out.write(pack([d for x in held for d in x[0]], ids, lengths))
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(lengths)], "n_ids": [len(ids)], "n_bytes": [out.size]})

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                flat, at = e.encode(rows.column(1).to_pylist())
                held.append((rows.column(0).to_pylist(), np.insert(flat, at[1:], end_id), np.diff(at) + 1))
                if sum(len(x[1]) for x in held) >= shard_ids:
                    yield flush()
                    shard, held = shard + 1, []
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The text's hash splits rows of equal or null id among ranges.
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(write, "part int, shard int, file string, n_docs long, n_ids long, n_bytes long")


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    Starts come from running sums over the parts, one small row each, over the shards of a part, and inside a shard.
    """
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    placed = shards.select("part", "file", before(Window.partitionBy("part").orderBy("shard")).alias("inside")).join(parts, "part")
    total = shards.agg(F.sum("n_bytes")).head()[0] or 0
    placed = placed.select("file", (F.col("part_start") + F.col("inside")).alias("before")).repartition(common.tasks_for(shards.sparkSession, total), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(files.read_all(row["file"]))
                crc = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(len(s.doc_ids))]
                start = row["before"] + np.cumsum(s.lengths) - s.lengths
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids, pa.int64()), "start": start, "n_tokens": s.lengths, "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    folder = common.shared_dir(docs.sparkSession, "token-files")
    return read_token_files(common.written(write_token_files(docs, folder, vocabulary or vocabulary_path()), "token-shards"))
