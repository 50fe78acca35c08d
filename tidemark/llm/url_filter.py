"""URL allow and block rules in a sorted digest array.

Rules (verdict, host, path) are kept as a sorted array of 64-bit xxhash keys of host + path, beside the full
strings. Sorting is Spark's: rules are dealt out in key ranges and each task writes its range, so that the array is a
row of parts. Workers memory-map the parts. For a url, Spark's own xxhash64 hashes every host suffix joined with every
path prefix of a length that some rule has; one vectorised binary search probes all of a batch, and each hit is
confirmed on the stored strings, so that a digest collision never decides. The longest confirmed rule wins.

A null url, or one without ``://``, has an empty host and path, and no rule fits it. Rules with a null field are left
out; of rules with equal host and path the alphabetically first verdict stays. Repeated rows stay; extra columns are
ignored; an empty table gives no rows; without rules every url gets the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, files

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """host: after the first ``://`` up to / ? # or the end, A-Z lower-cased. path: then up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


RULES_A_PART = 1_000_000


def key(host: Column, path: Column) -> Column:
    return F.xxhash64(F.concat(host, path))


def write_index(rules: DataFrame, folder: str, rules_a_part: int = RULES_A_PART) -> DataFrame:
    """Write the array for (verdict, host, path) rules; returns (part, least, n_rules, path_lengths) of each part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, least, lengths = f"{folder}/part-{TaskContext.get().partitionId():06d}", 0, None, set()
        parts: dict[str, files.Output] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = parts or {x: files.Output(f"{name}.{x}") for x in ("keys", "sizes", "strings")}
            keys = batch.column(0).to_numpy()
            strings = [[x.encode() for x in c.to_pylist()] for c in batch.columns[1:4]]
            parts["keys"].write(keys.astype("<i8").tobytes())
            parts["sizes"].write(np.array([[len(x) for x in c] for c in strings], "<u4").T.tobytes())
            parts["strings"].write(b"".join(x for rule in zip(*strings, strict=True) for x in rule))
            n, least = n + batch.num_rows, int(keys[0]) if least is None else least
            lengths |= set(batch.column(4).to_pylist())
        for out in parts.values():
            out.close()
        if parts:
            yield pa.RecordBatch.from_pydict({"part": [name], "least": pa.array([least], pa.int64()), "n_rules": [n], "path_lengths": pa.array([sorted(lengths)], pa.list_(pa.int32()))})

    whole = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").na.drop().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = whole.select(key(F.col("host"), F.col("path")).alias("key"), "verdict", "host", "path", F.length("path").alias("length"))
    dealt = keyed.repartitionByRange(max(1, -(-rules.count() // rules_a_part)), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(write, "part string, least long, n_rules long, path_lengths array<int>")


class Index:
    """The memory-mapped parts of an array: (part, least key) of each, in key order."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.least = np.array([least for _, least in parts], np.int64)
        self.parts = []
        for name, _ in parts:
            keys, sizes, strings = (_map(f"{name}.{x}", t) for x, t in (("keys", "<i8"), ("sizes", "<u4"), ("strings", "u1")))
            self.parts.append((keys, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), strings))

    def find(self, probes: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """(probe number, [verdict, host, path]) of every rule whose key a probe has."""
        of = np.searchsorted(self.least, probes, "right") - 1
        for k, (keys, ends, strings) in enumerate(self.parts):
            # Equal keys may go on in the next part: its least key is theirs.
            mine = np.flatnonzero((of == k) | ((of > k) & (self.least[np.minimum(k + 1, len(self.least) - 1)] == probes)))
            first, after = np.searchsorted(keys, probes[mine], "left"), np.searchsorted(keys, probes[mine], "right")
            for n in np.flatnonzero(after > first).tolist():
                for r in range(first[n], after[n]):
                    cut = ends[3 * r : 3 * r + 4].tolist()
                    yield int(mine[n]), [strings[i:j].tobytes().decode() for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _map(uri: str, kind: str) -> np.ndarray:
    system, path = files.place(uri)
    if system.type_name != "local":  # a remote store: the worker holds the part in memory
        return np.frombuffer(files.read_all(uri), kind)
    with open(path, "rb") as f:
        return np.memmap(f, kind, "r") if f.seek(0, 2) else np.zeros(0, kind)


_indexes: dict[str, Index] = {}


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of every suffix of the host (whole labels, longest first) with every path prefix of the given lengths; null where the path is shorter."""
    labels = F.split(host, "[.]")
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    of = lambda s: F.array(*(F.when(F.length(path) >= n, key(s, F.substring(path, 1, n))) for n in lengths))
    return F.coalesce(F.flatten(F.transform(suffixes, of)), F.array().cast("array<long>"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", rules_a_part: int = RULES_A_PART) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. One small row a part of the array goes to the driver."""
    folder = common.shared_dir(pages.sparkSession, "url-index")
    made = write_index(rules, folder, rules_a_part).collect()
    parts = sorted(((r.part, r.least) for r in made), key=lambda p: p[1])
    lengths = sorted({n for r in made for n in r.path_lengths})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts and folder not in _indexes:
            _indexes[folder] = Index(parts)
        for batch in batches:
            best: list[list[str] | None] = [None] * batch.num_rows
            keys = batch.column(3)
            flat = keys.flatten()
            at = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy())
            first = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
            for n, rule in _indexes[folder].find(flat.drop_null().to_numpy()) if len(at) else ():
                k = int(row[at[n]])
                suffix, length = divmod(int(at[n] - first[k]), len(lengths))
                if rule[1] == batch.column(1)[k].as_py().split(".", suffix)[-1] and rule[2] == batch.column(2)[k].as_py()[: lengths[length]]:
                    held = best[k]
                    if held is None or (len(rule[1] + rule[2]), rule[1]) > (len(held[1] + held[2]), held[1]):
                        best[k] = rule
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r and r[1] + r[2] for r in best], pa.string()), pa.array([r[0] if r else default for r in best], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    named = with_host_and_path(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))).select("page_id", "host", "path")
    keyed = named.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<long>"))
    return keyed.mapInArrow(probe, "page_id long, host string, path string, rule string, verdict string")
