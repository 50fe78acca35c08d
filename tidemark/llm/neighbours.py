"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, and a chi-square test that stops the search.

Vectors of length one are projected on M Gaussian directions, which are 2-stable: the squared projected distance of two
vectors is their squared distance times a chi-square variable of M degrees of freedom. A query looks at vectors in the
order of projected distance, a kd-tree's leaves giving them out nearest first, and verifies them on the original vectors.
It stops where the next one lies so far that a vector nearer than its worst result would have come before with
probability TRUST: where chi-square(M) of (next projected distance / worst result's distance)**2 reaches TRUST. So each
true neighbour is found with probability TRUST or more, the nearer ones with more.

The upper levels of the tree are cut at medians of at most SAMPLE vectors' projections and make at most 2**LEVELS cells;
every vector is indexed. A cell of more than CHUNK vectors is dealt by digest into chunks; the lower levels of the tree are
built inside a chunk's task. A query first searches one chunk of its own cell, which bounds its worst result, and then all
chunks of those cells whose bounding box the test does not rule out; the bound shrinks as it goes. Queries of a chunk
come in blocks of about BLOCK, each with the chunk's vectors, so that no task holds more than a chunk and a block.

Equal vectors are one node with the RESULTS + 1 smallest ids, and are searched for once, so that no group of copies is
large anywhere. A query leaves out its own row, once: repeated rows of its id are candidates like others. Each query row
has its result, repeated ones too. Vectors are compared with those of as many components only. Rows with a null id are
candidates (last among ties), never queries. Vectors that are null, empty, zero or hold null or non-finite components take
no part. With fewer candidates than RESULTS all come. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

RESULTS, EVERY = 5, 50
M, TRUST, SEED = 16, 0.97, 13
SAMPLE, LEVELS, CELL, CHUNK, LEAF, BLOCK = 65_536, 12, 4096, 16_384, 64, 4096
SLACK = 1e-9  # of squared distances, for rounding
RESULT = "query_id long, rank int, vec_id long, score double"


def chi_square(x: float, m: int = M) -> float:
    """The distribution function, for even degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(m // 2))


def stopping_ratio(trust: float = TRUST, m: int = M) -> float:
    """The squared ratio of projected to true distance at which the test holds."""
    low, high = 0.0, 1.0
    while chi_square(high, m) < trust:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < trust else (low, mid)
    return high


def directions(dimensions: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, m))


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, so that no square overflows, and their lengths."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0.0, keepdims=True))[1])
    return v, np.sqrt((v * v).sum(1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows have equal results wherever they stand."""
    (x, nx), (y, ny) = unit(x), unit(y)
    return (x * y).sum(1) / (nx * ny)


def numbers(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, key, dim, v) of the rows that take part, and the number format of v's bytes; equal vectors have equal keys."""
    inner = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if inner == "float" else "<f8"
    column = F.col("embedding") if inner == "float" else F.col("embedding").cast("array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, rows=4096):
            lists = batch.column("embedding")
            n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # null as NaN, -0.0 as 0.0
            at = np.concatenate([[0], np.cumsum(n)])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            good = np.flatnonzero((n > 0) & (sums(np.isfinite(flat)) == n) & (sums(flat != 0) > 0))
            raw = [flat[at[k] : at[k + 1]].tobytes() for k in good.tolist()]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(pa.array(good)), "key": pa.array(keys, pa.binary()), "dim": n[good].astype(np.int32), "v": pa.array(raw, pa.binary())})

    return vectors.select(F.col("vec_id").cast("long"), column.alias("embedding")).mapInArrow(pack, "vec_id long, key binary, dim int, v binary"), kind


def projected(dims: np.ndarray, v: list[bytes], kind: str) -> np.ndarray:
    out = np.zeros((len(v), M))
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        x, length = unit(numbers([v[k] for k in rows.tolist()], kind))
        out[rows] = (x / length[:, None]) @ directions(d)
    return out


def nodes_of(rows: DataFrame, kind: str) -> DataFrame:
    """(key, dim, v, proj, ids) of the distinct vectors, ids the RESULTS + 1 smallest, null last."""
    first = Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= RESULTS + 1)
    ids = F.array_sort(F.collect_list(F.struct("n", "vec_id")))
    nodes = few.groupBy("key").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), ids.alias("ids"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, rows=4096):
            proj = projected(batch.column("dim").to_numpy(), batch.column("v").to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([p.tobytes() for p in proj], pa.binary())], ["key", "dim", "v", "proj"]).append_column("ids", batch.column("ids"))

    return nodes.select("key", "dim", "v", F.col("ids.vec_id").alias("ids")).mapInArrow(project, "key binary, dim int, v binary, proj binary, ids array<long>")


class Tree:
    """The upper levels: a complete kd-tree in heap order. Level by level a node cuts the dimension that spreads most at its median."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.dim, self.cut = levels, np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        members = {0: np.arange(len(sample))}
        for node in range(len(self.dim)):
            rows = members.pop(node)
            if len(rows):
                own = sample[rows]
                self.dim[node] = np.argmax(own.max(0) - own.min(0))
                self.cut[node] = np.median(own[:, self.dim[node]])
            above = sample[rows, self.dim[node]] > self.cut[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~above], rows[above]

    def cells(self, proj: np.ndarray) -> np.ndarray:
        node = np.zeros(len(proj), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (proj[np.arange(len(proj)), self.dim[node]] > self.cut[node])
        return node - len(self.dim)


def leaves(proj: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The lower levels: row numbers by leaf, each part halved at the median of the dimension that spreads most."""
    todo, done = [np.arange(len(proj))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        own = proj[rows]
        order = np.argpartition(own[:, np.argmax(own.max(0) - own.min(0))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) from boxes (columns), one dimension at a time."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        out += np.maximum(np.maximum(low[:, k] - q[:, k, None], q[:, k, None] - high[:, k]), 0.0) ** 2
    return out


def search(v: np.ndarray, proj: np.ndarray, weight: np.ndarray, q: np.ndarray, q_proj: np.ndarray, bound: np.ndarray, ratio: float, wanted: int = RESULTS + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest rows of v to each q: (query, row, cosine) of all that may be among the ``wanted`` best, each query's bound, rows verified.

    ``weight``: how many ids a row has; the bound of a query is the cosine that its ``wanted`` best ids reach, at least the given one.
    """
    parts = leaves(proj)
    width = max(map(len, parts))
    member = np.full((len(parts), width), -1)
    for k, rows in enumerate(parts):
        member[k, : len(rows)] = rows
    low, high = np.array([proj[r].min(0) for r in parts]), np.array([proj[r].max(0) for r in parts])
    (x, nx), (y, ny) = unit(v), unit(q)
    x, y = x / nx[:, None], y / ny[:, None]
    verified, found = 0, []
    bound = bound.copy()
    for a in range(0, len(q), 256):
        block = np.arange(a, min(a + 256, len(q)))
        distance = box_distances(q_proj[block], low, high)
        order = np.argsort(distance, axis=1, kind="stable")
        best, score = np.full((len(block), wanted), -1), np.full((len(block), wanted), -np.inf)
        active = np.arange(len(block))
        for step in range(len(parts)):
            leaf = order[active, step]
            reach = ratio * np.maximum(2 - 2 * bound[block[active]], 0) + SLACK
            go = distance[active, leaf] <= reach  # the test on the next leaf; those after it lie no nearer
            active, leaf, reach = active[go], leaf[go], reach[go]
            if not len(active):
                break
            rows = member[leaf]
            near = ((proj[rows] - q_proj[block[active], None]) ** 2).sum(2) <= reach[:, None]
            near &= rows >= 0
            verified += int(near.sum())
            new = np.where(near, np.einsum("lrd,ld->lr", x[rows], y[block[active]]), -np.inf)
            both, rows = np.concatenate([score[active], new], 1), np.concatenate([best[active], rows], 1)
            keep = np.argpartition(-both, wanted - 1, axis=1)[:, :wanted]
            keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(both, keep, 1), axis=1), 1)
            score[active], best[active] = np.take_along_axis(both, keep, 1), np.take_along_axis(rows, keep, 1)
            reached = np.cumsum(np.where(np.isfinite(score[active]), weight[best[active]], 0), axis=1) >= wanted
            worst = np.where(reached.any(1), score[active, reached.argmax(1)], -np.inf)
            bound[block[active]] = np.maximum(bound[block[active]], worst - SLACK)
        ok = np.isfinite(score)
        query, row = np.repeat(block, ok.sum(1)), best[ok]
        exact = cosines(q[query], v[row])
        keep = exact >= bound[query]
        found.append((query[keep], row[keep], exact[keep]))
    query, row, exact = (np.concatenate(c) for c in zip(*found, strict=True))
    return query, row, exact, bound, verified


HITS = "key binary, node binary, ids array<long>, score double"


def _searched(kind: str, ratio: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Search of one chunk by one block of queries: hits, and each query's bound in a row without a node."""

    def searched(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        key, own, bound = queries["key"].to_pylist(), nodes["key"].combine_chunks(), queries["bound"].to_numpy().copy()
        query, row, score = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        ids = nodes["ids"].combine_chunks()
        if key and len(own):
            v, q = numbers(nodes["v"].to_pylist(), kind), numbers(queries["v"].to_pylist(), kind)
            proj, q_proj = (numbers(t["proj"].to_pylist(), "<f8") for t in (nodes, queries))
            query, row, score, bound, _ = search(v, proj, np.asarray(ids.value_lengths()), q, q_proj, bound, ratio)
        none = len(key)
        hits = pa.table({"key": pa.array([key[k] for k in query], pa.binary()), "node": own.take(pa.array(row)), "ids": ids.take(pa.array(row)), "score": score})
        bounds = pa.table({"key": pa.array(key, pa.binary()), "node": pa.nulls(none, pa.binary()), "ids": pa.nulls(none, ids.type), "score": bound})
        return pa.concat_tables([hits, bounds])

    return searched


class Index:
    """The nodes in the shared folder, the tree's upper levels, and of each cell its size and its box: at most 2**LEVELS rows in the driver."""

    def __init__(self, nodes: DataFrame, kind: str):
        self.nodes, self.kind, self.ratio = common.written(nodes, "nodes"), kind, stopping_ratio()
        n = self.nodes.count()
        part = self.nodes if n <= SAMPLE else self.nodes.filter(F.pmod(F.xxhash64("key"), F.lit(n)) < int(SAMPLE * 0.95))
        sample = part.select("proj").limit(SAMPLE).toArrow()["proj"].to_pylist()
        levels = min(LEVELS, max(0, int(math.log2(max(n, 1) / CELL))) if n >= CELL else 0)
        self.tree = Tree(numbers(sample, "<f8") if sample else np.zeros((0, M)), levels)
        self.size, self.low, self.high = self._boxes()
        self.chunks = np.maximum(-(-self.size // CHUNK), 1)

    def _boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tree, cells = self.tree, 1 << self.tree.levels

        def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, low, high = np.zeros(cells, np.int64), np.full((cells, M), np.inf), np.full((cells, M), -np.inf)
            for batch in batches:
                if batch.num_rows:
                    proj = numbers(batch.column("proj").to_pylist(), "<f8")
                    cell = tree.cells(proj)
                    size += np.bincount(cell, minlength=cells)
                    np.minimum.at(low, cell, proj)
                    np.maximum.at(high, cell, proj)
            has = np.flatnonzero(size)
            yield pa.RecordBatch.from_pydict({"cell": has, "n": size[has], **{f"l{k}": low[has, k] for k in range(M)}, **{f"h{k}": high[has, k] for k in range(M)}})

        names = [f"l{k}" for k in range(M)], [f"h{k}" for k in range(M)]
        parts = self.nodes.select("proj").mapInArrow(boxes, "cell long, n long, " + ", ".join(f"{c} double" for c in names[0] + names[1]))
        whole = parts.groupBy("cell").agg(F.sum("n"), *[F.min(c) for c in names[0]], *[F.max(c) for c in names[1]]).collect()
        size, low, high = np.zeros(cells, np.int64), np.full((cells, M), np.inf), np.full((cells, M), -np.inf)
        for cell, n, *edges in whole:
            size[cell], low[cell], high[cell] = n, edges[:M], edges[M:]
        return size, low, high

    def _dealt(self, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Queries to (cell, chunk): one chunk of their own cell, or all that the test leaves at their bound."""
        tree, kind, ratio, size, low, high, chunks = self.tree, self.kind, self.ratio, self.size, self.low, self.high, self.chunks

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            has = np.flatnonzero(size)
            for batch in common.slices(batches, rows=256):
                if not batch.num_rows:
                    continue
                proj = projected(batch.column("dim").to_numpy(), batch.column("v").to_pylist(), kind)
                if first:
                    row, cell = np.arange(batch.num_rows), tree.cells(proj)
                    chunk = np.array([k[0] for k in batch.column("key").to_pylist()]) % chunks[cell]
                else:
                    reach = ratio * np.maximum(2 - 2 * batch.column("bound").to_numpy(), 0) + SLACK
                    row, at = np.nonzero(box_distances(proj, low[has], high[has]) <= reach[:, None])
                    n = chunks[has[at]]
                    row, cell = np.repeat(row, n), np.repeat(has[at], n)
                    chunk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                raw = pa.array([p.tobytes() for p in proj], pa.binary())
                sent = pa.RecordBatch.from_pydict({"dim": batch.column("dim"), "key": batch.column("key"), "v": batch.column("v"), "proj": raw, "bound": batch.column("bound")})
                for a in range(0, len(row), 4096):
                    part = sent.take(pa.array(row[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 4096]), pa.array(chunk[a : a + 4096].astype(np.int64)), *part.columns], ["cell", "chunk", *part.schema.names])

        return dealt

    def ask(self, queries: DataFrame, first: bool) -> DataFrame:
        """``queries``: (key, dim, v, bound) -> hits of the first search or the second, and bounds."""
        tree = self.tree
        chunks = F.element_at(F.lit(self.chunks.tolist()), (F.col("cell") + 1).cast("int"))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.cells(numbers(batch.column("proj").to_pylist(), "<f8")) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", *batch.schema.names])

        pairs = queries.mapInArrow(self._dealt(first), "cell long, chunk long, dim int, key binary, v binary, proj binary, bound double")
        counts = pairs.groupBy("cell", "chunk").count().groupBy("cell").agg(F.max("count"))
        blocks = np.ones(len(self.chunks), np.int64)
        for cell, n in counts.collect():
            blocks[cell] = -(-n // BLOCK)
        block = F.element_at(F.lit(blocks.tolist()), (F.col("cell") + 1).cast("int"))
        salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(SEED)), n)
        held = self.nodes.mapInArrow(placed, "cell long, key binary, dim int, v binary, proj binary, ids array<long>")
        held = held.withColumn("chunk", salt("key", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block - 1)))
        asked = pairs.withColumn("block", salt("key", block))
        by = ["dim", "cell", "chunk", "block"]
        return held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_searched(self.kind, self.ratio), HITS)


def _without_own(best: Column) -> Column:
    """The best rows of a query but its own, which is the first of its node with its id, if it is among them."""
    own = F.array_position(F.transform(best, lambda b: F.coalesce(b.own & (b.vec_id == F.col("query_id")), F.lit(False))), True)
    rest = F.when(own > 0, F.concat(F.slice(best, 1, (own - 1).cast("int")), F.slice(best, (own + 1).cast("int"), RESULTS + 1))).otherwise(best)
    return F.slice(rest, 1, RESULTS)


def nearest(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the queries, the rows whose id is divisible by ``every``."""
    rows, kind = packed(vectors)
    asking, _ = packed(vectors.filter(F.col("vec_id") % every == 0))
    index = Index(nodes_of(rows, kind), kind)
    queries = common.written(asking.groupBy("key").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.lit(float("-inf")).alias("bound")), "queries")
    begun = common.written(index.ask(queries, first=True), "begun")
    bounds = begun.filter(F.col("node").isNull()).select("key", F.col("score").alias("bound"))
    bounded = common.written(queries.drop("bound").join(bounds, "key"), "bounded")
    # What the first search found stands: the second, with the bound known from the start, may stop before it comes there.
    hits = begun.unionByName(index.ask(bounded, first=False)).filter(F.col("node").isNotNull()).dropDuplicates(["key", "node"])
    each = hits.select("key", "score", (F.col("key") == F.col("node")).alias("own"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    few = each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= RESULTS + 1)
    best = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("best"))
    answers = asking.select(F.col("vec_id").alias("query_id"), "key").join(best, "key").withColumn("best", _without_own(F.col("best")))
    ranked = answers.select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
