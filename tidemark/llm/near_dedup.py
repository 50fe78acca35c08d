"""Near-duplicate classes by DartMinHash.

Equal texts are one node (MD5 of the text). Each node's five-word shingles, weighted by how often they occur, throw
hashed darts: a weighted element owns regions of the weight axis ([0, 1), then doubling ones), darts fall on a region
as a Poisson process in rank that depends on the element's hash alone, and a dart counts where it lies below the
element's weight. A coordinate keeps its earliest dart, so two signatures agree in a coordinate with the generalised
Jaccard similarity (sum of lesser over sum of greater weights). Only darts up to a rank that fills all coordinates are
thrown; it doubles where one stays empty. Signatures are cut into BANDS bands; equal bands make buckets. A pair at the
threshold shares no bucket with a chance of at most MISS, other linked pairs with less: rows_of sets the band's length.

A bucket is never expanded into pairs. A round compares its members with one pivot on the exact weighted shingles and
links those of similarity THRESHOLD or more. Links found in any bucket then label what they connect; a bucket whose
members share one label is settled. The distance is a metric, so a member that links to the pivot can link to one
that does not only if their distances to it differ by at most 1 - THRESHOLD; other linked members leave. What is left
after a round is settled by blocks: a bucket of up to LOCAL members and LOCAL_BYTES bytes of shingles is one block in
one task, a larger one (after LARGE_ROUNDS more rounds) is cut into b blocks and each pair of blocks is one task, so
that a member's row occurs b times and no more. A task counts the shingles that all its pairs share by matrix products
and gives back links that span its parts, never pairs. Classes are the connected components, by large-star and
small-star rounds.

Rows at most: BANDS a text, times b in buckets beyond a block. Comparisons grow with the square of a bucket that holds
more than LOCAL texts of which none is linked to another; nothing is left out.

Shingles are compared by 32-bit hashes; a shingle's n-th occurrence is an element of its own there, which makes the
plain Jaccard similarity of the sets the generalised one of the counts. Words are lower-cased runs of letters and
digits; a text of one to four words has one shingle, one without words only matches equal texts. Null counts as the
empty text, and all empty texts are one class. Repeated rows stay in the result; a class of rows with null ids only
has a null class id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, lexer

SHINGLE, THRESHOLD = 5, 0.8
BANDS, MISS = 30, 2e-4
LOCAL, LOCAL_BYTES, LARGE_ROUNDS = 2000, 8 << 20, 2
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle, repeated ones too."""
    w = lexer.words([(t or "").lower() for t in texts], join_alnum=True)
    w = w.only(w.kind == lexer.LETTER)
    h, n = w.hashes, len(w.start) - size + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        whole = whole * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < size))
    few = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = np.diff(w.bounds)[short] > k
        few[has] = few[has] * np.uint64(0xD6E8FEB86659FD93) + h[w.bounds[short][has] + k] + np.uint64(1)
    doc = np.concatenate([w.doc[at], short])
    value = lexer.mix(np.concatenate([whole[at], few]), 5)
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


def weighted(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 44-bit element, how often it occurs there), sorted; at most 2**20 texts."""
    pair, n = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (element >> np.uint64(20)), return_counts=True)
    return (pair >> np.uint64(44)).astype(np.int64), pair & np.uint64((1 << 44) - 1), n


def occurrences(doc: np.ndarray, element: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sorted numbers (text << 32 | hash) of each element's first, second, ... occurrence."""
    first = np.cumsum(n) - n
    nth = (np.arange(n.sum()) - np.repeat(first, n)).astype(np.uint64)
    h = lexer.mix(np.repeat(element, n) ^ (nth << np.uint64(44)), 6) >> np.uint64(32)
    return np.unique((np.repeat(doc, n).astype(np.uint64) << np.uint64(32)) | h)


def rows_of(threshold: float, bands: int = BANDS) -> int:
    """The greatest band length at which a pair of that similarity shares no band with a chance of at most MISS."""
    return max(1, int(np.log(1 - MISS ** (1 / bands)) / np.log(threshold)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) signatures; the row of a document without elements is all ones.

    A value holds the dart's rank in its upper half and 32 bits of the dart's hash in the lower.
    """
    out = np.full(n_docs * k, _EMPTY)
    total = np.bincount(doc, weight, n_docs)
    limit = k * (np.log(k) + 4) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        d, e, w = doc[mine], element[mine], weight[mine]
        for region in range(int(np.ceil(np.log2(max(w.max(), 1)))) + 1):
            low, width = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** (region - 1))
            over = w > low
            cell, of, top = lexer.mix(e[over], 100 + region), d[over], w[over]
            rank, m = np.zeros(len(cell)), 0
            while len(cell):
                m += 1
                dart = lexer.mix(cell, 1000 + m)
                rank = rank - np.log(lexer.uniform(dart)) / width
                on = rank <= limit[of]
                cell, of, top, rank, dart = cell[on], of[on], top[on], rank[on], dart[on]
                hit = low + width * lexer.uniform(lexer.mix(dart, 1)) < top
                coordinate = (lexer.mix(dart[hit], 2) % np.uint64(k)).astype(np.int64)
                value = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart[hit] & np.uint64(0xFFFFFFFF))
                np.minimum.at(out, of[hit] * k + coordinate, value)
        todo &= (out.reshape(n_docs, k) == _EMPTY).any(1)
        limit = np.where(todo, 2 * limit, limit)
    return out.reshape(n_docs, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        keys = lexer.mix(keys + signatures[:, r * bands : (r + 1) * bands], 3)
    return lexer.mix(keys + np.arange(bands, dtype=np.uint64), 4).view(np.int64)


def node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def signed(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(doc_id, node, bands) of every row; bands is empty for a text without words."""
    rows = rows_of(threshold, bands)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(2).to_pylist()
            for a, b in lexer.by_bytes(texts):
                doc, element, n = weighted(*shingles(texts[a:b]))
                keys = band_keys(dart_signatures(doc, lexer.mix(element), n.astype(float), b - a, bands * rows), bands, rows)
                has = np.bincount(doc, minlength=b - a) > 0
                cut = np.concatenate([[0], np.cumsum(has * bands)])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], lists], ["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long"), node(F.col("text")).alias("node"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) for the nodes of wanted (doc_id, node): the sorted 32-bit hashes of each one's shingle occurrences."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            for a, b in lexer.by_bytes(texts):
                pair = occurrences(*weighted(*shingles(texts[a:b])))
                cut = np.searchsorted(pair, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(32))
                low = (pair & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([low[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["node", "words"])

    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), node(F.col("text")).alias("own_node"), F.col("text").cast("string").alias("text"))
    rows = own.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_node") == F.col("node")))
    return rows.select("node", "text").mapInArrow(collect, "node binary, words binary").dropDuplicates(["node"])


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes with the Jaccard similarity of their shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = np.concatenate([u, v])
                both.sort()
                common_ones = int((both[1:] == both[:-1]).sum())
                out.append(common_ones / max(len(both) - common_ones, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    one = sets.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    two = sets.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b").mapInArrow(compare, "a binary, b binary, similarity double")


def labelled(members: DataFrame, stars: DataFrame | None) -> DataFrame:
    """Members (key, node) with the label of their part of what is linked so far; buckets of one label are settled and go."""
    if stars is None:
        named = members.select("key", "node", F.col("node").alias("label"))
    else:
        labels = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        named = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return common.written(named.join(mixed.select("key"), "key", "left_semi"), "dedup-members")


def pivot_round(members: DataFrame, sets: DataFrame, stars: DataFrame | None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare each bucket's members with one of them: (links found, all stars, members that may still have links).

    members: (key, node, label), those of one label are linked to each other already. A pivot is the least node of
    its bucket's rarest label, so a large label is met once for each member outside it. Only members of other labels
    are compared with it; the pivot then leaves. A member that links to the pivot stays only if its distance lets it
    link to one that still has another label.
    """
    slack = 1 - threshold + 1e-9
    each = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    pivots = each.groupBy("key").agg(F.min(F.struct("n", "node", "label")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("own"))
    with_pivot = members.join(pivots, "key").filter("node <> pivot").select("key", "node", "pivot", (F.col("label") == F.col("own")).alias("same"))
    pairs = with_pivot.filter("not same").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    compared = common.written(similarities(pairs, sets), "dedup-compared")
    linked = compared.filter(F.col("similarity") >= threshold)
    edges = linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = star_rounds(edges if stars is None else edges.unionByName(stars), 2)
    far = compared.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("far"))
    judged = with_pivot.join(far, ["node", "pivot"], "left").select("key", "node", "far", F.coalesce(F.col("far") > slack, F.lit(False)).alias("open"))
    reach = judged.groupBy("key").agg(F.min(F.when(F.col("open"), F.col("far"))).alias("nearest"), F.count_if(F.col("far").isNull()).alias("unseen"))
    stay = judged.join(reach, "key").filter(F.col("open") | F.col("far").isNull() | (F.col("unseen") > 0) | (F.col("far") >= F.col("nearest") - slack))
    return linked, stars, labelled(stay, stars)


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two different ones of the sorted sets share.

    Elements of more than a 32nd of the sets go through matrix products, some columns at a time; rarer ones add
    to their few pairs one by one.
    """
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint32)
    order = np.argsort(element, kind="stable")
    element, doc = element[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, int)
    count = np.diff(np.append(first, len(element)))
    shared = np.zeros((n, n), np.float32)
    often = np.flatnonzero(count > max(1, n // 32))
    for a in range(0, len(often), columns):
        part = often[a : a + columns]
        size = count[part]
        at = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ones = np.zeros((n, len(part)), np.float32)
        ones[doc[at], np.repeat(np.arange(len(part)), size)] = 1
        shared += ones @ ones.T
    flat = shared.reshape(-1)
    for size in range(2, n // 32 + 1):
        part = first[count == size]
        for i in range(size if len(part) else 0):
            for j in range(i + 1, size):
                cell = np.sort(np.concatenate([doc[part + i] * n + doc[part + j], doc[part + j] * n + doc[part + i]]))
                cell, times = np.unique(cell, return_counts=True)
                flat[cell] += times
    return shared


def spanning_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links (i, j, similarity) that connect what links of the threshold connect, given that equal labels are linked already.

    side: 0 or 1; where both occur only pairs of different sides are compared.
    """
    shared, size = shared_counts(sets), np.array([len(x) for x in sets], np.float32)
    similar = shared / np.maximum(size[:, None] + size - shared, 1)
    if side.min() != side.max():
        similar[side[:, None] == side] = 0
    root, out = np.unique(label, return_inverse=True)[1], []
    for i in range(len(sets)):
        for j in np.flatnonzero((similar[i] >= threshold - 1e-7) & (root != root[i])).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j, float(similar[i, j])))
    return out


def deal(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, low, high, side, node, label): each member once for every pair of blocks (low <= high) of its bucket that holds its own."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", "node", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def block_links(members: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links that connect each bucket of members (key, node, label); sizes (key, blocks): into how many blocks it is cut."""

    def find(part: pa.Table) -> pa.Table:
        nodes = part.column("node").to_pylist()
        words = [np.frombuffer(x, "<u4") for x in part.column("words").to_pylist()]
        label = np.array([x.hex() for x in part.column("label").to_pylist()])
        links = spanning_links(words, label, np.array(part.column("side").to_pylist()), threshold)
        return pa.table({"a": pa.array([nodes[i] for i, _, _ in links], pa.binary()), "b": pa.array([nodes[j] for _, j, _ in links], pa.binary()), "similarity": pa.array([s for _, _, s in links], pa.float64())})

    return deal(members, sizes).join(sets, "node").groupBy("key", "low", "high").applyInArrow(find, "a binary, b binary, similarity double")


def bucket_sizes(members: DataFrame, sets: DataFrame, local: int, local_bytes: int) -> DataFrame:
    """(key, blocks) of each bucket."""
    size = members.join(sets.select("node", F.octet_length("words").alias("size")), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return size.select("key", F.ceil(F.greatest(F.col("n") / local, F.col("size") / local_bytes)).cast("int").alias("blocks"))


def links(docs: DataFrame, signatures: DataFrame, threshold: float = THRESHOLD, local: int = LOCAL, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(a, b, similarity) links between nodes that connect each class of near duplicates."""
    nodes = signatures.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
    keyed = nodes.select("node", "doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = common.written(keyed.join(shared, "key").select("key", "node", "doc_id", F.col("node").alias("label")), "dedup-members")
    sets = common.written(shingle_sets(docs, members.select("node", "doc_id").distinct()), "dedup-sets")
    linked, stars, members = pivot_round(members.drop("doc_id"), sets, None, threshold)
    found = [linked]
    for _ in range(LARGE_ROUNDS):
        sizes = common.written(bucket_sizes(members, sets, local, local_bytes), "dedup-sizes")
        large = sizes.filter("blocks > 1").select("key")
        if large.isEmpty():
            break
        linked, stars, rest = pivot_round(members.join(large, "key", "left_semi"), sets, stars, threshold)
        found.append(linked)
        members = members.join(large, "key", "left_anti").unionByName(rest)
    else:
        sizes = common.written(bucket_sizes(members, sets, local, local_bytes), "dedup-sizes")
    out = block_links(members, sets, sizes, threshold)
    for part in found:
        out = out.unionByName(part)
    return out


def star_rounds(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, after large-star and small-star rounds: all of them until nothing changes, or the given number.

    At the end v is the least node of u's component; after fewer rounds it is some node of that component.
    """
    edges, state, done = edges.filter("u <> v").distinct(), None, 0
    while rounds is None or done < rounds:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.written(small, "star")
        done += 1
        if rounds is None:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
            if now == state:
                break
            state = now
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of its component."""
    stars = star_rounds(common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, root, class_id, class_rows) of every row; class_id is the least doc_id of the class, root its least node."""
    signatures = common.written(signed(docs, threshold), "dedup-signatures")
    roots = components(links(docs, signatures, threshold))
    nodes = signatures.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_rows"))
    named = rooted.select("node", "root").join(totals, "root")
    return signatures.select("doc_id", "node").join(named, "node").select("doc_id", "node", "root", "class_id", "class_rows")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class: that with the least id, null ids last (of equal ids the least text's MD5); columns stay."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")
    kept_id, kept_node = common.fresh(docs, "kept_id"), common.fresh(docs, "kept_node")
    keep = classes(docs).groupBy("root").agg(least).select(F.col("k.doc_id").alias(kept_id), F.col("k.node").alias(kept_node))
    rows = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (node(F.col("text")) == F.col(kept_node)))
    return rows.dropDuplicates([kept_id, kept_node]).select(*docs.columns)
