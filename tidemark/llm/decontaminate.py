"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units (after a number) turn
into typed placeholders, other words are folded to lower case, punctuation goes. Windows of ``WINDOW`` template
tokens are hash-joined with those of the benchmark; windows with fewer than ``LEAST_LITERAL`` plain words say little
as templates and are hashed with the words of their slots, so that they match word for word only.

Windows of one document and item that lie on one diagonal (equal distance of places) fill each slot of the item with
one value. Slots that hold one name in the item must hold one name in the document too: where they don't, the windows
over the slots that go against the commonest value are dropped. Numbers and units that are equal in the item may be so
by chance and can change apart. An item leaks into a document if the windows left cover ``COVERAGE`` of the item's, or
if ``VERBATIM_WINDOWS`` windows of one diagonal are the item's own word for word, however long the item is. The kind is
verbatim if all slot values are the item's own, or if only the latter holds; else re-parameterised.

Items of fewer tokens than a window are matched by windows of their own length; items with fewer than LEAST_LITERAL
tokens, empty or null ones included, match nothing. Null and empty documents match nothing. Repeated rows and equal ids
are judged row by row and reported once for each (doc_id, text). An empty table on either side gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, lexer

WINDOW, LEAST_LITERAL, COVERAGE, VERBATIM_WINDOWS = 8, 4, 0.5, 25
#: Benchmark windows up to this number are looked up inside the scan of the documents; beyond it, all windows are shuffled.
#: The benchmark's windows are broadcast to the join only up to so many bytes.
LOOKUP_WINDOWS, BROADCAST_BYTES = 2_000_000, 32 << 20
# Unit words.
UNITS = "km m cm mm kg g mg t lb oz l ml s sec ms min h hr hours minutes seconds days weeks months years mph kmh hz w kw v a c f k pa j cal usd eur gbp dollars euros cents percent meters metres miles feet inches grams kilograms liters litres degrees".split()

_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (0x51ED270B0A1F3C15, 0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99))
_unit_hashes = np.sort(lexer.words(UNITS).hashes)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z and the capitals of Latin-1 in lower case, and where those capitals begin."""
    low = _FOLD[data]
    capital = (data >= 65) & (data <= 90)
    after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) if len(data) else np.zeros(0, int)
    low[after + 1] += 0x20
    capital[after] = True
    return low, capital


class Templates:
    """Template tokens of many texts: ``code`` is what is compared, ``slot`` tells placeholders."""

    def __init__(self, texts: list[str | None]):
        w = lexer.words(texts)
        low, capital = _folded(w.data)
        # A sentence starts after . ! ? : or a line end, with marks and spaces between.
        stop = np.isin(w.data, np.frombuffer(b".!?:\n", np.uint8))
        stops = np.concatenate([[0], np.cumsum(stop)])
        w = w.only(w.kind != lexer.OTHER)
        previous_end = np.concatenate([w.edges[:1], w.end[:-1]])
        same = np.concatenate([[False], w.doc[1:] == w.doc[:-1]]) if len(w.doc) else np.zeros(0, bool)
        opens = ~same | (stops[w.start] > stops[previous_end])
        digits = w.kind == lexer.DIGIT
        # 1,234.5 is one number.
        joined = np.zeros(len(w.start), bool)
        if len(joined):
            near = digits[1:] & digits[:-1] & (w.start[1:] == w.end[:-1] + 1)
            joined[1:] = near & np.isin(w.data[w.end[:-1]], np.frombuffer(b".,", np.uint8))
        heads = np.flatnonzero(~joined)
        end = w.end[np.concatenate([heads[1:] - 1, [len(joined) - 1]])] if len(heads) else w.end
        w = w.only(~joined)
        w.end, opens, digits = end, opens[heads], digits[heads]
        code = lexer.hash_spans(low, w.start, w.end)
        wide = np.minimum(w.start + 1, len(w.data) - 1)
        title = capital[w.start] & ~capital[np.minimum(wide + (w.data[w.start] == 0xC3), len(w.data) - 1)] if len(w.start) else np.zeros(0, bool)
        unit = np.zeros(len(code), bool)
        if len(code):
            unit[1:] = digits[:-1] & (w.doc[1:] == w.doc[:-1]) & np.isin(code[1:], _unit_hashes)
        name = title & ~opens & ~unit & ~digits & (w.end - w.start > 1)
        self.literal = code.copy()
        code[digits], code[name], code[unit] = _NUMBER, _NAME, _UNIT
        self.slot, self.name, self.code, self.words = digits | name | unit, name, code, w

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of each window of one text."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.words.doc[:n] == self.words.doc[size - 1 :])
        plain = np.concatenate([[0], np.cumsum(~self.slot)])
        poor = plain[at + size] - plain[at] < LEAST_LITERAL
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(poor, self.literal[at + k], self.code[at + k])
        return at, lexer.mix(h + poor.astype(np.uint64), 7)

    def values(self, first: int, size: int) -> tuple[list[str], list[int]]:
        """The values of a window's slots and their places in it, names' places counted from -1 down; none where the window is matched word for word."""
        w = self.words
        if size - self.slot[first : first + size].sum() < LEAST_LITERAL:
            return [], []
        at = first + np.flatnonzero(self.slot[first : first + size])
        places = np.where(self.name[at], -1 - (at - first), at - first)
        return [w.data[w.start[k] : w.end[k]].tobytes().decode("utf-8", "replace") for k in at.tolist()], places.tolist()


_WINDOWS = "row_id long, key long, size int, place int, hash long, slots array<string>, slot_places array<int>"


def template_windows(df: DataFrame, row_id: str, sizes: list[int] | None = None, lookup: np.ndarray | None = None) -> DataFrame:
    """Windows of each text: (row_id, key, size, place, hash, slots, slot_places). key: hash of the row's id and text.

    sizes: window sizes; None takes WINDOW, and the text's own length where that is less. lookup: sorted hashes;
    other windows are left out already here.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, keys, texts = (c.to_pylist() for c in batch.columns)
            for a, b in lexer.by_bytes(texts):
                t, out = Templates(texts[a:b]), []
                n_tokens = np.diff(t.words.bounds)
                for size in sizes or range(LEAST_LITERAL, WINDOW + 1):
                    at, h = t.windows(size)
                    if sizes is None and size < WINDOW:
                        short = n_tokens[t.words.doc[at]] == size
                        at, h = at[short], h[short]
                    if lookup is not None and len(at):
                        hit = lookup[np.minimum(np.searchsorted(lookup, h), len(lookup) - 1)] == h if len(lookup) else np.zeros(len(h), bool)
                        at, h = at[hit], h[hit]
                    doc = t.words.doc[at]
                    place = at - t.words.bounds[doc]
                    out += [(ids[a + d], keys[a + d], size, p, v, *t.values(k, size)) for d, p, v, k in zip(doc.tolist(), place.tolist(), h.view(np.int64).tolist(), at.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], ["row_id", "key", "size", "place", "hash", "slots", "slot_places"])

    text = F.col("text").cast("string")
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.xxhash64(F.col(row_id).cast("long"), text).alias("key"), text.alias("text")).filter("text is not null")
    return rows.mapInArrow(find, _WINDOWS)


def line_verdict(windows: list[dict]) -> tuple[list[tuple[int, int]], int, bool]:
    """Of the windows of one diagonal: (places of those that stay, how many are the item's own word for word, whether all that stay are)."""
    names: dict[str, dict[int, str]] = {}
    for w in windows:
        for place, item, own in zip(w["slot_places"], w["item_slots"], w["slots"], strict=True):
            if place < 0:
                names.setdefault(item, {})[w["item_place"] - place - 1] = own
    astray = set()
    for filled in names.values():
        common_one = max(sorted(set(filled.values())), key=list(filled.values()).count)
        astray |= {place for place, own in filled.items() if own != common_one}
    stay = [w for w in windows if not any(p < 0 and w["item_place"] - p - 1 in astray for p in w["slot_places"])]
    own = [w["item_slots"] == w["slots"] for w in windows]
    return sorted({(w["size"], w["item_place"]) for w in stay}), sum(own), all(w["item_slots"] == w["slots"] for w in stay)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, lookup_windows: int = LOOKUP_WINDOWS) -> DataFrame:
    """(doc_id, key, item_id, n_windows, item_windows, coverage, kind) of each document and item that leaks into it."""
    items = template_windows(benchmark, "item_id").select(F.col("row_id").alias("item_id"), F.col("key").alias("item_key"), "size", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"), "slot_places")
    items = common.written(items.dropDuplicates(["item_key", "size", "item_place"]), "benchmark-windows")
    n, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "item_slots")) + 8 * F.size("item_slots") + 64), F.lit(0))).head()
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    whole = items.groupBy("item_key").agg(F.count("*").alias("item_windows"))
    small, few = n_bytes <= BROADCAST_BYTES, n <= lookup_windows
    lookup = np.sort(items.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)) if few else None
    found = template_windows(docs, "doc_id", sizes or [WINDOW], lookup).drop("slot_places")
    items = items.join(F.broadcast(whole) if small else whole, "item_key")
    hits = found.join(F.broadcast(items) if small else items, ["hash", "size"])
    # One item's windows at most in a row.
    lines = hits.groupBy("key", F.col("row_id").alias("doc_id"), "item_key", "item_id", "item_windows", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        F.collect_set(F.struct("size", "item_place", "slots", "item_slots", "slot_places")).alias("windows")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            verdicts = [line_verdict(w) for w in batch.column(5).to_pylist()]
            places = pa.array([[size << 32 | place for size, place in v[0]] for v in verdicts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], places, pa.array([v[1] for v in verdicts], pa.int32()), pa.array([v[2] for v in verdicts], pa.bool_())], [*batch.schema.names[:5], "places", "verbatim", "own"])

    ids = ["key", "doc_id", "item_key", "item_id", "item_windows"]
    lines = lines.select(*ids, "windows").mapInArrow(judge, "key long, doc_id long, item_key long, item_id long, item_windows long, places array<long>, verbatim int, own boolean")
    judged = lines.groupBy(*ids).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_windows"), F.min("own").alias("own"), F.max("verbatim").alias("verbatim"))
    enough = F.col("n_windows") >= coverage * F.col("item_windows")
    return judged.filter(enough | (F.col("verbatim") >= VERBATIM_WINDOWS)).select(
        "doc_id", "key", "item_id", F.col("n_windows").cast("long"), "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), F.when(F.col("own") | ~enough, "verbatim").otherwise("re-parameterised").alias("kind")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks; columns stay."""
    leaked = common.fresh(docs, "leaked_key")
    bad = leaks(docs, benchmark).select(F.col("key").alias(leaked)).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(bad, key == F.col(leaked), "left_anti")
