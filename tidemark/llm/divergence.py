"""Divergence of sources within each language, by a heavy-light split of the terms, in exact integers.

Terms are runs of letters (any character beyond ASCII counts as one), A-Z lower-cased. A language keeps the terms that
occur in at least LEAST of its documents. A group (language, source) gives each kept term the smoothed share
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)); two groups differ by the sum of |p - p'| over the kept terms.

Tasks count terms of their texts by group before anything is shuffled. A kept term is heavy where more than LIGHT groups
of its language hold it, else light; the two kinds are summed apart and then added:

* heavy: tiles of about TILE_TERMS terms and two blocks of at most SOURCES groups; each tile is one dense matrix of
  shares in one task, compared row by row in numpy;
* light: were no light term anywhere, two groups would differ by L |z - z'|, with z a group's share of an absent term and
  L the number of light terms. Postings correct that: a group's own postings, taken as a histogram of their shares,
  against the other's z, and, for the at most LIGHT groups that meet in a term's posting list, what both holding it
  changes. A list of at most LIGHT entries is the only thing expanded into pairs.

Null text, lang and source are ''. Texts of any length are read whole, in pieces cut between terms. A group without terms
is compared as others are; a language without kept terms has distances of 0. Repeated rows are documents of their own.
Ties rank by the item's UTF-8 bytes. The table's other columns, whatever their names, are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

LEAST, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
LIGHT, TILE_TERMS, SOURCES = 8, 512, 256
BROADCAST_GROUPS = 50_000  # a table of more groups is joined by shuffling
ENTRIES, PIECE = 200_000, 1 << 20

_LETTERS = bytearray(b" " * 256)
for _b in range(128, 256):
    _LETTERS[_b] = _b
for _b in range(65, 91):
    _LETTERS[_b] = _LETTERS[_b + 32] = _b + 32


def term_pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The text's terms in order, by pieces of about ``piece`` bytes; a term is never cut."""
    spaced, at = text.translate(bytes(_LETTERS)), 0
    while at < len(spaced):
        end = spaced.find(b" ", at + piece)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def _counted(entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by (lang, source, term), given up whenever ``entries`` of them are held; a null term stands for the group itself."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in common.slices(batches, rows=500, n_bytes=8 << 20):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in term_pieces(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(len(n) for n, _ in groups.values()) >= entries:
                yield from _given_up(groups)
        yield from _given_up(groups)

    return counted


def _given_up(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        terms, counts = [None, *n], [0, *n.values()]
        rows = {"lang": [lang] * len(terms), "source": [source] * len(terms), "term": pa.array(terms, pa.binary())}
        yield pa.RecordBatch.from_pydict(rows | {"n": pa.array(counts, pa.int64()), "docs": pa.array([0, *map(docs.__getitem__, n)], pa.int64())})
    groups.clear()


def kept_cells(docs: DataFrame, least: int = LEAST, light: int = LIGHT) -> DataFrame:
    """(lang, source, term, n, lang_n, heavy, leads): counts of kept terms by group, and one row of null term a group.

    ``leads`` marks one row of each kept term in its language.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    parts = docs.select(*names, text.alias("text")).mapInArrow(_counted(ENTRIES), "lang string, source string, term binary, n long, docs long")
    cells = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = cells.select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n",
        F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
        (F.count("*").over(term) > light).alias("heavy"), (F.row_number().over(term.orderBy("source")) == 1).alias("leads"),
    )
    return whole.filter((F.col("lang_docs") >= least) | F.col("term").isNull()).drop("lang_docs")


def share(count: Column | str, total: Column | str, kept: Column | str, prior: int = PRIOR, unit: int = UNIT) -> Column:
    """1 + floor(unit * (count + prior) / (total + prior * kept)), in decimals so that no product overflows; 0 without kept terms."""
    above = (F.col(count) if isinstance(count, str) else count) + prior
    below = F.col(total) + prior * F.col(kept)
    ratio = F.call_function("div", above.cast("decimal(19,0)") * F.lit(unit).cast("decimal(12,0)"), below.cast("decimal(19,0)"))
    return F.when(F.col(kept) > 0, 1 + ratio).otherwise(F.lit(0)).cast("long")


def groups_of(cells: DataFrame, prior: int = PRIOR) -> DataFrame:
    """A row for each group: its number g in the language, totals N and V, its share z of an absent term, and the language's figures."""
    is_term = F.col("term").isNotNull()
    leads = lambda c: F.sum((is_term & F.col("leads") & c).cast("long"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), leads(F.lit(True)).alias("led"), leads(F.col("heavy")).alias("led_heavy"))
    lang = Window.partitionBy("lang")
    ranked = own.select(
        "lang", "source", "total", (F.row_number().over(lang.orderBy("source")) - 1).alias("g"), F.count("*").over(lang).alias("sources"),
        F.sum("total").over(lang).alias("lang_total"), F.sum("led").over(lang).alias("kept"), F.sum("led_heavy").over(lang).alias("heavy_terms"),
    )
    return ranked.withColumn("z", share(F.lit(0), "total", "kept", prior))


def _tiled(sources: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of |p - p'| over a tile's terms, for each pair of groups; rows of null term bring every group and its z."""

    def tiled(table: pa.Table) -> pa.Table:
        g, p = table["g"].to_numpy(), table["p"].to_numpy()
        code = table["term"].combine_chunks().dictionary_encode()
        is_group = np.asarray(code.is_null())
        at = np.flatnonzero(is_group)
        ids, first = np.unique(g[at], return_index=True)
        dense = np.repeat(p[at][first][:, None], max(len(code.dictionary), 1), axis=1)
        cells = np.flatnonzero(~is_group)
        dense[np.searchsorted(ids, g[cells]), np.asarray(code.indices.fill_null(0))[cells]] = p[cells]
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        rows = np.flatnonzero(ids // sources == a)
        columns = rows if a == b else np.flatnonzero(ids // sources == b)
        i, j, f = [], [], []
        for r in rows.tolist():
            others = columns[columns > r]
            i.append(np.full(len(others), ids[r]))
            j.append(ids[others])
            f.append(np.abs(dense[others] - dense[r]).sum(1))
        return _pairs(table, i, j, f)

    return tiled


def _pairs(table: pa.Table, i: list[np.ndarray], j: list[np.ndarray], f: list[np.ndarray]) -> pa.Table:
    i, j, f = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (i, j, f))
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(i), pa.string()), "i": i, "j": j, "f": f})


FROM, TO, POSTINGS = 0, 1, 2


def _one_sided(table: pa.Table) -> pa.Table:
    """What groups' own light postings change against other groups' z, and once a pair what absent light terms would give.

    Rows of kind FROM have a group's z and the number of light terms, TO the others' z, POSTINGS a share and how often it occurs.
    """
    kind, g, p, m = (table[c].to_numpy() for c in ("kind", "g", "p", "m"))
    others, z_others = g[kind == TO], p[kind == TO]
    i, j, f = [], [], []
    for s in np.flatnonzero(kind == FROM).tolist():
        own = np.flatnonzero((kind == POSTINGS) & (g == g[s]))
        own = own[np.argsort(p[own])]
        times = np.concatenate([[0], np.cumsum(m[own])])
        mass = np.concatenate([[0], np.cumsum(m[own] * p[own])])
        keep = others != g[s]
        o, z = others[keep], z_others[keep]
        k = np.searchsorted(p[own], z)
        apart = (mass[-1] - mass[k]) - z * (times[-1] - times[k]) + z * times[k] - mass[k]
        absent = np.abs(z - p[s])
        i.append(np.minimum(o, g[s]))
        j.append(np.maximum(o, g[s]))
        f.append(apart - times[-1] * absent + np.where(o > g[s], m[s] * absent, 0))
    return _pairs(table, i, j, f)


PAIRS = "lang string, i long, j long, f long"


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value) for each pair i < j of a language's groups. ``cells`` have p and the group's figures."""
    block = lambda c: F.floor(F.col(c) / SOURCES)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / SOURCES)))
    tiles = F.greatest(F.ceil(F.col("heavy_terms") / TILE_TERMS), F.lit(0))
    heavy = cells.filter("heavy").select("lang", "g", "p", "term", F.pmod(F.xxhash64("term"), tiles).alias("tile"), block("g").alias("x"), every.alias("y"))
    present = groups.filter("heavy_terms > 0").select("lang", "g", F.col("z").alias("p"), F.lit(None).cast("string").alias("term"), block("g").alias("x"), "sources", "heavy_terms", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"))
    present = present.select("lang", "g", "p", "term", "tile", "x", every.alias("y"))
    dealt = heavy.unionByName(present).select("lang", "g", "p", "term", "tile", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    dense = dealt.groupBy("lang", "tile", "a", "b").applyInArrow(_tiled(SOURCES), PAIRS)

    light = cells.filter("not heavy")
    postings = light.groupBy("lang", "g", "p", "sources").agg(F.count("*").alias("m"))
    z = F.col("z").alias("p")
    kinds = [
        groups.select("lang", F.lit(FROM).alias("kind"), "g", z, (F.col("kept") - F.col("heavy_terms")).alias("m"), block("g").alias("x"), every.alias("y")),
        groups.select("lang", F.lit(TO).alias("kind"), "g", z, F.lit(0).cast("long").alias("m"), block("g").alias("y"), every.alias("x")),
        postings.select("lang", F.lit(POSTINGS).alias("kind"), "g", "p", "m", block("g").alias("x"), every.alias("y")),
    ]
    single = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("lang", "x", "y").applyInArrow(_one_sided, PAIRS)

    met = light.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "z"))).alias("held")).filter(F.size("held") > 1)
    two = F.expr("flatten(transform(held, (s, k) -> transform(slice(held, k + 2, size(held)), t -> struct(s, t))))")
    both = met.select("lang", F.explode(two).alias("two")).select(
        "lang", F.col("two.s.g").alias("i"), F.col("two.t.g").alias("j"),
        F.expr("abs(two.s.p - two.t.p) - abs(two.s.p - two.t.z) - abs(two.s.z - two.t.p) + abs(two.s.z - two.t.z)").alias("f"),
    )
    return dense.unionByName(single).unionByName(both).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))


def audited(docs: DataFrame, least: int = LEAST, prior: int = PRIOR, top: int = TOP, light: int = LIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources of the language, and the terms a source has most beyond it."""
    cells = common.written(kept_cells(docs, least, light), "cells")
    groups = common.written(groups_of(cells, prior), "groups")
    small = groups.count() <= BROADCAST_GROUPS
    side = F.broadcast(groups) if small else groups
    known = cells.filter(F.col("term").isNotNull()).join(side, ["lang", "source"])
    known = known.withColumn("p", share("n", "total", "kept", prior))

    q = share("lang_n", "lang_total", "kept", prior)
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value"))
    terms = above.filter("value > 0").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)

    sums = pair_sums(known, groups)
    sums = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    named = groups.select("lang", "g", "source")
    named = F.broadcast(named) if small else named
    pairs = sums.join(named.select("lang", F.col("g").alias("i"), "source"), ["lang", "i"])
    pairs = pairs.join(named.select("lang", F.col("g").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(terms)
