"""Exact nearest neighbours without a window over all pairs: blocks of queries meet blocks of points, and far blocks are ruled out.

Points of a key are put in order of their distance to the origin, one pivot for all, and cut into blocks; queries likewise. By
the triangle inequality a query and a point lie at least as far apart as their distances to the pivot differ. Each block of
queries first meets the block of points nearest in that order, which bounds its k-th neighbours, and then only those blocks
that the bound leaves. A pair of blocks is one task's work, and gives back at most k points a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks, shared
from tidemark.functions.columns import case, over, ratio, series
from tidemark.operators import discovery, learning

c = F.col
BLOCK, SLACK = 2048, 1e-9
KS = (10, 20, 40)
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean(q: np.ndarray, h: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(h)))
    for k in range(q.shape[1]):
        total += (q[:, k, None] - h[None, :, k]) ** 2
    return np.sqrt(total)


def mixed(numbers: int) -> Measure:
    """Numbers differ relative to the greater of their sizes, the rest are categories that differ by 1 or not."""

    def measure(q: np.ndarray, h: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), len(h)))
        for k in range(q.shape[1]):
            a, b = q[:, k, None], h[None, :, k]
            total += ((a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 0.0001)) ** 2 if k < numbers else a != b
        return np.sqrt(total)

    return measure


def _blocked(rows: DataFrame, keys: list[str], ties: list[str], block: int, name: str) -> tuple[DataFrame, DataFrame, bool]:
    """Rows with their block, of each block the range of distances to the pivot, and whether one block holds every key's rows."""
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x))
    at = shared.cut(rows.withColumn("norm", norm), name)
    one = (at.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0) <= block
    if one:
        at = at.withColumn(name, F.lit(0).cast("long"))
    else:
        at = ranks.ranked(at, keys, ["norm", *ties], "_rank", "_total")
        at = shared.cut(at.withColumn(name, F.floor((c("_rank") - 1) / block)).drop("_rank", "_total"), name)
    return at, at.groupBy(*keys, name).agg(F.min("norm").alias(f"{name}_low"), F.max("norm").alias(f"{name}_high")), one


def _met(keys: list[str], ids: list[str], k: int, measure: Measure, places: int | None, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def met(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows or not points.num_rows:
            return schema.empty_table()
        q, h = (np.array(t["z"].to_pylist(), float) for t in (queries, points))
        distance, tie = measure(q, h), points["h_idx"].to_numpy()
        distance = distance if places is None else np.round(distance, places)
        take = min(k, len(h))
        order = np.lexsort((np.broadcast_to(tie, distance.shape), distance), axis=1)[:, :take]
        row, column = np.repeat(np.arange(len(q)), take), order.ravel()
        out = queries.select([*keys, *ids]).take(pa.array(row))
        out = out.append_column("h_idx", points["h_idx"].take(pa.array(column))).append_column("label", points["label"].take(pa.array(column)))
        return out.append_column("distance", pa.array(distance[row, column])).cast(schema)

    return met


def top_k(queries: DataFrame, points: DataFrame, keys: list[str], ids: list[str], k: int, measure: Measure = euclidean, metric: bool = True, places: int | None = 9, block: int = BLOCK) -> DataFrame:
    """(keys, ids, h_idx, label, distance, rank) of each query's k nearest points of equal keys, ties to the smaller h_idx.

    ``queries``: keys, ids, z; ``points``: keys, h_idx, label, z; z is an array of finite numbers. Distances are rounded to ``places``, if given.
    Without ``metric`` the triangle inequality may not hold for ``measure``, and no block is ruled out.
    """
    q, q_blocks, q_one = _blocked(queries.select(*keys, *ids, "z"), keys, ids, block, "q_block")
    h, h_blocks, h_one = _blocked(points.select(*keys, "h_idx", "label", "z"), keys, ["h_idx"], block, "h_block")
    names = dict(q.dtypes)
    ddl = ", ".join(f"{n} {names[n]}" for n in (*keys, *ids)) + ", h_idx long, label string, distance double"
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([*((n, kinds[names[n]]) for n in (*keys, *ids)), ("h_idx", pa.int64()), ("label", pa.string()), ("distance", pa.float64())])
    both, by = [*keys, "q_block", "h_block"], Window.partitionBy(*keys, *ids)

    def search(units: DataFrame) -> DataFrame:
        own = q.join(units.select(*both), [*keys, "q_block"]).groupBy(*both)
        return own.cogroup(h.join(units.select(*both), [*keys, "h_block"]).groupBy(*both)).applyInArrow(_met(keys, ids, k, measure, places, schema), ddl)

    if q_one and h_one:
        found = q.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInArrow(_met(keys, ids, k, measure, places, schema), ddl)
        return found.withColumn("rank", F.row_number().over(by.orderBy("distance", "h_idx")))
    gap = F.greatest(c("h_block_low") - c("q_block_high"), c("q_block_low") - c("h_block_high"), F.lit(0.0))
    units = q_blocks.join(h_blocks, keys).withColumn("gap", gap)
    off = F.abs(c("q_block_low") + c("q_block_high") - c("h_block_low") - c("h_block_high"))
    nth = F.row_number().over(Window.partitionBy(*keys, "q_block").orderBy("gap", off, "h_block"))
    units = shared.cut(units.withColumn("nth", nth), "units")
    found = search(units if not metric else units.filter("nth = 1"))
    if metric and not units.filter("nth > 1").isEmpty():
        first = shared.cut(found, "first")
        reached = first.groupBy(*keys, *ids).agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach"))
        reach = q.select(*keys, *ids, "q_block").join(reached, [*keys, *ids], "left").groupBy(*keys, "q_block").agg(F.max(F.coalesce("reach", F.lit(float("inf")))).alias("reach"))
        rest = units.filter("nth > 1").join(reach, [*keys, "q_block"]).filter(c("gap") <= c("reach") + SLACK)
        found = first.unionByName(search(rest))
    return found.withColumn("rank", F.row_number().over(by.orderBy("distance", "h_idx"))).filter(c("rank") <= k)


def _votes(near: DataFrame, tests: DataFrame, keys: list[str], names: tuple[str, str, str], ks: tuple[int, ...]) -> DataFrame:
    """Counts of the labels ``names`` (rising, flat, falling) among the first k, for each k."""
    many = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(c("rank") <= c("k"))
    counts = many.groupBy(*keys, "k").agg(F.count("*").alias("n"), *(F.count_if(c("label") == x).alias(y) for x, y in zip(names, ("n_rising", "n_flat", "n_falling"), strict=True)))
    every = tests.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return every.join(counts, [*keys, "k"], "left").na.fill(0, ["n", "n_rising", "n_flat", "n_falling"])


STRUCTURE = ("return_15", "return_30", "return_60", "bullish_ratio", "bearish_ratio", "directional_imbalance", "volatility", "volatility_ratio", "location_in_range", "normalized_slope")


def structure_features(bars: DataFrame, n: int = 60) -> DataFrame:
    """Ten numbers of the last ``n`` bars with a regime by score and a volatility regime; bars without ``n`` bars have none."""
    was = lambda k: F.lag("close", k).over(series())
    f = bars.filter("close is not null").withColumn("move", F.when((c("idx") >= 1) & (was(1) != 0), (c("close") - was(1)) / was(1)))
    inside, recent, window = over(2 - n), over(-19), over(1 - n)
    f = f.withColumns({
        **{f"return_{k}": ratio(c("close") - was(back), was(back)) for k, back in ((15, 15), (30, 30), (60, n - 1))},
        "bullish_ratio": F.sum((c("close") > c("open")).cast("double")).over(window) / n, "bearish_ratio": F.sum((c("close") < c("open")).cast("double")).over(window) / n,
        "volatility": F.stddev_pop("move").over(inside), "recent": F.stddev_pop("move").over(recent), "high_n": F.max("high").over(window), "low_n": F.min("low").over(window),
    }).filter((c("idx") >= n - 1) & (c("close") > 0))
    f = f.withColumns({
        "directional_imbalance": c("bullish_ratio") - c("bearish_ratio"), "volatility_ratio": ratio("recent", "volatility"),
        "location_in_range": ratio(c("close") - c("low_n"), c("high_n") - c("low_n")), "normalized_slope": c("return_60"),
    })
    bounds = (("return_15", 0.001), ("return_30", 0.002), ("return_60", 0.003), ("directional_imbalance", 0.05))
    score = sum(((c(x) > b).cast("int") - (c(x) < -b).cast("int") for x, b in bounds), F.lit(0))
    f = f.withColumn("score", score)
    return f.select("series_id", "idx", "close", *STRUCTURE, case((c("score") >= 3, "bullish"), (c("score") >= 1, "bullish_bias"), (c("score") <= -3, "bearish"), (c("score") <= -1, "bearish_bias"), otherwise="neutral").alias("regime"),
                    case((c("volatility_ratio") >= 1.15, "expanding"), (c("volatility_ratio") <= 0.85, "contracting"), otherwise="stable").alias("volatility_regime"))


def _labelled(bars: DataFrame, rows: DataFrame, label: Callable[[Column], Column]) -> DataFrame:
    """Rows by horizon with their label, null while the horizon is open (in the column ``direction``, as walk-forward windows need it)."""
    futures = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(series()).alias("future")) for h in discovery.HORIZONS))
    ahead = bars.withColumn("ahead", futures).select("series_id", "idx", F.explode("ahead").alias("a")).select("series_id", "idx", "a.*")
    rows = rows.join(ahead, ["series_id", "idx"])
    return rows.withColumn("direction", F.when(c("future").isNotNull(), label((c("future") - c("close")) / c("close"))))


BASE = ["series_id", "window_no", "horizon"]


def regime_neighbours(bars: DataFrame, ks: tuple[int, ...] = KS, threshold: float = 0.0015) -> DataFrame:
    """Each test row's nearest training rows of the same regime and volatility regime, in the ten numbers scaled by the window's training rows.

    The commonest label decides (ties: bullish, neutral, bearish): BUY, SELL or NO TRADE, the last too where no such row exists.
    """
    rows = _labelled(bars, structure_features(bars), lambda x: case((x >= threshold, "bullish"), (x <= -threshold, "bearish"), otherwise="neutral"))
    train, test = learning.training_of(bars, rows), learning.tests_of(bars, rows)
    spread = lambda v: F.when(F.stddev_pop(v) > 1e-12, F.stddev_pop(v)).otherwise(1.0)
    scale = train.groupBy(*BASE).agg(*(F.avg(v).alias(f"m_{v}") for v in STRUCTURE), *(spread(v).alias(f"s_{v}") for v in STRUCTURE))
    z = F.array(*((c(v) - c(f"m_{v}")) / c(f"s_{v}") for v in STRUCTURE))
    keys = [*BASE, "regime", "volatility_regime"]
    scaled = lambda df: df.join(F.broadcast(scale), BASE).select(*keys, "idx", "direction", z.alias("z"))
    queries = shared.cut(scaled(test), "queries")
    near = top_k(queries, scaled(train).select(*keys, c("idx").alias("h_idx"), c("direction").alias("label"), "z"), keys, ["idx"], max(ks))
    out = _votes(near, queries.drop("z"), [*keys, "idx"], ("bullish", "neutral", "bearish"), ks)
    most = F.greatest("n_rising", "n_flat", "n_falling")
    says = case((c("n") == 0, "NO TRADE"), (c("n_rising") == most, "BUY"), (c("n_flat") == most, "NO TRADE"), otherwise="SELL")
    return out.withColumns({"says": says, "confidence": F.when(c("n") > 0, most / c("n")).otherwise(0.0)})


MIXED_NUMBERS = tuple(n for n in discovery.NUMBERS if n != "volatility")
MIXED_KINDS = ("directional_regime", "trend_consistency", "volatility_regime", "location_state", "momentum_state", "pressure", "range_event")


def mixed_neighbours(bars: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Each test row's nearest training rows by numbers and categories together: the commoner of BUY and SELL decides, SELL in a tie, and its share of both."""
    f = discovery.features(bars).filter((c("idx") >= discovery.FIRST) & (c("close") > 0))
    momentum = case(((c("return_5") > 0) & (c("return_10") > 0), "bullish"), ((c("return_5") < 0) & (c("return_10") < 0), "bearish"), otherwise="mixed")
    rows = _labelled(bars, f.withColumn("momentum_state", momentum), lambda x: case((x > 0.0005, "BUY"), (x < -0.0005, "SELL"), otherwise="NEUTRAL"))
    values = {**discovery.CATEGORIES, "momentum_state": ("bullish", "bearish", "mixed")}
    code = lambda n: F.array_position(F.array(*map(F.lit, values[n])), c(n)).cast("double")
    z = F.array(*map(c, MIXED_NUMBERS), *map(code, MIXED_KINDS))
    queries = shared.cut(learning.tests_of(bars, rows).select(*BASE, "idx", "direction", z.alias("z")), "queries")
    points = learning.training_of(bars, rows).select(*BASE, c("idx").alias("h_idx"), c("direction").alias("label"), z.alias("z"))
    near = top_k(queries, points, BASE, ["idx"], max(ks), mixed(len(MIXED_NUMBERS)), metric=False)
    out = _votes(near, queries.drop("z"), [*BASE, "idx"], ("BUY", "NEUTRAL", "SELL"), ks)
    both = c("n_rising") + c("n_falling")
    return out.withColumns({"says": case((both == 0, "NO TRADE"), (c("n_rising") > c("n_falling"), "BUY"), otherwise="SELL"), "confidence": F.when(both > 0, F.greatest("n_rising", "n_falling") / both).otherwise(0.0)})


def probability(bars: DataFrame, k: int = 25) -> DataFrame:
    """Class shares of the k nearest training rows of each test row, weighted by exp(-distance / 1.25); ties to the later row."""
    z = shared.cut(learning.standardised(bars), "vectors")
    queries = z.filter("not train").select(*BASE, "idx", "direction", "z")
    points = z.filter("train").select(*BASE, (-c("idx")).alias("h_idx"), c("direction").alias("label"), "z")
    near = top_k(queries, points, BASE, ["idx"], k, places=None)
    # Shares don't depend on a common factor; without it all weights of a far query would be 0.
    near = near.withColumn("least", F.min("distance").over(Window.partitionBy(*BASE, "idx")))
    w = F.exp(-(c("distance") - c("least")) / 1.25)
    shares = near.groupBy(*BASE, "idx").agg(F.count("*").alias("n"), *((F.sum(F.when(c("label") == d, w).otherwise(0.0)) / F.sum(w)).alias(f"p_{d.lower()}") for d in learning.DIRECTIONS))
    return queries.drop("z").join(shares, [*BASE, "idx"])
