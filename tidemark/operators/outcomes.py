"""Outcomes after a bar: they read the future and are kept apart from features; joined only to rows whose horizon has passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import case, over, ratio, series
from tidemark.operators.candles import features

c = F.col
HORIZONS = (4, 8, 16)
BAND = 0.25


def _ahead(h: int) -> Column:
    future, high, low = F.lead("close", h).over(series()), F.max("high").over(over(1, h)), F.min("low").over(over(1, h))
    path = F.collect_list(F.struct("high", "low")).over(over(1, h))
    return F.struct(F.lit(h).alias("horizon"), future.alias("future"), high.alias("future_high"), low.alias("future_low"), path.alias("ahead"))


def outcomes(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, band: float = BAND) -> DataFrame:
    """One row a bar and horizon: direction by a band of ``band`` ATR, by 0.1 % of price, returns, excursions in ATR, first time of each, completeness.

    All horizons are windows over one sorted pass, exploded at the end.
    """
    f = features(bars)
    rows = f.select("series_id", "idx", "close", "atr", *(_ahead(h).alias(f"after{h}") for h in horizons))
    rows = rows.select("series_id", "idx", "close", "atr", F.explode(F.array(*(f"after{h}" for h in horizons))).alias("x")).select("series_id", "idx", "close", "atr", "x.*")
    rows = rows.withColumns({"change": c("future") - c("close"), "complete": c("future").isNotNull() & c("atr").isNotNull()}).withColumn("atr_return", ratio("change", "atr"))
    return rows.withColumns({
        "raw_return": ratio("change", "close"), "quality": case((c("complete"), "COMPLETE"), otherwise="INCOMPLETE"),
        "direction": F.when(c("complete"), case((c("atr_return") > band, "UP"), (c("atr_return") < -band, "DOWN"), otherwise="NEUTRAL")),
        "price_direction": F.when(c("future").isNotNull(), case((c("change") > F.greatest(c("close") * 0.001, F.lit(1e-9)), "bullish"), (-c("change") > F.greatest(c("close") * 0.001, F.lit(1e-9)), "bearish"), otherwise="neutral")),
        "mfe_atr": F.when(c("complete"), ratio(c("future_high") - c("close"), c("atr"))), "mae_atr": F.when(c("complete"), ratio(c("future_low") - c("close"), c("atr"))),
        "time_to_high": F.when(c("complete"), F.array_position(F.transform("ahead", lambda x: x["high"]), c("future_high"))), "time_to_low": F.when(c("complete"), F.array_position(F.transform("ahead", lambda x: x["low"]), c("future_low"))),
    })


#: Price bands by name: width as a share of the price, and whether the edge itself counts as a move (fixed values).
BANDS = {"b05": (0.0005, False), "b15": (0.0015, True), "b03": (0.0003, False), "b01": (0.0001, False)}


def other_labels(bars: DataFrame) -> DataFrame:
    """Outcomes under other rules: clipped excursions along and against the move, four classes by one ATR, two classes, price bands."""
    rows = outcomes(bars).filter("complete")
    up = c("change") > 0
    along = case((c("change") == 0, F.lit(None).cast("double")), (up, c("mfe_atr")), otherwise=-c("mae_atr"))
    against = case((c("change") == 0, F.lit(None).cast("double")), (up, -c("mae_atr")), otherwise=c("mfe_atr"))
    edge = lambda w, inclusive: ((c("raw_return") >= w), (c("raw_return") <= -w)) if inclusive else ((c("raw_return") > w), (c("raw_return") < -w))
    bands = {n: case((edge(*b)[0], "UP"), (edge(*b)[1], "DOWN"), otherwise="NEUTRAL") for n, b in BANDS.items()}
    strong = F.when(c("change") != 0, case((c("atr_return") >= 1, "STRONG_UP"), (c("atr_return") <= -1, "STRONG_DOWN"), (up, "UP"), otherwise="DOWN"))
    return rows.withColumns({
        "mfe_clipped": F.greatest("mfe_atr", F.lit(0.0)), "mae_clipped": F.greatest(-c("mae_atr"), F.lit(0.0)), "along": F.greatest(along, F.lit(0.0)), "against": F.greatest(against, F.lit(0.0)),
        "strength": strong, "two_way": F.when(c("change") != 0, F.when(up, 1).otherwise(0)), **bands,
    })


def excursion_summary(bars: DataFrame) -> DataFrame:
    rows = other_labels(bars)
    return rows.groupBy("horizon", "strength").agg(F.count("*").alias("n"), F.avg("along").alias("mean_along"), F.avg("against").alias("mean_against"))


def distribution(rows: DataFrame) -> DataFrame:
    done = rows.filter("complete")
    share = lambda d: F.avg((c("direction") == d).cast("double"))
    return done.groupBy("series_id", "horizon").agg(
        F.count("*").alias("n"), share("UP").alias("up"), share("DOWN").alias("down"), share("NEUTRAL").alias("neutral"),
        F.avg("raw_return").alias("mean_return"), F.percentile("raw_return", 0.5).alias("median_return"), F.avg("mfe_atr").alias("mean_mfe"), F.avg("mae_atr").alias("mean_mae"),
    )


def threshold_grid(rows: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """Candidates for a band, from the rows given (training rows only, if a choice follows): share of directional outcomes less 20 times their imbalance."""
    grid = rows.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    out = grid.groupBy(*keys, "threshold").agg(F.count_if(c("atr_return") > c("threshold")).alias("n_up"), F.count_if(c("atr_return") < -c("threshold")).alias("n_down"), F.count("*").alias("n"))
    return out.withColumn("score", 100 * (c("n_up") + c("n_down")) / c("n") - 20 * F.abs(c("n_up") - c("n_down")) / F.greatest(c("n_up") + c("n_down"), F.lit(1)))


def best_threshold(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of the best score, the smallest of equal ones."""
    return grid.groupBy(*keys).agg(F.max_by(F.struct("threshold", "score"), F.struct(F.round("score", 9), -c("threshold"))).alias("b")).select(*keys, "b.threshold", "b.score")
