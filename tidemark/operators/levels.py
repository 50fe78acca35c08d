"""Levels from confirmed swings: alternating swings, place among the last ten, scores of labels, price zones and the nearest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, case, over
from tidemark.operators import candles, structure

c = F.col
LOOKBACK = 240


def pivots(bars: DataFrame, right: int = 3) -> DataFrame:
    """(series_id, seen, pivot_idx, kind, price, mark): both kinds of confirmed swings in one table; seen is the bar that confirms it."""
    s = structure.swings(candles.features(bars))
    side = lambda kind, price, mark: F.when(c(price).isNotNull(), F.struct(F.lit(kind).alias("kind"), c(price).alias("price"), c(mark).alias("mark")))
    both = F.array_compact(F.array(side("HIGH", "pivot_high", "high_mark"), side("LOW", "pivot_low", "low_mark")))
    return s.select("series_id", c("idx").alias("seen"), (c("idx") - right).alias("pivot_idx"), F.explode(both).alias("p")).select("series_id", "seen", "pivot_idx", "p.kind", "p.price", "p.mark")


def alternating(bars: DataFrame) -> DataFrame:
    """Runs of swings of one kind, each reduced to its extreme (of equal ones the latest)."""
    w = Window.partitionBy("series_id").orderBy("pivot_idx", "kind")
    p = pivots(bars).withColumn("new", F.coalesce((c("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1)))
    p = p.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    height = F.when(c("kind") == "HIGH", c("price")).otherwise(-c("price"))
    best = F.max_by(F.struct("price", "pivot_idx"), F.struct(height, "pivot_idx"))
    return p.groupBy("series_id", "run", "kind").agg(best.alias("b"), F.count("*").alias("n")).select("series_id", "run", "kind", "b.price", "b.pivot_idx", "n")


def swing_places(bars: DataFrame, n: int = 10, labels: int = 6) -> DataFrame:
    """Each bar's place in the range of the last ``n`` swings seen by then (0.5 with less than two), and the score of the last ``labels`` marks."""
    w = Window.partitionBy("series_id").orderBy("seen", "kind")
    good = F.when(c("mark").isin("HH", "HL"), 1).otherwise(-1)
    p = pivots(bars).withColumns({
        "top": F.max("price").over(w.rowsBetween(1 - n, 0)), "bottom": F.min("price").over(w.rowsBetween(1 - n, 0)), "held": F.count("*").over(w.rowsBetween(1 - n, 0)), "score": F.sum(good).over(w.rowsBetween(1 - labels, 0)),
    })
    last = p.groupBy("series_id", c("seen").alias("idx")).agg(F.max_by(F.struct("top", "bottom", "held", "score"), "kind").alias("p"))
    f = bars.join(last, ["series_id", "idx"], "left").withColumn("p", F.last("p", ignorenulls=True).over(over(None)))
    known = (c("p.held") >= 2) & (c("p.top") - c("p.bottom") > EPS)
    f = f.select("series_id", "idx", F.when(known, (c("close") - c("p.bottom")) / (c("p.top") - c("p.bottom"))).otherwise(0.5).alias("place"), F.coalesce("p.score", F.lit(0)).cast("int").alias("score"))
    return f.withColumns({"location": case((c("place") >= 0.67, "HIGH"), (c("place") <= 0.33, "LOW"), otherwise="MIDDLE"), "label_trend": case((c("score") >= 2, "BULLISH"), (c("score") <= -2, "BEARISH"), otherwise="NEUTRAL")})


def price_zones(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Zones of highs (RESISTANCE) and lows (SUPPORT) as of each series' last bar, from swings and bars of the last ``lookback`` bars.

    Prices in order; a price begins a new zone where it is further than the tolerance from the running mean of the zone
    below. That depends on what was joined before, so the prices of a series, at most lookback of them, are folded as one array.
    """
    last = candles.features(bars).groupBy("series_id").agg(F.max("idx").alias("last_idx"), F.max_by(F.struct("close", "range_atr"), "idx").alias("l"))
    last = last.select("series_id", "last_idx", c("l.close").alias("last_close"), F.greatest(0.6 * c("l.range_atr"), 0.001 * c("l.close")).alias("tolerance"))
    recent = pivots(bars).join(last, "series_id").filter(c("pivot_idx") >= c("last_idx") - lookback)
    grouped = recent.groupBy("series_id", "kind", "tolerance", "last_idx", "last_close").agg(F.sort_array(F.collect_list("price")).alias("prices"))
    zone = "array<struct<low:double,high:double,total:double,n:int>>"
    begin = lambda x: F.struct(x.alias("low"), x.alias("high"), x.alias("total"), F.lit(1).alias("n"))

    def join(zones, x):
        top = F.element_at(zones, -1)
        grown = F.struct(top["low"].alias("low"), x.alias("high"), (top["total"] + x).alias("total"), (top["n"] + 1).alias("n"))
        new = (F.size(zones) == 0) | (F.abs(x - F.try_element_at(zones, F.lit(-1))["total"] / F.try_element_at(zones, F.lit(-1))["n"]) > c("tolerance"))
        return F.when(new, F.array_append(zones, begin(x))).otherwise(F.array_append(F.slice(zones, 1, F.size(zones) - 1), grown))

    found = grouped.withColumn("zones", F.aggregate("prices", F.array().cast(zone), join)).select("*", F.posexplode("zones").alias("zone", "z"))
    pad = c("tolerance") * 0.25
    found = found.select("series_id", F.when(c("kind") == "HIGH", "RESISTANCE").otherwise("SUPPORT").alias("kind"), "zone", (c("z.low") - pad).alias("zone_low"), (c("z.high") + pad).alias("zone_high"), (c("z.total") / c("z.n")).alias("center"), c("z.n").alias("n_swings"), "last_idx", "last_close")
    # Zones of a series are few (a swing each at most), so bars meet them by series and a range condition.
    touch = bars.select("series_id", "idx", "high", "low", "close").join(found, "series_id").filter((c("idx") >= c("last_idx") - lookback) & (c("high") >= c("zone_low")) & (c("low") <= c("zone_high")))
    back = ((c("kind") == "RESISTANCE") & (c("close") < c("center"))) | ((c("kind") == "SUPPORT") & (c("close") > c("center")))
    tests = touch.groupBy("series_id", "kind", "zone").agg(F.count("*").alias("n_tests"), F.count_if(back).alias("n_rejections"), F.max("idx").alias("last_test"))
    return found.join(tests, ["series_id", "kind", "zone"], "left").withColumns({"n_tests": F.coalesce("n_tests", F.lit(0)), "n_rejections": F.coalesce("n_rejections", F.lit(0))})


def nearest_zones(bars: DataFrame) -> DataFrame:
    """Of each series and kind the nearest zone below the last close and the nearest above."""
    z = price_zones(bars).withColumns({"side": case((c("center") < c("last_close"), "BELOW"), (c("center") > c("last_close"), "ABOVE"), otherwise="AT"), "distance": F.abs(c("center") - c("last_close"))})
    best = F.min_by(F.struct("zone", "center", "distance", "n_tests"), F.struct("distance", "zone"))
    return z.filter("side <> 'AT'").groupBy("series_id", "kind", "side").agg(best.alias("b")).select("series_id", "kind", "side", "b.zone", "b.center", "b.distance", "b.n_tests")
