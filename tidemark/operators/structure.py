"""Confirmed swings, breaks of structure, trend, market states and episodes: windows only, each reading rows at or before its bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, case, over, series
from tidemark.operators.candles import features

c = F.col
GAP = 8


def _carried(value: Column | str, last: int = 0) -> Column:
    return F.last(value, ignorenulls=True).over(over(None, last))


def swings(bars: DataFrame, left: int = 3, right: int = 3, strict: bool = True) -> DataFrame:
    """Adds pivot_high, pivot_low (confirmed at this bar, ``right`` bars after the pivot) and their labels."""
    high, low = F.lag("high", right).over(series()), F.lag("low", right).over(series())
    sides = [over(-right - left, -right - 1), over(1 - right)]
    above = lambda w: high > F.max("high").over(w) if strict else high >= F.max("high").over(w)
    below = lambda w: low < F.min("low").over(w) if strict else low <= F.min("low").over(w)
    enough = c("idx") >= left + right
    out = bars.withColumn("pivot_high", F.when(enough & above(sides[0]) & above(sides[1]), high)).withColumn("pivot_low", F.when(enough & below(sides[0]) & below(sides[1]), low))
    before_high, before_low = _carried("pivot_high", -1), _carried("pivot_low", -1)
    return out.withColumns({
        "high_mark": F.when(c("pivot_high").isNotNull(), case((before_high.isNull() | (c("pivot_high") > before_high), "HH"), otherwise="LH")),
        "low_mark": F.when(c("pivot_low").isNotNull(), case((before_low.isNull() | (c("pivot_low") > before_low), "HL"), otherwise="LL")),
    })


def structure(bars: DataFrame) -> DataFrame:
    """Swings carried forward, and the first close beyond each pivot: with the trend a BOS, against it a CHoCH."""
    s = swings(bars)
    s = s.withColumns({
        "last_high": _carried("pivot_high"), "last_low": _carried("pivot_low"), "high_label": F.coalesce(_carried("high_mark"), F.lit("UNKNOWN")), "low_label": F.coalesce(_carried("low_mark"), F.lit("UNKNOWN")),
        "high_seen": _carried(F.when(c("pivot_high").isNotNull(), c("idx"))), "low_seen": _carried(F.when(c("pivot_low").isNotNull(), c("idx"))),
    })
    up = F.coalesce((c("idx") > c("high_seen")) & (c("close") > c("last_high")), F.lit(False))
    down = F.coalesce((c("idx") > c("low_seen")) & (c("close") < c("last_low")), F.lit(False))
    s = s.withColumn("over_high", up.cast("int")).withColumn("under_low", down.cast("int"))
    nth = lambda flag, seen: F.sum(flag).over(Window.partitionBy("series_id", seen).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("broke_up", (c("over_high") == 1) & (nth("over_high", "high_seen") == 1)).withColumn("broke_down", (c("under_low") == 1) & (nth("under_low", "low_seen") == 1))
    s = s.withColumn("turn", case((c("broke_down"), "BEARISH"), (c("broke_up"), "BULLISH"), otherwise=F.lit(None).cast("string")))
    s = s.withColumns({"trend": F.coalesce(_carried("turn"), F.lit("NEUTRAL")), "trend_before": F.coalesce(_carried("turn", -1), F.lit("NEUTRAL")), "event_index": _carried(F.when(c("turn").isNotNull(), c("idx")))})
    against_up, against_down = c("trend_before") == "BEARISH", c("trend_before") == "BULLISH"
    event = case((c("broke_up") & against_up, "CHoCH_BULLISH"), (c("broke_up"), "BOS_BULLISH"), (c("broke_down") & against_down, "CHoCH_BEARISH"), (c("broke_down"), "BOS_BEARISH"), otherwise="NONE")
    return s.withColumns({"event": event, "event_age": c("idx") - c("event_index"), "structure_age": c("idx") - F.coalesce("event_index", F.lit(0))})


def simple_structure(bars: DataFrame) -> DataFrame:
    """Snapshot with 2/2 pivots, ties allowed: a break is reported at every bar beyond the level."""
    s = swings(bars, 2, 2, strict=False)
    s = s.withColumns({
        "last_high": _carried("pivot_high"), "last_low": _carried("pivot_low"), "high_label": F.coalesce(_carried("high_mark"), F.lit("UNKNOWN")), "low_label": F.coalesce(_carried("low_mark"), F.lit("UNKNOWN")),
        "high_seen": _carried(F.when(c("pivot_high").isNotNull(), c("idx"))), "low_seen": _carried(F.when(c("pivot_low").isNotNull(), c("idx"))),
    })
    up, down = (c("idx") > c("high_seen")) & (c("close") > c("last_high")), (c("idx") > c("low_seen")) & (c("close") < c("last_low"))
    s = s.withColumn("event", case((up, "BOS_BULLISH"), (down, "BOS_BEARISH"), otherwise="NONE"))
    trend = case((c("event") == "BOS_BULLISH", "bullish"), (c("event") == "BOS_BEARISH", "bearish"), ((c("high_label") == "HH") & (c("low_label") == "HL"), "bullish"), ((c("high_label") == "LH") & (c("low_label") == "LL"), "bearish"), otherwise="range")
    return s.withColumn("trend", trend)


def market_states(bars: DataFrame) -> DataFrame:
    """Structure and features with location, regime, momentum, sequence and the state key of the eight."""
    s = structure(features(bars))
    one, two = F.lag("close", 1).over(series()), F.lag("close", 2).over(series())
    s = s.withColumns({"close_1": one, "close_2": two})
    vol, r1, r3, r8 = c("volatility_ratio"), c("r1"), c("r3"), c("r8")
    s = s.withColumns({
        "location": case((F.abs(c("close") - c("last_low")) <= c("unit"), "NEAR_SUPPORT"), (F.abs(c("close") - c("last_high")) <= c("unit"), "NEAR_RESISTANCE"), otherwise="MID_STRUCTURE"),
        "regime": case((vol >= 1.35, "VOL_EXPANSION"), (vol <= 0.75, "VOL_CONTRACTION"), ((c("trend") == "BULLISH") & (r8 > 0), "TRENDING_UP"), ((c("trend") == "BEARISH") & (r8 < 0), "TRENDING_DOWN"), (c("trend") == "NEUTRAL", "RANGING"), otherwise="TRANSITION"),
        "momentum": case(((r1 > 0) & (r3 > 0) & (r8 > 0), "BULLISH_ACCELERATION"), ((r1 < 0) & (r3 < 0) & (r8 < 0), "BEARISH_ACCELERATION"), ((r8 > 0) & (r1 < 0), "BULLISH_MOMENTUM_LOSS"), ((r8 < 0) & (r1 > 0), "BEARISH_MOMENTUM_LOSS"), otherwise="MIXED"),
        "sequence": case((c("idx") < 2, "INITIAL"), (c("event").endswith("BULLISH"), "BULLISH_BREAK"), (c("event").endswith("BEARISH"), "BEARISH_BREAK"),
                         ((c("close") > c("close_1")) & (c("close_1") <= c("close_2")), "BULLISH_RESPONSE"), ((c("close") < c("close_1")) & (c("close_1") >= c("close_2")), "BEARISH_RESPONSE"),
                         (c("body") < 0.25 * F.greatest("range", F.lit(EPS)), "COMPRESSION"), (c("trend") == "BULLISH", "RECOVERY_OR_CONTINUATION"), (c("trend") == "BEARISH", "SELLING_OR_CONTINUATION"), otherwise="MIXED_SEQUENCE"),
    })
    return s.withColumn("state_key", F.concat_ws("|", "trend", "event", "high_label", "low_label", "location", "regime", "momentum", "sequence"))


def episodes(bars: DataFrame) -> DataFrame:
    """Market states with episode numbers: a new one at every change of trend, regime or sequence, at every event, and every GAP bars."""
    s = market_states(bars)
    was = lambda x: F.lag(x).over(series())
    changed = (c("idx") > 0) & ((c("trend") != was("trend")) | (c("regime") != was("regime")) | (c("sequence") != was("sequence")) | (c("event") != "NONE"))
    s = s.withColumn("changed", changed.cast("long")).withColumn("run", F.sum("changed").over(over(None)))
    s = s.withColumn("offset", F.row_number().over(Window.partitionBy("series_id", "run").orderBy("idx")) - 1)
    starts = ((c("changed") == 1) | ((c("offset") > 0) & (c("offset") % GAP == 0))).cast("long")
    return s.withColumn("starts", starts).withColumn("episode", F.sum("starts").over(over(None)))


def regime_runs(states: DataFrame) -> DataFrame:
    """Persistence (bars so far in the regime), stability over the last 20 bars, kind of transition."""
    s = states.withColumn("before", F.lag("regime").over(series())).withColumn("new", F.coalesce((c("regime") != c("before")).cast("long"), F.lit(0)))
    s = s.withColumn("island", F.sum("new").over(over(None)))
    persistence = F.row_number().over(Window.partitionBy("series_id", "island").orderBy("idx")).cast("long")
    return s.withColumns({"persistence": persistence, "stability": 1 - F.avg("new").over(over(-19)), "transition": case((c("new") == 1, F.concat_ws(">", "before", "regime")), otherwise="NONE")})


def zones(bars: DataFrame, width: float = 0.6) -> DataFrame:
    """Price zones of confirmed pivots: prices in order, a new zone where a price is more than ``width`` mean ATRs above the one below; touches counted by a bounded range join."""
    s = swings(features(bars))
    tolerance = s.groupBy("series_id").agg((F.avg("range_atr") * width).alias("tolerance"))
    pivots = s.select("series_id", F.explode(F.array_compact(F.array("pivot_high", "pivot_low"))).alias("price"))
    by_price = Window.partitionBy("series_id").orderBy("price")
    marked = pivots.join(tolerance, "series_id").withColumn("new", F.coalesce((c("price") - F.lag("price").over(by_price) > c("tolerance")).cast("long"), F.lit(1)))
    numbered = marked.withColumn("zone", F.sum("new").over(by_price.rangeBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("series_id", "zone").agg(F.min("price").alias("zone_low"), F.max("price").alias("zone_high"), F.count("*").alias("n_pivots"))
    touch = (c("low") <= c("zone_high")) & (c("high") >= c("zone_low"))
    closes_out = (c("close") > c("zone_high")) | (c("close") < c("zone_low"))
    return bars.join(found, "series_id").filter(touch).groupBy("series_id", "zone", "zone_low", "zone_high", "n_pivots").agg(F.count("*").alias("n_touches"), F.count_if(closes_out).alias("n_rejections"), F.max("idx").alias("last_touch"))
