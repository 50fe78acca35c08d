"""What follows a break of structure: its distance and strength, acceptance, retest and phase, and the sequence machine on them.

The machine's thirteen states depend on the state before only through whether that was IMPULSE_PULLBACK. Whether a bar is
IMPULSE_PULLBACK follows from the bar's own window and event alone, so one look back takes the place of a running state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import case, over, series
from tidemark.operators import behaviour, candles, structure

c = F.col
LENGTH, RETURN_AGE = 8, 4


def accepted(bars: DataFrame) -> DataFrame:
    """Structure events with level, side, distance and strength in ATR, acceptance, retest and phase; ``bars`` have the columns of candles.features."""
    s = structure.structure(bars)
    bullish, happens = c("event").endswith("BULLISH"), c("event") != "NONE"
    carried = lambda x: F.last(F.when(happens, x), ignorenulls=True).over(over(None))
    s = s.withColumns({
        "event_direction": F.coalesce(carried(case((bullish, "BULLISH"), otherwise="BEARISH")), F.lit("NONE")),
        "event_level": carried(F.when(bullish, c("last_high")).otherwise(c("last_low"))),
    })
    side = F.when(c("event_direction") == "BULLISH", F.lit(1.0)).otherwise(F.lit(-1.0))
    s = s.withColumn("beyond", (c("close") - c("event_level")) * side)
    since = Window.partitionBy("series_id", "event_index").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("closes_beyond", F.sum((c("beyond") > 0).cast("long")).over(since))
    distance = F.coalesce(c("beyond") / c("unit"), F.lit(0.0))
    old = c("event_age") >= 1
    s = s.withColumns({
        "break_distance": distance, "break_strength": F.greatest(distance, F.lit(0.0)),
        "acceptance": case((c("event_age").isNull() | ~old, "NONE"), ((c("beyond") < 0) & (c("event_age") <= RETURN_AGE), "REJECTED"), (c("closes_beyond") >= F.least(F.lit(3), c("event_age") + 1), "ACCEPTED"), otherwise="PENDING"),
        "retest": case((old & (F.abs("beyond") <= c("unit")), case((c("beyond") > 0, "HOLD"), otherwise="FAIL")), otherwise="NONE"),
    })
    return s.withColumn("phase", case((c("event_age").isNull(), "NEUTRAL"), (c("event_age") == 0, "BREAK"), (c("acceptance") == "ACCEPTED", "POST_BREAK"), otherwise="TRANSITION"))


def structure_acceptance(bars: DataFrame) -> DataFrame:
    return accepted(candles.features(bars))


def sequence_machine(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """The state of each bar, the one before it, the transition ("NONE" where nothing changes) and the counts of its last bars."""
    s = accepted(behaviour.normalised_anatomy(bars))
    w = over(1 - length)
    count = lambda x: F.sum(x.cast("long")).over(w)
    s = s.withColumns({
        "impulses": count((c("body_span") >= 0.60) & (c("growth") >= 1.10)), "falls": count(c("direction") == "DOWN"), "rises": count(c("direction") == "UP"),
        "compressions": count((c("type") == "COMPRESSION") | (c("growth") <= 0.70)), "expands": c("growth") >= 1.35,
    })
    s = s.withColumn("pullbacks", case((c("trend") == "BULLISH", c("falls")), (c("trend") == "BEARISH", c("rises")), otherwise=F.lit(0).cast("long")))
    with_trend = case((c("trend") == "BULLISH", "UP"), otherwise="DOWN")
    against = case((c("trend") == "BULLISH", "DOWN"), otherwise="UP")
    event, pulled = c("event") != "NONE", (c("impulses") >= 2) & (c("pullbacks") >= 1)
    s = s.withColumn("is_pullback", ~event & (c("acceptance") != "REJECTED") & (c("retest") != "HOLD") & pulled)
    after = F.coalesce(F.lag("is_pullback").over(series()), F.lit(False))
    trending = c("trend") != "NEUTRAL"
    state = case(
        (event & (c("event_direction") == "BULLISH"), "BULLISH_BREAK"), (event, "BEARISH_BREAK"), (c("acceptance") == "REJECTED", "FAILED_BREAK"), (c("retest") == "HOLD", "BREAK_RETEST_HOLD"),
        (pulled, "IMPULSE_PULLBACK"), (after & trending & (c("direction") == with_trend), "PULLBACK_CONTINUATION"), (after & (c("direction") == against), "PULLBACK_FAILURE"),
        ((c("compressions") >= 3) & c("expands"), "COMPRESSION_EXPANSION"), (c("expands"), "IMPULSE"), (c("compressions") >= 3, "COMPRESSION"), (trending, "TREND_CONTINUATION"), otherwise="MIXED",
    )
    s = s.withColumn("sequence", state).withColumn("before", F.coalesce(F.lag("sequence").over(series()), F.lit("INITIAL")))
    return s.withColumn("transition", case((c("sequence") != c("before"), F.concat_ws("->", "before", "sequence")), otherwise="NONE"))
