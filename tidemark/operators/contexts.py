"""Contexts of each bar: follow-through, pressure, change of range, pace and volume, breaks of ranges and levels, signal vectors. All look back only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, case, over, ratio, series
from tidemark.operators import candles, structure

c = F.col
# Thresholds and names in this module must equal outside ones (fixed values).


def sequence_contexts(bars: DataFrame, k: int = 20, length: int = 5) -> DataFrame:
    """States of the last ``k`` bars, and of the last ``length`` for pressure."""
    was = lambda name, n=1: F.lag(name, n).over(series())
    f = candles.anatomy(bars).withColumns({"n": F.count("*").over(over(1 - k)), "before": was("close"), "change": c("close") - was("close"), "was": was("direction")})
    f = f.withColumn("r", F.when(F.abs("before") > EPS, c("change") / c("before")))
    f = f.withColumns({
        "range_recent": F.avg("range").over(over(-2)), "range_rest": F.avg("range").over(over(1 - k, -3)), "r_recent": F.avg("r").over(over(-2)), "r_rest": F.avg("r").over(over(2 - k, -3)),
        "step_recent": F.avg("change").over(over(-1)), "step_before": F.avg("change").over(over(-3, -2)), "top": F.max("high").over(over(1 - k, -1)), "bottom": F.min("low").over(over(1 - k, -1)),
        "high_k": F.max("high").over(over(1 - k)), "low_k": F.min("low").over(over(1 - k)), "volume_before": F.avg("volume").over(over(1 - k, -1)), "n_volume": F.count("volume").over(over(1 - k)),
        "n_up": F.count_if(c("direction") == "UP").over(over(1 - length)), "n_down": F.count_if(c("direction") == "DOWN").over(over(1 - length)), "was2": was("direction", 2),
    })
    f = f.withColumns({"range_change": F.try_divide("range_recent", "range_rest"), "volume_change": F.try_divide("volume", "volume_before"), "place": F.when(c("high_k") - c("low_k") <= EPS, 0.5).otherwise((c("close") - c("low_k")) / (c("high_k") - c("low_k")))})
    up, down = c("direction") == "UP", c("direction") == "DOWN"
    return f.withColumns({
        "movement": case((c("change") > EPS, "UP"), (c("change") < -EPS, "DOWN"), otherwise="FLAT"),
        "follow_two": case((c("n") < 3, "INSUFFICIENT_DATA"), ((c("was") == "UP") & up & (c("change") >= 0), "BULLISH_FOLLOW_THROUGH"), ((c("was") == "DOWN") & down & (c("change") <= 0), "BEARISH_FOLLOW_THROUGH"), otherwise="NO_CLEAR_FOLLOW_THROUGH"),
        "follow_three": case((c("idx") < 2, "INSUFFICIENT_HISTORY"), (up & (c("was") == "UP") & (c("was2") == "UP"), "BULLISH_FOLLOW_THROUGH"), (down & (c("was") == "DOWN") & (c("was2") == "DOWN"), "BEARISH_FOLLOW_THROUGH"),
                             (up & (c("was") == "DOWN"), "BULLISH_RESPONSE"), (down & (c("was") == "UP"), "BEARISH_RESPONSE"), otherwise="MIXED_FOLLOW_THROUGH"),
        "rejection": case((c("range") <= EPS, "NO_RANGE"), ((c("lower_share") >= 0.45) & (c("lower_share") > c("upper_share")), "LOWER_PRICE_REJECTION"), ((c("upper_share") >= 0.45) & (c("upper_share") > c("lower_share")), "HIGHER_PRICE_REJECTION"),
                          (c("body_share") >= 0.75, "STRONG_BODY"), otherwise="NO_STRONG_REJECTION"),
        "range_state": case((c("n") < 6, "INSUFFICIENT_DATA"), (c("range_rest") <= EPS, "UNDEFINED"), (c("range_change") >= 1.5, "EXPANSION"), (c("range_change") <= 0.67, "COMPRESSION"), otherwise="STABLE"),
        "pace": case((c("n") < 6, "INSUFFICIENT_DATA"), (c("r_recent") > c("r_rest"), "MOMENTUM_INCREASING"), (c("r_recent") < c("r_rest"), "MOMENTUM_DECREASING"), otherwise="MOMENTUM_STABLE"),
        "acceleration": case((c("n") < 5, "INSUFFICIENT_DATA"), (c("step_recent") > c("step_before"), "ACCELERATING_UP"), (c("step_recent") < c("step_before"), "ACCELERATING_DOWN"), otherwise="NO_CLEAR_ACCELERATION"),
        "break_state": case((c("n") < 5, "INSUFFICIENT_DATA"), (c("close") > c("top"), "UPSIDE_BREAK"), (c("close") < c("bottom"), "DOWNSIDE_BREAK"), (c("high") > c("top"), "POSSIBLE_UPSIDE_REJECTION"), (c("low") < c("bottom"), "POSSIBLE_DOWNSIDE_REJECTION"), otherwise="NO_RANGE_BREAK"),
        "volume_state": case((c("n_volume") < 5, "NO_VOLUME_CONTEXT"), (c("volume_before") <= EPS, "UNDEFINED_VOLUME"), (c("volume_change") >= 1.5, "VOLUME_EXPANSION"), (c("volume_change") <= 0.67, "VOLUME_CONTRACTION"), otherwise="NORMAL_VOLUME"),
        "place_state": case((c("place") >= 0.8, "NEAR_RANGE_HIGH"), (c("place") <= 0.2, "NEAR_RANGE_LOW"), otherwise="MID_RANGE"),
        "pressure": case((c("n_up") >= length - 1, "PERSISTENT_BULLISH_PRESSURE"), (c("n_down") >= length - 1, "PERSISTENT_BEARISH_PRESSURE"), (c("n_up") > c("n_down"), "BULLISH_SEQUENCE"), (c("n_down") > c("n_up"), "BEARISH_SEQUENCE"), otherwise="BALANCED_SEQUENCE"),
    })


def pressure_histogram(bars: DataFrame, sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """How often each pressure state occurs for windows of several lengths."""
    parts = [sequence_contexts(bars, length=n).select(F.lit(n).alias("length"), "pressure") for n in sizes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("length", "pressure").agg(F.count("*").alias("n"))


def simple_types(bars: DataFrame) -> DataFrame:
    """The five candle types, the four body strengths, ranges of 4, 8 and 16 bars against the close, volatility against that of ten bars ago, long means."""
    f = candles.features(bars)
    f = f.withColumns({f"span{n}": ratio(F.max("high").over(over(1 - n)) - F.min("low").over(over(1 - n)), c("close")) for n in (4, 8, 16)})
    f = f.withColumns({"volatility_before": F.lag("rolling_volatility", 10).over(series()), "sma50": F.avg("close").over(over(-49)), "sma200": F.avg("close").over(over(-199)), "atr_before": F.lag("range_atr", 1).over(series())})
    b = c("body_share")
    return f.withColumns({
        "type": case((b < 0.1, "doji"), (b > 0.7, "strong"), (c("lower_share") > 0.5, "lower_rejection"), (c("upper_share") > 0.5, "upper_rejection"), otherwise="normal"),
        "strength": case((b >= 0.7, "STRONG"), (b >= 0.4, "MODERATE"), (b >= 0.2, "WEAK"), otherwise="VERY_WEAK"),
        "volatility_change": F.when(c("volatility_before") > EPS, c("rolling_volatility") / c("volatility_before")).otherwise(1.0), "atr_change": ratio(c("range_atr") - c("atr_before"), c("atr_before")),
        "long_bias": case(((c("close") > c("sma20")) & (c("sma20") > c("sma50")) & (c("sma50") > c("sma200")), "BULLISH"), ((c("close") < c("sma20")) & (c("sma20") < c("sma50")) & (c("sma50") < c("sma200")), "BEARISH"), otherwise="NEUTRAL"),
        "volume_level": case((c("volume_ratio") >= 1.5, "HIGH"), (c("volume_ratio") <= 0.5, "LOW"), otherwise="NORMAL"),
    })


def level_structure(bars: DataFrame) -> DataFrame:
    """Swing candidates against 20-bar levels, structure against 50-bar levels seen one bar later, support and resistance behaviour, bias and event code."""
    f = candles.level_events(bars)
    level = lambda fn, name, a, b, least: F.when(F.count("*").over(over(a, b)) >= least, fn(name).over(over(a, b)))
    f = f.withColumns({
        "resistance": level(F.max, "high", -20, -1, 5), "support": level(F.min, "low", -20, -1, 5), "old_high": level(F.max, "high", -51, -2, 10), "old_low": level(F.min, "low", -51, -2, 10),
    })
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    # A flat bar before there is an ATR has no unit to measure in.
    f = f.withColumn("unit", F.when(c("unit") > 1e-9, c("unit")))
    f = f.withColumns({
        "candidate_high": flag(c("high") > c("prior_high")), "candidate_low": flag(c("low") < c("prior_low")), "hh": flag(c("high") > c("old_high")), "lh": flag(c("high") < c("old_high")), "hl": flag(c("low") > c("old_low")), "ll": flag(c("low") < c("old_low")),
        "support_rejection": flag((c("low") <= c("support")) & (c("close") > c("support"))), "resistance_rejection": flag((c("high") >= c("resistance")) & (c("close") < c("resistance"))),
        "support_break": flag(c("close") < c("support")), "resistance_break": flag(c("close") > c("resistance")),
        "support_distance": (c("close") - c("support")) / c("unit"), "resistance_distance": (c("resistance") - c("close")) / c("unit"),
        "support_percent": F.when(F.abs("close") > EPS, (c("close") - c("support")) / c("close") * 100), "strength": c("body") / c("unit"),
        "sweep_depth": case((c("sweep") == "LOW", (c("prior_low") - c("low")) / c("unit")), (c("sweep") == "HIGH", (c("high") - c("prior_high")) / c("unit")), otherwise=F.lit(0.0)),
    })
    score = case(((c("hh") == 1) & (c("hl") == 1), F.lit(2)), ((c("lh") == 1) & (c("ll") == 1), F.lit(-2)), ((c("hh") == 1) | (c("hl") == 1), F.lit(1)), ((c("lh") == 1) | (c("ll") == 1), F.lit(-1)), otherwise=F.lit(0))
    side, choch, bos = F.coalesce("broke", F.lit(0)), c("break_event") == "CHOCH", c("break_event") == "BOS"
    return f.withColumns({
        "swing_score": score, "near_support": flag(F.abs("support_distance") <= 1), "near_resistance": flag(F.abs("resistance_distance") <= 1), "bias": score + side * bos.cast("int") + side * choch.cast("int"),
        "event_code": case((choch, side * 5), (bos, side * 3), (c("sweep") == "LOW", F.lit(2)), (c("sweep") == "HIGH", F.lit(-2)), otherwise=F.lit(0)),
    })


SCALES = (20, 60, 120)


def scale_contexts(bars: DataFrame) -> DataFrame:
    """Direction over 20, 60 and 120 bars (change and majority of candles agree), their weighted vote (1, 2, 3), and whether all agree."""
    f = candles.anatomy(bars)
    for n in SCALES:
        first, up, down = F.first("close").over(over(1 - n)), F.count_if(c("direction") == "UP").over(over(1 - n)), F.count_if(c("direction") == "DOWN").over(over(1 - n))
        f = f.withColumns({f"change{n}": ratio(c("close") - first, first), f"balance{n}": up - down})
        f = f.withColumn(f"direction{n}", case(((c(f"change{n}") > 0) & (c(f"balance{n}") > 0), F.lit(1)), ((c(f"change{n}") < 0) & (c(f"balance{n}") < 0), F.lit(-1)), otherwise=F.lit(0)))
    vote = sum((w * c(f"direction{n}") for w, n in ((2, SCALES[1]), (3, SCALES[2]))), c(f"direction{SCALES[0]}"))
    f = f.withColumn("vote", vote)
    return f.withColumns({
        "integrated": case((c("vote") >= 2, "BULLISH"), (c("vote") <= -2, "BEARISH"), otherwise="MIXED"), "confidence": F.abs("vote") / 6.0,
        "aligned": ((c("direction20") == c("direction60")) & (c("direction60") == c("direction120")) & (c("direction20") != 0)).cast("int"),
    })


def regime_frequency(bars: DataFrame) -> DataFrame:
    return scale_contexts(bars).groupBy("series_id", "integrated").agg(F.count("*").alias("n"))


def segment_features(bars: DataFrame, n: int = 60) -> DataFrame:
    """Numbers of the last 60 bars: returns, shares of rising and falling candles, volatility and its change, place, slope, halves."""
    f = candles.features(bars).withColumn("up", (c("direction") == "UP").cast("double")).withColumn("down", (c("direction") == "DOWN").cast("double"))
    back = lambda k: F.when(c("idx") >= k, ratio(c("close") - F.lag("close", k).over(series()), F.lag("close", k).over(series()))).otherwise(0.0)
    w, half = over(1 - n), n // 2
    f = f.withColumns({f"r{k}": back(k) for k in (5, 10, 20, 40)})
    f = f.withColumns({
        "up_share": F.avg("up").over(w), "down_share": F.avg("down").over(w), "vol_short": F.stddev_pop("r1").over(over(-9)), "vol_long": F.stddev_pop("r1").over(w), "high_n": F.max("close").over(w), "low_n": F.min("close").over(w),
        "slope": ratio(F.covar_pop("close", c("idx").cast("double")).over(w), F.var_pop(c("idx").cast("double")).over(w)), "range_late": F.avg("range").over(over(1 - half)), "range_early": F.avg("range").over(over(1 - n, -half)),
        "body_late": F.avg("body").over(over(1 - half)), "body_early": F.avg("body").over(over(1 - n, -half)),
    })
    halves = lambda a, b: case((c(b).isNull(), "UNKNOWN"), (c(a) > c(b) * 1.1, "RISING"), (c(a) < c(b) * 0.9, "FALLING"), otherwise="STEADY")
    return f.withColumns({
        "imbalance": c("up_share") - c("down_share"), "vol_ratio": F.when(c("vol_long") > EPS, c("vol_short") / c("vol_long")).otherwise(1.0), "place": F.when(c("high_n") - c("low_n") > EPS, (c("close") - c("low_n")) / (c("high_n") - c("low_n"))).otherwise(0.5),
        "slope_share": ratio("slope", "close"), "acceleration": c("r5") - c("r10") / 2, "range_half": halves("range_late", "range_early"), "body_half": halves("body_late", "body_early"),
    })


def segment_states(bars: DataFrame) -> DataFrame:
    """The numbers of the last 60 bars as states by fixed thresholds."""
    f = segment_features(bars)
    return f.withColumns({
        "volatility_state": case((c("vol_ratio") >= 1.25, "HIGH"), (c("vol_ratio") <= 0.75, "LOW"), otherwise="NORMAL"), "location_state": case((c("place") >= 0.67, "UPPER"), (c("place") <= 0.33, "LOWER"), otherwise="MIDDLE"),
        "direction_state": case((c("r20") > 0.002, "UP"), (c("r20") < -0.002, "DOWN"), otherwise="FLAT"), "momentum_state": case((c("acceleration") > 0, "RISING"), (c("acceleration") < 0, "FALLING"), otherwise="FLAT"),
        "pressure_state": case((c("imbalance") >= 0.2, "BUYING"), (c("imbalance") <= -0.2, "SELLING"), otherwise="BALANCED"),
    })


def signal_vectors(bars: DataFrame) -> DataFrame:
    """Each bar's signal as an array of 25 numbers: returns, spans and candle in ATR, distances and ages of levels (999 where there is none), ratios, one-hot states."""
    s = structure.market_states(bars)
    n = lambda x: x.cast("double")
    flag = lambda x: n(F.coalesce(x, F.lit(False)).cast("int"))
    age = lambda x: F.when(c(x).isNull(), 999.0).otherwise((c("idx") - c(x)) / 32.0)
    away = lambda a, b: F.when(c("unit") > 1e-9, F.coalesce((a - b) / c("unit"), F.lit(999.0))).otherwise(999.0)
    span = lambda k: ratio(F.max("high").over(over(1 - k)) - F.min("low").over(over(1 - k)), c("close"))
    r32 = F.when(c("idx") >= 32, ratio(c("close") - F.lag("close", 32).over(series()), F.lag("close", 32).over(series()))).otherwise(0.0)
    parts = [
        c("r1"), c("r3"), c("r8"), c("r16"), r32, span(4), span(8), span(16), c("body") / c("unit"), c("range") / c("unit"), c("upper") / c("unit"), c("lower") / c("unit"), away(c("last_high"), c("close")), away(c("close"), c("last_low")),
        age("high_seen"), age("low_seen"), age("event_index"), c("volatility_ratio"), F.log1p("volume_ratio"), flag(c("trend") == "BULLISH"), flag(c("trend") == "BEARISH"), flag(c("event").endswith("BULLISH")), flag(c("event").endswith("BEARISH")),
        flag(c("regime") == "VOL_EXPANSION"), flag(c("regime") == "VOL_CONTRACTION"),
    ]
    return s.select("series_id", "idx", F.array(*(n(p) for p in parts)).alias("signal"))
