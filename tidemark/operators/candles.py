"""Candle anatomy, classes and language, rolling features, indicators, and named patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, case, over, ratio, series

c = F.col


def anatomy(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({
        "range": c("high") - c("low"), "body": F.abs(c("close") - c("open")),
        "upper": c("high") - F.greatest("open", "close"), "lower": F.least("open", "close") - c("low"),
        "direction": case((c("close") > c("open"), "UP"), (c("close") < c("open"), "DOWN"), otherwise="FLAT"),
    })
    return out.withColumns({"body_share": ratio("body", "range"), "upper_share": ratio("upper", "range"), "lower_share": ratio("lower", "range"), "close_location": ratio(c("close") - c("low"), c("range"))})


def features(bars: DataFrame) -> DataFrame:
    """Anatomy with true range, ATR over 14 rows (null before), returns, volatility ratio and rolling levels."""
    before = F.lag("close").over(series())
    out = anatomy(bars).withColumn("true_range", F.coalesce(F.greatest(c("range"), F.abs(c("high") - before), F.abs(c("low") - before)), c("range")))
    out = out.withColumn("share_of_close", ratio(c("range"), F.greatest(c("close"), F.lit(EPS))))
    atr = F.when(F.count("*").over(over(-13)) == 14, F.greatest(F.avg("true_range").over(over(-13)), F.lit(EPS)))
    back = lambda n: F.when(c("idx") >= n, ratio(c("close") - F.lag("close", n).over(series()), F.lag("close", n).over(series()))).otherwise(0.0)
    recent, older = F.avg("share_of_close").over(over(-7)), F.coalesce(F.avg("share_of_close").over(over(-31, -8)), F.lit(0.0))
    high20, low20 = F.max("high").over(over(-19)), F.min("low").over(over(-19))
    out = out.withColumns({
        "atr": atr, **{f"r{n}": back(n) for n in (1, 3, 8, 16)}, "volatility_ratio": ratio(recent, F.when(older > EPS, older).otherwise(recent + EPS)),
        "range_atr": F.avg("range").over(over(-13)), "sma20": F.avg("close").over(over(-19)), "return_1": back(1),
        "location20": (c("close") - low20) / F.greatest(high20 - low20, F.lit(1e-12)), "volume_ratio": ratio(c("volume").cast("double"), F.avg("volume").over(over(-19))),
    })
    out = out.withColumn("rolling_volatility", F.stddev_pop("return_1").over(over(-19)))
    return out.withColumn("unit", F.coalesce("atr", F.greatest("range", F.lit(EPS))))


def classes(bars: DataFrame) -> DataFrame:
    """Three families of candle classes: the eight labels, the size/body/wick/family classes, volume, volatility and location states."""
    f = features(bars).withColumns({"relative": F.when(c("range_atr") > EPS, c("range") / c("range_atr")).otherwise(1.0), "mean_range20": F.avg("range").over(over(-19))})
    f = f.withColumn("range_ratio20", F.when(c("mean_range20") > EPS, c("range") / c("mean_range20")).otherwise(1.0))
    up, down, b, u, lo = c("close") > c("open"), c("close") < c("open"), c("body_share"), c("upper_share"), c("lower_share")
    empty = c("range") <= EPS
    return f.withColumns({
        "label": case((empty, "flat"), (b <= 0.10, "doji"), (up & (b >= 0.65) & (c("close_location") >= 0.75), "strong_bullish"), (down & (b >= 0.65) & (ratio(c("high") - c("close"), c("range")) >= 0.75), "strong_bearish"),
                      (up & (b >= 0.5), "bullish_close_strong"), (down & (b >= 0.5), "bearish_close_strong"), ((lo >= 0.55) & (b <= 0.35), "hammer_like"), ((u >= 0.55) & (b <= 0.35), "shooting_star_like"), otherwise="normal"),
        "size_class": case((empty, "NO_RANGE"), (c("relative") >= 2, "LARGE_RANGE"), (c("relative") >= 1.25, "EXPANSION"), (c("relative") <= 0.6, "COMPRESSION"), otherwise="NORMAL_RANGE"),
        "body_class": case((b >= 0.8, "STRONG_BODY"), (b >= 0.55, "MODERATE_BODY"), (b <= 0.2, "SMALL_BODY"), otherwise="BALANCED_BODY"),
        "wick_class": case(((u >= 0.45) & (u > lo * 1.5), "UPPER_REJECTION"), ((lo >= 0.45) & (lo > u * 1.5), "LOWER_REJECTION"), ((u >= 0.25) & (lo >= 0.25), "TWO_SIDED_REJECTION"), otherwise="LOW_WICK_ACTIVITY"),
        "family": case((b <= 0.1, "DOJI_LIKE"), ((lo >= 0.5) & (b <= 0.35), "HAMMER_LIKE"), ((u >= 0.5) & (b <= 0.35), "SHOOTING_STAR_LIKE"), (b >= 0.85, "MARUBOZU_LIKE"), otherwise="STANDARD"),
        "volume_state": case((c("volume_ratio") >= 2, "HIGH_VOLUME"), (c("volume_ratio") >= 1.25, "ABOVE_AVERAGE_VOLUME"), (c("volume_ratio") <= 0.5, "LOW_VOLUME"), (c("volume_ratio") <= 0.8, "BELOW_AVERAGE_VOLUME"), otherwise="NORMAL_VOLUME"),
        "volatility_state": case((c("range_ratio20") >= 1.75, "VOLATILITY_EXPANSION"), (c("range_ratio20") <= 0.6, "VOLATILITY_COMPRESSION"), (c("range_ratio20") >= 1.25, "ELEVATED_VOLATILITY"), (c("range_ratio20") <= 0.8, "LOW_VOLATILITY"), otherwise="NORMAL_VOLATILITY"),
        "location_state": case((c("location20") >= 0.8, "NEAR_RANGE_HIGH"), (c("location20") >= 0.6, "UPPER_RANGE"), (c("location20") <= 0.2, "NEAR_RANGE_LOW"), (c("location20") <= 0.4, "LOWER_RANGE"), otherwise="MID_RANGE"),
    })


def language(bars: DataFrame) -> DataFrame:
    """Direction, body and range size against the 20 bars before, wick profile, behaviours and a sentence."""
    f = anatomy(bars).withColumns({"mean_range": F.avg("range").over(over(-20, -1)), "mean_body": F.avg("body").over(over(-20, -1))})
    rr, br = (F.when(c(m) > 0, c(x) / c(m)).otherwise(1.0) for x, m in (("range", "mean_range"), ("body", "mean_body")))
    u, lo, b = c("upper"), c("lower"), c("body")
    f = f.withColumns({
        "body_size": case((br >= 1.5, "large"), (br <= 0.6, "small"), otherwise="medium"),
        "range_size": case((rr >= 1.5, "expansion"), (rr <= 0.6, "compression"), otherwise="normal"),
        "wick_profile": case((((b == 0) | (lo / b >= 2)) & (lo > u * 1.25), "long_lower_rejection"), (((b == 0) | (u / b >= 2)) & (u > lo * 1.25), "long_upper_rejection"),
                             (c("body_share") <= 0.12, "doji_like"), ((u <= c("range") * 0.08) & (lo <= c("range") * 0.08), "marubozu_like"), otherwise="balanced"),
    })
    said = F.array_compact(F.array(
        F.when(c("range_size") == "expansion", F.lit("expansion")), F.when(c("range_size") == "compression", F.lit("compression")),
        F.when(c("wick_profile").contains("rejection"), F.lit("rejection")), F.when((c("body_size") == "large") & (c("range_size") == "expansion"), F.lit("momentum")),
    ))
    f = f.withColumn("behaviours", F.when(F.size(said) > 0, F.concat_ws("+", said)).otherwise("ordinary"))
    pressure = case((c("direction") == "UP", "buying pressure"), (c("direction") == "DOWN", "selling pressure"), otherwise="short-term hesitation")
    return f.withColumn("sentence", F.concat_ws(", ", pressure, F.concat(c("body_size"), F.lit(" body")), F.replace(c("wick_profile"), F.lit("_"), F.lit(" "))))


def indicators(bars: DataFrame) -> DataFrame:
    """SMA 20/50 (partial windows), RSI 14, momentum 10, ATR regime, MA bias, volume against its mean."""
    f = features(bars).withColumn("change", c("close") - F.lag("close").over(series()))
    gain, loss = (F.avg(F.greatest(x, F.lit(0.0))).over(over(-13)) for x in (c("change"), -c("change")))
    f = f.withColumns({"gain": gain, "loss": loss, "sma50": F.avg("close").over(over(-49)), "mean_atr": F.avg("range_atr").over(over(-49))})
    return f.withColumns({
        "rsi": case((c("gain").isNull(), F.lit(50.0)), ((c("loss") == 0) & (c("gain") == 0), F.lit(50.0)), (c("loss") == 0, F.lit(100.0)), otherwise=100 - 100 / (1 + c("gain") / c("loss"))),
        "momentum": F.when(c("idx") >= 10, ratio(c("close") - F.lag("close", 10).over(series()), F.lag("close", 10).over(series())) * 100).otherwise(0.0),
        "atr_regime": case((c("range_atr") > c("mean_atr") * 1.25, "HIGH"), (c("range_atr") < c("mean_atr") * 0.75, "LOW"), otherwise="NORMAL"),
        "ma_bias": case(((c("close") > c("sma20")) & (c("sma20") > c("sma50")), "BULLISH"), ((c("close") < c("sma20")) & (c("sma20") < c("sma50")), "BEARISH"), otherwise="NEUTRAL"),
    })


def streaks(bars: DataFrame) -> DataFrame:
    """Length of the run of equal directions that ends at each bar, signed; runs are islands between changes."""
    d = anatomy(bars).withColumn("new", F.coalesce((c("direction") != F.lag("direction").over(series())).cast("long"), F.lit(1)))
    d = d.withColumn("island", F.sum("new").over(over(None)))
    run = F.row_number().over(Window.partitionBy("series_id", "island").orderBy("idx")).cast("long")
    sign = case((c("direction") == "UP", F.lit(1)), (c("direction") == "DOWN", F.lit(-1)), otherwise=F.lit(0))
    return d.withColumn("streak", run).withColumn("signed_streak", c("streak") * sign).withColumn("exhausted", (c("streak") >= 5).cast("int"))


def window_context(bars: DataFrame) -> DataFrame:
    """Of the last 60 bars: bullish share, net change, body momentum (10 against the 10 before), rejection balance; of 5: pressure and break states."""
    f = anatomy(bars)
    count = lambda cond, w: F.sum(cond.cast("long")).over(w)
    f = f.withColumns({
        "n60": F.count("*").over(over(-59)), "up60": count(c("direction") == "UP", over(-59)), "down60": count(c("direction") == "DOWN", over(-59)),
        "first60": F.first("close").over(over(-59)), "body_recent": F.avg("body").over(over(-9)), "body_before": F.avg("body").over(over(-19, -10)),
        "lower60": F.sum("lower").over(over(-59)), "upper60": F.sum("upper").over(over(-59)), "up5": F.avg((c("direction") == "UP").cast("double")).over(over(-4)),
        "down5": F.avg((c("direction") == "DOWN").cast("double")).over(over(-4)), "high5": F.max("high").over(over(-5, -1)), "low5": F.min("low").over(over(-5, -1)),
    })
    return f.withColumns({
        "imbalance": (c("up60") - c("down60")) / c("n60"), "change60": ratio(c("close") - c("first60"), c("first60")) * 100,
        "body_momentum": case((c("body_before").isNull(), "steady"), (c("body_recent") > c("body_before") * 1.1, "rising"), (c("body_recent") < c("body_before") * 0.9, "falling"), otherwise="steady"),
        "rejection": case((c("lower60") > c("upper60") * 1.1, "lower"), (c("upper60") > c("lower60") * 1.1, "upper"), otherwise="balanced"),
        "pressure": case((c("up5") >= 0.7, "BUYING"), (c("down5") >= 0.7, "SELLING"), otherwise="MIXED"),
        "break_state": case((c("high5").isNull(), "NONE"), (c("close") > c("high5"), "BREAK_UP"), (c("close") < c("low5"), "BREAK_DOWN"), (c("high") > c("high5"), "FAILED_UP"), (c("low") < c("low5"), "FAILED_DOWN"), otherwise="INSIDE"),
    })


def level_events(bars: DataFrame) -> DataFrame:
    """Events against earlier levels: 20-bar breaks, sweeps, displacement, SMA alignment, distances to levels."""
    f = features(bars).withColumns({
        "prior_high": F.when(F.count("*").over(over(-20, -1)) == 20, F.max("high").over(over(-20, -1))), "prior_low": F.when(F.count("*").over(over(-20, -1)) == 20, F.min("low").over(over(-20, -1))),
        **{f"mean{n}": F.when(F.count("*").over(over(1 - n)) == n, F.avg("close").over(over(1 - n))) for n in (10, 20, 50)},
    })
    up, down = c("close") > c("prior_high"), c("close") < c("prior_low")
    f = f.withColumn("broke", case((up, F.lit(1)), (down, F.lit(-1)), otherwise=F.lit(None).cast("int")))
    f = f.withColumn("memory", F.coalesce(F.last("broke", ignorenulls=True).over(over(None, -1)), F.lit(0)))
    sign = lambda m: F.coalesce(F.signum(c("close") - c(m)).cast("int"), F.lit(0))
    return f.withColumns({
        "break_event": case((c("broke").isNull(), "NONE"), (c("broke") * c("memory") < 0, "CHOCH"), otherwise="BOS"),
        "sweep": case(((c("low") < c("prior_low")) & (c("close") > c("prior_low")), "LOW"), ((c("high") > c("prior_high")) & (c("close") < c("prior_high")), "HIGH"), otherwise="NONE"),
        "displacement": case((c("body") >= 1.5 * c("unit"), c("direction")), otherwise="NONE"), "alignment": sign("mean10") + sign("mean20") + sign("mean50"),
        "high_distance": (c("prior_high") - c("close")) / c("unit"), "low_distance": (c("close") - c("prior_low")) / c("unit"),
    })


def path_vectors(bars: DataFrame, length: int = 12) -> DataFrame:
    """The last ``length`` rows of (change, range, direction, body) in ATR units, zero rows in front where history is short."""
    f = features(bars)
    step = F.struct(
        F.coalesce(ratio(c("close") - F.lag("close").over(series()), c("unit")), F.lit(0.0)).alias("change"), ratio("range", "unit").alias("range"),
        F.signum(c("close") - c("open")).alias("direction"), ratio("body", "unit").alias("body"),
    )
    f = f.withColumn("step", step).withColumn("steps", F.collect_list("step").over(over(1 - length)))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("change", "range", "direction", "body")))
    return f.withColumn("path", F.concat(F.array_repeat(zero, length - F.size("steps")), c("steps"))).drop("steps", "step")


def _patterns() -> dict[str, Column]:
    r, b, u, lo = c("range"), c("body"), c("upper"), c("lower")
    up, down = c("close") > c("open"), c("close") < c("open")
    was = lambda n, name: F.lag(name, n).over(series())
    up1, down1 = was(1, "close") > was(1, "open"), was(1, "close") < was(1, "open")
    up2, down2 = was(2, "close") > was(2, "open"), was(2, "close") < was(2, "open")
    covers = lambda low, high: (c("open") <= low) & (c("close") >= high)
    covered = lambda high, low: (c("open") >= high) & (c("close") <= low)
    small_wicks = (u <= r * 0.1) & (lo <= r * 0.1)
    middle = (was(2, "open") + was(2, "close")) / 2
    return {
        "DOJI": b <= r * 0.1, "HAMMER": (lo >= b * 2) & (u <= F.greatest(b * 0.75, r * 0.1)) & (b <= r * 0.4), "SHOOTING_STAR": (u >= b * 2) & (lo <= F.greatest(b * 0.75, r * 0.1)) & (b <= r * 0.4),
        "SPINNING_TOP": (b <= r * 0.35) & (u >= r * 0.2) & (lo >= r * 0.2), "BULLISH_MARUBOZU": up & (b >= r * 0.8) & small_wicks, "BEARISH_MARUBOZU": down & (b >= r * 0.8) & small_wicks,
        "RANGE_EXPANSION": r >= c("mean_range") * 1.5,
        "BULLISH_ENGULFING": down1 & up & covers(was(1, "close"), was(1, "open")), "BEARISH_ENGULFING": up1 & down & covered(was(1, "close"), was(1, "open")),
        "BULLISH_HARAMI": down1 & up & (c("open") >= was(1, "close")) & (c("close") <= was(1, "open")), "BEARISH_HARAMI": up1 & down & (c("open") <= was(1, "close")) & (c("close") >= was(1, "open")),
        "INSIDE_BAR": (c("high") <= was(1, "high")) & (c("low") >= was(1, "low")), "OUTSIDE_BAR": (c("high") >= was(1, "high")) & (c("low") <= was(1, "low")),
        "MORNING_STAR": down2 & (was(1, "body") <= was(1, "range") * 0.35) & up & (c("close") > middle), "EVENING_STAR": up2 & (was(1, "body") <= was(1, "range") * 0.35) & down & (c("close") < middle),
        "THREE_WHITE_SOLDIERS": up2 & up1 & up & (was(1, "close") > was(2, "close")) & (c("close") > was(1, "close")), "THREE_BLACK_CROWS": down2 & down1 & down & (was(1, "close") < was(2, "close")) & (c("close") < was(1, "close")),
    }


SINGLE = ("DOJI", "HAMMER", "SHOOTING_STAR", "SPINNING_TOP", "BULLISH_MARUBOZU", "BEARISH_MARUBOZU", "RANGE_EXPANSION")


def patterns(bars: DataFrame) -> DataFrame:
    """(series_id, idx, pattern): every named one-, two- and three-bar pattern at each bar."""
    f = anatomy(bars)
    f = f.withColumn("mean_range", F.avg("range").over(over(None, None)))
    held = [F.when(cond & (c("range") > 0) if name in SINGLE else cond, F.lit(name)) for name, cond in _patterns().items()]
    flagged = f.select("series_id", "idx", "direction", F.array_compact(F.array(*held)).alias("held"))
    return flagged.select("series_id", "idx", "direction", F.explode("held").alias("pattern"))


def pattern_evaluation(bars: DataFrame) -> DataFrame:
    """Of each pattern: occurrences, share of prior pressure, confirmations within three bars (evaluation only: it reads the future)."""
    f = anatomy(bars).withColumns({
        "up_before": F.sum((c("direction") == "UP").cast("long")).over(over(-5, -1)), "down_before": F.sum((c("direction") == "DOWN").cast("long")).over(over(-5, -1)), "later": F.lead("close", 3).over(series()),
    })
    rows = patterns(bars).drop("direction").join(f, ["series_id", "idx"])
    rows = rows.withColumn("prior", case((c("up_before") > c("down_before"), "UP"), (c("down_before") > c("up_before"), "DOWN"), otherwise="FLAT"))
    return rows.groupBy("pattern").agg(
        F.count("*").alias("n"), F.count_if(c("prior") == "UP").alias("n_after_up"), F.count_if(c("prior") == "DOWN").alias("n_after_down"),
        F.count_if(c("later") > c("close")).alias("n_higher"), F.count_if(c("later") < c("close")).alias("n_lower"), F.count_if(c("later").isNull()).alias("n_pending"),
    )
