"""Symbols and normalised anatomy of candles, counters of the last bars, sequences of labels with their outcomes, states with a prior, schemes of splits, and what retrieval finds by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, case, over, series
from tidemark.operators import candles, evaluation, learning, outcomes

c = F.col
DIRECTIONS = learning.DIRECTIONS
# Thresholds and names in this module must equal outside ones (fixed values).
PRIOR_UP, PRIOR_DOWN = 2.0, 2.0
TRAIN_SHARE, LEAST_TRAIN, LEAST_TEST, RATIO_WINDOWS, FOLDS = 0.70, 150, 50, 5, 4
RANKS = (1, 5, 10, 25)
RANKED = ("similarity", "structure", "regime", "path")


def symbols(bars: DataFrame) -> DataFrame:
    """Classes of body, wicks and close of each candle against its range (1e-6 at least), and the symbol that joins them."""
    span = F.greatest(c("range"), F.lit(1e-6))
    wick = lambda x: case((x >= 0.35, "high"), (x >= 0.15, "medium"), otherwise="low")
    place = (c("close") - c("low")) / span
    f = candles.anatomy(bars).withColumns({
        "side": case((c("close") > c("open"), "B"), (c("close") < c("open"), "S"), otherwise="N"), "body_class": case((c("body") / span >= 0.65, "strong"), (c("body") / span >= 0.30, "medium"), otherwise="weak"),
        "upper_class": wick(c("upper") / span), "lower_class": wick(c("lower") / span), "close_class": case((place >= 0.70, "high"), (place <= 0.30, "low"), otherwise="middle"),
    })
    return f.withColumn("symbol", F.concat("side", F.lit(":"), "body_class", F.lit(":U"), "upper_class", F.lit(":L"), "lower_class"))


def normalised_anatomy(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Anatomy against ATR and against the median range of the bars before: place of the body, efficiency, expansion, nine types, rejection and pressure.

    Efficiency is null for a bar without range and expansion where the earlier ranges are (nearly) all 0: there is no unit to measure in.
    The types take such an expansion for wide unless the bar itself has no range.
    """
    f = candles.features(bars).withColumns({"span": F.greatest(c("range"), F.lit(EPS)), "was": F.coalesce(F.lag("close").over(series()), c("close"))})
    f = f.withColumn("usual", F.greatest(F.coalesce(F.percentile("range", 0.5).over(over(-lookback, -1)), c("unit")), F.lit(EPS)))
    f = f.withColumns({"place": (c("close") - c("low")) / c("span"), "growth": c("span") / c("usual"), "body_span": c("body") / c("span")})
    up, down = c("direction") == "UP", c("direction") == "DOWN"
    long_wick = lambda wick: c(wick) >= F.greatest(c("body") * 1.5, c("span") * 0.45)
    return f.withColumns({
        "body_atr": c("body") / c("unit"), "span_atr": c("span") / c("unit"), "body_place": ((c("open") + c("close")) / 2 - c("low")) / c("span"),
        "efficiency": F.when(c("range") > 1e-9, F.abs(c("close") - c("was")) / c("span")), "expansion": F.when(c("usual") > 1e-9, c("growth")),
        "type": case((c("body_span") <= 0.15, "DOJI"), ((c("body_span") >= 0.70) & up, "STRONG_BODY_UP"), ((c("body_span") >= 0.70) & down, "STRONG_BODY_DOWN"),
                     ((c("lower") >= c("body") * 1.8) & (c("place") >= 0.60), "BULLISH_REJECTION"), ((c("upper") >= c("body") * 1.8) & (c("place") <= 0.40), "BEARISH_REJECTION"),
                     ((c("growth") >= 1.8) & up, "WIDE_RANGE_UP"), ((c("growth") >= 1.8) & down, "WIDE_RANGE_DOWN"), (c("growth") <= 0.65, "COMPRESSION"), otherwise="NORMAL"),
        "rejection": case((long_wick("lower") & (c("place") > 0.55), "BULLISH"), (long_wick("upper") & (c("place") < 0.45), "BEARISH"), otherwise="NONE"),
        "pressure": case(((c("place") >= 0.75) & up, "BUYING"), ((c("place") <= 0.25) & down, "SELLING"), otherwise="MIXED"),
    })


def window_counters(bars: DataFrame, k: int = 30) -> DataFrame:
    """Over the last ``k`` bars: bars that follow through, changes of direction, and strict three-bar swings against the swing before.

    A swing counts once the bar after it is there and its three bars lie in the window; a comparison counts if both swings do.
    """
    was = lambda name, n=1: F.lag(name, n).over(series())
    f = candles.anatomy(bars).withColumn("was", was("direction"))
    swing = lambda x, side: F.when((side * was(x) > side * was(x, 2)) & (side * was(x) > side * c(x)), was(x))
    f = f.withColumns({"swing_high": swing("high", 1), "swing_low": swing("low", -1)})
    before = over(None, -1)
    f = f.withColumns({f"{x}_step": F.when(c(x).isNotNull(), F.coalesce(F.signum(c(x) - F.last(x, ignorenulls=True).over(before)), F.lit(0.0))) for x in ("swing_high", "swing_low")})
    pair, inner = over(2 - k), over(3 - k)
    both = lambda a, b: F.count_if((c("was") == a) & (c("direction") == b)).over(pair)
    # The first swing of a window has its partner before the window.
    steps = lambda x, way: F.count_if(c(f"{x}_step") == way).over(inner) - F.coalesce(F.first(f"{x}_step", ignorenulls=True).over(inner) == way, F.lit(False)).cast("long")
    f = f.withColumns({
        "n_bullish": both("UP", "UP"), "n_bearish": both("DOWN", "DOWN"), "n_changes": both("UP", "DOWN") + both("DOWN", "UP"),
        "n_hh": steps("swing_high", 1), "n_lh": steps("swing_high", -1), "n_hl": steps("swing_low", 1), "n_ll": steps("swing_low", -1),
    })
    return f.withColumn("context", case(((c("n_hh") > c("n_lh")) & (c("n_hl") >= c("n_ll")), "bullish_structure"), ((c("n_lh") > c("n_hh")) & (c("n_ll") >= c("n_hl")), "bearish_structure"), otherwise="mixed_structure"))


def label_sequences(bars: DataFrame, lengths: tuple[int, ...] = (2, 3, 4, 5), least: int = 20, confidence: float = 0.20, k: int = 10) -> DataFrame:
    """Sequences of candle labels and the outcome that mostly follows: the ``k`` most certain of each length and horizon.

    There are at most eight labels, so the sequences left to rank are bounded whatever the number of bars. Ties go to more samples, then to the sequence
    first in order; of equally frequent outcomes UP goes before DOWN before NEUTRAL.
    """
    lags = lambda n: F.concat_ws(">", *(F.lag("label", j).over(series()) for j in range(n - 1, 0, -1)), c("label"))
    f = candles.classes(bars).withColumns({f"s{n}": F.when(c("idx") >= n - 1, lags(n)) for n in lengths})
    f = f.select("series_id", "idx", F.explode(F.array(*(F.struct(F.lit(n).alias("length"), c(f"s{n}").alias("labels")) for n in lengths))).alias("s")).select("series_id", "idx", "s.*").filter("labels is not null")
    rows = f.join(outcomes.outcomes(bars).filter("direction is not null").select("series_id", "idx", "horizon", "direction"), ["series_id", "idx"])
    counts = learning.state_counts(rows, ["horizon", "length", "labels"]).filter(c("n") >= least)
    top = F.greatest("up", "down", "neutral")
    found = counts.withColumns({"says": case((c("up") == top, "UP"), (c("down") == top, "DOWN"), otherwise="NEUTRAL"), "confidence": top / c("n")}).filter(c("confidence") >= confidence)
    rank = F.row_number().over(Window.partitionBy("horizon", "length").orderBy(F.desc("confidence"), F.desc("n"), "labels"))
    return found.withColumn("rank", rank).filter(c("rank") <= k)


def prior_states(bars: DataFrame) -> DataFrame:
    """Test rows with the chance of UP against DOWN in training rows of the same state, under a beta prior; of all training rows where the state has none. NEUTRAL rows don't count."""
    rows, base = learning.experience(bars), ["series_id", "window_no", "horizon"]
    train = learning.training_of(bars, rows).filter("direction <> 'NEUTRAL'")
    counted = lambda keys, names: train.groupBy(*keys).agg(F.count_if(c("direction") == "UP").alias(names[0]), F.count("*").alias(names[1]))
    out = learning.tests_of(bars, rows).join(counted([*base, "state_key"], ("up", "n")), [*base, "state_key"], "left").join(counted(base, ("all_up", "all_n")), base, "left")
    chance = lambda up, n: (c(up) + PRIOR_UP) / (c(n) + PRIOR_UP + PRIOR_DOWN)
    return out.withColumns({
        "source": case((c("n").isNotNull(), "STATE"), (c("all_n").isNotNull(), "GLOBAL"), otherwise="NONE"), "samples": F.coalesce("n", "all_n", F.lit(0)),
        "p_up": F.coalesce(chance("up", "n"), chance("all_up", "all_n"), F.lit(0.5)),
    })


def split_schemes(bars: DataFrame) -> DataFrame:
    """Other ways to part a series: windows behind a share of it, the last to its end; expanding folds of equal size; one chronological cut.

    A series too short for a scheme (200 bars for windows, 5 for folds, 2 for the cut) has no rows of it; the outside original raises an error there.
    """
    n = bars.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("cut", F.floor(c("n") * F.lit(TRAIN_SHARE)))
    w = n.withColumns({"size": F.greatest(F.lit(LEAST_TEST).cast("long"), F.floor((c("n") - c("cut")) / RATIO_WINDOWS)), "k": F.explode(F.sequence(F.lit(0), F.lit(RATIO_WINDOWS - 1)))}).withColumn("start", c("cut") + c("k") * c("size"))
    w = w.withColumn("stop", F.when(c("k") == RATIO_WINDOWS - 1, c("n")).otherwise(F.least("n", c("start") + c("size")))).filter((c("n") >= LEAST_TRAIN + LEAST_TEST) & (c("start") >= LEAST_TRAIN) & (c("stop") - c("start") >= LEAST_TEST))
    f = n.withColumns({"size": F.floor(c("n") / (FOLDS + 1)), "k": F.explode(F.sequence(F.lit(1), F.lit(FOLDS)))}).filter("size > 0").withColumn("start", c("k") * c("size"))
    part = lambda df, scheme, start, stop, k: df.select("series_id", F.lit(scheme).alias("scheme"), k.cast("int").alias("window_no"), start.alias("oos_start"), stop.alias("oos_end"))
    numbered = F.row_number().over(Window.partitionBy("series_id").orderBy("k"))
    return part(w, "ratio", c("start"), c("stop"), numbered).unionByName(part(f, "folds", c("start"), c("start") + c("size"), c("k"))).unionByName(part(n.filter("cut > 0"), "chronological", c("cut"), c("n"), F.lit(1)))


def confidence_bins(predictions: DataFrame, actual: str = "direction") -> DataFrame:
    """Five bins of equal width of the confidence: rows, share of hits, mean confidence."""
    rows = evaluation.scored(predictions, actual).withColumn("confidence", F.round("confidence", 9))
    rows = rows.withColumn("bin", F.least(F.floor(c("confidence") * 5), F.lit(4).cast("long")).cast("int"))
    return rows.groupBy("horizon", "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def candidate_diagnostics(bars: DataFrame) -> DataFrame:
    """Means over test rows of what their 1, 5, 10 and 25 most similar matches hold: share of the same outcome, similarity, distance back, components; over all queries with an outcome and a match."""
    rank = F.row_number().over(Window.partitionBy(*learning.QUERY).orderBy(F.desc("similarity"), F.desc("h_idx")))
    m = learning.matches(bars).filter("actual is not null").withColumns({"rank": rank, "same": (c("direction") == c("actual")).cast("double"), "gap": (c("idx") - c("h_idx")).cast("double")})
    parts = ("same", "gap", *RANKED)
    within = lambda k: F.struct(F.lit(k).alias("k"), *(F.avg(F.when(c("rank") <= k, c(p))).alias(p) for p in parts))
    by_query = m.groupBy(*learning.QUERY).agg(F.array(*(within(k) for k in RANKS)).alias("tops")).select("horizon", F.inline("tops"))
    return by_query.groupBy("horizon", "k").agg(F.count("*").alias("n_queries"), *(F.avg(p).alias(f"mean_{p}") for p in parts))
