"""Metrics of three-class predictions: accuracy, Brier, log loss, calibration, buckets, rank correlation, permutation and invariance checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks, shared
from tidemark.functions.columns import case

c = F.col
CLASSES = ("up", "down", "neutral")


def scored(predictions: DataFrame, actual: str = "actual") -> DataFrame:
    """Rows with an outcome, and their Brier score (a third of the sum of squares), log loss, predicted class and hit."""
    p = predictions.filter(c(actual).isNotNull())
    hit = lambda k: (c(actual) == k.upper()).cast("double")
    brier = sum(((c(f"p_{k}") - hit(k)) ** 2 for k in CLASSES[1:]), (c("p_up") - hit("up")) ** 2) / 3
    own = case((c(actual) == "UP", c("p_up")), (c(actual) == "DOWN", c("p_down")), otherwise=c("p_neutral"))
    best = F.greatest(*(f"p_{k}" for k in CLASSES))
    said = case((c("p_up") == best, "UP"), (c("p_down") == best, "DOWN"), otherwise="NEUTRAL")
    return p.withColumns({"brier": brier, "log_loss": -F.log(F.greatest(own, F.lit(1e-12))), "confidence": best, "said": said}).withColumn("hit", (c("said") == c(actual)).cast("long"))


def metrics(rows: DataFrame, actual: str = "actual") -> DataFrame:
    """By horizon: accuracy, majority share, Brier, log loss, balanced accuracy and macro F1."""
    s = scored(rows, actual)
    out = s.groupBy("horizon").agg(
        F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"),
        *(F.count_if(c(actual) == k.upper()).alias(f"is_{k}") for k in CLASSES), *(F.count_if(c("said") == k.upper()).alias(f"said_{k}") for k in CLASSES),
        *(F.count_if((c("said") == k.upper()) & (c(actual) == k.upper())).alias(f"both_{k}") for k in CLASSES),
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall = [part(c(f"both_{k}"), c(f"is_{k}")) for k in CLASSES]
    f1 = [part(2 * c(f"both_{k}"), c(f"is_{k}") + c(f"said_{k}")) for k in CLASSES]
    majority = F.greatest(*(f"is_{k}" for k in CLASSES)) / c("n")
    return out.select("horizon", "n", "accuracy", majority.alias("majority"), "brier", "log_loss", ((recall[0] + recall[1] + recall[2]) / 3).alias("balanced"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"))


def confusion(rows: DataFrame, actual: str = "actual") -> DataFrame:
    return scored(rows, actual).groupBy("horizon", c(actual).alias("actual"), "said").agg(F.count("*").alias("n"))


def calibration(rows: DataFrame, bins: int = 10, actual: str = "actual") -> DataFrame:
    """Expected and maximal calibration error over equal-width confidence bins."""
    s = scored(rows, actual).withColumn("bin", F.least(F.floor(c("confidence") * bins), F.lit(bins - 1)).cast("int"))
    b = s.groupBy("horizon", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("hit") - F.avg("confidence")).alias("gap"))
    return b.groupBy("horizon").agg((F.sum(c("n") * c("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"), F.count("*").alias("n_bins"))


def equal_count_buckets(rows: DataFrame, key: str, by: list[str], value: Column, k: int = 10) -> DataFrame:
    """Buckets d of ranks [d*n//k, (d+1)*n//k) in the total order ``by``: size and mean of value in each."""
    at = ranks.ranked(rows, [key], by, "rn")
    bucket = F.floor((k * c("rn") - 1) / c("total")).cast("int")
    return at.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))


def spearman(rows: DataFrame, key: str, a: str, b: str, ties: list[str]) -> DataFrame:
    """Rank correlation with average ranks for ties; ``ties`` names each row."""
    known = rows.filter(c(a).isNotNull() & c(b).isNotNull()).select(key, *ties, a, b)
    both = ranks.average_ranks(ranks.average_ranks(known, [key], a, ties, "ra"), [key], b, ties, "rb")
    return both.groupBy(key).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def shifted_accuracy(rows: DataFrame, shifts: tuple[int, ...] = (0, 7, 13, 29, 53), actual: str = "actual") -> DataFrame:
    """Block permutation: predictions against outcomes shifted in a circle by each of ``shifts`` within the horizon; shift 0 is the real pairing."""
    s = scored(rows, actual).select("horizon", "series_id", "idx", "said", c(actual).alias("is"))
    s = shared.cut(ranks.ranked(s, ["horizon"], ["series_id", "idx"], "rn"), "places").withColumn("rn", c("rn") - 1)
    moved = s.select("horizon", "rn", "said", "total", F.explode(F.array(*(F.lit(x) for x in shifts))).alias("shift"))
    moved = moved.withColumn("to", (c("rn") + c("shift")) % c("total"))
    target = s.select("horizon", c("rn").alias("to"), "is")
    return moved.join(target, ["horizon", "to"]).groupBy("horizon", "shift").agg(F.count("*").alias("n"), F.avg((c("said") == c("is")).cast("double")).alias("accuracy"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks: 0 for equal multisets."""
    return a.exceptAll(b).agg(F.count("*").alias("only_first")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_second")))


def with_changed_future(bars: DataFrame, cut: int | Column) -> DataFrame:
    """Bars whose prices and volume from index ``cut`` on are changed (fixed values): what is computed before the cut must not change."""
    late = lambda p, changed: F.when(c("idx") >= cut, changed).otherwise(c(p))
    return bars.withColumns({**{p: late(p, c(p) * 1.137 + 17) for p in ("open", "high", "low", "close")}, "volume": late("volume", c("volume") * 2 + 100)})


CUT_SHARES = (0.10, 0.25, 0.50, 0.75)


def cuts(bars: DataFrame, shares: tuple[float, ...] = CUT_SHARES) -> DataFrame:
    """(series_id, cut): the bars in each of ``shares`` of every series, at least one."""
    first = F.min("idx")
    at = F.transform(F.array(*(F.lit(x) for x in shares)), lambda x: first + F.greatest(F.floor(F.count("*") * x), F.lit(1)))
    return bars.groupBy("series_id").agg(at.alias("at")).select("series_id", F.explode(F.array_distinct("at")).alias("cut"))


def future_dependence(bars: DataFrame, features: Callable[[DataFrame], DataFrame], suffix: bool = False) -> DataFrame:
    """Rows before each cut in which any column of ``features`` differs when later bars are missing or, with ``suffix``, changed.

    Each series is computed once as it is and once for each cut, under a name of its own.
    """
    at = F.broadcast(cuts(bars))
    named = bars.join(at, "series_id").withColumn("series_id", F.concat_ws("@", "series_id", "cut"))
    other = with_changed_future(named, c("cut")) if suffix else named.filter("idx < cut")
    limit = lambda d: d.filter(c("idx") < F.substring_index("series_id", "@", -1).cast("long"))
    whole, other = features(bars).join(at, "series_id").withColumn("series_id", F.concat_ws("@", "series_id", "cut")).drop("cut"), features(other.drop("cut"))
    shown = lambda d: limit(d).select(*(F.round(n, 7).alias(n) if t in ("double", "float") else c(n) for n, t in sorted(d.dtypes)))
    compared = shown(whole)
    return differing(compared, shown(other)).crossJoin(compared.agg(F.count("*").alias("n_compared")))
