"""Data quality: bar validity, order and gap audits, price and volume statistics, target boundary and overlap checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import case, series


def with_validity(bars: DataFrame) -> DataFrame:
    body_in = (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))
    finite = F.lit(True)
    for p in ("open", "high", "low", "close", "volume"):
        x = F.col(p).cast("double")
        finite = finite & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    positive = F.least("open", "high", "low", "close") > 0
    holds = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return bars.withColumn("ohlc_valid", holds(body_in)).withColumn("contract_valid", holds(finite & body_in & positive & (F.col("volume") >= 0)))


def audit(bars: DataFrame) -> DataFrame:
    """One row a series: rows, invalid bars, order breaks, duplicate times, verdict."""
    rows = with_validity(bars).withColumn("before", F.lag("ts").over(series()))
    out = rows.groupBy("series_id").agg(
        F.count("*").alias("n_bars"), F.sum(1 - F.col("ohlc_valid")).alias("n_invalid"), F.sum(1 - F.col("contract_valid")).alias("n_contract_invalid"),
        F.count_if(F.col("ts") < F.col("before")).alias("n_disordered"), F.count_if(F.col("ts") == F.col("before")).alias("n_repeated"),
        (F.count("*") - F.count_distinct("ts")).alias("n_duplicates"),
    )
    verdict = case((F.col("n_invalid") + F.col("n_disordered") > 0, "FAIL"), (F.col("n_contract_invalid") + F.col("n_duplicates") > 0, "REVIEW"), otherwise="PASS")
    return out.withColumn("verdict", verdict)


def gaps(bars: DataFrame, factor: float = 1.5) -> DataFrame:
    """One row a series: modal interval in seconds (the smallest of equally common ones), gaps beyond factor times it, largest gap."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    delta = (seconds - F.lag(seconds).over(series())).alias("delta")
    deltas = bars.select("series_id", delta).filter("delta is not null")
    counts = deltas.groupBy("series_id", "delta").agg(F.count("*").alias("n"))
    # The distinct intervals of a series are few: counts, not rows, go on.
    mode = counts.groupBy("series_id").agg(F.max_by("delta", F.struct("n", (-F.col("delta")).alias("d"))).alias("modal"))
    joined = counts.join(mode, "series_id")
    over = F.sum(F.when(F.col("delta") > factor * F.col("modal"), F.col("n")).otherwise(0))
    return joined.groupBy("series_id", "modal").agg(over.alias("n_gaps"), F.max("delta").alias("largest"), F.sum(F.when(F.col("delta") <= 0, F.col("n")).otherwise(0)).alias("n_backward"))


def statistics(bars: DataFrame) -> DataFrame:
    span, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    return bars.groupBy("series_id").agg(
        F.min_by("close", "idx").alias("first_close"), F.max_by("close", "idx").alias("last_close"), F.max("high").alias("max_high"), F.min("low").alias("min_low"),
        F.avg(span).alias("mean_range"), F.percentile(span, 0.5).alias("median_range"), F.avg(body).alias("mean_body"),
        F.count("volume").alias("n_volume"), F.avg("volume").alias("mean_volume"), F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume"),
    )


def boundary_violations(inputs: DataFrame) -> DataFrame:
    """(query_idx, input_idx) pairs -> pairs and those whose input lies after its query, by series."""
    return inputs.groupBy("series_id").agg(F.count("*").alias("n_inputs"), F.count_if(F.col("input_idx") > F.col("query_idx")).alias("n_violations"))


def overlapping_targets(targets: DataFrame) -> DataFrame:
    """For (series_id, idx, stop) windows over the bars after idx up to stop: how many windows that begin earlier reach into each.

    Windows that have begun less those that have ended, as one running sum over beginnings and ends: no join of pairs.
    """
    begin = targets.select("series_id", F.col("idx").alias("at"), F.lit(1).alias("step"), "idx", "stop")
    end = targets.select("series_id", F.col("stop").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("stop"))
    marks = begin.unionByName(end).withColumn("order", F.col("at") * 2 + (F.col("step") > 0).cast("int"))
    running = F.sum("step").over(Window.partitionBy("series_id").orderBy("order").rangeBetween(Window.unboundedPreceding, -1))
    return marks.withColumn("n_overlapping", F.coalesce(running, F.lit(0)).cast("long")).filter("idx is not null").select("series_id", "idx", "stop", "n_overlapping")


def overlapping_pairs(targets: DataFrame, width: int = 64) -> DataFrame:
    """(series_id, idx, later_idx): pairs of windows, the first beginning earlier and reaching into the other.

    An interval join by blocks of ``width`` bars: a window meets others in the blocks that it covers, and a pair counts
    in the block of the later beginning.
    """
    block = lambda x: F.floor(x / width)
    one = targets.select("series_id", "idx", "stop", F.explode(F.sequence(block(F.col("idx")), block(F.col("stop")))).alias("block"))
    two = targets.select("series_id", F.col("idx").alias("later_idx"), block(F.col("idx")).alias("block"))
    return one.join(two, ["series_id", "block"]).filter("idx < later_idx and stop > later_idx").select("series_id", "idx", "later_idx")


def visible(bars: DataFrame, through: object) -> DataFrame:
    """Bars up to a time; none at all is an error."""
    seen = bars.filter(F.col("ts") <= F.lit(through))
    if seen.isEmpty():
        raise ValueError(f"no bar is visible through {through}")
    return seen


ROLES = ("causal_input", "future_target", "evaluation_only", "prohibited")


def with_roles(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Mark columns with their role; it stays in their metadata."""
    for name, role in roles.items():
        if role not in ROLES:
            raise ValueError(f"{role} is no role")
        rows = rows.withMetadata(name, {"role": role})
    return rows


def check_inputs(rows: DataFrame, inputs: list[str]) -> None:
    """An error if a column that is used as an input is marked as anything but a causal input."""
    role = {f.name: f.metadata.get("role", "causal_input") for f in rows.schema.fields}
    if wrong := [n for n in inputs if role[n] != "causal_input"]:
        raise ValueError(f"not causal inputs: {', '.join(wrong)}")


def wide_gaps(bars: DataFrame) -> DataFrame:
    """By series: intervals above the modal one, negative and zero ones, and the largest, in seconds."""
    out = gaps(bars, 1.0)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    signs = bars.select("series_id", (seconds - F.lag(seconds).over(series())).alias("delta")).groupBy("series_id").agg(F.count_if(F.col("delta") < 0).alias("n_negative"), F.count_if(F.col("delta") == 0).alias("n_zero"))
    return out.join(signs, "series_id").select("series_id", "modal", F.col("n_gaps").alias("n_above_mode"), "n_negative", "n_zero", "largest")
