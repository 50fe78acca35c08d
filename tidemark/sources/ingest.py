"""Ingestion of rows as they came: a raw layer that keeps every row with its issues, a normalised one of accepted bars, and a guard of files.

Errors reject a row: a missing or invalid open, high, low or close, an invalid time, prices that contradict each other, a time
that an accepted earlier row of the series has. Warnings keep it: a time before that of an earlier row, an invalid volume,
which becomes null, a gap wider than the timeframe. Raw values are never rewritten; bars keep the number of their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks, shared

c = F.col
PRICES = ("open", "high", "low", "close")
FEW_TIMES = 100_000  # so many times, of five numbers each, are sent to the rows; more are joined by a shuffle
RANGE_ROWS = 250_000


def layers(raw: DataFrame, timeframe: int) -> DataFrame:
    """The raw layer: ``raw`` (series_id, source_row, ts, open, high, low, close, volume; the last six as text) with status, errors and warnings.

    ``timeframe`` is in seconds. Columns n_<name> hold the parsed values.
    """
    number = lambda n: F.trim(c(n)).try_cast("double")
    blank = lambda n: F.coalesce(F.trim(c(n)) == "", F.lit(True))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = raw.withColumns({**{f"n_{p}": number(p) for p in (*PRICES, "volume")}, "n_ts": F.trim(c("ts")).try_cast("timestamp")})
    issue = lambda cond, name: F.when(cond, F.lit(name))
    numbers = [finite(c(f"n_{p}")) for p in PRICES]
    fits = (c("n_low") <= F.least("n_open", "n_close")) & (c("n_high") >= F.greatest("n_open", "n_close"))
    rows = rows.withColumn("own_errors", F.array_compact(F.array(
        *(issue(blank(p), f"MISSING_{p.upper()}") for p in PRICES), *(issue(~blank(p) & ~ok, f"INVALID_{p.upper()}") for p, ok in zip(PRICES, numbers, strict=True)),
        issue(c("n_ts").isNull(), "INVALID_TIMESTAMP"), issue(numbers[0] & numbers[1] & numbers[2] & numbers[3] & ~fits, "INVALID_OHLC"),
    )))
    good = c("n_ts").isNotNull() & numbers[0] & numbers[1] & numbers[2] & numbers[3] & fits
    times = _times(rows.withColumn("good", good))
    rows = rows.join(times, c("series_id").eqNullSafe(c("_series")) & (c("n_ts") == c("_ts")), "left")
    first = c("source_row") == c("_good_row")
    accepted, repeated = good & first, good & ~first
    rows = rows.withColumn("errors", F.when(repeated, F.array(F.lit("DUPLICATE_TIMESTAMP"))).otherwise(c("own_errors"))).withColumn("status", F.when(accepted, "ACCEPTED").otherwise("REJECTED"))
    late = c("_later_from") < c("source_row")
    wide = accepted & (c("n_ts").cast("long") - c("_before").cast("long") > timeframe)
    bad_volume = ~blank("volume") & ~(finite(c("n_volume")) & (c("n_volume") >= 0))
    rows = rows.withColumn("warnings", F.array_compact(F.array(issue(late, "OUT_OF_ORDER"), issue(bad_volume, "INVALID_VOLUME"), issue(wide, "TIME_GAP"))))
    return rows.withColumn("n_volume", F.when(~bad_volume, c("n_volume"))).drop("own_errors", *times.columns)


def _times(rows: DataFrame) -> DataFrame:
    """What rows must know of others, by time: the first good row of that time, the time of a good row before it, the first row of any time after it.

    A row comes late where a row before it has a later time, so the first row of all later times tells. Times are dealt by
    ranges; a window reaches over one range, and what lies before or after it comes from one row for each range.
    """
    times = rows.filter("n_ts is not null").groupBy(c("series_id").alias("_series"), c("n_ts").alias("_ts")).agg(F.min("source_row").alias("_row"), F.min(F.when(c("good"), c("source_row"))).alias("_good_row"))
    times = ranks.dealt(times, ["_series"], ["_ts"])
    good_ts = F.when(c("_good_row").isNotNull(), c("_ts"))
    parts = times.groupBy("_series", "_part").agg(F.max(good_ts).alias("_last"), F.min("_row").alias("_least"))
    past = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_series", "_part", F.max("_last").over(past(["_series"], "_part")).alias("_last"), F.min("_least").over(past(["_series"], F.desc("_part"))).alias("_least"))
    here = ["_series", "_part"]
    times = ranks.with_ranges(times, parts, ["_series"]).select(
        "_series", "_ts", "_good_row", F.coalesce(F.max(good_ts).over(past(here, "_ts")), "_last").alias("_before"), F.least(F.min("_row").over(past(here, F.desc("_ts"))), "_least").alias("_later_from"),
    )
    times = shared.cut(times, "times")
    return F.broadcast(times) if times.count() <= FEW_TIMES else times


def normalised(rows: DataFrame) -> DataFrame:
    """The normalised layer: accepted bars in order of time, each with the number of the row it came from."""
    kept = rows.filter("status = 'ACCEPTED'").select("series_id", "source_row", c("n_ts").alias("ts"), *(c(f"n_{p}").alias(p) for p in (*PRICES, "volume")))
    return ranks.ranked(shared.cut(kept, "accepted"), ["series_id"], ["ts"], "idx").withColumn("idx", c("idx") - 1).drop("total")


def issue_counts(rows: DataFrame) -> DataFrame:
    """Rows by series, issue and whether it is an error."""
    named = lambda kind: F.transform(c(f"{kind}s"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("issue")))
    return rows.select("series_id", F.explode(F.concat(named("error"), named("warning"))).alias("i")).groupBy("series_id", "i.kind", "i.issue").agg(F.count("*").alias("n"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as price rows in the order they were entered, in hundredths: the price of a piece with tax, without, and with the discount."""
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", *order)
    ranges = max(spark.sparkContext.defaultParallelism, rows.count() // RANGE_ROWS + 1)  # no range grows with the table
    rows = ranks.ranked(rows, ["l_returnflag"], order, "source_row", keep=["l_returnflag", "l_shipdate", *order[5:]], ranges=ranges)
    price = c("l_extendedprice") / c("l_quantity")
    text = lambda x: F.floor(x * 100).cast("string")
    high, low, close = price * (1 + c("l_tax")), price * (1 - c("l_discount")), price * (0.99 + c("l_discount") / 4)
    return rows.select(c("l_returnflag").alias("series_id"), "source_row", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ts"), text(price).alias("open"), text(high).alias("high"),
                       text(low).alias("low"), text(close).alias("close"), F.when(c("l_quantity") > 3, F.format_string("%.0f", c("l_quantity") - 10)).alias("volume"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


class Guard:
    """Remembers what files hold, and tells whether they still do."""

    def __init__(self, spark: SparkSession, path: str, manifest: str):
        self.spark, self.path, self.manifest = spark, path, manifest
        digests(spark, path).write.mode("overwrite").parquet(manifest)

    def changes(self) -> DataFrame:
        """(path, change) of files that were added, removed or changed since."""
        was, now = self.spark.read.parquet(self.manifest), digests(self.spark, self.path)
        both = was.alias("w").join(now.alias("n"), "path", "full")
        change = F.when(c("w.sha256").isNull(), "ADDED").when(c("n.sha256").isNull(), "REMOVED").when(c("w.sha256") != c("n.sha256"), "CHANGED")
        return both.select("path", change.alias("change")).filter("change is not null")

    def verify(self) -> None:
        found = self.changes().limit(5).collect()
        if found:
            raise ValueError("files are not what they were: " + ", ".join(f"{r.path} {r.change.lower()}" for r in found))
