"""Bars: built from ticks, read from tolerant rows and chart JSON, resampled, and written with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import over

#: Outside names of the fields (fixed values).
ALIASES = {"ts": ("timestamp", "ts", "time", "date", "datetime"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "vol", "v")}


def indexed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")).cast("long") - 1)


def from_ticks(ticks: DataFrame, value: str, ts: str, order: str, series: str | None = None, unit: str = "hour") -> DataFrame:
    """OHLC bars with tick counts as volume; ticks without a finite value are left out, gaps stay gaps."""
    v = F.col(value)
    first = F.struct(F.col(ts), F.col(order))
    rows = ticks.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).withColumn("series_id", F.col(series) if series else F.lit("all"))
    bars = rows.groupBy("series_id", F.date_trunc(unit, ts).alias("ts")).agg(
        F.min_by(v, first).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, first).alias("close"), F.count("*").alias("volume")
    )
    return indexed(bars)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "ts", "event_id", "event_type")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_ticks(orders, "o_totalprice", "o_orderdate", "o_orderkey", unit="day")


def resample(bars: DataFrame, k: int) -> DataFrame:
    """Complete groups of k bars, anchored at bar 0; a group's time is that of its last bar."""
    groups = bars.groupBy("series_id", F.floor(F.col("idx") / k).alias("group")).agg(
        F.max("ts").alias("ts"), F.min_by("open", "idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "idx").alias("close"), F.sum("volume").alias("volume"), F.max("idx").alias("end_idx"), F.count("*").alias("n"),
    )
    return groups.filter(F.col("n") == k).withColumn("idx", F.col("group").cast("long")).drop("group", "n")


def multi_timeframe(bars: DataFrame, scales: tuple[int, ...] = (3, 12)) -> DataFrame:
    """Each bar with the last complete bar of every scale as of it: a union in index order and a carried value, no range join."""
    out = bars.select("series_id", "idx", "close")
    for k in scales:
        marks = resample(bars, k).select("series_id", F.col("end_idx").alias("idx"), F.col("close").alias(f"close_{k}"), F.col("open").alias(f"open_{k}"))
        out = out.join(marks, ["series_id", "idx"], "left")
        for c in (f"close_{k}", f"open_{k}"):
            out = out.withColumn(c, F.last(c, ignorenulls=True).over(over(None)))
    return out


def tolerant(rows: DataFrame, series: str = "all") -> DataFrame:
    """Bars of rows whose columns go by any of ALIASES; rows without valid prices are dropped, a missing volume stays null."""
    named = {c.lower(): c for c in rows.columns}
    pick = {to: F.coalesce(*(F.col(named[a]) for a in names if a in named)) if any(a in named for a in names) else F.lit(None) for to, names in ALIASES.items()}
    prices = [pick[c].cast("double") for c in ("open", "high", "low", "close")]
    out = rows.select(F.lit(series).alias("series_id"), pick["ts"].alias("ts"), *(p.alias(c) for p, c in zip(prices, ("open", "high", "low", "close"), strict=True)), pick["volume"].cast("double").alias("volume"))
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in ("open", "high", "low", "close"))
    return indexed(out.filter(f"{finite} and low <= least(open, close) and greatest(open, close) <= high"))


def from_lists(rows: DataFrame, column: str = "row", series: str = "all") -> DataFrame:
    """Bars of rows that are lists: time, open, high, low, close, volume; or five values without a time, which take the place they come in."""
    x, timed = F.col(column), F.size(column) >= 6
    at = lambda with_time, without: F.when(timed, F.try_element_at(x, F.lit(with_time))).otherwise(F.try_element_at(x, F.lit(without)))
    place = F.monotonically_increasing_id().cast("double")
    named = rows.select(F.when(timed, F.try_element_at(x, F.lit(1))).otherwise(place).alias("ts"), *(at(k + 2, k + 1).alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"))))
    return tolerant(named, series)


#: Keys under which packages keep their rows, in order of preference (fixed values).
CONTAINERS = ("candles", "data", "rows", "bars", "records")


def from_package_json(texts: DataFrame, column: str = "value", series: str = "all") -> DataFrame:
    """Bars of packages: JSON objects that hold a list of row objects under one of CONTAINERS, or such lists themselves."""
    row = "map<string,string>"
    parsed = texts.select(F.from_json(column, row).alias("m"), F.from_json(column, f"array<{row}>").alias("list"))
    held = F.coalesce(*(F.from_json(F.col("m")[k], f"array<{row}>") for k in CONTAINERS), F.col("list"))
    rows = parsed.select(F.explode(held).alias("r"))
    fields = {to: F.coalesce(*(F.col("r")[a] for a in names)) for to, names in ALIASES.items()}
    return tolerant(rows.select(*(v.try_cast("double").alias(k) for k, v in fields.items())), series)


CHART = "chart struct<result: array<struct<timestamp: array<long>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>>>>>"


def from_chart_json(texts: DataFrame, column: str = "value", series: str = "all") -> DataFrame:
    """Bars of chart responses: parallel arrays are zipped and exploded, incomplete or invalid rows dropped."""
    parsed = texts.select(F.from_json(column, CHART).alias("j")).select(F.explode("j.chart.result").alias("r"))
    quote = parsed.select("r.timestamp", F.col("r.indicators.quote")[0].alias("q"))
    rows = quote.select(F.explode(F.arrays_zip("timestamp", "q.open", "q.high", "q.low", "q.close", "q.volume")).alias("x"))
    rows = rows.select(F.timestamp_seconds("x.timestamp").alias("ts"), *(F.col(f"x.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))
    return tolerant(rows.na.drop(subset=["ts"]), series).select("series_id", "ts", "open", "high", "low", "close", "volume", "idx")


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series, in order."""
    back = Window.partitionBy("series_id").orderBy(F.desc("idx"))
    return bars.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n).drop("back")


def fingerprints(bars: DataFrame) -> DataFrame:
    """Bars with a SHA-256 of their raw fields in a fixed order and format."""
    fields = [F.col("series_id"), F.col("ts").cast("string"), *(F.format_string("%.6f", c) for c in ("open", "high", "low", "close")), F.col("volume").cast("string")]
    return bars.withColumn("fingerprint", F.sha2(F.concat_ws("|", *fields), 256))


def archive(bars: DataFrame, path: str) -> DataFrame:
    """Write bars with fingerprints as Parquet by series, read them back and report rows written, read and differing."""
    out = fingerprints(bars)
    out.write.mode("overwrite").partitionBy("series_id").parquet(path)
    back = bars.sparkSession.read.parquet(path).select(*out.columns)
    differ = out.exceptAll(back).unionByName(back.exceptAll(out)).agg(F.count("*").alias("differing"))
    return out.agg(F.count("*").alias("written")).crossJoin(back.agg(F.count("*").alias("read"))).crossJoin(differ)
