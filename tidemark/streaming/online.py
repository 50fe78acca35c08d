"""Predict, reveal, learn as a stream: state per series and state key, pending predictions until their outcome is known, and a memory that can be kept.

The stream's events come in order of ``at`` for each key: an ask (predict bar idx now) or an outcome (bar idx turned out
so). A repeated ask, and an outcome of a bar that is not pending, change nothing: events may be delivered again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import outcomes, structure

c = F.col
KINDS = ("bullish", "bearish", "neutral")
EVENTS = "series_id string, state_key string, at long, ask int, idx long, outcome string"
PREDICTIONS = "series_id string, idx long, state_key string, support long, p_bullish double, p_bearish double, p_neutral double, prediction string"
_STATE = "bullish long, bearish long, neutral long, asked long, pending array<long>"


def events(bars: DataFrame, horizon: int = 4, lag: int | None = None) -> DataFrame:
    """Asks at each bar and outcomes ``lag`` bars later (default: the horizon)."""
    rows = structure.market_states(bars).select("series_id", "idx", "state_key").join(outcomes.outcomes(bars, (horizon,)).select("series_id", "idx", "price_direction"), ["series_id", "idx"])
    none = F.lit(None).cast("string")
    asks = rows.select("series_id", "state_key", c("idx").alias("at"), F.lit(1).alias("ask"), "idx", none.alias("outcome"))
    known = rows.filter("price_direction is not null").select("series_id", "state_key", (c("idx") + (horizon if lag is None else lag)).alias("at"), F.lit(0).alias("ask"), "idx", c("price_direction").alias("outcome"))
    return asks.unionByName(known)


def _advance(key: tuple[str, str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    *counts, asked, pending = state.get if state.exists else (0, 0, 0, -1, [])
    n, waiting, out = dict(zip(KINDS, counts, strict=True)), set(pending or []), []
    rows = pd.concat(list(parts)).sort_values(["at", "ask", "idx"])
    for idx, ask, outcome in zip(rows["idx"].tolist(), rows["ask"].tolist(), rows["outcome"].tolist(), strict=True):
        if not ask:
            if idx in waiting:
                waiting.discard(idx)
                n[outcome] += 1
        elif idx > asked:
            total = sum(n.values())
            p = {k: (n[k] + 1) / (total + 3) for k in KINDS}
            out.append((key[0], idx, key[1], total, *p.values(), max(KINDS, key=lambda k: p[k])))
            asked = idx
            waiting.add(idx)
    state.update((*n.values(), asked, sorted(waiting)))
    found = pd.DataFrame(out, columns=["series_id", "idx", "state_key", "support", "p_bullish", "p_bearish", "p_neutral", "prediction"])
    # An empty frame has no types of its own.
    yield found.astype({"idx": "int64", "support": "int64", **{f"p_{k}": "float64" for k in KINDS}})


def predictions(stream: DataFrame) -> DataFrame:
    """A stream of events -> a stream of predictions, each made from the outcomes revealed before it."""
    return stream.groupBy("series_id", "state_key").applyInPandasWithState(_advance, PREDICTIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, files_a_batch: int = 8) -> DataFrame:
    """Take in what is new in the folder ``source`` (Parquet of EVENTS) and return all predictions made so far; the checkpoint lets a later run go on."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = predictions(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(PREDICTIONS).parquet(sink)


def append(rows: DataFrame, source: str) -> None:
    """Add events to the folder, those of a key in one file, so that keys keep their order."""
    rows.select("series_id", "state_key", "at", "ask", "idx", "outcome").repartition("series_id", "state_key").write.mode("append").parquet(source)


def replay(bars: DataFrame, folder: str, slices: int = 3) -> DataFrame:
    """The loop over given bars: their events arrive in ``slices`` pieces by time, and the stream runs after each."""
    spark, rows = bars.sparkSession, events(bars)
    last = rows.agg(F.max("at")).head()[0] or 0
    out = spark.createDataFrame([], PREDICTIONS)
    for k in range(slices):
        append(rows.filter(F.floor(c("at") * slices / (last + 1)) == k), f"{folder}/events")
        out = run(spark, f"{folder}/events", f"{folder}/predictions", f"{folder}/checkpoint")
    return out


def memory(rows: DataFrame) -> DataFrame:
    """(series_id, state_key, count, outcomes) of all revealed outcomes: outcomes is a map of counts."""
    counts = rows.filter("ask = 0").groupBy("series_id", "state_key", "outcome").agg(F.count("*").alias("n"))
    return counts.groupBy("series_id", "state_key").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))


def _manifest(kept: DataFrame) -> DataFrame:
    line = F.concat_ws("|", "series_id", "state_key", "count", F.to_json("outcomes"))
    return kept.agg(F.count("*").alias("n_buckets"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_outcomes"), F.coalesce(F.sum(F.xxhash64(line).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def save_memory(kept: DataFrame, path: str) -> None:
    """Write the memory and a manifest of its size and digest."""
    kept.write.mode("overwrite").parquet(f"{path}/buckets")
    _manifest(kept.sparkSession.read.parquet(f"{path}/buckets")).write.mode("overwrite").parquet(f"{path}/manifest")


def load_memory(spark: SparkSession, path: str) -> DataFrame:
    """The memory as saved; an error if it does not agree with its manifest."""
    kept = spark.read.parquet(f"{path}/buckets")
    if _manifest(kept).head() != spark.read.parquet(f"{path}/manifest").head():
        raise ValueError(f"the memory in {path} is not what its manifest says")
    return kept
