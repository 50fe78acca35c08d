"""The forecasting loop with its whole memory as a stream: buckets of equal states, forecasts at several horizons, outcomes when their bar comes.

Each event is a bar with its state (fusion.states) and close. By series the operator keeps a map of buckets, a list of
outcomes that are pending at each horizon, and the last bar. A bar first reveals the outcomes that fall due at it and
teaches them to the buckets of the bars they belong to; then it is forecast at every horizon from what has been revealed;
then its own outcomes become pending. Buckets and weights are those of fusion.unified_retrieval.

Bars of a series come in order, in one batch or several; a bar at or before the last one changes nothing, so events may be
delivered again. A batch reads a series' buckets once and writes back those that changed. Rows without a state or close are
left out by whoever makes the events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import shared
from tidemark.operators import fusion

c = F.col
KINDS = ("bullish", "bearish", "neutral")
HORIZONS, BAND, LEAST_SCORE, USED, FULL = (4, 8, 16), 0.001, 0.34, 25, 20
EVENTS = "series_id string, idx long, close double, bucket long, parts string, returns array<double>, path array<double>, kept_returns array<double>, kept_path array<double>"
OUT = (
    "series_id string, idx long, horizon int, n long, evidence long, level string, best double, p_bullish double, p_bearish double, p_neutral double, "
    "favored string, outcome string, result string"
)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(bars: DataFrame) -> DataFrame:
    flat = lambda path: F.flatten(F.transform(path, lambda x: F.array(x["change"], x["range"], x["direction"], x["body"])))
    rows = fusion.states(bars).join(bars.select("series_id", "idx", "close"), ["series_id", "idx"])
    return rows.select("series_id", "idx", "close", "bucket", F.to_json("parts").alias("parts"), "returns", flat(c("path")).alias("path"), "kept_returns", F.flatten("kept_path").alias("kept_path"))


class Buckets:
    """A series' buckets as arrays, so that a bar is compared with all of them at once."""

    def __init__(self, kept: dict[int, str]):
        self.at: dict[int, int] = {}
        self.parts: list[list[str]] = []
        self.returns, self.path = np.zeros((64, 4)), np.zeros((64, 48))
        self.counts = np.zeros((64, len(HORIZONS), 3), np.int64)
        self.names, self.codes, self.changed = np.zeros((64, 12), np.int64), {}, set()
        for bucket, text in kept.items():
            value = json.loads(text)
            k = self._added(bucket, value["parts"], value["returns"], value["path"])
            self.counts[k] = value["counts"]
        self.changed.clear()

    def coded(self, parts: list[str]) -> np.ndarray:
        return np.array([self.codes.setdefault(p, len(self.codes)) for p in parts])

    def _added(self, bucket: int, parts: list[str], returns: list[float], path: list[float]) -> int:
        k = self.at.setdefault(bucket, len(self.at))
        if k == len(self.returns):
            self.returns, self.path, self.counts, self.names = (np.concatenate([x, np.zeros_like(x)]) for x in (self.returns, self.path, self.counts, self.names))
        if k == len(self.parts):
            self.parts.append(parts)
            self.returns[k], self.path[k], self.names[k] = returns, path, self.coded(parts)
        return k

    def learn(self, bucket: int, parts: list[str], returns: list[float], path: list[float], horizon: int, kind: int) -> None:
        k = self._added(bucket, parts, returns, path)
        self.counts[k, horizon, kind] += 1
        self.changed.add(bucket)

    def forecast(self, bucket: int, parts: list[str], returns: np.ndarray, path: np.ndarray) -> list[tuple]:
        """Of each horizon: matches, evidence, level, best likeness, shares of the kinds and the favoured one."""
        n, own = len(self.at), self.at.get(bucket)
        equal = (self.names[:n] == self.coded(parts)).sum(1) / 12
        near = (1 / (1 + 25 * np.abs(self.returns[:n] - returns))).sum(1) / 4
        apart = np.abs(self.path[:n] - path).reshape(n, 12, 4).sum(2) / 4
        score = np.round(0.55 * equal + 0.20 * near + 0.25 * ((1 / (1 + apart)).sum(1) / 12), 9)
        number = np.fromiter(self.at, np.int64, n)
        out = []
        for h in range(len(HORIZONS)):
            size = self.counts[:n, h].sum(1)
            rows = np.flatnonzero((size > 0) & (score >= LEAST_SCORE) & (np.arange(n) != (-1 if own is None else own)))
            rows = rows[np.lexsort((number[rows], -size[rows], -score[rows]))][:USED]
            weighed = ((score[rows] * np.minimum(1, size[rows] / FULL))[:, None] * self.counts[rows, h]).sum(0)
            evidence = int(size[rows].sum())
            if own is not None:
                weighed, evidence = weighed + self.counts[own, h], evidence + int(size[own])
            total = weighed.sum()
            level = "NONE" if total <= 0 else "WEAK" if evidence < 20 else "MODERATE" if evidence < 100 else "STRONG"
            p = (weighed + 1) / (total + 3)
            out.append((len(rows), evidence, level, float(score[rows[0]]) if len(rows) else None, *p.tolist(), KINDS[int(p.argmax())]))
        return out

    def kept(self, bucket: int) -> str:
        k = self.at[bucket]
        return json.dumps({"parts": self.parts[k], "returns": self.returns[k].tolist(), "path": self.path[k].tolist(), "counts": self.counts[k].tolist()})


def outcome(start: float, end: float) -> int:
    least = max(start * BAND, 1e-9)
    return 0 if end - start > least else 1 if start - end > least else 2


class Memory(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", "bucket long", "value string")
        self.pending = handle.getValueState("pending", "value string")
        self.last = handle.getValueState("last", "idx long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (series,) = key
        last = self.last.get()[0] if self.last.exists() else -1
        pending = json.loads(self.pending.get()[0]) if self.pending.exists() else []
        memory = Buckets({k[0]: v[0] for k, v in self.buckets.iterator()})
        bars = pd.concat(list(rows)).sort_values("idx").drop_duplicates("idx")
        out = []
        for bar in bars[bars["idx"] > last].itertuples(index=False):
            waiting = []
            for p in pending:
                if p["idx"] + HORIZONS[p["h"]] > bar.idx:
                    waiting.append(p)
                    continue
                kind = outcome(p["close"], bar.close)
                memory.learn(p["bucket"], p["parts"], p["returns"], p["path"], p["h"], kind)
                result = "neutral" if 2 in (kind, KINDS.index(p["said"])) else "confirmed" if KINDS[kind] == p["said"] else "not_confirmed"
                out.append((series, p["idx"], HORIZONS[p["h"]], *[None] * 8, KINDS[kind], result))
            parts = json.loads(bar.parts)
            for h, found in enumerate(memory.forecast(bar.bucket, parts, np.array(bar.returns), np.array(bar.path))):
                out.append((series, bar.idx, HORIZONS[h], *found, None, None))
                waiting.append({"idx": int(bar.idx), "h": h, "close": bar.close, "bucket": int(bar.bucket), "parts": parts, "returns": list(bar.kept_returns), "path": list(bar.kept_path), "said": found[-1]})
            pending, last = waiting, int(bar.idx)
        for bucket in memory.changed:
            self.buckets.updateValue((bucket,), (memory.kept(bucket),))
        self.pending.update((json.dumps(pending),))
        self.last.update((last,))
        names = [f.split()[0] for f in OUT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"idx": "int64", "horizon": "int32", "n": "Int64", "evidence": "Int64", **{x: "float64" for x in names if x.startswith("p_") or x == "best"}})

    def close(self) -> None:
        pass


def forecasts(stream: DataFrame) -> DataFrame:
    """A stream of events -> rows of forecasts (at their bar) and of outcomes (when revealed)."""
    return stream.groupBy("series_id").transformWithStateInPandas(Memory(), OUT, "Append", "None")


def store(batch: DataFrame, number: int, folder: str) -> None:
    """A batch's rows under its number: a batch that is run again replaces its own rows."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each (series_id, idx, horizon): the forecast, and the outcome and result once they are known."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(folder)
    names = [f.split()[0] for f in OUT.split(", ")][3:]
    return rows.groupBy("series_id", "idx", "horizon").agg(*(F.first(n, ignorenulls=True).alias(n) for n in names))


def run(spark: SparkSession, source: str, folder: str, checkpoint: str, files_a_batch: int = 64) -> DataFrame:
    """Take in what is new in the folder ``source`` and return all observations; the checkpoint lets a later run go on.

    The state lives in RocksDB, which the running session is told to use while the stream runs.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        query = forecasts(stream).writeStream.foreachBatch(lambda df, n: store(df, n, folder)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, was)
    return observations(spark, folder)


def replay(bars: DataFrame, slices: int = 3) -> DataFrame:
    """The loop over given bars: their events arrive in ``slices`` pieces by time, and the stream runs after each."""
    spark, folder = bars.sparkSession, shared.folder(bars.sparkSession, "memory")
    rows = shared.cut(events(bars), "memory-events")
    last = rows.agg(F.max("idx")).head()[0]
    if last is None:
        return spark.createDataFrame([], OUT)
    for k in range(slices):
        rows.filter(F.floor(c("idx") * slices / (last + 1)) == k).repartition("series_id").write.mode("append").parquet(f"{folder}/events")
        out = run(spark, f"{folder}/events", f"{folder}/observations", f"{folder}/checkpoint")
    return out
