"""Exponential means of long series: a prefix scan over blocks of bars, so that one series is many tasks.

The recursion e' = r e + (1 - r) x is an affine map of e, and so is a whole block of bars: e' = r**n e + s, where s is the
weighted sum of the block's values. Tasks sum s where the bars are; a scan over (series, block, s), one narrow row for each
BLOCK bars, composes the maps and gives every block the value that enters it; blocks then run the recursion side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import case

c = F.col
BLOCK = 4096


def exponential_means(bars: DataFrame, column: str, periods: tuple[int, ...], block: int = BLOCK) -> DataFrame:
    """Adds ema_<period> of ``column``, seeded with the first value, with weight 2 / (period + 1) for the new value.

    Bars of a series are numbered from 0 without gaps (``idx``), and ``column`` holds numbers.
    """
    keep = {p: 1 - 2 / (p + 1) for p in periods}
    names = [f"ema_{p}" for p in periods]
    rows = bars.withColumn("block", F.floor(c("idx") / block).cast("long"))
    place = c("idx") - c("block") * block
    weight = lambda p: (1 - keep[p]) * F.pow(F.lit(keep[p]), F.lit(block - 1) - place)
    sums = rows.groupBy("series_id", "block").agg(F.min_by(c(column), c("idx")).alias("first"), *(F.sum(weight(p) * c(column)).alias(f"ema_{p}") for p in periods))

    def entries(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block").reset_index(drop=True)
        out = blocks[["series_id", "block"]].copy()
        for p, name in zip(periods, names, strict=True):
            value, through = float(blocks["first"].iloc[0]), keep[p] ** block
            entry = []
            for s in blocks[name]:
                entry.append(value)
                value = through * value + s
            out[f"in_{p}"] = entry
        return out

    entering = sums.groupBy("series_id").applyInPandas(entries, "series_id string, block long, " + ", ".join(f"in_{p} double" for p in periods))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        out = {"series_id": part["series_id"], "idx": part["idx"]}
        for p, name in zip(periods, names, strict=True):
            whole = pd.concat([part[f"in_{p}"].iloc[:1], part[column]], ignore_index=True)
            out[name] = whole.ewm(alpha=1 - keep[p], adjust=False).mean().iloc[1:].to_numpy()
        return pd.DataFrame(out)

    narrow = rows.select("series_id", "block", "idx", c(column).cast("double").alias(column)).join(entering, ["series_id", "block"])
    means = narrow.groupBy("series_id", "block").applyInPandas(run, "series_id string, idx long, " + ", ".join(f"{n} double" for n in names))
    return bars.join(means, ["series_id", "idx"])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = BLOCK) -> DataFrame:
    """The difference of two exponential means of the close, its own mean, and on which side of it the difference lies."""
    lines = exponential_means(bars.select("series_id", "idx", "close"), "close", (fast, slow), block)
    lines = lines.select("series_id", "idx", (c(f"ema_{fast}") - c(f"ema_{slow}")).alias("macd"))
    out = exponential_means(lines, "macd", (signal,), block).withColumnRenamed(f"ema_{signal}", "signal")
    out = out.withColumn("histogram", c("macd") - c("signal"))
    return out.withColumn("state", case((c("histogram") > 1e-9, "BULLISH"), (c("histogram") < -1e-9, "BEARISH"), otherwise="NEUTRAL"))
