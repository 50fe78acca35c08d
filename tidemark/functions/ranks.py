"""Exact ranks of large groups: rows are dealt by ranges of the order, numbered where they lie, and each range adds what lies before it.

A window over a group puts all of the group into one task; here a group of any size is spread over as many tasks as there are
partitions, and only one row for each group and range goes through a window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shared

c = F.col


def dealt(rows: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The rows (of them the columns ``keep``) in ranges of keys and order, written once: ``_at`` grows in that order, ``_part`` numbers the ranges."""
    spread = rows.repartitionByRange(*([ranges] if ranges else []), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    return shared.cut(spread.select(*(keep or rows.columns), "_at"), "ranked").withColumn("_part", F.shiftright("_at", 33))


def with_ranges(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each dealt row the columns that ``parts`` holds for its keys (null being equal to null) and range."""
    by = [*keys, "_part"]
    parts = parts.withColumnsRenamed({k: f"_of_{k}" for k in by})
    return rows.join(parts, functools.reduce(Column.__and__, (c(k).eqNullSafe(c(f"_of_{k}")) for k in by))).drop(*(f"_of_{k}" for k in by))


def ranked(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", total: str = "total", keep: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds the 1-based ``rank`` of each row among those of its ``keys`` by ``order`` (a total order, nulls first), and their number.

    ``keep`` names the columns to keep, ``keys`` among them; ``ranges`` sets the number of ranges.
    """
    spread = dealt(rows, keys, order, keep, ranges)
    parts = spread.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, so that its true size is known: as a rule it is small enough to be sent to the rows.
    parts = shared.cut(parts.select(*keys, "_part", (before - c("_first") + 1).alias("_shift"), F.sum("_n").over(by).alias(total)), "ranges")
    return with_ranges(spread, parts, keys).withColumn(rank, c("_at") + c("_shift")).drop("_at", "_part", "_shift")


def average_ranks(rows: DataFrame, keys: list[str], value: str, ties: list[str], rank: str) -> DataFrame:
    """Adds the rank of ``value`` within ``keys``, ties sharing the mean of theirs; ``ties`` makes the order total."""
    at = ranked(rows, keys, [value, *ties], "_rank", "_total")
    shared_rank = at.groupBy(*keys, value).agg(((F.min("_rank") + F.max("_rank")) / 2).alias(rank))
    return at.drop("_rank", "_total").join(shared_rank, [*keys, value])


def dealt_anew(rows: DataFrame, keys: list[str], place: str, value: str, draw: Column) -> DataFrame:
    """For each row of ``keys`` at its place the ``value`` of the row whose ``draw`` has that rank: (keys, place, value)."""
    drawn = rows.select(*keys, value, draw.alias("_draw"), c(place).alias("_tie"))
    return ranked(drawn, keys, ["_draw", "_tie"], place, "_total").select(*keys, place, value)
