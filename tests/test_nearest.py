"""Nearest neighbours by blocks against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import nearest


def table(spark, seed, n, name, groups=3, d=4):
    rng = np.random.default_rng(seed)
    rows = [(int(g), k, f"l{k % 3}", [float(round(x, 1)) for x in rng.normal(size=d) + 4 * rng.integers(0, 3)]) for k, g in enumerate(rng.integers(0, groups, n))]
    return rows, spark.createDataFrame(rows, f"g int, {name} long, label string, z array<double>")


def stated(queries, points, k, measure):
    out = {}
    for g, i, _, z in queries:
        near = sorted((round(measure(z, x), 9), h, label) for gg, h, label, x in points if gg == g)[:k]
        out[g, i] = [(h, label, d) for d, h, label in near]
    return {key: x for key, x in out.items() if x}


def euclid(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def mixed(a, b):
    return math.sqrt(sum(((x - y) / max(abs(x), abs(y), 0.0001)) ** 2 for x, y in zip(a[:2], b[:2], strict=True)) + sum(x != y for x, y in zip(a[2:], b[2:], strict=True)))


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out.setdefault((r.g, r.idx), []).append((r.h_idx, r.label, r.distance))
    return out


@pytest.mark.parametrize("block", [5, 40, 2048])
def test_neighbours_by_blocks_are_those_of_all_pairs(spark, block):
    q, queries = table(spark, 1, 60, "idx")
    h, points = table(spark, 2, 150, "h_idx", groups=2)  # one key has no points
    h += [(0, 500 + k, "copy", h[0][3]) for k in range(30)]
    points = points.unionByName(spark.createDataFrame(h[150:], points.schema))
    assert found(nearest.top_k(queries, points, ["g"], ["idx"], 7, block=block)) == stated(q, h, 7, euclid)
    assert found(nearest.top_k(queries, points, ["g"], ["idx"], 200, block=block)) == stated(q, h, 200, euclid)  # more than there are
    assert found(nearest.top_k(queries, points, ["g"], ["idx"], 7, nearest.mixed(2), metric=False, block=block)) == stated(q, h, 7, mixed)
    assert found(nearest.top_k(queries.limit(0), points, ["g"], ["idx"], 7, block=block)) == {}


def test_far_blocks_are_not_compared(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)
    plain = nearest.euclidean

    def counted(q, h):
        met.add(len(q) * len(h))
        return plain(q, h)

    rng = np.random.default_rng(3)
    rows = [(0, k, "x", [float(x) for x in rng.normal(size=2) + 100 * (k % 10)]) for k in range(1000)]
    points = spark.createDataFrame(rows, "g int, h_idx long, label string, z array<double>")
    queries = points.filter("h_idx % 5 = 0").select("g", F.col("h_idx").alias("idx"), "z")
    got = nearest.top_k(queries, points, ["g"], ["idx"], 3, counted, block=50)
    assert found(got) == stated([(r.g, r.idx, None, r.z) for r in queries.collect()], rows, 3, euclid)
    assert met.value < 0.5 * 200 * 1000
