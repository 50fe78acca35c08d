"""Regime scores against a statement that goes window by window, on walks with ties, and on short and empty series."""

import numpy as np
from tidemark.operators import regimes

SCHEMA = "series_id string, idx long, open double, high double, low double, close double, volume long"


def walk(n, seed, series):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0.05, 1, n)).round(0)
    opened = close + rng.integers(-1, 2, n)
    return [(series, k, float(o), float(max(o, c) + x), float(min(o, c) - y), float(c), 10) for k, (o, c, x, y) in enumerate(zip(opened, close, rng.integers(0, 3, n), rng.integers(0, 3, n)))]


def context(rows):
    n, half = len(rows), len(rows) // 2
    up, down = sum(r[5] > r[2] for r in rows), sum(r[5] < r[2] for r in rows)
    lead = max(2, n * 0.05)
    grown = lambda a, b, more, less: more if a > b * 1.10 else less if a < b * 0.90 else "stable"
    moves = [abs(part[-1][5] - part[0][5]) for part in (rows[:half], rows[half:])]
    spans = [sum(r[3] - r[4] for r in part) / half for part in (rows[:half], rows[half:])]
    direction = "bullish" if up > down + lead else "bearish" if down > up + lead else "mixed"
    return direction, grown(moves[1], moves[0], "increasing", "decreasing"), grown(spans[1], spans[0], "expanding", "contracting")


def structure(rows):
    inner = range(2, len(rows) - 2)
    tops = [rows[i][3] for i in inner if all(rows[i][3] >= rows[i + d][3] for d in (-2, -1, 1, 2))]
    bottoms = [rows[i][4] for i in inner if all(rows[i][4] <= rows[i + d][4] for d in (-2, -1, 1, 2))]
    pairs = [*zip(tops, tops[1:]), *zip(bottoms, bottoms[1:])]
    good, bad = sum(b > a for a, b in pairs), sum(b < a for a, b in pairs)
    return "bullish" if good > bad + 1 else "bearish" if bad > good + 1 else "range"


def test_scale_states_match_statement(spark):
    data = [*walk(190, 1, "a"), *walk(150, 2, "b"), *walk(119, 3, "short")]
    of = {s: [r for r in data if r[0] == s] for s in ("a", "b")}
    got = {(r.series_id, r.idx): r for r in regimes.regime_scores(spark.createDataFrame(data, SCHEMA)).collect()}
    assert sorted(got) == [(s, k) for s in ("a", "b") for k in range(119, len(of[s]))]
    for (s, k), r in got.items():
        for n in regimes.SCALES:
            rows = of[s][k - n + 1 : k + 1]
            assert (r[f"direction{n}"], r[f"momentum{n}"], r[f"volatility{n}"], r[f"structure{n}"]) == (*context(rows), structure(rows)), (s, k, n)
        scores = [r[x] for x in regimes.REGIMES]
        assert r.leader == regimes.REGIMES[scores.index(max(scores))]
        assert abs(r.confidence - (max(scores) / sum(scores) * 100 if sum(scores) else 0)) < 1e-9
    assert regimes.regime_scores(spark.createDataFrame([], SCHEMA)).collect() == []
