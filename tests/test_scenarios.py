"""Capped shares, scores of one bar by hand, votes and events of no bars."""

import pytest
from tests.test_sequences import BARS, walk
from tidemark.operators import fusion, scenarios


def stated_cap(shares):
    shares = list(shares)
    at = max(range(3), key=lambda k: shares[k])
    if shares[at] > 0.80:
        excess, shares[at] = shares[at] - 0.80, 0.80
        rest = sum(s for k, s in enumerate(shares) if k != at)
        shares = [s if k == at or not rest else s + excess * s / rest for k, s in enumerate(shares)]
    return shares


def test_what_is_cut_off_goes_to_the_others(spark):
    rows = [(0.9, 0.06, 0.04), (0.05, 0.9, 0.05), (0.0, 0.1, 0.9), (0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (1.0, 0.0, 0.0), (0.8, 0.1, 0.1)]
    got = scenarios.capped(spark.createDataFrame(rows, "a double, b double, d double"), ("a", "b", "d")).collect()
    for r, row in zip(got, rows, strict=True):
        assert tuple(r) == pytest.approx(stated_cap(row))


def test_shares_are_whole_and_bounded(spark):
    table = spark.createDataFrame(walk(130, 2, "a") + [("c", k, 5.0, 5.0, 5.0, 5.0, 1) for k in range(40)], BARS)
    rows = scenarios.scenario_scores(table).collect()
    assert len(rows) == 3 * 170
    for r in rows:
        assert r.percent_bullish + r.percent_bearish + r.percent_neutral == pytest.approx(100)
        assert max(r.share_bullish, r.share_bearish, r.share_neutral) <= 0.80 + 1e-12
    near, far = ({(r.series_id, r.idx): abs(r.percent_bullish - 33.33) for r in rows if r.horizon == h} for h in (4, 16))
    assert all(far[k] == pytest.approx(0.84 * near[k]) for k in near)
    flat = [r for r in rows if r.series_id == "c"]
    assert all(r.score_bullish == r.score_bearish == 0 or r.support > 0 or r.resolved > 0 for r in flat)
    for r in scenarios.fused(table).collect():
        assert r.fused_bullish + r.fused_bearish + r.fused_neutral == pytest.approx(1) and 0 <= r.trust <= 1
    inside = scenarios.event_independence(table).collect()
    assert {sum(r.n_inside + r.n_outside for r in inside if (r.series_id, r.scheme) == k) for k in {(r.series_id, r.scheme) for r in inside}} <= {130, 40}


def test_levels_at_zero_reach_nothing(spark):
    lows = {5: 0.0, 12: 0.0, 19: 2.0, 26: 2.002}
    rows = [("a", k, 5.0, 9.0, lows.get(k, 4.0), 5.0, 1) for k in range(34)]
    got = [(r.level_no, round(r.price, 6), r.touches, r.side) for r in fusion.level_clusters(spark.createDataFrame(rows, BARS)).orderBy("level_no").collect()]
    assert got == [(0, 0.0, 1, "SUPPORT"), (1, 0.0, 1, "SUPPORT"), (2, 2.001, 2, "SUPPORT")]


def test_no_bars(spark):
    none = spark.createDataFrame([], BARS)
    assert [f(none).collect() for f in (scenarios.scenario_scores, scenarios.fused, scenarios.group_votes, scenarios.event_independence)] == [[]] * 4
