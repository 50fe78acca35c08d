"""The engine's queries against their SQL in DuckDB, the structure windows against a sequential statement, and edge cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions.columns import series
from tidemark.operators import behaviour, candles, evaluation, fusion, learning, outcomes, quality, structure
from tidemark.plans import catalog
from tidemark.sources import bars as source
from tidemark.streaming import online

SF = "/root/testdata/sf0.001"
SLOW = {"retrieval_topk", "retrieval_shares", "retrieval_decision", "retrieval_boundary_audit", "rule_validation", "rule_predictions", "stable_rules", "rule_mining", "forecast_shapes", "incremental_value", "discrimination", "tertile_agreement", "accuracy_permutation", "bootstrap_lift", "sign_test", "retrieval_null", "label_permutation", "coverage_summary", "similarity_histogram", "failure_patterns", "temporal_integrity", "calibration_grid", "confidence_sweep", "stability", "correlations", "discretised_rules", "excursion_summary", "threshold_grid", "regime_frequency", "segment_states", "nearest_zones", "seen_states_semi", "confusion_matrix", "calibration_ece", "ensemble_probability", "temperature_scaling", "evidence_rules", "shrunk_retrieval", "component_ablation", "failure_penalties", "naive_baselines", "decision_stability", "unified_retrieval", "candidate_diagnostics"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(r[k]) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL if n not in SLOW])
def test_query_matches_sql(spark, duck, name):
    got = [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    if got or want:
        assert comparable(got) == comparable(want)


def walk(n, seed, series="s"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n)).round(1)
    opened = close + rng.normal(0, 1, n).round(1)
    return [(series, k, float(o), float(max(o, c) + abs(x)), float(min(o, c) - abs(y)), float(c), 10) for k, (o, c, x, y) in enumerate(zip(opened, close, rng.normal(0, 1, n).round(1), rng.normal(0, 1, n).round(1)))]


def sequential_structure(rows):
    """Events and trends bar by bar, as the definition states them."""
    high = low = None
    used, trend, out = set(), "NEUTRAL", []
    for i, (_, _, _, _, _, close, _) in enumerate(rows):
        j = i - 3
        if j >= 3:
            around = [rows[k] for k in range(j - 3, j + 4) if k != j]
            if all(rows[j][3] > r[3] for r in around):
                high = (j, i, rows[j][3])
            if all(rows[j][4] < r[4] for r in around):
                low = (j, i, rows[j][4])
        event = "NONE"
        if high and i > high[1] and close > high[2] and (high, 1) not in used:
            event = "CHoCH_BULLISH" if trend == "BEARISH" else "BOS_BULLISH"
            used.add((high, 1))
            trend = "BULLISH"
        if low and i > low[1] and close < low[2] and (low, 0) not in used:
            event = event if event != "NONE" else "CHoCH_BEARISH" if trend == "BULLISH" else "BOS_BEARISH"
            used.add((low, 0))
            trend = "BEARISH"
        out.append((event, trend))
    return out


BARS = "series_id string, idx long, open double, high double, low double, close double, volume long"


def test_structure_matches_sequential_statement(spark):
    series = {f"s{seed}": walk(250, seed, f"s{seed}") for seed in range(4)}
    table = spark.createDataFrame([r for rows in series.values() for r in rows], BARS)
    got = structure.structure(candles.features(table)).select("series_id", "idx", "event", "trend").collect()
    by = {(r.series_id, r.idx): (r.event, r.trend) for r in got}
    for name, rows in series.items():
        assert [by[name, k] for k in range(len(rows))] == sequential_structure(rows)


def test_past_does_not_depend_on_future(spark):
    table = spark.createDataFrame(walk(160, 9), BARS)
    keep = lambda d: structure.episodes(d).select("idx", "state_key", "episode", "atr").filter("idx < 90")
    assert tuple(evaluation.differing(keep(table), keep(evaluation.with_changed_future(table, 90))).head()) == (0, 0)


def test_audits_find_late_dependence_on_the_future(spark):
    """Features that read the next bar after bar 150 of 400 only, a price or the volume, next to one that doesn't."""
    table = spark.createDataFrame(walk(400, 3, "a") + walk(400, 4, "b"), BARS)
    ahead = lambda n: lambda d: d.withColumn("leak", F.when(F.col("idx") > 150, F.lead(n).over(series())))
    assert sorted(r.cut for r in evaluation.cuts(table).collect()) == [40, 40, 100, 100, 200, 200, 300, 300]
    for n in ("close", "volume"):
        for suffix in (False, True):
            assert tuple(evaluation.future_dependence(table, ahead(n), suffix).head())[:2] == (4, 4)
    for suffix in (False, True):
        assert tuple(evaluation.future_dependence(table, structure.episodes, suffix).head()) == (0, 0, 1280)


def test_flat_bars_and_warm_up(spark):
    rows = [("s", k, 5.0, 5.0, 5.0, 5.0, 1) for k in range(20)]
    f = candles.features(spark.createDataFrame(rows, BARS)).orderBy("idx").collect()
    assert [r.atr is None for r in f] == [k < 13 for k in range(20)]
    assert all(r.body_share == 0 and r.r8 == 0 for r in f)
    assert {r.label for r in candles.classes(spark.createDataFrame(rows, BARS)).collect()} == {"flat"}


def test_contract_outcomes(spark):
    rows = [("s", k, 100 + 0.25 * k, 100.35 + 0.25 * k, 99.9 + 0.25 * k, 100.25 + 0.25 * k, 1) for k in range(30)]
    out = {(r.idx, r.horizon): r for r in outcomes.outcomes(spark.createDataFrame(rows, BARS)).collect()}
    assert out[20, 4].quality == "COMPLETE" and out[20, 4].direction == "UP" and out[20, 4].time_to_high == 4
    assert out[28, 4].quality == "INCOMPLETE" and out[28, 4].direction is None


def test_tolerant_rows(spark):
    rows = [(1, 1.0, 3.0, 0.5, 2.0, None), (2, None, 3.0, 1.0, 2.0, 5), (3, 2.0, 1.0, 0.5, 1.5, 5), (4, float("nan"), 3.0, 1.0, 2.0, 5), (5, 2.0, 2.5, 1.0, 1.5, 7)]
    got = source.tolerant(spark.createDataFrame(rows, "time long, o double, h double, l double, c double, vol int")).orderBy("idx").collect()
    assert [(r.ts, r.idx, r.volume) for r in got] == [(1, 0, None), (5, 1, 7.0)]


def test_chart_json(spark):
    text = '{"chart": {"result": [{"timestamp": [10, 20, 30], "indicators": {"quote": [{"open": [1, null, 2], "high": [2, 2, 3], "low": [0.5, 1, 1], "close": [1.5, 1, 2.5], "volume": [4, 5, null]}]}}]}}'
    got = source.from_chart_json(spark.createDataFrame([(text,)], "value string")).orderBy("idx").collect()
    assert [(r.close, r.volume) for r in got] == [(1.5, 4.0), (2.5, None)]


def test_archive_round_trip(spark, tmp_path):
    bars = source.hourly(spark, SF)
    report = source.archive(bars, str(tmp_path / "archive")).head()
    assert report.written == report.read == bars.count() and report.differing == 0


def test_reference_maturity_sees_more(spark):
    bars = source.hourly(spark, SF)
    support = lambda m: learning.online_walk_forward(bars, 4, m).agg(F.sum("support")).head()[0]
    assert support("reference") > support("fenced")


def test_audit_finds_faults(spark):
    rows = [("s", 0, 1, 1.0, 2.0, 0.5, 1.5, 3), ("s", 1, 1, 1.0, 0.9, 0.5, 1.5, 3), ("s", 2, 0, 1.0, 2.0, 0.5, 1.5, -1)]
    r = quality.audit(spark.createDataFrame(rows, "series_id string, idx long, ts long, open double, high double, low double, close double, volume long")).head()
    assert (r.n_invalid, r.n_disordered, r.n_repeated, r.n_duplicates, r.verdict) == (1, 1, 1, 1, "FAIL")


def test_validity_needs_finite_values_and_a_volume(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, 0.5, 1.5, 3.0), (1.0, nan, 0.5, 1.5, 3.0), (1.0, 2.0, 0.5, 1.5, None), (1.0, inf, 0.5, 1.5, 3.0), (None, 2.0, 0.5, 1.5, 3.0), (1.0, 2.0, 0.5, 1.5, -1.0), (1.0, 2.0, -0.5, 1.5, 1.0)]
    table = spark.createDataFrame([("s", k, k, *r) for k, r in enumerate(rows)], "series_id string, idx long, ts long, open double, high double, low double, close double, volume double")
    got = quality.with_validity(table).orderBy("idx").collect()
    assert [r.contract_valid for r in got] == [1, 0, 0, 0, 0, 0, 0]
    assert quality.audit(table).head().n_contract_invalid == 6


def test_overlaps_on_windows_with_gaps(spark):
    rng = np.random.default_rng(5)
    rows = [("a", 0, 4), ("a", 100, 104), ("a", 200, 204), ("b", 10, 14), ("b", 12, 16), ("b", 20, 24), ("b", 24, 30)] + [("c", int(i), int(i + n)) for i, n in zip(rng.choice(400, 80, replace=False), rng.integers(1, 90, 80))]
    table = spark.createDataFrame(rows, "series_id string, idx long, stop long")
    want = {(s, i): sum(t == s and j < i < e for t, j, e in rows) for s, i, _ in rows}
    assert {(r.series_id, r.idx): r.n_overlapping for r in quality.overlapping_targets(table).collect()} == want
    pairs = {(r.series_id, r.idx, r.later_idx) for r in quality.overlapping_pairs(table, 16).collect()}
    assert pairs == {(s, j, i) for s, i, _ in rows for t, j, e in rows if t == s and j < i < e}


def test_roles_and_visibility(spark):
    rows = quality.with_roles(spark.createDataFrame([(1, 2, 3)], "ts long, r1 long, future long"), {"future": "future_target"})
    quality.check_inputs(rows, ["r1"])
    for bad in (lambda: quality.check_inputs(rows, ["r1", "future"]), lambda: quality.with_roles(rows, {"r1": "other"}), lambda: quality.visible(rows, 0)):
        with pytest.raises(ValueError):
            bad()
    assert quality.visible(rows, 1).count() == 1


def test_rows_as_lists_and_packages(spark):
    lists = spark.createDataFrame([([7.0, 1.0, 3.0, 0.5, 2.0, 5.0],), ([9.0, 1.0, 0.5, 0.4, 2.0, 5.0],), ([8.0, 1.0, 3.0, 0.5, 2.0],)], "row array<double>")
    got = source.from_lists(lists).orderBy("idx").collect()
    assert [(r.open, r.close, r.volume) for r in got if r.ts == 7] == [(1.0, 2.0, 5.0)] and len(got) == 1
    five = source.from_lists(spark.createDataFrame([([1.0, 3.0, 0.5, 2.0, 5.0],), ([2.0, 3.0, 0.5, 2.5, 6.0],)], "row array<double>").coalesce(1))
    assert [(r.idx, r.close, r.volume) for r in five.orderBy("idx").collect()] == [(0, 2.0, 5.0), (1, 2.5, 6.0)]
    texts = spark.createDataFrame([('{"version": "1", "candles": [{"datetime": 5, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 3}, {"time": 6, "open": "x"}]}',), ('[{"ts": 7, "open": 1, "high": 2, "low": 1, "close": 2}]',)], "value string")
    assert [(r.ts, r.close, r.volume) for r in source.from_package_json(texts).orderBy("idx").collect()] == [(5.0, 1.5, 3.0), (7.0, 2.0, None)]


def test_stream_goes_on_after_a_restart_and_repeated_events(spark, tmp_path):
    bars = source.hourly(spark, SF).filter("idx < 90")
    rows = online.events(bars).cache()
    for k in range(3):  # each run is a new query on the same checkpoint; the second piece is delivered twice
        for piece in {0: [0], 1: [1], 2: [1, 2]}[k]:
            online.append(rows.filter(F.floor(F.col("at") * 3 / 94) == piece), str(tmp_path / "events"))
        out = online.run(spark, str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    names = ["series_id", "idx", "state_key", "support", "prediction"]
    want = learning.online_walk_forward(bars, 4).select(*names)
    assert tuple(evaluation.differing(out.select(*names), want).head()) == (0, 0)
    kept = online.memory(rows)
    online.save_memory(kept, str(tmp_path / "memory"))
    assert online.load_memory(spark, str(tmp_path / "memory")).count() == kept.count()
    spark.createDataFrame([("x", "y", 1, {"bullish": 1})], kept.schema).write.mode("append").parquet(str(tmp_path / "memory" / "buckets"))
    with pytest.raises(ValueError):
        online.load_memory(spark, str(tmp_path / "memory"))


def test_logistic_models_stand_at_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=300) > 0.7).astype(float)
    rows = [("s", 0, 4, [float(v) for v in a], float(b)) for a, b in zip(x, y)] + [("t", 0, 4, [float(v) for v in x[0]], 1.0)] * 3
    table = spark.createDataFrame(rows, "series_id string, window_no int, horizon int, z array<double>, y double")
    found = {r.series_id: r for r in fusion.logistic_models(table).collect()}
    w = np.array(found["s"].weights)
    balance = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    error = (1 / (1 + np.exp(-(w[0] + x @ w[1:]))) - y) * balance
    assert abs(error.mean()) < 1e-9 and np.abs(x.T @ error / 300 + 0.75 * w[1:]).max() < 1e-9
    assert found["t"].positive == found["t"].n == 3
    assert fusion.logistic_models(table.limit(0)).count() == 0


def test_window_counters_bar_by_bar(spark):
    rows = walk(90, 5)
    got = {r.idx: r for r in behaviour.window_counters(spark.createDataFrame(rows, BARS)).collect()}
    for i in range(len(rows)):
        seen = rows[max(0, i - 29) : i + 1]
        sides = [(r[5] > r[2]) - (r[5] < r[2]) for r in seen]
        tops = [b[3] for a, b, d in zip(seen, seen[1:], seen[2:]) if b[3] > a[3] and b[3] > d[3]]
        lows = [b[4] for a, b, d in zip(seen, seen[1:], seen[2:]) if b[4] < a[4] and b[4] < d[4]]
        pairs = list(zip(sides, sides[1:]))
        want = (pairs.count((1, 1)), pairs.count((-1, -1)), pairs.count((1, -1)) + pairs.count((-1, 1)), *(sum((b - a) * way > 0 for a, b in zip(x, x[1:])) for x, way in ((tops, 1), (tops, -1), (lows, 1), (lows, -1))))
        r = got[i]
        assert (r.n_bullish, r.n_bearish, r.n_changes, r.n_hh, r.n_lh, r.n_hl, r.n_ll) == want


def test_behaviour_of_empty_and_short_series(spark):
    none = spark.createDataFrame([], BARS)
    for f in (behaviour.symbols, behaviour.normalised_anatomy, behaviour.window_counters, behaviour.label_sequences, behaviour.split_schemes):
        assert f(none).count() == 0
    one = spark.createDataFrame([("s", 0, 5.0, 5.0, 5.0, 5.0, 1)], BARS)
    assert behaviour.symbols(one).first().symbol == "N:weak:Ulow:Llow"
    flat = behaviour.normalised_anatomy(one).first()
    assert (flat.type, flat.efficiency, flat.expansion) == ("DOJI", None, 1.0 if flat.usual > 1e-9 else None)
    assert behaviour.split_schemes(one).count() == 0
