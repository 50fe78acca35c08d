"""Ingestion by the contract, the guard of files, and rules as a book, on small hand-made tables."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F
from tests.test_sequences import BARS, walk
from tidemark.operators import discovery, rulebook
from tidemark.sources import ingest

RAW = "series_id string, source_row long, ts string, open string, high string, low string, close string, volume string, kept string"
ROWS = [
    ("a", 1, "2024-01-01 00:00:00", "1", "3", "0.5", "2", "10", "x"),
    ("a", 2, "2024-01-01 02:00:00", "2", "3", "1", "2.5", "", "x"),  # a gap, no volume
    ("a", 3, "2024-01-01 01:30:00", "2", "3", "1", "2.5", "-4", "x"),  # late, volume below 0
    ("a", 4, "2024-01-01 02:00:00", "2", "3", "1", "2.5", "7", "x"),  # that time is taken
    ("a", 5, "2024-01-01 03:00:00", "2", "2.1", "1", "2.5", "7", "x"),  # high below close
    ("a", 6, "2024-01-01 03:00:00", "2", "3", "1", "2.5", "many", "x"),  # good, although a bad row had its time first
    ("a", 7, "no time", "", "3", "nan", None, "7", "x"),
    ("a", 8, None, "1e400", "3", "1", "2", "7", "x"),
    ("b", 1, "2024-01-01 05:00:00", " 1 ", "1", "1", "1", "0", "x"),
    ("b", 2, "2024-01-01 04:00:00", "1", "1", "1", "1", "inf", "x"),
]


@pytest.fixture(scope="module")
def layers(spark):
    return ingest.layers(spark.createDataFrame(ROWS, RAW), 3600)


def test_every_row_keeps_its_payload_and_its_issues(layers):
    got = {(r.series_id, r.source_row): (r.status, sorted(r.errors), sorted(r.warnings)) for r in layers.collect()}
    assert got == {
        ("a", 1): ("ACCEPTED", [], []),
        ("a", 2): ("ACCEPTED", [], []),
        ("a", 3): ("ACCEPTED", [], ["INVALID_VOLUME", "OUT_OF_ORDER", "TIME_GAP"]),
        ("a", 4): ("REJECTED", ["DUPLICATE_TIMESTAMP"], []),
        ("a", 5): ("REJECTED", ["INVALID_OHLC"], []),
        ("a", 6): ("ACCEPTED", [], ["INVALID_VOLUME"]),
        ("a", 7): ("REJECTED", ["INVALID_LOW", "INVALID_TIMESTAMP", "MISSING_CLOSE", "MISSING_OPEN"], []),
        ("a", 8): ("REJECTED", ["INVALID_OPEN", "INVALID_TIMESTAMP"], []),
        ("b", 1): ("ACCEPTED", [], []),
        ("b", 2): ("ACCEPTED", [], ["INVALID_VOLUME", "OUT_OF_ORDER"]),
    }
    raw = layers.select(*[x.split()[0] for x in RAW.split(", ")]).collect()
    assert sorted(map(tuple, raw), key=repr) == sorted(ROWS, key=repr)


def test_accepted_bars_are_in_order_with_their_row(layers):
    got = [(r.series_id, r.idx, r.source_row, str(r.ts)[11:16], r.close, r.volume) for r in ingest.normalised(layers).orderBy("series_id", "idx").collect()]
    assert got == [("a", 0, 1, "00:00", 2.0, 10.0), ("a", 1, 3, "01:30", 2.5, None), ("a", 2, 2, "02:00", 2.5, None), ("a", 3, 6, "03:00", 2.5, None), ("b", 0, 2, "04:00", 1.0, None), ("b", 1, 1, "05:00", 1.0, 0.0)]
    counts = {(r.series_id, r.kind, r.issue): r.n for r in ingest.issue_counts(layers).collect()}
    assert counts["a", "warning", "INVALID_VOLUME"] == 2 and counts["a", "error", "INVALID_TIMESTAMP"] == 2 and sum(counts.values()) == 14


def test_ingestion_of_no_rows(spark):
    none = ingest.layers(spark.createDataFrame([], RAW), 60)
    assert none.collect() == [] and ingest.normalised(none).collect() == [] and ingest.issue_counts(none).collect() == []


@pytest.fixture
def ranges_kept(spark):
    """Small ranges stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def entered(n, times, seed):
    draw, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows = [(s, k + 1, None if draw.random() < 0.05 else str(start + datetime.timedelta(hours=draw.randrange(times))), "2", "3" if draw.random() < 0.7 else "1", "1", "2", "1", "x") for s in ("a", "b", None) for k in range(n)]
    draw.shuffle(rows)
    return rows


def stated(rows):
    """Row by row in the order they came, then the gaps of what was accepted."""
    out, taken = {}, collections.defaultdict(dict)
    latest = {}
    for s, k, ts, _, high, *_ in sorted(rows, key=lambda r: r[1]):
        errors = ([] if ts else ["INVALID_TIMESTAMP"]) + ([] if high == "3" else ["INVALID_OHLC"])
        if not errors and taken[s].setdefault(ts, k) != k:
            errors = ["DUPLICATE_TIMESTAMP"]
        out[s, k] = (errors, ["OUT_OF_ORDER"] if ts and s in latest and ts < latest[s] else [])
        latest[s] = max(latest.get(s, ""), ts or "")
    for s, times in taken.items():
        for a, b in zip(sorted(times), sorted(times)[1:]):
            if datetime.datetime.fromisoformat(b) - datetime.datetime.fromisoformat(a) > datetime.timedelta(hours=1):
                out[s, times[b]][1].append("TIME_GAP")
    return out, {s: [times[t] for t in sorted(times)] for s, times in taken.items()}


@pytest.mark.parametrize(("n", "times", "few"), [(300, 2000, 0), (300, 2000, 10_000), (400, 60, 0), (3, 2, 10_000)])
def test_times_in_several_ranges_row_by_row(spark, monkeypatch, ranges_kept, n, times, few):
    monkeypatch.setattr(ingest, "FEW_TIMES", few)
    rows = entered(n, times, n + times)
    want, order = stated(rows)
    layers = ingest.layers(spark.createDataFrame(rows, RAW), 3600)
    assert {(r.series_id, r.source_row): (r.errors, r.warnings) for r in layers.collect()} == want
    got = collections.defaultdict(list)
    for r in sorted(ingest.normalised(layers).collect(), key=lambda r: r.idx):
        assert r.idx == len(got[r.series_id])
        got[r.series_id].append(r.source_row)
    assert got == order


def largest_share(df):
    sizes = collections.Counter(r.p for r in df.withColumn("p", F.spark_partition_id()).collect())
    return max(sizes.values()) / sizes.total()


def test_no_task_holds_a_whole_series(spark, tmp_path, ranges_kept):
    row = "named_struct('l_returnflag', if(id < 100, null, 'N'), 'l_orderkey', 7919 * id % 4000, 'l_linenumber', 1, 'l_shipdate', timestamp_seconds(3600 * id), 'l_partkey', 1L, 'l_suppkey', 1L, 'l_extendedprice', 100.0d, 'l_quantity', 5.0d, 'l_tax', 0.05d, 'l_discount', 0.04d)"
    spark.range(4000).selectExpr(f"inline(array({row}))").write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = ingest.lines(spark, str(tmp_path))
    assert largest_share(lines.select("source_row", "open")) < 0.5
    flags = {k: sorted(r.source_row for r in lines.collect() if r.series_id == k) for k in ("N", None)}
    assert flags == {"N": list(range(1, 3901)), None: list(range(1, 101))}
    layers = ingest.layers(lines, 3600)
    assert largest_share(layers.select("series_id", "status", "errors", "warnings")) < 0.5
    assert largest_share(ingest.normalised(layers).select("idx", "close")) < 0.5


def test_guard_of_files(spark, tmp_path):
    data = tmp_path / "data"
    (data / "sub").mkdir(parents=True)
    for name, text in (("one", "1"), ("sub/two", "2"), ("three", "3")):
        (data / name).write_text(text)
    guard = ingest.Guard(spark, str(data), str(tmp_path / "manifest"))
    guard.verify()
    (data / "one").write_text("x")  # of equal length
    (data / "three").unlink()
    (data / "four").write_text("4")
    assert {r.path.rsplit("/", 1)[1]: r.change for r in guard.changes().collect()} == {"one": "CHANGED", "three": "REMOVED", "four": "ADDED"}
    with pytest.raises(ValueError, match="not what they were"):
        guard.verify()


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame(walk(260, 3, "a") + walk(230, 4, "b"), BARS)


def test_structure_rules_by_counting(few):
    rows = discovery.folded(discovery.records(few)).filter("calibrates").collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        momentum = "bullish" if r.return_5 > 0 and r.return_10 > 0 else "bearish" if r.return_5 < 0 and r.return_10 < 0 else "mixed"
        counts[r.series_id, r.horizon, r.fold, *(momentum if k == "momentum_state" else r[k] for k in rulebook.STRUCTURE)][r.outcome] += 1
    want = {}
    for key, n in counts.items():
        both = n["BUY"] + n["SELL"]
        if sum(n.values()) >= 5 and both and max(n["BUY"], n["SELL"]) / both >= 0.55:
            want[key] = (sum(n.values()), n["BUY"], n["SELL"], "BUY" if n["BUY"] >= n["SELL"] else "SELL", max(n["BUY"], n["SELL"]) / both)
    got = {(r.series_id, r.horizon, r.fold, *(r[k] for k in rulebook.STRUCTURE)): (r.n, r.n_buy, r.n_sell, r.says, r.confidence) for r in rulebook.structure_rules(few, 5).collect()}
    assert got == want and want


def test_signatures_usage_and_rules_that_add_nothing(few):
    rules = discovery.mined_rules(few).collect()
    folds = collections.Counter((r.series_id, r.horizon, " & ".join(sorted(r.rule.split(" & "))), r.says) for r in rules)
    assert {(r.series_id, r.horizon, r.rule, r.says): r.n_folds for r in rulebook.signatures(few).collect()} == folds
    uses = collections.Counter((r.series_id, r.horizon, r.fold, x.split("=")[0]) for r in rules for x in r.rule.split(" & "))
    assert {(r.series_id, r.horizon, r.fold, r.feature): r.n_rules for r in rulebook.feature_usage(few).collect()} == uses
    found = rulebook.redundant(few).collect()
    coded = {(r.series_id, r.horizon, r.fold, r.idx): {discovery.CONDITIONS[k] for k in r.codes} for r in discovery.coded(discovery.folded(discovery.records(few))).filter("calibrates").collect()}
    assert found
    for r in found[:200]:
        sets = [s for key, s in coded.items() if key[:3] == (r.series_id, r.horizon, r.fold)]
        assert {k for k, s in enumerate(sets) if set(r.rule.split(" & ")) <= s} == {k for k, s in enumerate(sets) if r.condition in s}


def test_rulebook_without_records(spark):
    none = spark.createDataFrame([], BARS)
    assert [f(none).collect() for f in (rulebook.structure_rules, rulebook.signatures, rulebook.feature_usage, rulebook.redundant)] == [[]] * 4
