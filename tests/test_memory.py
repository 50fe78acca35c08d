"""The stream with its whole memory against a loop over plain dictionaries, ranks of large groups, and outcomes shuffled among eligible records."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_sequences import BARS, stated_shuffle, walk
from tidemark.functions import ranks
from tidemark.operators import fusion, learning, skill
from tidemark.streaming import memory

KINDS = ("bullish", "bearish", "neutral")


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk(90, 5, "a") + walk(70, 6, "b", flat=range(30, 64))
    flat = [("c", k, 5.0, 5.0, 5.0, 5.0, 1) for k in range(50)]
    return spark.createDataFrame(rows + flat, BARS)


def stated_loop(states, closes):
    """Forecasts and outcomes of one series: buckets by key, each bar after the outcomes due at it."""
    buckets = {h: {} for h in memory.HORIZONS}
    said, out = {}, {}

    def forecast(h, parts, returns, path, own):
        found = []
        for key, bucket in buckets[h].items():
            if key == own:
                continue
            p, r, q = bucket["state"]
            equal = sum(a == b for a, b in zip(parts, p)) / 12
            near = sum(1 / (1 + 25 * abs(a - b)) for a, b in zip(returns, r)) / 4
            likeness = sum(1 / (1 + sum(abs(path[4 * k + j] - q[4 * k + j]) for j in range(4)) / 4) for k in range(12)) / 12
            score = round(0.55 * equal + 0.2 * near + 0.25 * likeness, 9)
            if score >= 0.34:
                found.append((score, sum(bucket["n"].values()), bucket))
        found.sort(key=lambda x: x[:2], reverse=True)  # stable: the bucket seen first stays first
        weights, evidence = dict.fromkeys(KINDS, 0.0), 0
        if own in buckets[h]:
            evidence = sum(buckets[h][own]["n"].values())
            for k in KINDS:
                weights[k] += buckets[h][own]["n"][k]
        for score, count, bucket in found[:25]:
            evidence += count
            for k in KINDS:
                weights[k] += bucket["n"][k] * score * min(1.0, count / 20)
        total = sum(weights.values())
        p = {k: (weights[k] + 1) / (total + 3) for k in KINDS}
        return min(len(found), 25), evidence, p, max(KINDS, key=lambda k: p[k])

    for i, state in enumerate(states):
        for h in memory.HORIZONS:
            j = i - h
            if j < 0:
                continue
            least = max(closes[j] * 0.001, 1e-9)
            kind = "bullish" if closes[i] - closes[j] > least else "bearish" if closes[j] - closes[i] > least else "neutral"
            bucket = buckets[h].setdefault(states[j]["key"], {"state": states[j]["kept"], "n": collections.Counter(), "first": j})
            bucket["n"][kind] += 1
            mine = said[j, h]
            out[j, h] = (*out[j, h][:4], kind, "neutral" if "neutral" in (kind, mine) else "confirmed" if kind == mine else "not_confirmed")
        for h in memory.HORIZONS:
            n, evidence, p, favoured = forecast(h, *state["now"], state["key"])
            said[i, h] = favoured
            out[i, h] = (n, evidence, {k: round(v, 9) for k, v in p.items()}, favoured, None, None)
    return out


def comparable(rows):
    return {(r.series_id, r.idx, r.horizon): (r.n, r.evidence, {k: round(r[f"p_{k}"], 9) for k in KINDS}, r.favored, r.outcome, r.result) for r in rows}


@pytest.fixture(scope="module")
def stated(bars):
    by = collections.defaultdict(list)
    for r in memory.events(bars).orderBy("series_id", "idx").collect():
        parts = json.loads(r.parts)
        key = (tuple(parts), tuple(r.kept_returns), tuple(r.kept_path))
        by[r.series_id].append({"now": (parts, r.returns, r.path), "kept": (parts, r.kept_returns, r.kept_path), "key": key, "close": r.close})
    return {(s, *k): v for s, states in by.items() for k, v in stated_loop(states, [x["close"] for x in states]).items()}


def test_memory_equals_a_loop_over_dictionaries(bars, stated):
    got = comparable(memory.replay(bars, slices=4).collect())
    assert got == stated
    assert any(v[1] >= 20 for v in got.values()) and {v[5] for v in got.values()} >= {None, "confirmed", "not_confirmed", "neutral"}


def test_memory_goes_on_after_a_restart_and_ignores_what_comes_again(spark, bars, stated, tmp_path):
    rows = memory.events(bars).cache()
    source, folder, checkpoint = (str(tmp_path / x) for x in ("events", "observations", "checkpoint"))
    for first, last in ((0, 40), (20, 60), (0, 1000)):  # each piece repeats bars that were there before
        rows.filter((F.col("idx") >= first) & (F.col("idx") < last)).write.mode("append").parquet(source)
        got = comparable(memory.run(spark, source, folder, checkpoint).collect())
    assert got == stated
    assert comparable(memory.run(spark, source, folder, checkpoint).collect()) == stated  # nothing new
    memory.store(memory.observations(spark, folder).filter("idx < 3"), 0, str(tmp_path / "again"))
    memory.store(memory.observations(spark, folder).filter("idx < 2"), 0, str(tmp_path / "again"))
    assert memory.observations(spark, str(tmp_path / "again")).agg(F.max("idx")).head()[0] == 1


def test_memory_of_no_bars(spark, bars):
    assert memory.replay(bars.limit(0)).collect() == []


def test_equal_states_share_a_bucket_named_by_its_first_bar(bars):
    rows = fusion.states(bars).filter("series_id = 'c'").collect()
    assert len({r.bucket for r in rows}) < len(rows) / 2 and all(r.bucket <= r.idx for r in rows)


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3 if k % 7 else 0, None if k % 50 == 0 else float(rng.integers(0, 12)), k) for k in range(900)]
    table = spark.createDataFrame(rows, "g int, x double, id int")
    want = {}
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (n + 1, len(own)) for n, r in enumerate(own)}
    assert {r.id: (r["rank"], r.total) for r in ranks.ranked(table, ["g"], ["x", "id"]).collect()} == want
    mean = collections.defaultdict(list)
    for g, x, k in rows:
        if x is not None:
            mean[g, x].append(k)
    known = table.filter("x is not null")
    got = {r.id: r.r for r in ranks.average_ranks(known, ["g"], "x", ["id"], "r").collect()}
    place = {r.id: r["rank"] for r in ranks.ranked(known, ["g"], ["x", "id"]).collect()}
    assert all(got[k] == sum(place[j] for j in ids) / len(ids) for ids in mean.values() for k in ids)
    dealt = ranks.dealt_anew(ranks.ranked(table, ["g"], ["id"], "place"), ["g"], "place", "id", F.md5(F.col("id").cast("string"))).collect()
    assert sorted(r.id for r in dealt) == list(range(900)) and len({(r.g, r.place) for r in dealt}) == 900


def test_outcomes_are_shuffled_among_all_eligible_records(spark):
    table = spark.createDataFrame(walk(300, 8), BARS)
    rows = learning.experience(table).collect()
    known = {h: sorted((r.idx, r.direction) for r in rows if r.horizon == h and r.direction is not None) for h in (4, 8, 16)}
    windows = {r.window_no: (r.oos_start, r.oos_end) for r in learning.windows(table).collect()}
    top = collections.defaultdict(list)
    for r in learning.top_matches(table).collect():
        top[r.horizon, r.window_no, r.idx].append((r.h_idx, r.similarity))

    def share(pairs):
        total = sum(s for _, s in pairs)
        return max(sum(s for d, s in pairs if d == k) for k in ("UP", "DOWN", "NEUTRAL")) / total if total else 0.0

    for r in skill.retrieval_null(table, permutations=4).collect():
        real, null = [], []
        for w, (start, end) in windows.items():
            for q in range(start, end):
                eligible = [x for x in known[r.horizon] if x[0] <= q - 16 and x[0] + r.horizon < start]
                if len(eligible) < 6:
                    continue
                found = top.get((r.horizon, w, q), [])
                at = {idx: k for k, (idx, _) in enumerate(eligible)}
                real.append(share([(eligible[at[i]][1], s) for i, s in found]))
                each = []
                for perm in range(4):
                    order = stated_shuffle(len(eligible), 1009 * (perm + 1) + q)
                    each.append(share([(eligible[order[at[i]]][1], s) for i, s in found]))
                null.append(sum(each) / 4)
        assert r.n_queries == len(real)
        assert np.allclose((r.real_share, r.null_share), (np.mean(real), np.mean(null)))
