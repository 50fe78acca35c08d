"""Acceptance of breaks, the sequence machine, exponential means and mined rules against statements that go bar by bar."""

import collections
import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import draws
from tidemark.operators import acceptance, discovery, scans

BARS = "series_id string, idx long, open double, high double, low double, close double, volume long"
EPS = 1e-12


def walk(n, seed, series="s", flat=()):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n)).round(1)
    opened = close + rng.normal(0, 1, n).round(1)
    wick = np.abs(rng.normal(0, 1, (2, n)).round(1))
    rows = []
    for k in range(n):
        o, c = (float(close[k]),) * 2 if k in flat else (float(opened[k]), float(close[k]))
        up, down = (0.0, 0.0) if k in flat else wick[:, k]
        rows.append((series, k, o, max(o, c) + float(up), min(o, c) - float(down), c, 10))
    return rows


def atr_of(rows, k):
    ranges = [rows[j][3] - rows[j][4] if j == 0 else max(rows[j][3] - rows[j][4], abs(rows[j][3] - rows[j - 1][5]), abs(rows[j][4] - rows[j - 1][5])) for j in range(max(0, k - 13), k + 1)]
    return max(sum(ranges) / 14, EPS) if k >= 13 else max(rows[k][3] - rows[k][4], EPS)


def stated_acceptance(rows):
    """One pass that carries swings, trend and the last event, and looks at the bars since that event."""
    high = low = None
    used, trend, out = set(), "NEUTRAL", []
    level = at = None
    side = "NONE"
    for i, (_, _, _, _, _, close, _) in enumerate(rows):
        j = i - 3
        if j >= 3:
            near = [rows[k] for k in range(j - 3, j + 4) if k != j]
            high = (j, i, rows[j][3]) if all(r[3] < rows[j][3] for r in near) else high
            low = (j, i, rows[j][4]) if all(r[4] > rows[j][4] for r in near) else low
        event = "NONE"
        if high and i > high[1] and close > high[2] and (1, high[0]) not in used:
            used.add((1, high[0]))
            event, level, at, side, trend = ("CHoCH_BULLISH" if trend == "BEARISH" else "BOS_BULLISH"), high[2], i, "BULLISH", "BULLISH"
        if low and i > low[1] and close < low[2] and (0, low[0]) not in used:
            used.add((0, low[0]))
            if event == "NONE":
                event, level, at, side = ("CHoCH_BEARISH" if trend == "BULLISH" else "BOS_BEARISH"), low[2], i, "BEARISH"
            trend = "BEARISH"
        unit, accepted, retest, phase, distance = atr_of(rows, i), "NONE", "NONE", "NEUTRAL", 0.0
        if at is not None:
            sign = 1 if side == "BULLISH" else -1
            age, distance = i - at, sign * (close - level) / unit
            if age >= 1:
                beyond = sum(sign * (r[5] - level) > 0 for r in rows[at : i + 1])
                accepted = "ACCEPTED" if beyond >= min(3, age + 1) else "PENDING"
                accepted = "REJECTED" if distance < 0 and age <= 4 else accepted
                if abs(close - level) <= unit:
                    retest = "HOLD" if distance > 0 else "FAIL"
            phase = "BREAK" if age == 0 else "POST_BREAK" if accepted == "ACCEPTED" else "TRANSITION"
        out.append((event, trend, side, level, round(distance, 6), round(max(distance, 0.0), 6), accepted, retest, phase))
    return out


def stated_machine(rows):
    """The running state, each from the one before it."""
    states, breaks, before, out = [], stated_acceptance(rows), "INITIAL", []
    for i, (_, _, o, h, low, c, _) in enumerate(rows):
        span, body = max(h - low, EPS), abs(c - o)
        ranges = [r[3] - r[4] for r in rows[max(0, i - 20) : i]]
        growth = span / max(statistics.median(ranges) if ranges else atr_of(rows, i), EPS)
        way = "UP" if c > o else "DOWN" if c < o else "FLAT"
        place, up, down = (c - low) / span, h - max(o, c), min(o, c) - low
        squeezed = growth <= 0.65 and not (
            body / span <= 0.15 or body / span >= 0.70 and way != "FLAT" or down >= body * 1.8 and place >= 0.60 or up >= body * 1.8 and place <= 0.40 or growth >= 1.8 and way != "FLAT"
        )
        states.append((body / span, growth, way, squeezed or growth <= 0.70))
        last = states[-8:]
        event, trend, side, _, _, _, accepted, retest, _ = breaks[i]
        impulses = sum(b >= 0.60 and g >= 1.10 for b, g, _, _ in last)
        back = {"BULLISH": "DOWN", "BEARISH": "UP"}.get(trend)
        pulls, tight, expands = sum(w == back for _, _, w, _ in last), sum(t for *_, t in last), growth >= 1.35
        if event != "NONE":
            state = f"{side}_BREAK"
        elif accepted == "REJECTED":
            state = "FAILED_BREAK"
        elif retest == "HOLD":
            state = "BREAK_RETEST_HOLD"
        elif impulses >= 2 and pulls >= 1:
            state = "IMPULSE_PULLBACK"
        elif before == "IMPULSE_PULLBACK" and trend != "NEUTRAL" and way == ("UP" if trend == "BULLISH" else "DOWN"):
            state = "PULLBACK_CONTINUATION"
        elif before == "IMPULSE_PULLBACK" and way == ("DOWN" if trend == "BULLISH" else "UP"):
            state = "PULLBACK_FAILURE"
        elif tight >= 3 and expands:
            state = "COMPRESSION_EXPANSION"
        elif expands:
            state = "IMPULSE"
        elif tight >= 3:
            state = "COMPRESSION"
        else:
            state = "TREND_CONTINUATION" if trend != "NEUTRAL" else "MIXED"
        out.append((state, f"{before}->{state}" if state != before else "NONE"))
        before = state
    return out


SERIES = {f"s{seed}": walk(400, seed, f"s{seed}", flat=(0, 1, 5, 40, 41, 42) if seed == 2 else ()) for seed in range(5)}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([r for rows in SERIES.values() for r in rows], BARS)


def test_acceptance_and_retest_bar_by_bar(table):
    columns = ("event", "trend", "event_direction", "event_level", "break_distance", "break_strength", "acceptance", "retest", "phase")
    got = {(r.series_id, r.idx): tuple(round(r[x], 6) if x.startswith("break_") else r[x] for x in columns) for r in acceptance.structure_acceptance(table).collect()}
    kinds = set()
    for name, rows in SERIES.items():
        want = stated_acceptance(rows)
        assert [got[name, k] for k in range(len(rows))] == want
        kinds |= {(w[6], w[7], w[8]) for w in want}
    assert len(kinds) >= 8


def test_sequence_machine_bar_by_bar(table):
    got = {(r.series_id, r.idx): (r.sequence, r.transition) for r in acceptance.sequence_machine(table).collect()}
    seen = set()
    for name, rows in SERIES.items():
        want = stated_machine(rows)
        assert [got[name, k] for k in range(len(rows))] == want
        seen |= {s for s, _ in want}
    assert len(seen) >= 10


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_exponential_means_over_blocks(table, block):
    got = {(r.series_id, r.idx): r for r in scans.macd(table, block=block).collect()}
    means = {(r.series_id, r.idx): r for r in scans.exponential_means(table.select("series_id", "idx", "close"), "close", (2, 50), block).collect()}
    for name, rows in SERIES.items():
        fast = slow = short = long = rows[0][5]
        signal = 0.0
        for k, r in enumerate(rows):
            x = r[5]
            fast, slow, short, long = fast + 2 / 13 * (x - fast), slow + 2 / 27 * (x - slow), short + 2 / 3 * (x - short), long + 2 / 51 * (x - long)
            signal += 2 / 10 * (fast - slow - signal) if k else fast - slow
            g, m = got[name, k], means[name, k]
            assert np.allclose((g.macd, g.signal, g.histogram, m.ema_2, m.ema_50), (fast - slow, signal, fast - slow - signal, short, long), atol=1e-9)


def test_exponential_means_of_one_bar_and_none(spark):
    one = spark.createDataFrame(walk(1, 1), BARS)
    assert [tuple(r)[-4:] for r in scans.macd(one).collect()] == [(0.0, 0.0, 0.0, "NEUTRAL")]
    assert scans.macd(one.limit(0)).collect() == []


# --- rules


def test_permutations_are_bijections_that_differ():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        seen = [tuple(discovery.permuted(np.arange(n), n, seed)) for seed in range(12)]
        assert all(sorted(p) == list(range(n)) for p in seen)
        assert len(set(seen)) >= min(math.factorial(n), 12) // 3
    many = np.stack([discovery.permuted(np.arange(200), 200, seed) for seed in range(400)])
    assert abs(many.mean(0) - 99.5).max() < 15 and abs(np.corrcoef(many[:, :40].T) - np.eye(40)).max() < 0.25


def quartiles(values):
    values = sorted(values)
    at = lambda q: (lambda p: values[math.floor(p)] + (values[math.ceil(p)] - values[math.floor(p)]) * (p - math.floor(p)))((len(values) - 1) * q)
    return at(0.25), at(0.75)


def mined(states, labels, least, confidence):
    """Rules by plain counting: (conditions) -> (samples, label, confidence)."""
    counts = collections.defaultdict(collections.Counter)
    for state, label in zip(states, labels, strict=True):
        facts = list(enumerate(state))
        for rule in [(f,) for f in facts] + list(itertools.combinations(facts, 2)):
            counts[rule][label] += 1
    out = {}
    for rule, by in counts.items():
        n, best = sum(by.values()), max(discovery.LABELS, key=lambda x: by[x])
        if n >= least and by[best] / n >= confidence:
            out[rule] = (n, best, by[best] / n)
    return out


def stated_folds(rows, labels, least=20, confidence=0.5):
    """(predictions, hits) of each fold for given labels, rules mined from the calibration part."""
    part, out = len(rows) // 5, []
    for fold in range(1, 5):
        states = binned(rows, fold * part)
        rules = mined(states[: fold * part], labels[: fold * part], least, confidence)
        said = hits = 0
        for k in range(fold * part, (fold + 1) * part):
            facts = list(enumerate(states[k]))
            met = [r for r in [(f,) for f in facts] + list(itertools.combinations(facts, 2)) if r in rules]
            if met:
                best = max(met, key=lambda r: (rules[r][2], rules[r][0], -len(r), [-f[0] for f in r]))
                said, hits = said + 1, hits + (rules[best][1] == labels[k])
        out.append((said, hits))
    return out


def binned(rows, n):
    cuts = {f: quartiles([r[f] for r in rows[:n]]) for f in discovery.NUMBERS}
    return [tuple(("q1" if r[f] <= cuts[f][0] else "q3" if r[f] >= cuts[f][1] else "q2") if f in cuts else r[f] for f in discovery.FEATURES) for r in rows]


def dealt(labels, n, seed):
    out = list(labels)
    for j, to in enumerate(discovery.permuted(np.arange(n), n, seed)):
        out[to] = labels[j]
    return out


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame(walk(190, 3, "a") + walk(171, 4, "b"), BARS)


@pytest.fixture(scope="module")
def stated_records(few):
    by = collections.defaultdict(list)
    for r in discovery.records(few).orderBy("place").collect():
        by[r.series_id, r.horizon].append(r.asDict())
    return by


def test_labels_are_mined_anew_in_every_draw(few, stated_records, monkeypatch):
    monkeypatch.setattr(discovery, "HORIZONS", (4, 8))
    got = {(r.series_id, r.horizon, r.fold, r.draw): (r.predictions, r.correct) for r in discovery.fold_hits(few, 2).collect()}
    for (series, horizon), rows in stated_records.items():
        labels = [r["outcome"] for r in rows]
        for draw in range(3):
            want = stated_folds(rows, labels if not draw else dealt(labels, len(labels), 42 + draw - 1))
            assert [got[series, horizon, fold, draw] for fold in range(1, 5)] == want
    null = discovery.label_null(few, 2).collect()
    assert all(r.p_value in (1 / 3, 2 / 3, 1.0) and r.n == len(stated_records[r.series_id, r.horizon]) // 5 * 4 for r in null)


def test_discovery_null_permutes_calibration_labels_only(few, stated_records):
    got = {(r.series_id, r.horizon, r.fold): r for r in discovery.discovery_null(few, draws=2).collect()}
    for (series, horizon), rows in stated_records.items():
        part, labels = len(rows) // 5, [r["outcome"] for r in rows]
        for fold in (1, 3):
            n = fold * part
            states, test = binned(rows, n), labels[n : n + part]
            base = max(collections.Counter(test).values()) / part
            found = []
            for draw in range(3):
                rules = mined(states[:n], (labels if not draw else dealt(labels[:n], n, 341 + draw - 1))[:n], 20, 0.45)
                order = sorted(rules, key=lambda r: (rules[r][2], rules[r][0], -len(r), [-discovery.CONDITIONS.index(f"{discovery.FEATURES[f]}={v}") for f, v in r]), reverse=True)[:500]
                scores = []
                for rule in order:
                    met = [x for s, x in zip(states[n : n + part], test, strict=True) if all(s[f] == v for f, v in rule)]
                    scores += [met.count(rules[rule][1]) / len(met)] if len(met) >= 5 else []
                found.append((len(rules), max(scores, default=0.0), sum(x > base for x in scores)))
            r = got[series, horizon, fold]
            assert (r.rules, r.best_accuracy, r.above) == found[0]
            assert np.allclose((r.baseline, r.mean_best, r.max_best, r.mean_rules, r.mean_above), (base, *(f(x[k] for x in found[1:]) for f, k in ((lambda v: statistics.mean(list(v)), 1), (max, 1), (lambda v: statistics.mean(list(v)), 0), (lambda v: statistics.mean(list(v)), 2)))))


def test_tables_of_many_chunks_add_up(few, stated_records, monkeypatch):
    whole = sorted(tuple(r) for r in discovery.mined_rules(few).collect())
    monkeypatch.setattr(discovery, "CHUNK", 16)
    monkeypatch.setattr(discovery, "FAN_IN", 2)
    assert sorted(tuple(r) for r in discovery.mined_rules(few).collect()) == whole and whole


def test_rules_without_records(spark):
    none = spark.createDataFrame([], BARS)
    assert discovery.mined_rules(none).collect() == [] and discovery.label_null(none, 2).collect() == []
    assert discovery.walk_forward(spark.createDataFrame(walk(62, 1), BARS)).collect() == []


# --- draws


def test_any_draw_of_the_generator_by_its_number(spark):
    seed, n = 12345, 400
    state, want = seed, []
    for _ in range(n):
        state = (1664525 * state + 1013904223) % 2**32
        want.append(state)
    rows = spark.range(1, n + 1).select(draws.nth("id", seed).alias("x")).collect()
    assert [r.x for r in rows] == want
    assert spark.range(1).select(draws.nth(F.lit(2**31 + 5), 7)).head()[0] == draws.nth_of(2**31 + 5, 7)


def stated_shuffle(n, seed):
    items, state = list(range(n)), seed % 2**32
    for i in range(n - 1, 0, -1):
        state = (state * 1664525 + 1013904223) % 2**32
        j = state % (i + 1)
        items[i], items[j] = items[j], items[i]
    return items


def test_places_of_a_shuffle_without_the_shuffled_list():
    for n in (0, 1, 2, 3, 10, 57, 500):
        seeds = np.array([0, 1, 1009, 2**32 - 1, 77777])
        got = draws.shuffle_sources(n, seeds, np.arange(n))
        assert got.tolist() == [stated_shuffle(n, int(s)) for s in seeds]
        some = np.arange(n)[::-3]
        assert (draws.shuffle_sources(n, seeds, some) == got[:, some]).all()


def test_samples_as_drawn_out_of_what_is_left(spark):
    want, rows = {}, [(n, seed) for n in (0, 1, 5, 16, 17, 300) for seed in (3, 7919, 2**31)]
    for n, seed in rows:
        left, state, want[n, seed] = list(range(n)), seed, []
        for _ in range(min(16, n)):
            state = (state * 1664525 + 1013904223) % 2**32
            want[n, seed].append(left.pop(state % len(left)))
    got = spark.createDataFrame(rows, "n long, seed long").select("n", "seed", draws.sampled(F.col("n"), 16, F.col("seed")).alias("x")).collect()
    assert {(r.n, r.seed): list(r.x) for r in got} == want
