"""From states and outcomes to predictions: back-off tables, rules, analog retrieval, small models, walk-forward windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shared
from tidemark.functions.columns import EPS, case
from tidemark.operators import candles, outcomes, structure

c = F.col
DIRECTIONS = ("UP", "DOWN", "NEUTRAL")
KEEP_GAP, TOP_K, LEAST_CANDIDATES, LEAST_MATCHES, TEMPERATURE = 16, 16, 12, 12, 0.10
WINDOWS, STEP = 5, 81
DECAY, DIVERSITY = 0.86, 0.78
#: Weights of the similarity components by horizon (fixed values).
WEIGHTS = {
    4: {"structure": 0.20, "sequence": 0.16, "regime": 0.14, "location": 0.08, "momentum": 0.12, "volatility": 0.08, "candle": 0.06, "path": 0.16},
    8: {"structure": 0.22, "sequence": 0.15, "regime": 0.16, "location": 0.08, "momentum": 0.10, "volatility": 0.08, "candle": 0.05, "path": 0.16},
    16: {"structure": 0.24, "sequence": 0.13, "regime": 0.17, "location": 0.07, "momentum": 0.08, "volatility": 0.09, "candle": 0.04, "path": 0.18},
}


def windows(bars: DataFrame, count: int = WINDOWS, step: int = STEP) -> DataFrame:
    """Expanding walk-forward windows of each series: training rows [0, oos_start), out-of-sample rows [oos_start, oos_end).

    Where a series has fewer than 2 * count * step bars the step is a tenth of it (count 5), so that half its bars train; series
    of fewer than 2 * count bars have no windows.
    """
    sizes = bars.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("step", F.least(F.lit(step), F.floor(c("n") / (2 * count)))).filter("step > 0")
    w = sizes.withColumn("window_no", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    start = c("n") - count * c("step") + c("window_no") * c("step")
    return w.select("series_id", "window_no", start.alias("oos_start"), (start + c("step")).alias("oos_end"))


def experience(bars: DataFrame) -> DataFrame:
    """States of every bar with their outcomes, written once; direction is null while the horizon is open."""
    states = structure.episodes(bars)
    known = outcomes.outcomes(bars).select("series_id", "idx", "horizon", "direction", "raw_return", "atr_return", "mfe_atr", "mae_atr")
    names = ("trend", "event", "high_label", "low_label", "location", "regime", "momentum", "sequence", "state_key", "episode", "volatility_ratio", "direction", "body", "range", "unit", "r1", "r3", "r8", "r16")
    return shared.cut(states.select("series_id", "idx", *names).withColumnRenamed("direction", "candle_direction").join(known, ["series_id", "idx"]), "experience")


def tests_of(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Out-of-sample rows with their window. Windows are a few rows a series."""
    w = windows(bars)
    return rows.join(F.broadcast(w), "series_id").filter((c("idx") >= c("oos_start")) & (c("idx") < c("oos_end")))


def training_of(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose outcome was known before the window began, by window."""
    w = windows(bars)
    return rows.join(F.broadcast(w), "series_id").filter((c("idx") + c("horizon") < c("oos_start")) & c("direction").isNotNull())


def state_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c("direction") == d).alias(d.lower()) for d in DIRECTIONS))


def state_frequency(rows: DataFrame) -> DataFrame:
    """How many state keys occur once, twice, 3-5, 6-10 and more often."""
    n = rows.groupBy("series_id", "state_key").agg(F.count("*").alias("n"))
    n = n.withColumn("bucket", case((c("n") == 1, "1"), (c("n") == 2, "2"), (c("n") <= 5, "3-5"), (c("n") <= 10, "6-10"), otherwise="11+"))
    return n.groupBy("bucket").agg(F.count("*").alias("n_states"), F.sum("n").alias("n_rows"))


def conditional_baseline(bars: DataFrame) -> DataFrame:
    """For each test row the class shares of training rows alike in regime, event and sequence; with too few, in regime; else of all."""
    rows = experience(bars)
    train, base = training_of(bars, rows), ["series_id", "window_no", "horizon"]
    levels = {"exact": [*base, "regime", "event", "sequence"], "regime": [*base, "regime"], "global": base}
    out = tests_of(bars, rows).select(*base, "idx", "regime", "event", "sequence", "direction")
    for name, keys in levels.items():
        table = state_counts(train, keys).select(*keys, *(c(x).alias(f"{name}_{x}") for x in ("n", "up", "down", "neutral")))
        out = out.join(table, keys, "left")
    level = case((c("exact_n") >= LEAST_MATCHES, "REGIME+EVENT+SEQUENCE"), (c("regime_n") >= LEAST_MATCHES, "REGIME"), otherwise="GLOBAL")
    pick = lambda x: case((c("exact_n") >= LEAST_MATCHES, c(f"exact_{x}")), (c("regime_n") >= LEAST_MATCHES, c(f"regime_{x}")), otherwise=c(f"global_{x}"))
    out = out.withColumn("level", level).withColumn("support", F.coalesce(pick("n"), F.lit(0)))
    share = lambda x: F.when(c("support") > 0, pick(x) / c("support")).otherwise(1 / 3)
    return out.select(*base, "idx", "direction", "level", "support", *(share(x).alias(f"p_{x}") for x in ("up", "down", "neutral")))


def hierarchical(bars: DataFrame, strength: float = 20.0) -> DataFrame:
    """Shrunk class shares: global to (trend, regime, momentum, location), and that to the whole state key."""
    rows = experience(bars)
    train, base = training_of(bars, rows), ["series_id", "window_no", "horizon"]
    coarse = [*base, "trend", "regime", "momentum", "location"]
    out = tests_of(bars, rows).select(*coarse, "idx", "state_key", "direction")
    for name, keys in {"g": base, "k": coarse, "e": [*base, "state_key"]}.items():
        out = out.join(state_counts(train, keys).select(*keys, *(c(x).alias(f"{name}_{x}") for x in ("n", "up", "down"))), keys, "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    for x in ("up", "down"):
        top = (zero(f"g_{x}") + 1) / (zero("g_n") + 3)
        middle = (zero(f"k_{x}") + strength * top) / (zero("k_n") + strength)
        out = out.withColumn(f"p_{x}", (zero(f"e_{x}") + strength * middle) / (zero("e_n") + strength))
    return out.select(*base, "idx", "direction", zero("e_n").alias("support"), "p_up", "p_down", (1 - c("p_up") - c("p_down")).alias("p_neutral"))


def unseen_states(bars: DataFrame) -> DataFrame:
    """Test rows whose state key no training row of the window has (anti-join)."""
    rows = experience(bars)
    keys = ["series_id", "window_no", "horizon", "state_key"]
    return tests_of(bars, rows).select(*keys, "idx").join(training_of(bars, rows).select(*keys).distinct(), keys, "left_anti")


def seen_states(bars: DataFrame) -> DataFrame:
    rows = experience(bars)
    keys = ["series_id", "window_no", "horizon", "state_key"]
    return tests_of(bars, rows).select(*keys, "idx").join(training_of(bars, rows).select(*keys), keys, "left_semi")


FEATURES = ("trend", "event", "high_label", "low_label", "location", "regime", "momentum", "sequence")


def _long(rows: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), c(f).alias("value")) for f in FEATURES))
    return rows.select(*keys, "direction", F.transform(pairs, lambda x: F.concat_ws("=", x["feature"], x["value"])).alias("facts"))


def _rules(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's one- and two-condition rules: at most 8 + 28 of them."""
    facts = _long(rows, keys)
    two = F.flatten(F.transform("facts", lambda a: F.transform(F.filter("facts", lambda b: a < b), lambda b: F.concat_ws(" & ", a, b))))
    return facts.select(*keys, "direction", F.explode(F.concat("facts", two)).alias("rule"))


def rules(bars: DataFrame, rows: DataFrame | None = None, least: int = 20, confidence: float = 0.45) -> DataFrame:
    """Rules of training rows with at least ``least`` cases whose commonest direction (ties: UP, DOWN, NEUTRAL) has ``confidence``."""
    keys = ["horizon", "window_no"]
    train = training_of(bars, experience(bars) if rows is None else rows)
    counted = state_counts(_rules(train, keys), [*keys, "rule"]).filter(c("n") >= least)
    best = F.greatest("up", "down", "neutral")
    counted = counted.withColumns({"confidence": best / c("n"), "says": case((c("up") == best, "UP"), (c("down") == best, "DOWN"), otherwise="NEUTRAL")})
    base = train.groupBy(*keys).agg(*(F.avg((c("direction") == d).cast("double")).alias(f"base_{d.lower()}") for d in DIRECTIONS))
    counted = counted.join(F.broadcast(base), keys)
    lift = c("confidence") / case((c("says") == "UP", c("base_up")), (c("says") == "DOWN", c("base_down")), otherwise=c("base_neutral"))
    return counted.filter(c("confidence") >= confidence).select(*keys, "rule", "n", "says", "confidence", lift.alias("lift"))


def rule_validation(bars: DataFrame) -> DataFrame:
    """Each rule's matches and hits on its window's test rows."""
    keys = ["horizon", "window_no"]
    rows = experience(bars)
    test = _rules(tests_of(bars, rows).filter("direction is not null"), keys)
    found = rules(bars, rows).select(*keys, "rule", "says")
    return test.join(found, [*keys, "rule"]).groupBy(*keys, "rule", "says").agg(F.count("*").alias("n_matches"), F.count_if(c("direction") == c("says")).alias("n_hits"))


def rule_predictions(bars: DataFrame) -> DataFrame:
    """The best rule for each test row: by confidence, cases, then name."""
    keys = ["horizon", "window_no"]
    rows = experience(bars)
    test = _rules(tests_of(bars, rows), ["series_id", "idx", *keys])
    joined = test.join(rules(bars, rows), [*keys, "rule"])
    best = joined.groupBy("series_id", "idx", *keys, "direction").agg(F.max_by(F.struct("rule", "says", "confidence"), F.struct("confidence", "n", "rule")).alias("b"))
    return best.select("series_id", "idx", *keys, "direction", "b.rule", "b.says", "b.confidence")


def stable_rules(bars: DataFrame, least_windows: int = 3) -> DataFrame:
    found = rules(bars).groupBy("horizon", "rule").agg(F.count_distinct("window_no").alias("n_windows"), F.count_distinct("says").alias("n_directions"), F.min("says").alias("says"), F.avg("confidence").alias("mean_confidence"))
    return found.filter((c("n_windows") >= least_windows) & (c("n_directions") == 1)).drop("n_directions")


def closeness(a: Column, b: Column, scale: float) -> Column:
    return F.exp(-F.abs(a - b) / scale)


COMPONENTS = ("structure", "sequence", "regime", "location", "momentum", "volatility", "candle", "path")
COMPARED = (*FEATURES, "candle_direction", "volatility_ratio", "body_ratio", "range_ratio")


def components(pairs: DataFrame) -> DataFrame:
    """Likeness of columns q_* and h_* in all components but the path, in place of those columns."""
    same = lambda n: (c(f"q_{n}") == c(f"h_{n}")).cast("int")
    return pairs.withColumns({
        "n_same": sum((same(n) for n in FEATURES[1:]), same(FEATURES[0])), "structure": (same("trend") + same("event") + same("high_label") + same("low_label")) / 4,
        **{n: same(n).cast("double") for n in ("sequence", "regime", "location", "momentum")}, "same_event": same("event"), "volatility": closeness(c("q_volatility_ratio"), c("h_volatility_ratio"), 0.35),
        "candle": 0.8 * (0.45 * closeness(c("q_body_ratio"), c("h_body_ratio"), 0.75) + 0.35 * closeness(c("q_range_ratio"), c("h_range_ratio"), 0.90)) + 0.2 * same("candle_direction"),
    }).drop(*(f"{side}_{n}" for side in "qh" for n in COMPARED))


def quality() -> Column:
    """How far the active components and the best of three of them support a match; its path counts as active."""
    active = sum(((c(n) > 0).cast("int") for n in COMPONENTS[:-1]), F.lit(1))
    return 0.75 + 0.25 * (0.55 * active / len(COMPONENTS) + 0.45 * F.greatest("structure", "sequence", "regime"))


def clash() -> Column:
    return (c("regime") == 0) | ((c("same_event") == 0) & (c("structure") < 0.25)) | (c("sequence") == 0) | (c("momentum") == 0)


def paths_of(bars: DataFrame) -> DataFrame:
    """(series_id, idx, path): the last twelve bars with the running total of their changes."""
    return candles.path_vectors(bars).select("series_id", "idx", F.transform("path", lambda x, k: x.withField("total", F.aggregate(F.slice("path", 1, k + 1), F.lit(0.0), lambda t, y: t + y["change"]))).alias("path"))


def with_paths(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of idx and h_idx with the likeness of their last twelve bars as ``path``."""
    paths = paths_of(bars)
    return path_likeness(pairs.join(paths.withColumnRenamed("path", "q_path"), ["series_id", "idx"]).join(paths.select("series_id", c("idx").alias("h_idx"), c("path").alias("h_path")), ["series_id", "h_idx"]))


def path_likeness(pairs: DataFrame) -> DataFrame:
    """The likeness of q_path and h_path as ``path``, in place of those columns."""
    # Weights and scales of the path's rows (fixed values): the later a row, the more it counts.
    row = lambda x, y: (
        0.40 * closeness(x["change"], y["change"], 0.65) + 0.25 * closeness(x["total"], y["total"], 1.25)
        + 0.20 * (0.65 * closeness(x["range"], y["range"], 0.80) + 0.35 * closeness(x["body"], y["body"], 0.70)) + F.when(x["direction"] == y["direction"], 0.15).otherwise(0.0)
    )
    decay = [DECAY ** (11 - k) for k in range(12)]
    weighed = F.zip_with(F.zip_with("q_path", "h_path", row), F.array(*(F.lit(d) for d in decay)), lambda v, d: v * d)
    return pairs.withColumn("path", F.aggregate(weighed, F.lit(0.0), lambda t, v: t + v) / sum(decay)).drop("q_path", "h_path")


def matches(bars: DataFrame) -> DataFrame:
    """Test rows against earlier rows of their series whose outcome is known: components, total similarity, contradiction gate, coarse filter.

    History is keyed by series and horizon, so the theta condition is a filter on an equi-join. Pairs that could not pass
    even with equal paths are left out before the paths are joined.
    """
    rows = experience(bars).withColumn("body_ratio", c("body") / c("unit")).withColumn("range_ratio", c("range") / c("unit"))
    names = COMPARED
    q = tests_of(bars, rows).select("series_id", "window_no", "horizon", "idx", "oos_start", c("direction").alias("actual"), *(c(n).alias(f"q_{n}") for n in names))
    h = rows.filter("direction is not null").select("series_id", "horizon", c("idx").alias("h_idx"), "episode", "direction", "atr_return", "mfe_atr", "mae_atr", *(c(n).alias(f"h_{n}") for n in names))
    pairs = q.join(h, ["series_id", "horizon"]).filter((c("h_idx") + c("horizon") < c("oos_start")) & (c("h_idx") <= c("idx") - KEEP_GAP))
    pairs = components(pairs)
    query = Window.partitionBy("series_id", "window_no", "horizon", "idx")
    pairs = pairs.withColumns({"n_strict": F.sum((c("n_same") >= 2).cast("int")).over(query), "n_relaxed": F.sum((c("n_same") >= 1).cast("int")).over(query)})
    need = case((c("n_strict") >= LEAST_CANDIDATES, F.lit(2)), (c("n_relaxed") >= LEAST_CANDIDATES, F.lit(1)), otherwise=F.lit(0))
    weight = lambda n: case(*((c("horizon") == h, F.lit(w[n])) for h, w in WEIGHTS.items()), otherwise=F.lit(WEIGHTS[8][n]))
    parts = COMPONENTS[:-1]
    score = sum((weight(n) * c(n) for n in parts[1:]), weight(parts[0]) * c(parts[0]))
    pairs = pairs.filter(c("n_same") >= need).withColumns({"quality": quality(), "partial": score, "floor": F.when(clash(), 0.60).otherwise(0.42)})
    total = lambda path: (c("partial") + weight("path") * path) * c("quality")
    pairs = pairs.filter(total(F.lit(1.0)) >= c("floor") - 1e-9)
    pairs = with_paths(bars, pairs).withColumn("similarity", total(c("path")))
    return pairs.filter(c("similarity") >= c("floor"))


QUERY = ["series_id", "window_no", "horizon", "idx"]


def _filled(k: int):
    """The matches of one query: the best of each episode, then by greedy choice those that add most likeness and least of what is there."""

    def fill(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values(["similarity", "h_idx"], ascending=False).reset_index(drop=True)
        chosen = list(m.drop_duplicates("episode").index[:k])
        values, similarity = m[list(COMPONENTS)].to_numpy(float), m["similarity"].to_numpy()
        nearest = np.full(len(m), -np.inf)
        for at in chosen:
            nearest = np.maximum(nearest, 1 - np.abs(values - values[at]).mean(1))
        while len(chosen) < min(k, len(m)):
            score = np.round(DIVERSITY * similarity - (1 - DIVERSITY) * nearest, 9)
            score[chosen] = -np.inf
            at = int(np.argmax(score))
            chosen.append(at)
            nearest = np.maximum(nearest, 1 - np.abs(values - values[at]).mean(1))
        return m.loc[sorted(chosen)]

    return fill


def top_matches(bars: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most similar matches of each query, one an episode; with fewer episodes than k, further matches by likeness less redundancy.

    An episode has at most structure.GAP bars, so a query that needs the second pass has fewer than k * GAP matches.
    """
    by = [F.desc("similarity"), F.desc("h_idx")]
    query = Window.partitionBy(*QUERY)
    every = matches(bars).withColumn("n", F.row_number().over(Window.partitionBy(*QUERY, "episode").orderBy(*by)))
    every = shared.cut(every.withColumn("n_episodes", F.count_if(c("n") == 1).over(query)).withColumn("n_all", F.count("*").over(query)), "matches")
    few = c("n_episodes") < F.least(F.lit(k), c("n_all"))
    filled = every.filter(few).groupBy(*QUERY).applyInPandas(_filled(k), every.schema)
    both = every.filter(~few & (c("n") == 1)).unionByName(filled)
    return both.withColumn("rank", F.row_number().over(query.orderBy(*by))).filter(c("rank") <= k)


def retrieval_shares(bars: DataFrame) -> DataFrame:
    m = top_matches(bars)
    total = F.sum("similarity")
    return m.groupBy(*QUERY, "actual").agg(
        F.count("*").alias("n"), F.max("similarity").alias("best"), *((F.sum(F.when(c("direction") == d, c("similarity")).otherwise(0.0)) / total).alias(f"share_{d.lower()}") for d in DIRECTIONS),
        (F.sum(c("similarity") * c("atr_return")) / total).alias("mean_return"), (F.sum(c("similarity") * c("mfe_atr")) / total).alias("mean_mfe"), (F.sum(c("similarity") * c("mae_atr")) / total).alias("mean_mae"),
    )


def decisions(bars: DataFrame) -> DataFrame:
    """Class-balanced kernel evidence of the matches and the abstaining decision."""
    m = top_matches(bars).withColumn("kernel", F.exp(-(1 - c("similarity")) / TEMPERATURE))
    counts = [F.count_if(c("direction") == d).alias(f"n_{d}") for d in DIRECTIONS]
    means = [F.avg(F.when(c("direction") == d, c("kernel"))).alias(f"m_{d}") for d in DIRECTIONS]
    e = m.groupBy(*QUERY, "actual").agg(*counts, *means)
    for d in DIRECTIONS:
        e = e.withColumn(f"e_{d}", F.when(c(f"n_{d}") >= 2, c(f"m_{d}") * (1 - F.exp(-c(f"n_{d}") / 6.0))).otherwise(0.0))
    e = e.withColumn("all", c("e_UP") + c("e_DOWN") + c("e_NEUTRAL"))
    e = e.withColumns({f"p_{d.lower()}": F.when(c("all") > EPS, c(f"e_{d}") / c("all")).otherwise(1 / 3) for d in DIRECTIONS})
    e = e.withColumn("order", F.sort_array(F.array(*(F.struct(c(f"p_{d.lower()}").alias("p"), F.lit(d).alias("d")) for d in DIRECTIONS)), asc=False))
    e = e.withColumns({"best": c("order")[0]["p"], "margin": c("order")[0]["p"] - c("order")[1]["p"], "leader": c("order")[0]["d"]})
    reason = case((c("best") < 0.42, "LOW_PROBABILITY"), (c("margin") < 0.08, "LOW_MARGIN"), otherwise="SUPPORTED")
    e = e.withColumn("reason", reason).withColumn("prediction", F.when(c("reason") == "SUPPORTED", c("leader")).otherwise("NEUTRAL"))
    return e.select(*QUERY, "actual", "p_up", "p_down", "p_neutral", "margin", "prediction", "reason")


VECTOR = ("r1", "r3", "r8", "r16", "volatility_ratio", "location20")


def standardised(bars: DataFrame) -> DataFrame:
    """Test and training vectors, scaled by each window's training mean and sample deviation."""
    f = candles.features(bars).select("series_id", "idx", *VECTOR)
    rows = outcomes.outcomes(bars).select("series_id", "idx", "horizon", "direction", "raw_return").join(f, ["series_id", "idx"])
    train, test = training_of(bars, rows), tests_of(bars, rows)
    base = ["series_id", "window_no", "horizon"]
    scale = train.groupBy(*base).agg(*(F.avg(v).alias(f"m_{v}") for v in VECTOR), *(F.coalesce(F.nullif(F.stddev_samp(v), F.lit(0.0)), F.lit(1.0)).alias(f"s_{v}") for v in VECTOR))
    z = lambda df: df.join(F.broadcast(scale), base).select(*base, "idx", "direction", "raw_return", F.array(*((c(v) - c(f"m_{v}")) / c(f"s_{v}") for v in VECTOR)).alias("z"))
    return z(train).withColumn("train", F.lit(True)).unionByName(z(test).withColumn("train", F.lit(False)))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_centroid(bars: DataFrame) -> DataFrame:
    """The class whose training mean is nearest (ties by name)."""
    z = standardised(bars)
    base = ["series_id", "window_no", "horizon"]
    means = z.filter("train").groupBy(*base, c("direction").alias("label")).agg(F.array(*(F.avg(c("z")[k]) for k in range(len(VECTOR)))).alias("mean"))
    pairs = z.filter("not train").join(F.broadcast(means), base).withColumn("distance", _distance("z", "mean"))
    return pairs.groupBy(*base, "idx", "direction").agg(F.min_by("label", F.struct("distance", "label")).alias("prediction"))


def online_walk_forward(bars: DataFrame, horizon: int = 4, maturity: str = "fenced") -> DataFrame:
    """Predict, reveal, learn in batch: Laplace-smoothed shares of earlier equal state keys whose outcome counts as known.

    maturity 'fenced': known once the horizon has passed; 'reference': known at the next bar. Earlier rows of a key are a
    running count at the time each outcome becomes known, so no self-join is needed.
    """
    lag = horizon if maturity == "fenced" else 1
    rows = structure.market_states(bars).select("series_id", "idx", "state_key").join(outcomes.outcomes(bars, (horizon,)).select("series_id", "idx", "price_direction"), ["series_id", "idx"])
    asks = rows.select("series_id", "state_key", c("idx").alias("at"), F.lit(1).alias("ask"), "idx", F.lit(None).cast("string").alias("learnt"), "price_direction")
    facts = rows.filter("price_direction is not null").select("series_id", "state_key", (c("idx") + lag).alias("at"), F.lit(0).alias("ask"), "idx", c("price_direction").alias("learnt"), "price_direction")
    w = Window.partitionBy("series_id", "state_key").orderBy("at", "ask", "idx").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda d: F.sum((c("learnt") == d).cast("long")).over(w)
    both = asks.unionByName(facts).withColumns({d: F.coalesce(count(d), F.lit(0)) for d in ("bullish", "bearish", "neutral")}).filter("ask = 1")
    n = c("bullish") + c("bearish") + c("neutral")
    out = both.withColumns({f"p_{d}": (c(d) + 1) / (n + 3) for d in ("bullish", "bearish", "neutral")}).withColumn("support", n)
    best = F.greatest("p_bullish", "p_bearish", "p_neutral")
    return out.withColumn("prediction", case((c("p_bullish") == best, "bullish"), (c("p_bearish") == best, "bearish"), otherwise="neutral")).select("series_id", "idx", "state_key", "support", "p_bullish", "p_bearish", "p_neutral", "prediction", c("price_direction").alias("actual"))
