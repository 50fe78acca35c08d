"""Forecasts built on other forecasts: logistic regression and the ensemble, states by training quantiles, temperature, decision rules, shrunk and ablated retrieval, penalties, plain baselines, scores of patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shared
from tidemark.functions.columns import EPS, case, over, series
from tidemark.operators import candles, evaluation, learning, levels, nearest, outcomes, structure

c = F.col
BASE = ["series_id", "window_no", "horizon"]
QUERY = learning.QUERY
DIRECTIONS = learning.DIRECTIONS
# Weights of the ensemble and of its confidence, bounds of a probability, least confidence and margin.
LOGISTIC, NEIGHBOURS, STATE = 0.55, 0.25, 0.20
FLOOR, CEILING, LEAST_CONFIDENCE, LEAST_MARGIN = 0.001, 0.999, 0.45, 0.02
RIDGE, PRIOR, LEAST_SAMPLES, MARGIN = 0.75, 12.0, 8, 0.02


def _shares(df: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """p_up, p_down, p_neutral in proportion to the weights, a third each where all are 0."""
    df = df.withColumns({f"w_{d.lower()}": w for d, w in weights.items()}).withColumn("w_all", c("w_up") + c("w_down") + c("w_neutral"))
    return df.withColumns({f"p_{d.lower()}": F.when(c("w_all") > EPS, c(f"w_{d.lower()}") / c("w_all")).otherwise(1 / 3) for d in DIRECTIONS})


def _newton(d: int):
    """One step from each group's sums of gradient and curvature; a group is one row."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            weights = []
            for _, r in m.iterrows():
                old = np.array(r["weights"], float)
                curve = np.zeros((d, d))
                curve[np.triu_indices(d)] = r["curvature"]
                curve += np.triu(curve, 1).T
                ridge = RIDGE * np.append(0.0, np.ones(d - 1))
                weights.append(list(old - np.linalg.solve(curve + np.diag(ridge + 1e-12), np.array(r["gradient"], float) + ridge * old)))
            yield m[[*BASE, "n", "positive"]].assign(weights=weights)

    return step


def logistic_models(rows: DataFrame, steps: int = 8) -> DataFrame:
    """Class-balanced logistic regression with a ridge of 0.75, by Newton's method: one aggregate over all groups a step.

    Rows have BASE, z (a vector) and y (0 or 1). A step shuffles sums only, 35 for six features; models are a row a group.
    """
    d = len(learning.VECTOR) + 1
    rows = rows.withColumn("x", F.concat(F.array(F.lit(1.0)), "z"))
    model = rows.groupBy(*BASE).agg(F.count("*").alias("n"), F.sum("y").alias("positive")).withColumn("weights", F.array_repeat(F.lit(0.0), d))
    schema = model.schema
    for _ in range(steps):
        model = shared.cut(model, "logistic")
        at = rows.join(model, BASE).withColumn("p", sigmoid(_dot("weights", "x")))
        balance = F.when(c("y") == 1, c("n") / F.greatest(2 * c("positive"), F.lit(1.0))).otherwise(c("n") / F.greatest(2 * (c("n") - c("positive")), F.lit(1.0))) / c("n")
        at = at.withColumns({"error": (c("p") - c("y")) * balance, "curve": c("p") * (1 - c("p")) * balance})
        sums = at.groupBy(*BASE, "n", "positive", "weights").agg(
            F.array(*(F.sum(c("error") * c("x")[j]) for j in range(d))).alias("gradient"),
            F.array(*(F.sum(c("curve") * c("x")[j] * c("x")[k]) for j in range(d) for k in range(j, d))).alias("curvature"),
        )
        model = sums.mapInPandas(_newton(d), schema)
    return shared.cut(model, "logistic")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic(bars: DataFrame) -> DataFrame:
    """Probability of a rise for each test row; where all training rows of a window moved one way, 0 or 1."""
    z = shared.cut(learning.standardised(bars), "vectors")
    train = z.filter("train and raw_return <> 0").withColumn("y", (c("raw_return") > 0).cast("double"))
    out = z.filter("not train").join(logistic_models(train), BASE)
    one_way = case((c("positive") == 0, F.lit(0.0)), (c("positive") == c("n"), F.lit(1.0)), otherwise=sigmoid(_dot("weights", F.concat(F.array(F.lit(1.0)), "z"))))
    return out.select(*QUERY, F.when(c("raw_return") != 0, (c("raw_return") > 0).cast("int")).alias("rose"), c("n").alias("n_train"), one_way.alias("p_up"))


def ensemble(bars: DataFrame) -> DataFrame:
    """Logistic, neighbours' and state's probability of a rise, mixed by fixed weights, with agreement, confidence and abstention."""
    two = lambda df: F.when(df.p_up + df.p_down > EPS, df.p_up / (df.p_up + df.p_down)).otherwise(0.5)
    knn, state = nearest.probability(bars), learning.hierarchical(bars)
    out = logistic(bars).withColumnRenamed("p_up", "p_logistic")
    out = out.join(knn.select(*QUERY, two(knn).alias("p_neighbours")), QUERY).join(state.select(*QUERY, "support", two(state).alias("p_state")), QUERY)
    a, b, s = c("p_logistic"), c("p_neighbours"), c("p_state")
    out = out.withColumn("p_up", F.least(F.greatest(LOGISTIC * a + NEIGHBOURS * b + STATE * s, F.lit(FLOOR)), F.lit(CEILING)))
    out = out.withColumns({"margin": 2 * F.abs(c("p_up") - 0.5), "agreement": 1 - (F.abs(a - b) + F.abs(a - s) + F.abs(b - s)) / 3})
    confidence = 0.55 * c("margin") + 0.25 * c("agreement") + 0.10 * F.least(c("support") / 20, F.lit(1.0)) + 0.10 * F.least(c("n_train") / 500, F.lit(1.0))
    out = out.withColumn("confidence", confidence)
    return out.withColumn("says", case(((F.round("confidence", 9) < LEAST_CONFIDENCE) | (F.round("margin", 9) < LEAST_MARGIN), "ABSTAIN"), (c("p_up") >= 0.5, "UP"), otherwise="DOWN"))


MEASURES = ("distance", "swing", "age", "persistence")


def structure_measures(bars: DataFrame) -> DataFrame:
    """Trend and event with the distance from the broken level, size of the swing, age of the event, persistence of the regime, and place in the range."""
    s = structure.regime_runs(structure.market_states(bars))
    broken = F.last(case((c("broke_down"), c("last_low")), (c("broke_up"), c("last_high")), otherwise=F.lit(None).cast("double")), ignorenulls=True).over(over(None))
    s = s.withColumns({"broken": broken, "span": c("last_high") - c("last_low")})
    way = case((c("trend") == "BULLISH", F.lit(1.0)), (c("trend") == "BEARISH", F.lit(-1.0)), otherwise=F.lit(0.0))
    place = case(((c("trend") == "BULLISH") & (c("span") > 0), (c("close") - c("last_low")) / c("span")), ((c("trend") == "BEARISH") & (c("span") > 0), (c("last_high") - c("close")) / c("span")), otherwise=F.lit(0.5))
    place = F.round(F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)), 9)
    return s.select(
        "series_id", "idx", "trend", "event", case((place < 0.33, "LOW"), (place > 0.66, "HIGH"), otherwise="MID").alias("place"),
        F.round(F.coalesce(F.abs(way * (c("close") - c("broken")) / F.greatest(F.abs("broken"), F.lit(EPS))), F.lit(0.0)), 9).alias("distance"), F.round(F.coalesce(F.abs("span"), F.lit(0.0)), 9).alias("swing"),
        F.least(F.coalesce("event_age", "structure_age"), F.lit(1000)).cast("double").alias("age"), F.least("persistence", F.lit(10)).cast("double").alias("persistence"),
    )


def quantile_states(bars: DataFrame) -> DataFrame:
    """States of measures cut at training terciles; their share of rises shrunk to that of all training rows, which alone answers below 8 samples."""
    rows = learning.experience(bars).select("series_id", "idx", "horizon", "direction").join(structure_measures(bars), ["series_id", "idx"])
    rows = shared.cut(rows, "measures")
    train, test = learning.training_of(bars, rows), learning.tests_of(bars, rows)
    cuts = train.groupBy(*BASE).agg(*(F.percentile(m, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias(f"cut_{m}") for m in MEASURES))

    def encoded(df: DataFrame) -> DataFrame:
        part = lambda m: case((c(m) <= c(f"cut_{m}")[0], "0"), ((c(m) <= c(f"cut_{m}")[1]) | (c(f"cut_{m}")[0] == c(f"cut_{m}")[1]), "1"), otherwise="2")
        return df.join(F.broadcast(cuts), BASE).withColumn("state", F.concat_ws("|", "trend", "event", "place", *(part(m) for m in MEASURES))).select(*QUERY, "direction", "state")

    moved = encoded(train).filter("direction <> 'NEUTRAL'")
    counted = moved.groupBy(*BASE, "state").agg(F.count("*").alias("samples"), F.count_if(c("direction") == "UP").alias("up"))
    whole = counted.groupBy(*BASE).agg((F.sum("up") / F.sum("samples")).alias("global_up"))
    out = encoded(test).join(counted, [*BASE, "state"], "left").join(F.broadcast(whole), BASE, "left").withColumn("global_up", F.coalesce("global_up", F.lit(0.5)))
    own = c("samples") >= LEAST_SAMPLES
    out = out.withColumn("source", case((c("samples").isNull(), "GLOBAL_BASELINE"), (own, "STRUCTURAL_STATE"), otherwise="GLOBAL_BASELINE_LOW_SAMPLE"))
    out = out.withColumn("p_up", F.when(own, (c("up") + PRIOR * c("global_up")) / (c("samples") + PRIOR)).otherwise(c("global_up"))).withColumn("samples", F.coalesce("samples", F.lit(0)))
    p = F.round("p_up", 9)
    return out.withColumn("prediction", case((p >= 0.5 + MARGIN, "UP"), (p <= 0.5 - MARGIN, "DOWN"), (c("global_up") >= 0.5, "UP"), otherwise="DOWN"))


def temperature(bars: DataFrame) -> DataFrame:
    """Temperature of the states' probabilities with the least log loss on all windows but the last, from 0.2 to 4 by 1/80, and the loss on the last with and without it."""
    rows = quantile_states(bars).filter("direction <> 'NEUTRAL'").select("horizon", "window_no", (c("direction") == "UP").alias("rose"), F.least(F.greatest("p_up", F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"))
    # Equal probabilities are counted before they meet the grid.
    rows = rows.groupBy("horizon", F.col("window_no") == learning.WINDOWS - 1, "rose", "p").agg(F.count("*").alias("n")).toDF("horizon", "last", "rose", "p", "n")
    grid = rows.withColumn("temperature", F.explode(F.transform(F.sequence(F.lit(16), F.lit(320)), lambda k: k / 80.0)))
    q = sigmoid(F.log(c("p") / (1 - c("p"))) / c("temperature"))
    loss = -F.log(F.greatest(F.when(c("rose"), q).otherwise(1 - q), F.lit(1e-12)))
    mean = lambda which: F.sum(F.when(which, loss * c("n"))) / F.sum(F.when(which, c("n")))
    tried = grid.groupBy("horizon", "temperature").agg(mean(~c("last")).alias("fit_loss"), mean(c("last")).alias("test_loss"))
    best = F.min_by(F.struct("temperature", "fit_loss", "test_loss"), F.struct(F.round("fit_loss", 9), "temperature"))
    return tried.groupBy("horizon").agg(best.alias("b"), F.max(F.when(c("temperature") == 1.0, c("test_loss"))).alias("plain_loss")).select("horizon", "b.temperature", "b.fit_loss", "b.test_loss", "plain_loss")


def evidence_rules(bars: DataFrame) -> DataFrame:
    """Nine ways to decide from a query's matches: powers of similarity, the best 5, 10, 20 squared, and their votes; accuracy on the windows before the last, where one is chosen, and on the last."""
    by = Window.partitionBy(*QUERY).orderBy(F.desc(F.round("similarity", 9)), F.desc("h_idx"))
    m = learning.matches(bars).filter("actual is not null").withColumn("place", F.row_number().over(by))
    is_ = lambda d: c("direction") == d
    sums = {f"power_{p}": (p, None) for p in (1, 2, 4)} | {f"top_{k}": (2, k) for k in (5, 10, 20)}
    aggregates = [F.sum(F.when(is_(d) & (F.lit(True) if k is None else c("place") <= k), c("similarity") ** p).otherwise(0.0)).alias(f"{n}_{d}") for n, (p, k) in sums.items() for d in DIRECTIONS]
    aggregates += [F.count_if(is_(d) & (c("place") <= k)).alias(f"vote_{k}_{d}") for k in (5, 10, 20) for d in DIRECTIONS] + [F.min(F.when(is_(d), c("place"))).alias(f"first_{d}") for d in DIRECTIONS]
    found = m.groupBy(*QUERY, "actual").agg(*aggregates)
    most = lambda n, tie: F.sort_array(F.array(*(F.struct(F.round(c(f"{n}_{d}").cast("double"), 9).alias("v"), tie(i, d).alias("t"), F.lit(d).alias("d")) for i, d in enumerate(DIRECTIONS))), asc=False)[0]["d"]
    said = [F.struct(F.lit(n).alias("rule"), most(n, lambda i, d: F.lit(-i)).alias("said")) for n in sums]
    said += [F.struct(F.lit(f"vote_{k}").alias("rule"), most(f"vote_{k}", lambda i, d: -F.coalesce(c(f"first_{d}"), F.lit(2**30))).alias("said")) for k in (5, 10, 20)]
    rows = found.select("horizon", "window_no", "actual", F.explode(F.array(*said)).alias("r")).withColumn("hit", (c("r.said") == c("actual")).cast("int"))
    last = c("window_no") == learning.WINDOWS - 1
    out = rows.groupBy("horizon", c("r.rule").alias("rule")).agg(F.count_if(~last).alias("n_fit"), F.avg(F.when(~last, c("hit"))).alias("fit_accuracy"), F.count_if(last).alias("n_test"), F.avg(F.when(last, c("hit"))).alias("test_accuracy"))
    best = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc(F.round("fit_accuracy", 9)), "rule"))
    return out.withColumn("chosen", (best == 1).cast("int"))


#: Weights of a similarity that puts structure first (fixed values).
STRUCTURE_FIRST = {"structure": 0.24, "sequence": 0.16, "regime": 0.16, "location": 0.08, "momentum": 0.08, "volatility": 0.07, "candle": 0.07, "path": 0.14}


def shrunk_retrieval(bars: DataFrame, halflife: float = 250.0, k: int = 16) -> DataFrame:
    """Shares from matches scored anew: structure-first weights, 0.35 for another regime, half-life in bars; best of each episode, fourth powers over roots of ranks, shrunk to thirds by the mix of classes."""
    base = sum((w * c(n) for n, w in STRUCTURE_FIRST.items() if n != "structure"), STRUCTURE_FIRST["structure"] * c("structure")) * c("quality")
    m = learning.matches(bars).withColumn("base", base).filter(F.round("base", 9) >= 0.42)
    age = F.exp(-np.log(2.0) * (c("idx") - c("h_idx")) / halflife)
    m = m.withColumn("score", F.round(c("base") * F.when(c("regime") == 1, 1.0).otherwise(0.35) * (0.70 + 0.30 * age), 9))
    by = [F.desc("score"), F.desc(F.round("base", 9)), F.asc("h_idx")]
    m = m.withColumn("n", F.row_number().over(Window.partitionBy(*QUERY, "episode").orderBy(*by))).filter("n = 1")
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy(*QUERY).orderBy(*by))).filter(c("rank") <= k)
    weight = F.greatest(F.lit(0.01), c("score") ** 4) / F.sqrt("rank")
    e = m.groupBy(*QUERY, "actual").agg(F.count("*").alias("n"), *(F.count_if(c("direction") == d).alias(f"n_{d}") for d in DIRECTIONS), *(F.sum(F.when(c("direction") == d, weight).otherwise(0.0)).alias(f"s_{d}") for d in DIRECTIONS))
    part = lambda d: F.when(c(f"n_{d}") > 0, c(f"n_{d}") / c("n") * F.log(c(f"n_{d}") / c("n"))).otherwise(0.0)
    e = e.withColumn("homogeneity", F.when(c("n") >= 5, 1 + (part("UP") + part("DOWN") + part("NEUTRAL")) / np.log(3.0)).otherwise(0.0))
    strength = F.when(c("n") >= 5, 0.15 + 0.85 * c("homogeneity")).otherwise(0.0)
    whole = c("s_UP") + c("s_DOWN") + c("s_NEUTRAL")
    return e.withColumns({f"p_{d.lower()}": 1 / 3 + strength * (c(f"s_{d}") / whole - 1 / 3) for d in DIRECTIONS})


def component_ablation(bars: DataFrame, k: int = learning.TOP_K) -> DataFrame:
    """Accuracy and Brier score of the class-balanced evidence when one component leaves the similarity of the matches (their gates stay), by component."""
    parts = learning.COMPONENTS
    weight = lambda n: case(*((c("horizon") == h, F.lit(w[n])) for h, w in learning.WEIGHTS.items()), otherwise=F.lit(learning.WEIGHTS[8][n]))
    m = learning.matches(bars).filter("actual is not null")
    whole = sum((weight(n) * c(n) for n in parts[1:]), weight(parts[0]) * c(parts[0]))
    without = lambda n: F.struct(F.lit(n).alias("dropped"), F.round((whole - weight(n) * c(n)) / (1 - weight(n)) * c("quality"), 9).alias("score"))
    m = m.select(*QUERY, "actual", "h_idx", "direction", "floor", F.explode(F.array(F.struct(F.lit("none").alias("dropped"), F.round(whole * c("quality"), 9).alias("score")), *(without(n) for n in parts))).alias("x"))
    m = m.select("*", "x.*").filter(c("score") >= c("floor")).withColumn("rank", F.row_number().over(Window.partitionBy(*QUERY, "dropped").orderBy(F.desc("score"), F.desc("h_idx")))).filter(c("rank") <= k)
    kernel = F.exp(-(1 - c("score")) / learning.TEMPERATURE)
    n, mean = (lambda d: F.count_if(c("direction") == d)), (lambda d: F.avg(F.when(c("direction") == d, kernel)))
    e = m.groupBy(*QUERY, "actual", "dropped").agg(*((F.coalesce(mean(d), F.lit(0.0)) * (1 - F.exp(-n(d) / 6.0))).alias(f"e_{d}") for d in DIRECTIONS))
    s = evaluation.scored(_shares(e, {d: c(f"e_{d}") for d in DIRECTIONS}))
    return s.groupBy("horizon", "dropped").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("brier").alias("brier"))


def failure_penalties(bars: DataFrame) -> DataFrame:
    """The conditional baseline after penalties for failures of the same call in the same trend, momentum and regime in earlier windows.

    ``stepped``: 0, 0.05 ... 0.20 by the number of failures; ``adaptive``: a quarter of their rate times the root of samples / 100
    times 0.65. Each moves from the called direction to neutral; a call of neutral keeps its shares.
    """
    rows = evaluation.scored(learning.conditional_baseline(bars), "direction")
    states = learning.experience(bars).select("series_id", "idx", "horizon", "trend", "momentum", c("regime").alias("in_regime"))
    rows = shared.cut(rows.join(states, ["series_id", "idx", "horizon"]), "calls")
    key = ["horizon", "said", "trend", "momentum", "in_regime"]
    counted = rows.groupBy(*key, "window_no").agg(F.count("*").alias("n"), F.count_if(c("hit") == 0).alias("failed"))
    earlier = Window.partitionBy(*key).orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(*key, "window_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("samples"), F.coalesce(F.sum("failed").over(earlier), F.lit(0)).alias("failures"))
    out = rows.join(counted, [*key, "window_no"])
    f, n = c("failures"), c("samples")
    out = out.withColumns({
        "stepped": case((f <= 0, F.lit(0.0)), (f < 50, F.lit(0.05)), (f < 100, F.lit(0.10)), (f < 200, F.lit(0.15)), otherwise=F.lit(0.20)),
        "adaptive": F.when(n > 0, 0.25 * (f / n) * F.least(F.lit(1.0), F.sqrt(n / 100)) * 0.65).otherwise(0.0),
    })
    move = lambda d, x: F.when(c("said") == d, F.least(c(f"p_{d.lower()}"), x)).otherwise(0.0)
    for name in ("stepped", "adaptive"):
        up, down = move("UP", c(name)), move("DOWN", c(name))
        out = out.withColumns({f"{name}_up": c("p_up") - up, f"{name}_down": c("p_down") - down, f"{name}_neutral": c("p_neutral") + up + down})
    return out


def naive_baselines(bars: DataFrame) -> DataFrame:
    """Accuracy of the training majority, the sign of the last three bars, the last candle and a draw by MD5, by horizon."""
    rows = learning.experience(bars)
    n = {d: F.count_if(c("direction") == d) for d in DIRECTIONS}
    most = learning.training_of(bars, rows).groupBy(*BASE).agg(case((n["UP"] == F.greatest(*n.values()), "UP"), (n["DOWN"] == F.greatest(*n.values()), "DOWN"), otherwise="NEUTRAL").alias("majority"))
    test = learning.tests_of(bars, rows).filter("direction is not null").join(F.broadcast(most), BASE)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "series_id", "idx", "horizon")), 1, 8), 16, 10).cast("long") % 3
    says = {
        "majority": c("majority"), "momentum": case((c("r3") > 0, "UP"), (c("r3") < 0, "DOWN"), otherwise="NEUTRAL"), "last_candle": case((c("candle_direction") == "FLAT", "NEUTRAL"), otherwise=c("candle_direction")),
        "random": case((draw == 0, "UP"), (draw == 1, "DOWN"), otherwise="NEUTRAL"),
    }
    long = test.select("horizon", "direction", F.explode(F.array(*(F.struct(F.lit(k).alias("method"), v.alias("said")) for k, v in says.items()))).alias("x"))
    return long.groupBy("horizon", c("x.method").alias("method")).agg(F.count("*").alias("n"), F.avg((c("x.said") == c("direction")).cast("int")).alias("accuracy"))


def decision_stability(bars: DataFrame) -> DataFrame:
    """How often the baseline's call is that of the bar before, within a window, by horizon and call."""
    rows = evaluation.scored(learning.conditional_baseline(bars), "direction").withColumn("was", F.lag("said").over(Window.partitionBy(*BASE).orderBy("idx")))
    same = c("said") == c("was")
    return rows.filter("was is not null").groupBy("horizon", "said").agg(F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_changed"), F.avg(same.cast("int")).alias("stability"))


def trust_tiers(bars: DataFrame) -> DataFrame:
    """State keys of a series by how many of their outcomes are known: level and score of trust, number of keys and of outcomes."""
    known = learning.experience(bars).groupBy("series_id", "horizon", "state_key").agg(F.count("direction").alias("resolved"))
    tiers = [(0, "not_available", 0.0), (5, "very_early", 20.0), (15, "developing", 40.0), (30, "moderate_sample", 60.0), (60, "strong_sample", 75.0)]
    test = lambda top: (c("resolved") == 0) if top == 0 else (c("resolved") < top)
    level, score = case(*((test(t), n) for t, n, _ in tiers), otherwise="large_sample"), case(*((test(t), F.lit(s)) for t, _, s in tiers), otherwise=F.lit(90.0))
    return known.withColumns({"level": level, "score": score}).groupBy("horizon", "level", "score").agg(F.count("*").alias("n_keys"), F.sum("resolved").alias("n_outcomes"))


def _sixes(bars: DataFrame) -> DataFrame:
    letter = F.left("direction", F.lit(1))
    return candles.anatomy(bars).select("series_id", "idx", F.when(c("idx") >= 5, F.concat(*(F.lag(letter, k).over(series()) for k in range(5, 0, -1)), letter)).alias("pattern")).filter("pattern is not null")


def pattern_scores(bars: DataFrame) -> DataFrame:
    """Runs of six directions: occurrences and known outcomes, share of the commonest outcome averaged over horizons (%), and the score of all three."""
    rows = _sixes(bars).join(outcomes.outcomes(bars).select("series_id", "idx", "horizon", "price_direction"), ["series_id", "idx"])
    n = lambda d: F.count_if(c("price_direction") == d)
    by = rows.groupBy("pattern", "horizon").agg(F.count("*").alias("occurrences"), F.count("price_direction").alias("resolved"), F.greatest(n("bullish"), n("bearish"), n("neutral")).alias("most"))
    out = by.groupBy("pattern").agg(F.max("occurrences").alias("occurrences"), F.sum("resolved").alias("resolved"), F.coalesce(F.avg(F.when(c("resolved") > 0, 100 * c("most") / c("resolved"))), F.lit(0.0)).alias("accuracy"))
    score = 0.60 * c("accuracy") + 20 * F.least(c("occurrences") / 20, F.lit(1.0)) + 20 * F.least(c("resolved") / (c("occurrences") * len(outcomes.HORIZONS)), F.lit(1.0))
    return out.withColumn("score", score)


def similar_patterns(bars: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """For each series' last run of six directions the k likest runs seen at least three times: by share of equal places, occurrences, name. Places meet by an equi-join."""
    sixes = _sixes(bars)
    now = sixes.groupBy("series_id").agg(F.max_by("pattern", "idx").alias("current"))
    stats = sixes.groupBy("pattern").agg(F.count("*").alias("occurrences")).filter(c("occurrences") >= least)
    place = lambda df, p: df.select("*", F.posexplode(F.split(p, "")).alias("at", "letter"))
    met = place(now, "current").join(place(stats, "pattern"), ["at", "letter"]).groupBy("series_id", "current", "pattern", "occurrences").agg((F.count("*") / 6).alias("similarity"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("similarity"), F.desc("occurrences"), "pattern"))).filter(c("rank") <= k)


def level_clusters(bars: DataFrame, lookback: int = levels.LOOKBACK, width: float = 0.0015) -> DataFrame:
    """Levels of recent swings: prices in order join the level whose running mean is within 0.15 %; touches, and the side of the last close.

    A price beyond a level's reach leaves it for good, as prices rise, so only the last level has to be looked at. At most lookback prices a series.
    A level at 0 reaches nothing, as 0.15 % of it has no meaning.
    """
    last = bars.groupBy("series_id").agg(F.max("idx").alias("last_idx"), F.max_by("close", "idx").alias("last_close"))
    recent = levels.pivots(bars).join(last, "series_id").filter(c("pivot_idx") >= c("last_idx") - lookback)
    grouped = recent.groupBy("series_id", "last_close").agg(F.sort_array(F.collect_list("price")).alias("prices"))
    kind = "array<struct<total:double,n:int>>"

    def join(found: Column, x: Column) -> Column:
        top = F.try_element_at(found, F.lit(-1))
        near = F.coalesce(F.try_divide(F.abs(x - top["total"] / top["n"]), F.abs(top["total"] / top["n"])) <= width, F.lit(False))
        grown = F.array_append(F.slice(found, 1, F.size(found) - 1), F.struct((top["total"] + x).alias("total"), (top["n"] + 1).alias("n")))
        return F.when(near, grown).otherwise(F.array_append(found, F.struct(x.alias("total"), F.lit(1).alias("n"))))

    out = grouped.select("series_id", "last_close", F.posexplode(F.aggregate("prices", F.array().cast(kind), join)).alias("level_no", "l"))
    out = out.select("series_id", "level_no", "last_close", (c("l.total") / c("l.n")).alias("price"), c("l.n").alias("touches"))
    return out.withColumn("side", case((F.round("price", 7) < F.round("last_close", 7), "SUPPORT"), (F.round("price", 7) > F.round("last_close", 7), "RESISTANCE"), otherwise="AT"))


PARTS = ("direction", "body_size", "wick_profile", "trend", "volatility_state", "location", "sequence", "event", "high_label", "low_label", "momentum", "regime")
RETURNS = ("r1", "r3", "r8", "r16")


def states(bars: DataFrame) -> DataFrame:
    """(series_id, idx, parts, returns, path, bucket): bars whose parts, returns (to 10 places) and path (to 6) are equal share a bucket, named by its first bar."""
    at = ["series_id", "idx"]
    state = structure.market_states(bars).select(*at, *RETURNS, *(p for p in PARTS if p not in ("body_size", "wick_profile", "volatility_state")))
    state = state.join(candles.language(bars).select(*at, "body_size", "wick_profile"), at).join(candles.classes(bars).select(*at, "volatility_state"), at).join(candles.path_vectors(bars).select(*at, "path"), at)
    near = F.transform("path", lambda x: F.array(*(F.round(x[n], 6) for n in ("change", "range", "direction", "body"))))
    rows = state.select(*at, F.array(*PARTS).alias("parts"), F.array(*RETURNS).alias("returns"), "path", F.array(*(F.round(r, 10) for r in RETURNS)).alias("kept_returns"), near.alias("kept_path"))
    return rows.withColumn("bucket", F.min("idx").over(Window.partitionBy("series_id", "parts", "kept_returns", "kept_path")))


def unified_retrieval(bars: DataFrame, horizon: int = 4, k: int = 25) -> DataFrame:
    """Forecasts of test bars from buckets of equal states of their series, filled with the outcomes known by then.

    A bar's own bucket counts in full. Of the others those of likeness 0.34 or more (0.55 equal parts of the state, 0.20 returns,
    0.25 path) count, the best k by likeness, then size, then age, each with its likeness times its size over 20, at most 1. Counts are
    smoothed by one a class; the level of evidence follows from the number of outcomes in all buckets used.
    """
    at = ["series_id", "idx"]
    rows = shared.cut(states(bars), "states")
    known = outcomes.outcomes(bars, (horizon,)).select(*at, "price_direction")
    q = learning.tests_of(bars, rows).select(*at, c("parts").alias("q_parts"), c("returns").alias("q_returns"), c("path").alias("q_path"), c("bucket").alias("q_bucket"))
    h = rows.join(known.filter("price_direction is not null"), at).select("series_id", c("idx").alias("h_idx"), "parts", c("kept_returns").alias("returns"), c("kept_path").alias("path"), "bucket", "price_direction")
    pairs = q.join(h, "series_id").filter(c("h_idx") + horizon <= c("idx"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    equal = total(F.zip_with("parts", "q_parts", lambda a, b: (a == b).cast("double"))) / len(PARTS)
    near = total(F.zip_with("returns", "q_returns", lambda a, b: 1 / (1 + 25 * F.abs(a - b)))) / len(RETURNS)
    apart = lambda a, b: (F.abs(a[0] - b["change"]) + F.abs(a[1] - b["range"]) + F.abs(a[2] - b["direction"]) + F.abs(a[3] - b["body"])) / 4
    path = total(F.zip_with("path", "q_path", lambda a, b: 1 / (1 + apart(a, b)))) / 12
    own = c("bucket") == c("q_bucket")
    pairs = pairs.withColumn("score", F.when(own, 1.0).otherwise(F.round(0.55 * equal + 0.20 * near + 0.25 * path, 9))).filter("score >= 0.34")
    kinds = ("bullish", "bearish", "neutral")
    buckets = pairs.groupBy(*at, "bucket", own.alias("own"), "score").agg(F.count("*").alias("count"), *(F.count_if(c("price_direction") == d).alias(d) for d in kinds))
    order = Window.partitionBy(*at, "own").orderBy(F.desc("score"), F.desc("count"), "bucket")
    used = buckets.withColumn("rank", F.row_number().over(order)).filter(c("own") | (c("rank") <= k))
    weight = F.when(c("own"), 1.0).otherwise(c("score") * F.least(F.lit(1.0), c("count") / 20))
    votes = used.groupBy(*at).agg(F.count_if(~c("own")).alias("n"), F.sum("count").alias("evidence"), F.max(F.when(~c("own"), c("score"))).alias("best"), *(F.sum(c(d) * weight).alias(d) for d in kinds))
    votes = q.select(*at).join(votes, at, "left").na.fill(0, ["n", "evidence"]).na.fill(0.0, list(kinds))
    whole = c("bullish") + c("bearish") + c("neutral")
    p = {d: (c(d) + 1) / (whole + 3) for d in kinds}
    votes = votes.withColumns({f"p_{d}": x for d, x in p.items()})
    most = F.greatest(*(c(f"p_{d}") for d in kinds))
    return votes.withColumns({
        "level": case((whole <= 0, "NONE"), (c("evidence") < 20, "WEAK"), (c("evidence") < 100, "MODERATE"), otherwise="STRONG"),
        "favored": case((c("p_bullish") == most, "bullish"), (c("p_bearish") == most, "bearish"), otherwise="neutral"),
    })
