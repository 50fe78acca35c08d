"""Is there skill: entropy and distance of forecasts, lifts over a baseline, discrimination of retrieval, permutations, bootstrap, sign test, correlations.

Random choices are ranks by MD5 of the replicate's number and the row's key, so that every engine draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import draws, ranks, shared
from tidemark.functions.columns import EPS, case
from tidemark.operators import evaluation, learning

c = F.col
CLASSES = ("up", "down", "neutral")


def entropy(p: dict[str, Column]) -> Column:
    """Entropy of three shares over that of even ones."""
    return -sum((F.when(x > EPS, x * F.log(x)).otherwise(0.0) for x in list(p.values())[1:]), F.when(p["up"] > EPS, p["up"] * F.log(p["up"])).otherwise(0.0)) / F.log(F.lit(3.0))


def pairs_of_forecasts(bars: DataFrame) -> DataFrame:
    """Retrieval's decision shares beside the conditional baseline's, for test rows with an outcome, with Brier score, log loss and hit of both; written once."""
    ret = evaluation.scored(learning.decisions(bars).withColumnRenamed("prediction", "decision"), "actual")
    base = evaluation.scored(learning.conditional_baseline(bars), "direction")
    keys = learning.QUERY
    names = [*(f"p_{k}" for k in CLASSES), "brier", "log_loss", "hit", "said"]
    one = ret.select(*keys, "actual", *(c(n).alias(f"r_{n}") for n in names))
    return shared.cut(one.join(base.select(*keys, *(c(n).alias(f"b_{n}") for n in names)), keys), "forecast-pairs")


def forecast_shapes(bars: DataFrame) -> DataFrame:
    """By horizon: mean entropy of both forecasts, their total variation and Jensen-Shannon divergence (base 2)."""
    rows = pairs_of_forecasts(bars)
    r, b = ({k: c(f"{s}_p_{k}") for k in CLASSES} for s in "rb")
    tv = sum((F.abs(r[k] - b[k]) for k in CLASSES[1:]), F.abs(r["up"] - b["up"])) / 2

    def kl(p: dict[str, Column], q: dict[str, Column]) -> Column:
        part = lambda k: F.when(p[k] > EPS, p[k] * F.log(p[k] / ((p[k] + q[k]) / 2))).otherwise(0.0)
        return part("up") + part("down") + part("neutral")

    js = (kl(r, b) + kl(b, r)) / 2 / F.log(F.lit(2.0))
    return rows.groupBy("horizon").agg(F.count("*").alias("n"), F.avg(entropy(r)).alias("retrieval_entropy"), F.avg(entropy(b)).alias("baseline_entropy"), F.avg(tv).alias("total_variation"), F.avg(js).alias("divergence"))


def incremental_value(bars: DataFrame) -> DataFrame:
    """By horizon: mean lifts of retrieval over the baseline in Brier score, log loss and accuracy, shares of rows with a lift, flags."""
    rows = pairs_of_forecasts(bars).withColumns({"brier": c("b_brier") - c("r_brier"), "loss": c("b_log_loss") - c("r_log_loss"), "hits": c("r_hit") - c("b_hit")})
    out = rows.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("brier").alias("brier_lift"), F.avg("loss").alias("log_loss_lift"), F.avg("hits").alias("accuracy_lift"), F.avg((c("brier") > EPS).cast("double")).alias("share_better"))
    return out.withColumn("improves", F.concat_ws(",", F.when(c("brier_lift") > EPS, F.lit("brier")), F.when(c("log_loss_lift") > EPS, F.lit("log_loss")), F.when(c("accuracy_lift") > EPS, F.lit("accuracy"))))


def discrimination(bars: DataFrame) -> DataFrame:
    """By horizon: similarity of each query's best tenth of its matches (one at least) against the rest, agreement of their outcomes with the query's, evidence mass."""
    m = learning.matches(bars)
    query = Window.partitionBy(*learning.QUERY)
    m = m.withColumns({"rank": F.row_number().over(query.orderBy(F.desc("similarity"), F.desc("h_idx"))), "n": F.count("*").over(query)})
    m = m.withColumn("top", c("rank") <= F.greatest(F.lit(1), F.floor(c("n") / 10)))
    agree = (c("direction") == c("actual")).cast("double")
    mean = lambda x, cond: F.avg(F.when(cond, x))
    each = m.groupBy(*learning.QUERY, "n").agg(
        mean(c("similarity"), c("top")).alias("top_similarity"), mean(c("similarity"), ~c("top")).alias("rest_similarity"), (F.sum(F.when(c("top"), c("similarity")).otherwise(0.0)) / F.sum("similarity")).alias("mass"),
        mean(agree, c("top")).alias("top_agree"), mean(agree, ~c("top")).alias("rest_agree"),
    )
    gap = c("top_similarity") - c("rest_similarity")
    return each.groupBy("horizon").agg(
        F.count("*").alias("n_queries"), F.avg("n").alias("mean_matches"), F.avg(gap).alias("separation"), F.avg((gap > 0.05).cast("double")).alias("share_separated"), F.avg("mass").alias("mean_mass"), F.avg("top_agree").alias("top_agree"), F.avg("rest_agree").alias("rest_agree"),
    )


def tertile_agreement(bars: DataFrame) -> DataFrame:
    """Agreement of matches' outcomes with the query's in the best, middle and worst third of its matches, by horizon."""
    query = Window.partitionBy(*learning.QUERY)
    m = learning.matches(bars).filter("actual is not null").withColumns({"rank": F.row_number().over(query.orderBy(F.desc("similarity"), F.desc("h_idx"))), "n": F.count("*").over(query)})
    third = F.floor((3 * c("rank") - 1) / c("n")).cast("int")
    return m.filter("n >= 3").groupBy("horizon", third.alias("third")).agg(F.count("*").alias("n"), F.avg("similarity").alias("mean_similarity"), F.avg((c("direction") == c("actual")).cast("double")).alias("agreement"))


def _draw(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(c(p).cast("string") if isinstance(p, str) else p for p in parts)))


def accuracy_permutation(bars: DataFrame, permutations: int = 250) -> DataFrame:
    """Does retrieval hit more often than the baseline by chance: outcomes are dealt anew ``permutations`` times within the horizon; add-one p."""
    rows = pairs_of_forecasts(bars).select("horizon", "series_id", "window_no", "idx", "actual", "r_said", "b_said")
    rows = shared.cut(ranks.ranked(rows, ["horizon"], ["series_id", "window_no", "idx"], "place"), "places")
    many = rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    dealt = ranks.dealt_anew(many, ["horizon", "perm"], "place", "actual", _draw("perm", "series_id", "window_no", "idx"))
    diff = (c("actual") == c("r_said")).cast("int") - (c("actual") == c("b_said")).cast("int")
    null = many.select("horizon", "perm", "place", "r_said", "b_said").join(dealt, ["horizon", "perm", "place"]).groupBy("horizon", "perm").agg(F.sum(diff).alias("gain"))
    real = rows.groupBy("horizon").agg(F.sum(diff).alias("real"), F.count("*").alias("n"))
    out = null.join(F.broadcast(real), "horizon").groupBy("horizon", "n", "real").agg(F.avg("gain").alias("null_gain"), F.stddev_pop("gain").alias("null_deviation"), F.count_if(c("gain") >= c("real")).alias("n_reaching"))
    return out.withColumns({"difference": c("real") / c("n"), "null_mean": c("null_gain") / c("n"), "null_std": c("null_deviation") / c("n"), "p_value": (c("n_reaching") + 1) / (permutations + 1.0)})


def bootstrap_lift(bars: DataFrame, replicates: int = 500) -> DataFrame:
    """Mean Brier lift of retrieval over the baseline with a 95 % interval: each replicate draws as many rows as there are, with repeats."""
    rows = pairs_of_forecasts(bars).select("horizon", "series_id", "window_no", "idx", F.round(c("b_brier") - c("r_brier"), 9).alias("lift"))
    rows = shared.cut(ranks.ranked(rows, ["horizon"], ["series_id", "window_no", "idx"], "place").select("horizon", "lift", c("place").cast("int").alias("place")), "places")
    sizes = rows.groupBy("horizon").agg(F.count("*").alias("n"))
    draws = sizes.select("horizon", "n", F.explode(F.sequence(F.lit(1), c("n"))).alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    number = F.conv(F.substring(_draw("rep", "k", "horizon"), 1, 12), 16, 10).cast("long")
    drawn = draws.select("horizon", "rep", (number % c("n") + 1).cast("int").alias("place")).join(rows, ["horizon", "place"])
    means = drawn.groupBy("horizon", "rep").agg(F.avg("lift").alias("m"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("horizon").orderBy("m", "rep")))
    at = lambda q: F.max(F.when(c("rank") == int(q * (replicates - 1)) + 1, c("m")))
    return ranked.groupBy("horizon").agg(F.avg("m").alias("mean_lift"), at(0.025).alias("low"), at(0.975).alias("high"))


def sign_test(bars: DataFrame, flips: int = 500) -> DataFrame:
    """Paired test of the mean Brier lift: the sign of each row's lift is drawn ``flips`` times; two-sided, add-one p."""
    rows = pairs_of_forecasts(bars).select("horizon", "series_id", "window_no", "idx", F.round(c("b_brier") - c("r_brier"), 9).alias("lift"))
    signs = rows.withColumn("flip", F.explode(F.sequence(F.lit(1), F.lit(flips))))
    up = F.conv(F.substring(_draw("flip", "series_id", "window_no", "idx", "horizon"), 1, 1), 16, 10).cast("int") < 8
    null = signs.groupBy("horizon", "flip").agg(F.sum(F.when(up, c("lift")).otherwise(-c("lift"))).alias("total"))
    real = rows.groupBy("horizon").agg(F.sum("lift").alias("real"), F.count("*").alias("n"), F.count_if(c("lift") > 0).alias("n_better"), F.count_if(c("lift") < 0).alias("n_worse"))
    out = null.join(F.broadcast(real), "horizon").groupBy("horizon", "n", "n_better", "n_worse", "real").agg(F.count_if(F.abs("total") >= F.abs("real") - 1e-7).alias("n_reaching"))
    return out.withColumns({"mean_lift": c("real") / c("n"), "p_value": (c("n_reaching") + 1) / (flips + 1.0)})


def _sources(permutations: int):
    """Of each query the records whose outcomes its matches get in each shuffle of all its eligible records, a row for each match and shuffle."""

    def trace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                seeds = 1009 * np.arange(1, permutations + 1) + row.idx
                source = draws.shuffle_sources(row.m, seeds, np.asarray(row.places))
                k = len(row.places)
                key = {n: np.repeat(getattr(row, n), permutations * k) for n in learning.QUERY}
                yield pd.DataFrame({**key, "perm": np.repeat(np.arange(permutations), k), "place": source.ravel(), "similarity": np.tile(row.similarities, permutations)})

    return trace


def retrieval_null(bars: DataFrame, permutations: int = 25, least: int = 6) -> DataFrame:
    """Is the greatest class share of the chosen matches more than chance: outcomes are shuffled among all earlier records the query may use.

    Similarity does not see outcomes, so the chosen matches (one an episode, then by likeness less redundancy) stay, and only the
    record that brings each of them its outcome is traced, shuffle by shuffle. A query without matches has shares of 0.
    """
    rows = learning.experience(bars)
    by = ["series_id", "horizon"]
    order = Window.partitionBy(*by).orderBy("idx")
    known = rows.filter("direction is not null").select(*by, c("idx").alias("h_idx"), "direction", (F.row_number().over(order) - 1).alias("place"))
    so_far = rows.select(*by, c("idx").alias("limit"), F.count("direction").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    queries = learning.tests_of(bars, rows).withColumn("limit", F.least(c("idx") - learning.KEEP_GAP, c("oos_start") - c("horizon") - 1)).select(*learning.QUERY, "limit")
    queries = queries.join(so_far, [*by, "limit"]).filter(c("m") >= least).drop("limit")
    chosen = learning.top_matches(bars).select(*learning.QUERY, "h_idx", "similarity").join(known, [*by, "h_idx"])
    total = F.sum("similarity")
    share = F.greatest(*(F.sum(F.when(c("direction") == k.upper(), c("similarity")).otherwise(0.0)) / total for k in CLASSES))
    held = chosen.groupBy(*learning.QUERY).agg(share.alias("real"), F.sort_array(F.collect_list(F.struct("place", "similarity"))).alias("held"))
    rows = shared.cut(queries.join(held, learning.QUERY, "left"), "null-queries")
    asked = rows.filter("held is not null").select(*learning.QUERY, "m", c("held.place").alias("places"), c("held.similarity").alias("similarities"))
    schema = "series_id string, window_no int, horizon int, idx long, perm int, place int, similarity double"
    dealt = asked.repartition(*learning.QUERY).mapInPandas(_sources(permutations), schema).join(known.select(*by, "place", "direction"), [*by, "place"])
    null = dealt.groupBy(*learning.QUERY, "perm").agg(share.alias("share"))
    ranked = null.withColumn("rank", F.row_number().over(Window.partitionBy(*learning.QUERY).orderBy("share", "perm")))
    at = int(0.95 * (permutations - 1)) + 1
    each = ranked.groupBy(*learning.QUERY).agg(F.avg("share").alias("null_mean"), F.max(F.when(c("rank") == at, c("share"))).alias("null_p95"))
    each = rows.select(*learning.QUERY, "real").join(each, learning.QUERY, "left").na.fill(0.0, ["real", "null_mean", "null_p95"])
    return each.groupBy("horizon").agg(F.count("*").alias("n_queries"), F.avg("real").alias("real_share"), F.avg("null_mean").alias("null_share"), F.avg("null_p95").alias("null_p95"), F.avg(c("real") - c("null_mean")).alias("lift"), F.avg((F.round("real", 9) > F.round("null_p95", 9)).cast("double")).alias("share_beyond"))


def label_permutation(bars: DataFrame, permutations: int = 100) -> DataFrame:
    """Do given rules hit test rows more often than by chance: outcomes of the test rows that they decide are dealt anew within the horizon, the rules stay (discovery.label_null mines anew); add-one p."""
    rows = shared.cut(learning.rule_predictions(bars).filter("direction is not null").select("horizon", "series_id", "window_no", "idx", "direction", "says"), "rule-tests")
    rows = shared.cut(ranks.ranked(rows, ["horizon"], ["series_id", "window_no", "idx"], "place"), "places")
    many = rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    dealt = ranks.dealt_anew(many, ["horizon", "perm"], "place", "direction", _draw("perm", "series_id", "window_no", "idx"))
    null = many.select("horizon", "perm", "place", "says").join(dealt, ["horizon", "perm", "place"]).groupBy("horizon", "perm").agg(F.count_if(c("says") == c("direction")).alias("hits"))
    real = rows.groupBy("horizon").agg(F.count_if(c("says") == c("direction")).alias("real"), F.count("*").alias("n"))
    out = null.join(F.broadcast(real), "horizon").groupBy("horizon", "n", "real").agg(F.avg("hits").alias("null_hits"), F.count_if(c("hits") >= c("real")).alias("n_reaching"))
    return out.withColumns({"accuracy": c("real") / c("n"), "null_accuracy": c("null_hits") / c("n"), "p_value": (c("n_reaching") + 1) / (permutations + 1.0)})


def correlations(bars: DataFrame) -> DataFrame:
    """Pearson correlation of four features with the outcome's return in ATR, and the mean return of their top quarter less that of the bottom one."""
    rows = learning.experience(bars).filter("direction is not null")
    names = ("r1", "r3", "r8", "volatility_ratio")
    long = rows.select("horizon", "series_id", "idx", F.round("atr_return", 9).alias("y"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.round(n, 9).alias("x")) for n in names))).alias("f")).select("horizon", "series_id", "idx", "y", "f.*")
    long = ranks.ranked(long, ["horizon", "feature"], ["x", "series_id", "idx"], "rank", "n")
    quarter = F.floor(c("n") / 4)
    return long.groupBy("horizon", "feature").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), (F.avg(F.when(c("rank") > c("n") - quarter, c("y"))) - F.avg(F.when(c("rank") <= quarter, c("y")))).alias("lift"))


def stability(bars: DataFrame) -> DataFrame:
    """Accuracy of the baseline over windows: mean, spread, extremes, windows above the majority share, and a composite of accuracy, coverage, steadiness and lift."""
    s = evaluation.scored(learning.conditional_baseline(bars), "direction")
    counts = [F.count_if(c("direction") == k.upper()) for k in CLASSES]
    w = s.groupBy("horizon", "window_no").agg(F.avg("hit").alias("accuracy"), (F.greatest(*counts) / F.count("*")).alias("majority"), F.avg((c("level") != "GLOBAL").cast("double")).alias("coverage"))
    out = w.groupBy("horizon").agg(
        F.count("*").alias("n_windows"), F.avg("accuracy").alias("mean_accuracy"), F.percentile("accuracy", 0.5).alias("median_accuracy"), F.stddev_samp("accuracy").alias("deviation"), F.min("accuracy").alias("worst"), F.max("accuracy").alias("best"),
        F.count_if(c("accuracy") > c("majority")).alias("n_above"), F.avg("coverage").alias("coverage"), F.avg(c("accuracy") - c("majority")).alias("lift"),
    )
    steady = 1 - F.least(F.lit(1.0), F.coalesce((c("best") - c("worst")) / F.nullif("mean_accuracy", F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("composite", 100 * (0.35 * c("mean_accuracy") + 0.25 * c("coverage") + 0.20 * steady + 0.20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + c("lift")))))


def calibration_grid(bars: DataFrame, shrinks: tuple[float, ...] = (0.0, 0.15, 0.35, 0.55, 0.75), temperatures: tuple[float, ...] = (0.75, 1.0, 1.5, 2.0)) -> DataFrame:
    """Shares of the baseline sharpened or flattened by a temperature and shrunk towards thirds: log loss on the earlier windows chooses, the last window tests."""
    s = evaluation.scored(learning.conditional_baseline(bars), "direction").select("horizon", "window_no", "direction", *(f"p_{k}" for k in CLASSES))
    grid = s.withColumn("shrink", F.explode(F.array(*(F.lit(x) for x in shrinks)))).withColumn("temperature", F.explode(F.array(*(F.lit(x) for x in temperatures))))
    raised = {k: F.exp(F.log(F.greatest(f"p_{k}", F.lit(1e-12))) / c("temperature")) for k in CLASSES}
    total = raised["up"] + raised["down"] + raised["neutral"]
    own = case((c("direction") == "UP", raised["up"]), (c("direction") == "DOWN", raised["down"]), otherwise=raised["neutral"])
    loss = -F.log(F.greatest(c("shrink") / 3 + (1 - c("shrink")) * own / total, F.lit(1e-12)))
    means = grid.groupBy("horizon", "shrink", "temperature").agg(F.avg(F.when(c("window_no") < 4, loss)).alias("fit_loss"), F.avg(F.when(c("window_no") == 4, loss)).alias("test_loss"))
    best = F.min_by(F.struct("shrink", "temperature", "fit_loss", "test_loss"), F.struct(F.round("fit_loss", 9), "shrink", "temperature"))
    return means.groupBy("horizon").agg(best.alias("b")).select("horizon", "b.*")


def confidence_sweep(bars: DataFrame, levels: tuple[float, ...] = (0.34, 0.4, 0.45, 0.5, 0.55, 0.6)) -> DataFrame:
    """Accuracy and coverage above each level of confidence; the best by accuracy times the root of coverage."""
    s = evaluation.scored(learning.conditional_baseline(bars), "direction").withColumn("confidence", F.round("confidence", 9))
    grid = s.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
    out = grid.groupBy("horizon", "level").agg(F.count_if(c("confidence") >= c("level")).alias("n_kept"), F.count("*").alias("n"), F.sum(F.when(c("confidence") >= c("level"), c("hit")).otherwise(0)).alias("hits"))
    out = out.withColumns({"coverage": c("n_kept") / c("n"), "accuracy": F.when(c("n_kept") > 0, c("hits") / c("n_kept")).otherwise(0.0)}).withColumn("score", c("accuracy") * F.sqrt("coverage"))
    return out.withColumn("chosen", (F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc(F.round("score", 9)), "level")) == 1).cast("int"))


def coverage_summary(bars: DataFrame) -> DataFrame:
    """By horizon and reason: how many queries retrieval decides, abstains on, and hits."""
    d = learning.decisions(bars)
    return d.groupBy("horizon", "reason").agg(F.count("*").alias("n"), F.count_if(c("prediction") == c("actual")).alias("n_hits"), F.avg("margin").alias("mean_margin"))


def similarity_histogram(bars: DataFrame, edges: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Matches by similarity bucket and the share of them that have the query's outcome."""
    m = learning.top_matches(bars).filter("actual is not null")
    bucket = sum(((F.round("similarity", 9) >= e).cast("int") for e in edges[1:]), (F.round("similarity", 9) >= edges[0]).cast("int"))
    return m.groupBy("horizon", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg((c("direction") == c("actual")).cast("double")).alias("agreement"))


def failure_patterns(bars: DataFrame, least: int = 5) -> DataFrame:
    """How often the baseline misses, by trend, regime, momentum and location."""
    s = evaluation.scored(learning.conditional_baseline(bars), "direction").select(*learning.QUERY, "hit")
    rows = s.join(learning.experience(bars).select("series_id", "idx", "horizon", "trend", "regime", "momentum", "location"), ["series_id", "idx", "horizon"])
    out = rows.groupBy("horizon", "trend", "regime", "momentum", "location").agg(F.count("*").alias("n"), F.count_if(c("hit") == 0).alias("n_failed")).filter(c("n") >= least)
    return out.withColumn("rate", c("n_failed") / c("n"))


def temporal_integrity(bars: DataFrame) -> DataFrame:
    """Matches that break the rules of time: the query itself, the future, too near, outcomes that reach into the test window."""
    m = learning.top_matches(bars)
    return m.groupBy("horizon").agg(
        F.count("*").alias("n"), F.count_if(c("h_idx") == c("idx")).alias("n_self"), F.count_if(c("h_idx") > c("idx")).alias("n_future"), F.count_if(c("idx") - c("h_idx") < learning.KEEP_GAP).alias("n_near"), F.count_if(c("h_idx") + c("horizon") >= c("oos_start")).alias("n_crossing"),
    )


def discretised_rules(bars: DataFrame, least: int = 20, confidence: float = 0.5) -> DataFrame:
    """One-condition rules over numbers cut at the training quartiles (q1 and below, q3 and above, between) of each window and horizon."""
    rows = learning.experience(bars)
    train, keys = learning.training_of(bars, rows), ["horizon", "window_no"]
    names = ("r1", "r3", "r8", "r16", "volatility_ratio")
    cuts = train.groupBy(*keys).agg(*(F.percentile(F.round(n, 9), [0.25, 0.75]).alias(f"cut_{n}") for n in names))
    cut = train.join(F.broadcast(cuts), keys)
    state = lambda n: case((F.round(n, 9) <= c(f"cut_{n}")[0], "LOW"), (F.round(n, 9) >= c(f"cut_{n}")[1], "HIGH"), otherwise="MID")
    facts = cut.select(*keys, "direction", F.explode(F.array(*(F.concat_ws("=", F.lit(n), state(n)) for n in names))).alias("rule"))
    counted = learning.state_counts(facts, [*keys, "rule"]).filter(c("n") >= least)
    best = F.greatest("up", "down", "neutral")
    counted = counted.withColumns({"confidence": best / c("n"), "says": case((c("up") == best, "UP"), (c("down") == best, "DOWN"), otherwise="NEUTRAL"), "directional_rate": (c("up") + c("down")) / c("n")})
    return counted.filter(c("confidence") >= confidence).withColumn("score", F.greatest("up", "down") / (c("up") + c("down")) * c("directional_rate"))
