"""Settings of the retrieval chosen on an inner, later part of each training range, and the test forecasts they give."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shared
from tidemark.functions.columns import EPS, case
from tidemark.operators import fusion, learning, outcomes

c = F.col
DIRECTIONS = learning.DIRECTIONS
ASKED = ["series_id", "horizon", "idx"]
RANGE = ["series_id", "window_no", "horizon"]
FIT, SELECT = 0.55, 0.80
LEAST_FIT, LEAST_SELECT, LEAST_CALIBRATION, LEAST_MATCHES, FLOOR, CLASH_FLOOR = 50, 30, 30, 5, 0.42, 0.60
BLOCK = 64  # bars whose queries meet the history in one task
#: The grid and the weights of its policies (fixed values); None stands for no decay, and for the weights of the horizon.
KS, HALFLIVES, REGIMES = (8, 16, 24), (None, 100.0), {"none": 1.0, "soft": 0.35}
POLICIES = {
    "balanced": None, "structure_first": fusion.STRUCTURE_FIRST,
    "context_first": {"structure": 0.15, "sequence": 0.10, "regime": 0.25, "location": 0.12, "momentum": 0.10, "volatility": 0.09, "candle": 0.07, "path": 0.12},
}
SHRINKS, TEMPERATURES = (0.0, 0.15, 0.25, 0.35, 0.50), (0.80, 1.0, 1.20, 1.50)
SETTINGS = list(product(HALFLIVES, REGIMES, POLICIES))
CONFIGS = [(k, *setting) for k in KS for setting in SETTINGS]
DEFAULT, DEFAULT_SHRINK, DEFAULT_TEMPERATURE = CONFIGS.index((16, 100.0, "soft", "balanced")), 0.35, 1.0


def inner_splits(bars: DataFrame) -> DataFrame:
    """Where the fit, select and calibrate parts of each training range end. Only outcomes known before the test range lie inside."""
    w = learning.windows(bars).withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in outcomes.HORIZONS))))
    w = w.withColumn("usable", c("oos_start") - c("horizon")).filter("usable > 0")
    return w.select(*RANGE, "oos_start", "oos_end", "usable", *(F.floor(F.lit(share) * c("usable")).alias(name) for name, share in (("fit_end", FIT), ("select_end", SELECT))))


def _wide_enough() -> Column:
    parts = c("usable") - c("select_end"), c("select_end") - c("fit_end"), c("fit_end")
    return (c("usable") >= 3 * LEAST_SELECT) & (parts[2] >= LEAST_FIT) & (parts[1] >= LEAST_SELECT) & (parts[0] >= LEAST_CALIBRATION)


def members(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by the part of each window's ranges that they fall in: fit, select, calibrate, test."""
    m = rows.select(*ASKED, "direction").join(inner_splits(bars), ["series_id", "horizon"])
    part = case((c("idx") < c("fit_end"), "fit"), (c("idx") < c("select_end"), "select"), (c("idx") < c("usable"), "calibrate"), ((c("idx") >= c("oos_start")) & (c("idx") < c("oos_end")), "test"))
    m = m.withColumn("part", part).filter(c("part").isNotNull() & (c("direction").isNotNull() | (c("part") == "test")))
    return m.select(*RANGE, "idx", "direction", "part", _wide_enough().alias("wide"))


def fenced_baseline(rows: DataFrame) -> DataFrame:
    """Class shares of rows at least KEEP_GAP bars back, alike in regime, event and sequence, else in regime, else all."""
    levels = {"exact": ("regime", "event", "sequence"), "regime": ("regime",), "all": ()}
    for name, keys in levels.items():
        past = Window.partitionBy("series_id", "horizon", *keys).orderBy("idx").rangeBetween(Window.unboundedPreceding, -learning.KEEP_GAP)
        rows = rows.withColumns({f"{name}_{d}": F.count_if(c("direction") == d).over(past) for d in DIRECTIONS})
    number = lambda name: sum((c(f"{name}_{d}") for d in DIRECTIONS[1:]), c(f"{name}_{DIRECTIONS[0]}"))
    pick = lambda f: case((number("exact") >= learning.LEAST_MATCHES, f("exact")), (number("regime") >= learning.LEAST_MATCHES, f("regime")), otherwise=f("all"))
    return rows.select(*ASKED, *(F.when(pick(number) > 0, pick(lambda name, d=d: c(f"{name}_{d}")) / pick(number)).otherwise(1 / 3).alias(f"base_{d}") for d in DIRECTIONS))


def _weighed(policy: str, path: Column) -> Column:
    """The policy's similarity. Weights of each policy add up to one."""
    w = POLICIES[policy]
    if w is None:
        weight = lambda n: case(*((c("horizon") == h, F.lit(x[n])) for h, x in learning.WEIGHTS.items()))
    else:
        weight = lambda n: F.lit(w[n])
    return sum((weight(n) * c(n) for n in learning.COMPONENTS[:-1]), weight("path") * path) * c("quality")


def ranked_matches(bars: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(series_id, horizon, idx, setting, rank, score, direction): best match of each episode for each of the twelve settings, the first 24.

    Components of a pair are worked out once, whatever the settings and windows that use it. Pairs that no policy
    could let in even with equal paths are left out before paths are joined; each episode's best match is found by
    partial aggregation, twelve maxima at once, so that pairs are not multiplied by settings. Queries are dealt in blocks of
    neighbouring bars and history is copied to the blocks after it, so that a long series is many tasks; pairs are not shuffled.
    """
    rows = rows.withColumn("body_ratio", c("body") / c("unit")).withColumn("range_ratio", c("range") / c("unit")).join(learning.paths_of(bars), ["series_id", "idx"])
    compared = (*learning.COMPARED, "path")
    q = rows.join(asked, ASKED, "left_semi").select(*ASKED, F.floor(c("idx") / BLOCK).alias("block"), *(c(n).alias(f"q_{n}") for n in compared))
    last = asked.groupBy("series_id", "horizon").agg(F.floor(F.max("idx") / BLOCK).alias("last"))
    h = rows.filter("direction is not null").select("series_id", "horizon", c("idx").alias("h_idx"), "episode", "direction", *(c(n).alias(f"h_{n}") for n in compared)).join(last, ["series_id", "horizon"])
    first = F.floor((c("h_idx") + learning.KEEP_GAP) / BLOCK)
    h = h.withColumn("block", F.explode(F.when(first <= c("last"), F.sequence(first, c("last"))))).drop("last")
    session = bars.sparkSession
    keys, tasks = ["series_id", "horizon", "block"], max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    pairs = q.repartition(tasks, *keys).join(h.repartition(tasks, *keys), keys).filter(c("h_idx") <= c("idx") - learning.KEEP_GAP)
    pairs = learning.components(pairs).withColumn("quality", learning.quality())
    pairs = pairs.filter(F.greatest(*(_weighed(p, F.lit(1.0)) for p in POLICIES)) >= FLOOR - 1e-9)
    pairs = learning.path_likeness(pairs).withColumns({f"like_{p}": F.round(_weighed(p, c("path")), 9) for p in POLICIES})
    best = []
    for number, (halflife, regime, policy) in enumerate(SETTINGS):
        age = F.lit(1.0) if halflife is None else F.exp(-np.log(2.0) * (c("idx") - c("h_idx")) / halflife)
        base = c(f"like_{policy}")
        score = F.round(base * F.when(c("regime") == 1, 1.0).otherwise(REGIMES[regime]) * (0.70 + 0.30 * age), 9)
        able = (base >= FLOOR) & (~learning.clash() | (score >= CLASH_FLOOR))
        best.append(F.max(F.when(able, F.struct(score.alias("score"), base.alias("base"), (-c("h_idx")).alias("back"), "direction"))).alias(f"best_{number}"))
    episodes = pairs.groupBy(*ASKED, "episode").agg(*best)
    found = F.array(*(F.struct(F.lit(n).alias("setting"), c(f"best_{n}").alias("m")) for n in range(len(SETTINGS))))
    every = episodes.select(*ASKED, F.explode(F.filter(found, lambda x: x["m"].isNotNull())).alias("s")).select(*ASKED, "s.setting", "s.m")
    rank = F.row_number().over(Window.partitionBy(*ASKED, "setting").orderBy(F.desc("m")))
    return every.withColumn("rank", rank).filter(c("rank") <= max(KS)).select(*ASKED, "setting", "rank", "m.score", "m.direction")


def setting_shares(ranked: DataFrame) -> DataFrame:
    """Forecast of every query under every configuration that finds a match: fourth powers over roots of ranks, shrunk to thirds by the mix of classes."""
    rows = ranked.withColumn("k", F.explode(F.filter(F.array(*(F.lit(k) for k in range(len(KS)))), lambda k: F.element_at(F.array(*(F.lit(x) for x in KS)), k + 1) >= c("rank"))))
    weight = F.greatest(F.lit(0.01), F.pow("score", F.lit(4.0))) / F.sqrt("rank")
    is_d = lambda d: c("direction") == d
    e = rows.groupBy(*ASKED, (c("k") * len(SETTINGS) + c("setting")).alias("config")).agg(
        F.count("*").alias("n"), *(F.count_if(is_d(d)).alias(f"n_{d}") for d in DIRECTIONS), *(F.sum(F.when(is_d(d), weight).otherwise(0.0)).alias(f"s_{d}") for d in DIRECTIONS)
    )
    part = lambda d: F.when(c(f"n_{d}") > 0, c(f"n_{d}") / c("n") * F.log(c(f"n_{d}") / c("n"))).otherwise(0.0)
    one_sided = F.least(F.greatest(1 + (part("UP") + part("DOWN") + part("NEUTRAL")) / np.log(3.0), F.lit(0.0)), F.lit(1.0))
    strength = F.when(c("n") >= LEAST_MATCHES, 0.15 + 0.85 * one_sided).otherwise(0.0)
    whole = c("s_UP") + c("s_DOWN") + c("s_NEUTRAL")
    return e.select(*ASKED, "config", *((1 / 3 + strength * (c(f"s_{d}") / whole - 1 / 3)).alias(f"p_{d}") for d in DIRECTIONS))


def _said(prefix: str) -> Column:
    """The class of the greatest share; ties go to the greater name."""
    return F.array_max(F.array(*(F.struct(F.round(f"{prefix}_{d}", 9).alias("p"), F.lit(d).alias("d")) for d in DIRECTIONS)))["d"]


def _of_actual(prefix: str) -> Column:
    return case(*((c("direction") == d, c(f"{prefix}_{d}")) for d in DIRECTIONS))


def _brier(prefix: str) -> Column:
    terms = [(c(f"{prefix}_{d}") - (c("direction") == d).cast("double")) ** 2 for d in DIRECTIONS]
    return terms[0] + terms[1] + terms[2]


def _log_loss(prefix: str) -> Column:
    return -F.log(F.greatest(F.lit(EPS), F.least(F.lit(1.0), _of_actual(prefix))))


def _prepared(bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, causal baselines and every query's forecast under every configuration (thirds where nothing is found)."""
    rows = learning.experience(bars)
    parts = shared.cut(members(bars, rows), "grid-parts")
    asked = parts.filter("part <> 'fit'").select(*ASKED).distinct()
    shares = setting_shares(shared.cut(ranked_matches(bars, rows, asked), "grid-ranked"))
    each = asked.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(CONFIGS) - 1))))
    forecasts = each.join(shares, [*ASKED, "config"], "left").select(*ASKED, "config", *(F.coalesce(f"p_{d}", F.lit(1 / 3)).alias(f"p_{d}") for d in DIRECTIONS))
    return parts, fenced_baseline(rows), forecasts


def _graded(parts: DataFrame, baseline: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Lifts over the baseline of each window's select part by configuration, and which one is chosen: by score, Brier, log loss, then place in the grid."""
    fitted = parts.filter("wide and part = 'fit'").groupBy(*RANGE).agg(F.count("*").alias("n_fit")).filter(c("n_fit") >= LEAST_FIT)
    rows = parts.filter("wide and part = 'select'").join(baseline, ASKED).join(forecasts, ASKED)
    hit = lambda prefix: (_said(prefix) == c("direction")).cast("int")
    g = rows.groupBy(*RANGE, "config").agg(
        F.count("*").alias("n"), F.avg(hit("p") - hit("base")).alias("accuracy_lift"), F.avg(_brier("base") - _brier("p")).alias("brier_lift"), F.avg(_log_loss("base") - _log_loss("p")).alias("log_loss_lift")
    )
    g = g.filter(c("n") >= LEAST_SELECT).join(fitted, RANGE).withColumn("score", 0.50 * c("brier_lift") + 0.40 * c("log_loss_lift") + 0.10 * c("accuracy_lift"))
    order = Window.partitionBy(*RANGE).orderBy(*(F.desc(F.round(n, 9)) for n in ("score", "brier_lift", "log_loss_lift")), "config")
    return g.withColumn("place", F.row_number().over(order)).withColumn("chosen", (c("place") == 1).cast("int"))


def config_grid(bars: DataFrame) -> DataFrame:
    """All 36 configurations on each window's select part. Windows too short for three parts have no rows; ``tuned_retrieval`` gives them the default.

    No row after a window's training range takes part, and no query sees an outcome less than KEEP_GAP bars back.
    """
    g = _graded(*_prepared(bars))
    names = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(h or 0.0).alias("halflife"), F.lit(r).alias("regimes"), F.lit(p).alias("policy")) for k, h, r, p in CONFIGS))
    return g.withColumn("of", F.element_at(names, c("config") + 1)).select(*RANGE, "config", "of.*", "n_fit", "n", "accuracy_lift", "brier_lift", "log_loss_lift", "score", "chosen")


def _calibrated(shrink: Column, temperature: Column) -> dict[str, Column]:
    """Shares sharpened by a temperature and drawn to thirds."""
    powers = {d: F.pow(F.greatest(F.lit(EPS), c(f"p_{d}")), 1 / temperature) for d in DIRECTIONS}
    whole = powers["UP"] + powers["DOWN"] + powers["NEUTRAL"]
    return {d: shrink / 3 + (1 - shrink) * powers[d] / whole for d in DIRECTIONS}


def tuned_retrieval(bars: DataFrame) -> DataFrame:
    """Test rows under their window's chosen configuration, calibrated on the last fifth of its training range.

    Calibration takes the least mean log loss (ties: smaller shrinkage, then smaller temperature). Windows too short for
    three parts, or with fewer than 30 rows to calibrate on, keep the default of that step.
    """
    parts, baseline, forecasts = _prepared(bars)
    chosen = _graded(parts, baseline, forecasts).filter("chosen = 1").select(*RANGE, "config")
    mine = parts.filter("part in ('calibrate', 'test')").join(chosen, RANGE, "left").withColumn("selected", c("config").isNotNull().cast("int")).fillna({"config": DEFAULT})
    mine = shared.cut(mine.join(forecasts, [*ASKED, "config"]), "grid-chosen")
    grid = F.array(*(F.struct(F.lit(s).alias("shrink"), F.lit(t).alias("temperature")) for s, t in product(SHRINKS, TEMPERATURES)))
    tried = mine.filter("part = 'calibrate'").withColumn("g", F.explode(grid))
    q = _calibrated(c("g.shrink"), c("g.temperature"))
    loss = -F.log(F.greatest(F.lit(EPS), case(*((c("direction") == d, q[d]) for d in DIRECTIONS))))
    losses = tried.groupBy(*RANGE, "g").agg(F.count("*").alias("n"), F.avg(loss).alias("loss")).filter(c("n") >= LEAST_CALIBRATION)
    best = losses.groupBy(*RANGE).agg(F.min_by("g", F.struct(F.round("loss", 9), "g")).alias("g")).select(*RANGE, "g.*")
    out = mine.filter("part = 'test'").join(best, RANGE, "left").fillna({"shrink": DEFAULT_SHRINK, "temperature": DEFAULT_TEMPERATURE})
    q = _calibrated(c("shrink"), c("temperature"))
    return out.select(*RANGE, "idx", "direction", "selected", "config", "shrink", "temperature", *(q[d].alias(f"p_{d.lower()}") for d in DIRECTIONS))
