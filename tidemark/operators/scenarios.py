"""Scenarios: scores of eight kinds of evidence, compressed and capped shares, their decay with the horizon, fused layers, and votes of feature groups.

Nothing here is a probability: shares are pulled toward even ones and none exceeds CAP; what is cut off goes to the others
in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import case, over
from tidemark.operators import behaviour, candles, contexts, learning, levels, structure

c = F.col
KINDS = ("bullish", "bearish", "neutral")
AT = ["series_id", "idx"]
#: Weights, pulls and bounds of the scenario scores and of the layers (fixed values).
CAP, PULL, CENTRES = 0.80, 0.70, (0.33, 0.33, 0.34)
UNCERTAINTY = {4: 0.00, 8: 0.08, 16: 0.16}
LAYERS = {"direct": 0.35, "scenario": 0.15, "scales": 0.20, "regime": 0.15, "memory": 0.15}


def evidence(bars: DataFrame, lag: int = 4) -> DataFrame:
    """What the scores are made of, each known at its bar: participation and change of 60 bars, structure, momentum, rejection, scales, regime, memory, experience."""
    window = candles.window_context(bars).select(*AT, "n60", "up60", "down60", "change60", "body_momentum", "rejection")
    scales = contexts.scale_contexts(bars).select(*AT, "integrated", "confidence")
    counters = behaviour.window_counters(bars).select(*AT, "context")
    runs = structure.regime_runs(structure.market_states(bars)).select(*AT, "regime", "stability")
    past = learning.online_walk_forward(bars).select(*AT, "support", *(f"p_{k}" for k in KINDS), "prediction", "actual")
    known, right = c("actual").isNotNull(), c("prediction") == c("actual")
    past = past.withColumns({"resolved": F.coalesce(F.sum(known.cast("long")).over(over(None, -lag)), F.lit(0)), "right": F.coalesce(F.sum((known & right).cast("long")).over(over(None, -lag)), F.lit(0))})
    past = past.select(*AT, "support", *(F.round(c(f"p_{k}") * (c("support") + 3) - 1, 6).alias(f"seen_{k}") for k in KINDS), *(f"p_{k}" for k in KINDS), "resolved", "right")
    out = window.join(scales, AT).join(counters, AT).join(runs, AT).join(past, AT)
    return out.withColumn("regime_side", case((c("regime") == "TRENDING_UP", "BULLISH"), (c("regime") == "TRENDING_DOWN", "BEARISH"), otherwise="NONE"))


def _sum(*parts: Column) -> Column:
    return sum(parts[1:], parts[0])


def scores(bars: DataFrame) -> DataFrame:
    """Evidence with the three scores."""
    e = evidence(bars)
    zero, both = F.lit(0.0), c("up60") + c("down60")
    side = lambda name, up, down, weight: {"bullish": F.when(c(name) == up, weight).otherwise(zero), "bearish": F.when(c(name) == down, weight).otherwise(zero)}
    rises = {"bullish": c("change60") > 0, "bearish": c("change60") < 0}
    says = {"bullish": c("integrated") == "BULLISH", "bearish": c("integrated") == "BEARISH"}
    rejects = {"bullish": c("rejection") == "lower", "bearish": c("rejection") == "upper"}
    took_part = {"bullish": c("up60"), "bearish": c("down60")}
    shape = side("context", "bullish_structure", "bearish_structure", F.lit(2.0))
    scale = side("integrated", "BULLISH", "BEARISH", 1.5 * c("confidence"))
    regime = side("regime_side", "BULLISH", "BEARISH", c("stability"))
    memory = {k: F.when(c("support") > 0, c(f"seen_{k}") / F.greatest(c("support"), F.lit(1)) * F.least(F.lit(2.0), c("support") / 10)).otherwise(zero) for k in KINDS}
    share, weight = c("right") / F.greatest(c("resolved"), F.lit(1)), F.least(F.lit(2.0), c("resolved") / 20)
    trusted = {"bullish": F.when((c("resolved") > 0) & (share > 0.5), weight).otherwise(zero), "bearish": F.when((c("resolved") > 0) & (share < 0.5), weight).otherwise(zero)}
    yes = lambda cond, x: F.when(cond, F.lit(x)).otherwise(zero)
    out = {
        k: _sum(
            3.0 * took_part[k] / F.greatest(both, F.lit(1)), yes(rises[k], 2.0), shape[k], yes(says[k] & (c("body_momentum") == "rising"), 1.5),
            yes(says[k] & rejects[k], 1.5), scale[k], regime[k], memory[k], trusted[k],
        )
        for k in ("bullish", "bearish")
    }
    flat = _sum(yes(c("change60") == 0, 1.0), yes(c("context") == "mixed_structure", 1.0), yes(c("integrated") == "MIXED", 1.0), memory["neutral"])
    return e.withColumns({**{f"score_{k}": x for k, x in out.items()}, "score_neutral": flat})


def capped(df: DataFrame, names: tuple[str, str, str], cap: float = CAP) -> DataFrame:
    """Shares of which none exceeds ``cap``: what the greatest (the first of equal ones) has beyond goes to the others in proportion."""
    a, b, d = (c(n) for n in names)
    most = F.greatest(a, b, d)
    first = {names[0]: a == most, names[1]: (a < most) & (b == most), names[2]: (a < most) & (b < most)}
    excess, others = F.greatest(most - cap, F.lit(0.0)), a + b + d - most
    spread = lambda n: c(n) + F.coalesce(F.try_divide(excess * c(n), others), F.lit(0.0))
    return df.withColumns({n: F.when(first[n], F.least(c(n), F.lit(cap))).otherwise(spread(n)) for n in names})


def shares(bars: DataFrame) -> DataFrame:
    """Scores with raw shares and the compressed, capped shares of the three scenarios."""
    s = scores(bars)
    total = _sum(*(c(f"score_{k}") for k in KINDS))
    s = s.withColumns({f"raw_{k}": c(f"score_{k}") / F.when(total > 0, total).otherwise(1.0) for k in KINDS})
    s = s.withColumns({f"pulled_{k}": F.greatest(F.lit(0.0), m + (c(f"raw_{k}") - m) * PULL) for k, m in zip(KINDS, CENTRES, strict=True)})
    whole = _sum(*(c(f"pulled_{k}") for k in KINDS))
    s = s.withColumns({f"share_{k}": F.coalesce(F.try_divide(c(f"pulled_{k}"), whole), F.lit(1 / 3)) for k in KINDS})
    return capped(s, tuple(f"share_{k}" for k in KINDS))


def scenario_scores(bars: DataFrame) -> DataFrame:
    """Shares in percent at each horizon: the further off, the nearer the directional ones come to a third."""
    s = shares(bars).withColumn("h", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(u).alias("unsure")) for h, u in UNCERTAINTY.items())))).select("*", "h.*")
    s = s.withColumns({f"percent_{k}": 33.33 + (100 * c(f"share_{k}") - 33.33) * (1 - c("unsure")) for k in KINDS[:2]})
    return s.withColumn("percent_neutral", 100 - c("percent_bullish") - c("percent_bearish"))


def fused(bars: DataFrame) -> DataFrame:
    """The layers' distributions in fixed proportions, the favoured kind, and confidence from spread (0.6) and dominance (0.4).

    Layers: the candles of 60 bars by kind, the favoured scenario and the scales' direction alone, the regime's direction with one half
    and its stability (even where it has none), and the smoothed shares of past outcomes.
    """
    s = shares(bars)

    def leaning(side: dict[str, Column]) -> dict[str, Column]:
        none = ~(side["bullish"] | side["bearish"])
        return {k: case((none, F.lit(1.0 if k == "neutral" else 0.0)), (side[k] if k in side else F.lit(False), F.lit(1.0)), otherwise=F.lit(0.0)) for k in KINDS}

    most = F.greatest(*(c(f"share_{k}") for k in KINDS))
    favoured = {"bullish": c("share_bullish") == most, "bearish": (c("share_bullish") < most) & (c("share_bearish") == most)}
    candles60, sure = c("n60").cast("double"), F.least(c("stability"), F.lit(0.5))
    sided = {"bullish": c("regime_side") == "BULLISH", "bearish": c("regime_side") == "BEARISH"}
    layers = {
        "direct": {"bullish": c("up60") / candles60, "bearish": c("down60") / candles60, "neutral": (c("n60") - c("up60") - c("down60")) / candles60}, "scenario": leaning(favoured),
        "scales": leaning({"bullish": c("integrated") == "BULLISH", "bearish": c("integrated") == "BEARISH"}),
        "regime": {**{k: case((sided[k], 0.5 + sure), (sided[o], 0.5 - sure), otherwise=F.lit(1 / 3)) for k, o in (("bullish", "bearish"), ("bearish", "bullish"))}, "neutral": case((sided["bullish"] | sided["bearish"], F.lit(0.0)), otherwise=F.lit(1 / 3))},
        "memory": {k: c(f"p_{k}") for k in KINDS},
    }
    s = s.withColumns({f"mix_{k}": _sum(*(w * layers[n][k] for n, w in LAYERS.items())) for k in KINDS})
    total = _sum(*(c(f"mix_{k}") for k in KINDS))
    s = s.withColumns({f"fused_{k}": F.coalesce(F.try_divide(c(f"mix_{k}"), total), F.lit(1 / 3)) for k in KINDS})
    three = F.array_sort(F.array(*(c(f"fused_{k}") for k in KINDS)))
    most, middle, least = three[2], three[1], three[0]
    return s.withColumns({
        "trust": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * (most - least) + 0.4 * (most - middle))),
        "favored": case((c("fused_bullish") == most, "bullish"), (c("fused_bearish") == most, "bearish"), otherwise="neutral"),
    })


GROUPS = {"STRUCTURE": ("structure",), "MOMENTUM": ("momentum",), "CANDLE": ("candle",), "STRUCTURE+MOMENTUM": ("structure", "momentum"), "STRUCTURE+LOCATION": ("structure", "location"), "ALL": ("structure", "momentum", "candle", "location")}
BASE = ["series_id", "window_no", "horizon"]


def group_votes(bars: DataFrame) -> DataFrame:
    """Votes of feature groups on test rows, with thresholds that are medians of the window's training rows.

    The trend votes its way; momentum beyond the median of its size, or by sign where that is 0; a close above or below the median place;
    a place in the lower half of the swings with a bullish trend or in the upper half with a bearish one. The sum decides.
    """
    rows = learning.experience(bars).select(*AT, "horizon", "direction", "trend", "r8")
    rows = rows.join(candles.anatomy(bars).select(*AT, "close_location"), AT).join(levels.swing_places(bars).select(*AT, "place"), AT)
    train, test = learning.training_of(bars, rows), learning.tests_of(bars, rows)
    medians = train.groupBy(*BASE).agg(F.percentile(F.abs("r8"), 0.5).alias("least"), F.percentile("close_location", 0.5).alias("middle"))
    t = test.filter("direction is not null").join(medians, BASE)
    sign = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    up, down = c("trend") == "BULLISH", c("trend") == "BEARISH"
    beyond, even = c("least") > 0, c("least") == 0
    t = t.withColumns({
        "structure": sign(up, down), "momentum": sign((beyond & (c("r8") > c("least"))) | (even & (c("r8") > 0)), (beyond & (c("r8") < -c("least"))) | (even & (c("r8") < 0))),
        "candle": sign(c("close_location") > c("middle"), c("close_location") < c("middle")), "location": sign(up & (c("place") < 0.5), down & (c("place") > 0.5)),
    })
    t = t.withColumn("g", F.explode(F.array(*(F.struct(F.lit(n).alias("group"), _sum(*map(c, parts)).alias("votes")) for n, parts in GROUPS.items())))).select(*BASE, "direction", "g.*")
    says = case((c("votes") > 0, "UP"), (c("votes") < 0, "DOWN"), otherwise="NEUTRAL")
    out = t.withColumn("says", says).groupBy(*BASE, "group").agg(F.count("*").alias("n"), F.count_if(c("says") != "NEUTRAL").alias("n_decided"), F.count_if((c("says") != "NEUTRAL") & (c("says") == c("direction"))).alias("n_hits"))
    return out.withColumn("accuracy", c("n_hits") / F.greatest(c("n_decided"), F.lit(1)))


def _ranges(bars: DataFrame) -> DataFrame:
    """(scheme, window_no, oos_start, oos_end) of every split scheme and of the walk-forward windows, by series."""
    windows = learning.windows(bars).select("series_id", F.lit("walk_forward").alias("scheme"), "window_no", "oos_start", "oos_end")
    return windows.unionByName(behaviour.split_schemes(bars).select("series_id", "scheme", "window_no", "oos_start", "oos_end"))


def event_independence(bars: DataFrame) -> DataFrame:
    """How often each structure event falls inside and outside the test ranges of each scheme, and its rates in both: an event that only tests see is no evidence.

    A bar counts once inside, however many ranges of a scheme hold it.
    """
    events = structure.structure(candles.features(bars)).select(*AT, "event")
    spans = _ranges(bars)
    schemes = spans.select("series_id", "scheme").distinct()
    inside = events.join(F.broadcast(spans), "series_id").filter((c("idx") >= c("oos_start")) & (c("idx") < c("oos_end"))).select(*AT, "scheme").distinct().withColumn("hit", F.lit(1))
    rows = events.join(F.broadcast(schemes), "series_id").join(inside, [*AT, "scheme"], "left").withColumn("inside", F.coalesce("hit", F.lit(0)))
    counts = rows.groupBy("series_id", "scheme", "event").agg(F.sum("inside").alias("n_inside"), F.sum(1 - c("inside")).alias("n_outside"))
    by = Window.partitionBy("series_id", "scheme")
    rate = lambda n: c(n) / F.greatest(F.sum(n).over(by), F.lit(1))
    return counts.withColumns({"rate_inside": rate("n_inside"), "rate_outside": rate("n_outside"), "only_inside": ((c("n_inside") > 0) & (c("n_outside") == 0)).cast("int")})
