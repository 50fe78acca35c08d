"""Rules as a book: whole structures of seven keys, which rules say the same thing twice, and which features rules use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import case
from tidemark.operators import discovery

c = F.col
STRUCTURE = ("directional_regime", "volatility_regime", "trend_consistency", "location_state", "momentum_state", "pressure", "range_event")
BY = ["series_id", "horizon", "fold"]


def structure_rules(bars: DataFrame, least: int = 40, confidence: float = 0.55) -> DataFrame:
    """Calibration records alike in all seven keys: BUY where at least as many buy as sell, else SELL, confident among the directional ones."""
    momentum = case(((c("return_5") > 0) & (c("return_10") > 0), "bullish"), ((c("return_5") < 0) & (c("return_10") < 0), "bearish"), otherwise="mixed")
    rows = discovery.folded(discovery.records(bars).withColumn("momentum_state", momentum)).filter("calibrates")
    out = rows.groupBy(*BY, *STRUCTURE).agg(F.count("*").alias("n"), F.count_if(c("outcome") == "BUY").alias("n_buy"), F.count_if(c("outcome") == "SELL").alias("n_sell"))
    both = c("n_buy") + c("n_sell")
    out = out.filter((c("n") >= least) & (both > 0)).withColumns({"says": case((c("n_buy") >= c("n_sell"), "BUY"), otherwise="SELL"), "confidence": F.greatest("n_buy", "n_sell") / both})
    return out.filter(c("confidence") >= confidence)


def signed(rules: DataFrame) -> DataFrame:
    """Adds the conditions of a rule in order, and the signature that rules share which have the same conditions and say the same."""
    conditions = F.array_sort(F.split("rule", " & "))
    return rules.withColumn("conditions", conditions).withColumn("signature", F.concat_ws(" -> ", F.array_join("conditions", " & "), "says"))


def signatures(bars: DataFrame) -> DataFrame:
    """How often each signature was mined in the folds of a series and horizon, and whether the same conditions said something else in another fold."""
    rules = signed(discovery.mined_rules(bars))
    met = rules.groupBy("series_id", "horizon", F.array_join("conditions", " & ").alias("rule"), "says").agg(F.count("*").alias("n_folds"), F.sum("n").alias("samples"))
    others = met.groupBy("series_id", "horizon", "rule").agg(F.count("*").alias("n_directions"))
    return met.join(others, ["series_id", "horizon", "rule"])


def feature_usage(bars: DataFrame) -> DataFrame:
    """How many rules of a fold have a condition on each feature."""
    rules = signed(discovery.mined_rules(bars)).select(*BY, F.explode("conditions").alias("condition"))
    return rules.groupBy(*BY, F.split_part("condition", F.lit("="), F.lit(1)).alias("feature")).agg(F.count("*").alias("n_rules"))


def redundant(bars: DataFrame) -> DataFrame:
    """Rules of two conditions that meet the very records of one of them (as many, so the same) and say the same: the other condition adds nothing."""
    rules = signed(discovery.mined_rules(bars))
    singles = rules.filter(F.size("conditions") == 1).select(*BY, c("rule").alias("condition"), "n", "says")
    pairs = rules.filter(F.size("conditions") == 2).select(*BY, "rule", "n", "says", F.explode("conditions").alias("condition"))
    return pairs.join(singles, [*BY, "condition", "n", "says"]).select(*BY, "rule", "condition", "n", "says")
