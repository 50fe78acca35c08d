"""All queries of the engine by name, with SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import shared
from tidemark.functions.columns import case, over, series, tidy
from tidemark.operators import acceptance, behaviour, candles, contexts, discovery, evaluation, fusion, grids, learning, levels, nearest, outcomes, quality, regimes, rulebook, scans, scenarios, skill, structure
from tidemark.plans.oracle import state
from tidemark.sources import bars as source
from tidemark.sources import ingest
from tidemark.streaming import memory, online

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[DataFrame], DataFrame], cte: str | None, columns: str, bars: Query = source.hourly) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(build(bars(spark, sf_dir)), columns)
    if cte:
        ORACLE_SQL[name] = state(cte, columns)


def _relative(bars: DataFrame) -> DataFrame:
    median = lambda x: F.percentile(F.when(c(x) > 0, c(x)), 0.5).over(over(-20, -1))
    f = candles.anatomy(bars).withColumns({"med": median("range"), "vmed": median("volume")})
    size, vol = c("range") / c("med"), c("volume") / c("vmed")
    return f.withColumns({
        "size_state": case((c("med").isNull(), "UNKNOWN"), (size < 0.5, "VERY_SMALL"), (size < 0.8, "SMALL"), (size <= 1.25, "NORMAL"), (size <= 1.75, "LARGE"), otherwise="VERY_LARGE"),
        "volume_state": case((c("vmed").isNull(), "UNKNOWN"), (vol >= 2, "VERY_HIGH"), (vol >= 1.3, "HIGH"), (vol <= 0.6, "LOW"), otherwise="NORMAL"),
    })


def _path_rows(bars: DataFrame) -> DataFrame:
    rows = candles.path_vectors(bars).select("series_id", "idx", F.posexplode("path").alias("k", "p"))
    # A flat bar's unit is tiny, so ratios are shown up to a million only.
    shown = lambda n: F.greatest(F.least(c(f"p.{n}"), F.lit(1e6)), F.lit(-1e6)).alias(f"p_{n}")
    return rows.select("series_id", "idx", c("k").cast("long"), *(shown(n) for n in ("change", "range", "direction", "body")))


def _ngrams(bars: DataFrame) -> DataFrame:
    letter = F.left("direction", F.lit(1))
    grams = candles.anatomy(bars).withColumn("pattern", F.concat(F.lag(letter, 2).over(series()), F.lag(letter, 1).over(series()), letter)).select("series_id", "idx", "pattern")
    rows = grams.join(outcomes.outcomes(bars), ["series_id", "idx"]).filter("pattern is not null and price_direction is not null")
    return rows.groupBy("pattern", "horizon").agg(F.count("*").alias("n"), *(F.count_if(c("price_direction") == d).alias(f"n_{d}") for d in ("bullish", "bearish", "neutral")))


def _transitions(bars: DataFrame) -> DataFrame:
    moves = structure.market_states(bars).select("regime", F.lag("regime").over(series()).alias("prev"))
    return moves.filter("prev is not null").groupBy("prev", "regime").agg(F.count("*").alias("n"))


def _report(bars: DataFrame) -> DataFrame:
    rows = learning.experience(bars).filter("direction is not null")
    out = rows.groupingSets([[], [c("horizon")], [c("direction")], [c("series_id"), c("horizon")]], "series_id", "horizon", "direction")
    level = F.grouping("series_id") + 2 * F.grouping("horizon") + 4 * F.grouping("direction")
    return out.agg(level.alias("level"), F.count("*").alias("n"), F.avg("atr_return").alias("mean_return"))


def _deciles(bars: DataFrame) -> DataFrame:
    rows = evaluation.scored(learning.conditional_baseline(bars), "direction").withColumn("confidence", F.round("confidence", 9))
    return evaluation.equal_count_buckets(rows, "horizon", ["confidence", "series_id", "idx"], c("hit"))


def _spearman(bars: DataFrame) -> DataFrame:
    rows = learning.experience(bars).select("horizon", "series_id", "idx", F.round("volatility_ratio", 9).alias("v"), F.round("atr_return", 9).alias("r"))
    return evaluation.spearman(rows, "horizon", "v", "r", ["series_id", "idx"])


def _thresholds(bars: DataFrame) -> DataFrame:
    return outcomes.threshold_grid(learning.training_of(bars, learning.experience(bars)), ["horizon", "window_no"])


def _targets(bars: DataFrame, horizon: int) -> DataFrame:
    return outcomes.outcomes(bars, (horizon,)).filter("future is not null").select("series_id", "idx", (c("idx") + c("horizon")).alias("stop"))


def _overlaps(bars: DataFrame) -> DataFrame:
    rows = outcomes.outcomes(bars).filter("future is not null").select("series_id", "horizon", "idx", (c("idx") + c("horizon")).alias("stop"))
    parts = [quality.overlapping_targets(rows.filter(c("horizon") == h)).withColumn("horizon", F.lit(h)) for h in outcomes.HORIZONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _prefix(bars: DataFrame) -> DataFrame:
    """Features of all bars and of those before each cut alone, both up to there."""
    return evaluation.future_dependence(bars, structure.episodes)


def _suffix(bars: DataFrame) -> DataFrame:
    """Features of all bars and of bars changed from each cut on, both up to there."""
    return evaluation.future_dependence(bars, structure.episodes, suffix=True)


def _leak_audit(bars: DataFrame) -> DataFrame:
    return quality.boundary_violations(learning.top_matches(bars).select("series_id", c("idx").alias("query_idx"), c("h_idx").alias("input_idx")))


def _scored(f: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda bars: f(learning.conditional_baseline(bars), actual="direction")


ID = "series_id idx"
CASE_ID = "series_id window_no horizon idx"
P = "~p_up ~p_down ~p_neutral"

_add("bars_hourly", lambda b: b, "bars", f"{ID} ~open ~high ~low ~close volume")
_add("bars_daily_orders", lambda b: b, "daily", f"{ID} ~open ~high ~low ~close volume", source.daily_orders)
_add("resample_3x", lambda b: source.resample(b, 3), "resampled", "series_id end_idx ~open ~high ~low ~close volume")
_add("multi_timeframe", source.multi_timeframe, "multi", f"{ID} ~close ~close_3 ~open_3 ~close_12 ~open_12")
_add("row_fingerprints", source.fingerprints, "prints", f"{ID} fingerprint")
_add("ohlc_audit", quality.audit, "audited", "series_id n_bars n_invalid n_contract_invalid n_disordered n_repeated n_duplicates verdict")
_add("gap_audit", quality.gaps, "gaps", "series_id modal n_gaps largest n_backward")
_add("price_volume_stats", quality.statistics, "stats", "series_id ~first_close ~last_close ~max_high ~min_low ~mean_range ~median_range ~mean_body n_volume ~mean_volume min_volume max_volume")
_add("candle_anatomy", candles.anatomy, "anatomy", f"{ID} ~range ~body ~upper ~lower direction ~body_share ~upper_share ~lower_share ~close_location")
_add("rolling_features", candles.features, "feat", f"{ID} ~true_range ~atr ~r1 ~r3 ~r8 ~r16 ~volatility_ratio ~range_atr ~sma20 ~location20 ~volume_ratio ~rolling_volatility ~unit")
_add("candle_classes", candles.classes, "classes", f"{ID} label size_class body_class wick_class family volume_state volatility_state location_state")
_add("candle_language", candles.language, "language", f"{ID} body_size range_size wick_profile behaviours sentence")
_add("relative_size_volume", _relative, "relative", f"{ID} ~med size_state ~vmed volume_state")
_add("indicators_rsi_sma_atr", candles.indicators, "indicators", f"{ID} ~rsi ~momentum atr_regime ma_bias ~sma50")
_add("exponential_means", lambda b: scans.exponential_means(b.select("series_id", "idx", "close"), "close", (12, 26)), "ema_lines", f"{ID} ~ema_12 ~ema_26")
_add("macd", scans.macd, "macd", f"{ID} ~macd ~signal ~histogram state")
_add("direction_streaks", candles.streaks, "streaks", f"{ID} streak signed_streak exhausted")
_add("window_context", candles.window_context, "context", f"{ID} ~imbalance ~change60 body_momentum rejection pressure break_state")
_add("level_events", candles.level_events, "levels", f"{ID} break_event sweep displacement alignment ~high_distance ~low_distance")
_add("path_vectors", _path_rows, "path_shown", f"{ID} k ~p_change ~p_range ~p_direction ~p_body")
_add("named_patterns", candles.patterns, "patterns", f"{ID} direction pattern")
_add("pattern_evaluation", candles.pattern_evaluation, "pattern_eval", "pattern n n_after_up n_after_down n_higher n_lower n_pending")
_add("direction_ngrams", _ngrams, "ngram", "pattern horizon n n_bullish n_bearish n_neutral")
_add("confirmed_swings", lambda b: structure.swings(candles.features(b)), "swings", f"{ID} ~pivot_high ~pivot_low high_mark low_mark")
_add("structure_events", lambda b: structure.structure(candles.features(b)), "structure", f"{ID} ~last_high ~last_low high_label low_label event trend event_index event_age structure_age")
_add("structure_snapshot", structure.simple_structure, "simple", f"{ID} event trend high_label low_label")
_add("market_state", structure.market_states, "states", f"{ID} trend event location regime momentum sequence state_key ~volatility_ratio")
_add("episodes", structure.episodes, "episodes", f"{ID} episode state_key")
_add("regime_runs", lambda b: structure.regime_runs(structure.market_states(b)), "regime_runs", f"{ID} regime persistence ~stability transition")
_add("regime_transitions", _transitions, "transitions", "prev regime n")
_add("state_frequency", lambda b: learning.state_frequency(structure.market_states(b)), "frequency", "bucket n_states n_rows")
_add("zone_touches", structure.zones, "zones", "series_id zone ~zone_low ~zone_high n_pivots n_touches n_rejections last_touch")
_add("structure_acceptance", acceptance.structure_acceptance, "acc", f"{ID} event trend event_direction ~event_level event_age ~break_distance ~break_strength acceptance retest phase")
_add("sequence_machine", acceptance.sequence_machine, "machine", f"{ID} sequence transition impulses pullbacks compressions")
_add("outcomes", outcomes.outcomes, "outcomes", f"{ID} horizon quality direction price_direction ~raw_return ~atr_return ~mfe_atr ~mae_atr time_to_high time_to_low")
_add("outcome_distribution", lambda b: outcomes.distribution(outcomes.outcomes(b)), "distribution", "series_id horizon n ~up ~down ~neutral ~mean_return ~median_return ~mean_mfe ~mean_mae")
_add("threshold_grid", _thresholds, "thresholds", "horizon window_no ~threshold n_up n_down n ~score")
_add("threshold_selection", lambda b: outcomes.best_threshold(_thresholds(b), ["horizon", "window_no"]), "threshold", "horizon window_no ~threshold ~score")
_add("other_labels", outcomes.other_labels, "labels", f"{ID} horizon ~mfe_clipped ~mae_clipped ~along ~against strength two_way b05 b15 b03 b01")
_add("excursion_summary", outcomes.excursion_summary, "excursions", "horizon strength n ~mean_along ~mean_against")
_add("overlapping_pairs", lambda b: quality.overlapping_pairs(_targets(b, 4)), "overpairs", "series_id idx later_idx")
_add("interval_gaps", quality.wide_gaps, "wgaps", "series_id modal n_above_mode n_negative n_zero largest")
_add("sequence_contexts", contexts.sequence_contexts, "seqctx", f"{ID} movement follow_two follow_three rejection range_state pace acceleration break_state volume_state place_state pressure")
_add("pressure_histogram", contexts.pressure_histogram, "pressures", "length pressure n")
_add("simple_types", contexts.simple_types, "types", f"{ID} type strength ~span4 ~span8 ~span16 ~volatility_change ~atr_change long_bias volume_level")
_add("level_structure", contexts.level_structure, "levelstr", f"{ID} candidate_high candidate_low hh lh hl ll swing_score support_rejection resistance_rejection support_break resistance_break near_support near_resistance ~support_distance ~support_percent ~strength ~sweep_depth bias event_code")
_add("scale_contexts", contexts.scale_contexts, "scales", f"{ID} ~change20 ~change60 ~change120 direction20 direction60 direction120 vote integrated ~confidence aligned")
_add("regime_frequency", contexts.regime_frequency, "regfreq", "series_id integrated n")
_add("segment_features", contexts.segment_features, "segs", f"{ID} ~r5 ~r10 ~r20 ~r40 ~up_share ~down_share ~imbalance ~vol_ratio ~place ~slope_share ~acceleration range_half body_half")
_add("segment_states", contexts.segment_states, "segst", f"{ID} volatility_state location_state direction_state momentum_state pressure_state")
_add("signal_vectors", lambda b: contexts.signal_vectors(b).select("series_id", "idx", F.posexplode("signal").alias("k", "value")).withColumn("k", c("k").cast("long")), "signal", f"{ID} k ~value")
_add("alternating_swings", levels.alternating, "altern", "series_id run kind ~price pivot_idx n")
_add("swing_places", levels.swing_places, "places", f"{ID} ~place score location label_trend")
_add("price_zones", levels.price_zones, "pzones", "series_id kind zone ~zone_low ~zone_high ~center n_swings n_tests n_rejections last_test")
_add("nearest_zones", levels.nearest_zones, "nzones", "series_id kind side zone ~center ~distance n_tests")
_add("overlapping_targets", _overlaps, "overlap", f"{ID} horizon n_overlapping")
_add("grouping_report", _report, "report", "series_id horizon direction level n ~mean_return")
_add("walk_forward_windows", learning.windows, "wins", "series_id window_no oos_start oos_end")
_add("conditional_baseline", learning.conditional_baseline, "baseline", f"{CASE_ID} direction level support {P}")
_add("hierarchical_state", learning.hierarchical, "hier", f"{CASE_ID} direction {P}")
_add("unseen_states_anti", learning.unseen_states, "unseen", f"{CASE_ID} state_key")
_add("seen_states_semi", learning.seen_states, "seen", f"{CASE_ID} state_key")
_add("rule_mining", learning.rules, "rules", "horizon window_no rule n says ~confidence ~lift")
_add("rule_validation", learning.rule_validation, "rule_check", "horizon window_no rule says n_matches n_hits")
_add("rule_predictions", learning.rule_predictions, "rule_best", "series_id idx horizon window_no direction rule says ~confidence")
_add("stable_rules", learning.stable_rules, "rule_stable", "horizon rule n_windows says ~mean_confidence")
_add("retrieval_topk", learning.top_matches, "top", f"{CASE_ID} rank h_idx episode direction ~similarity")
_add("retrieval_shares", learning.retrieval_shares, "shares", f"{CASE_ID} n ~best ~share_up ~share_down ~share_neutral ~mean_return ~mean_mfe ~mean_mae")
_add("retrieval_decision", learning.decisions, "decisions", f"{CASE_ID} {P} ~margin prediction reason")
_add("retrieval_boundary_audit", _leak_audit, "zone_inputs", "series_id n_inputs n_violations")
_add("knn_probability", nearest.probability, "knn", f"{CASE_ID} n {P}")
_add("centroid_classifier", learning.nearest_centroid, "centroid", f"{CASE_ID} direction prediction")
_add("online_walk_forward", learning.online_walk_forward, "online", f"{ID} state_key support ~p_bullish ~p_bearish ~p_neutral prediction actual")
_add("online_stream", lambda b: online.replay(b, shared.folder(b.sparkSession, "online")), "online", f"{ID} state_key support ~p_bullish ~p_bearish ~p_neutral prediction")
_add("experience_memory", lambda b: online.memory(online.events(b)).select("series_id", "state_key", "count", *(F.coalesce(c("outcomes")[k], F.lit(0)).alias(f"n_{k}") for k in online.KINDS)), "memo", "series_id state_key count n_bullish n_bearish n_neutral")
_add("walkforward_metrics", _scored(evaluation.metrics), "metrics", "horizon n ~accuracy ~majority ~brier ~log_loss ~balanced ~macro_f1")
_add("confusion_matrix", _scored(evaluation.confusion), "confusion", "horizon actual said n")
_add("calibration_ece", _scored(evaluation.calibration), "calib", "horizon ~ece ~mce n_bins")
_add("confidence_deciles", _deciles, "deciles", "horizon bucket n ~mean_value")
_add("spearman", _spearman, "spear", "horizon n ~rho")
_add("block_permutation", _scored(evaluation.shifted_accuracy), "shifted", "horizon shift n ~accuracy")
_add("prefix_invariance", _prefix, "nothing", "only_first only_second n_compared")
_add("suffix_mutation", _suffix, "nothing", "only_first only_second n_compared")
_add("forecast_shapes", skill.forecast_shapes, "shapes", "horizon n ~retrieval_entropy ~baseline_entropy ~total_variation ~divergence")
_add("incremental_value", skill.incremental_value, "incval", "horizon n ~brier_lift ~log_loss_lift ~accuracy_lift ~share_better improves")
_add("discrimination", skill.discrimination, "discrim", "horizon n_queries ~mean_matches ~separation ~share_separated ~mean_mass ~top_agree ~rest_agree")
_add("tertile_agreement", skill.tertile_agreement, "thirds", "horizon third n ~mean_similarity ~agreement")
_add("accuracy_permutation", skill.accuracy_permutation, "accperm", "horizon n ~difference ~null_mean ~null_std ~p_value")
_add("bootstrap_lift", skill.bootstrap_lift, "boot", "horizon ~mean_lift ~low ~high")
_add("sign_test", skill.sign_test, "signs", "horizon n n_better n_worse ~mean_lift ~p_value")
_add("retrieval_null", skill.retrieval_null, None, "horizon n_queries ~real_share ~null_share ~null_p95 ~lift ~share_beyond")
_add("label_permutation", skill.label_permutation, "labperm", "horizon n ~accuracy ~null_accuracy ~p_value")
_add("correlations", skill.correlations, "corrs", "horizon feature n ~pearson ~lift")
_add("stability", skill.stability, "stable", "horizon n_windows ~mean_accuracy ~median_accuracy ~deviation ~worst ~best n_above ~coverage ~lift ~composite")
_add("calibration_grid", skill.calibration_grid, "calgrid", "horizon ~shrink ~temperature ~fit_loss ~test_loss")
_add("confidence_sweep", skill.confidence_sweep, "sweep", "horizon ~level n_kept n ~coverage ~accuracy ~score chosen")
_add("coverage_summary", skill.coverage_summary, "covsum", "horizon reason n n_hits ~mean_margin")
_add("similarity_histogram", skill.similarity_histogram, "simhist", "horizon bucket n ~agreement")
_add("failure_patterns", skill.failure_patterns, "failures", "horizon trend regime momentum location n n_failed ~rate")
_add("temporal_integrity", skill.temporal_integrity, "integrity", "horizon n n_self n_future n_near n_crossing")
_add("discretised_rules", skill.discretised_rules, "drules", "horizon window_no rule n says ~confidence ~directional_rate ~score")
_add("logistic_probability", fusion.logistic, "logit", f"{CASE_ID} rose n_train ~p_up")
_add("ensemble_probability", fusion.ensemble, "ensem", f"{CASE_ID} rose support ~p_logistic ~p_neighbours ~p_state ~p_up ~agreement ~confidence says")
_add("quantile_states", fusion.quantile_states, "qstates", f"{CASE_ID} direction state samples source ~p_up prediction")
_add("temperature_scaling", fusion.temperature, "temper", "horizon ~temperature ~fit_loss ~test_loss ~plain_loss")
_add("evidence_rules", fusion.evidence_rules, "evrules", "horizon rule n_fit ~fit_accuracy n_test ~test_accuracy chosen")
_add("shrunk_retrieval", fusion.shrunk_retrieval, "shrunk", f"{CASE_ID} n ~homogeneity {P}")
_add("component_ablation", fusion.component_ablation, "ablate", "horizon dropped n ~accuracy ~brier")
_add("failure_penalties", fusion.failure_penalties, "fpen", f"{CASE_ID} said samples failures ~stepped ~adaptive ~stepped_up ~stepped_down ~stepped_neutral ~adaptive_up ~adaptive_down ~adaptive_neutral")
_add("naive_baselines", fusion.naive_baselines, "naive", "horizon method n ~accuracy")
_add("decision_stability", fusion.decision_stability, "dstab", "horizon said n_same n_changed ~stability")
_add("trust_tiers", fusion.trust_tiers, "tiers", "horizon level ~score n_keys n_outcomes")
_add("pattern_scores", fusion.pattern_scores, "pscore", "pattern occurrences resolved ~accuracy ~score")
_add("similar_patterns", fusion.similar_patterns, "simpat", "series_id current pattern occurrences ~similarity rank")
_add("level_clusters", fusion.level_clusters, "lclus", "series_id level_no ~price touches side")
_add("unified_retrieval", fusion.unified_retrieval, "unified", f"{ID} n evidence level best ~p_bullish ~p_bearish ~p_neutral favored")
_add("candle_symbols", behaviour.symbols, "symb", f"{ID} body_class upper_class lower_class close_class symbol")
_add("normalised_anatomy", behaviour.normalised_anatomy, "norm", f"{ID} ~body_atr ~span_atr ~body_place ~efficiency ~expansion type rejection pressure")
_add("window_counters", behaviour.window_counters, "wcount", f"{ID} n_bullish n_bearish n_changes n_hh n_lh n_hl n_ll context")
_add("label_sequences", behaviour.label_sequences, "lseq", "horizon length labels n says ~confidence rank")
_add("prior_states", behaviour.prior_states, "prior", f"{CASE_ID} direction state_key source samples ~p_up")
_add("split_schemes", behaviour.split_schemes, "schemes", "series_id scheme window_no oos_start oos_end")
_add("confidence_bins", lambda b: behaviour.confidence_bins(learning.conditional_baseline(b)), "confbins", "horizon bin n ~accuracy ~mean_confidence")
_add("candidate_diagnostics", behaviour.candidate_diagnostics, "canddiag", "horizon k n_queries ~mean_same ~mean_gap ~mean_similarity ~mean_structure ~mean_regime ~mean_path")
_add("research_features", discovery.features, "feat26", f"{ID} " + " ".join([*(f"~{n}" for n in discovery.NUMBERS), *discovery.CATEGORIES]))
_add("condition_rules", discovery.mined_rules, "crules", "series_id horizon fold rule n says ~confidence")
_add("condition_walk_forward", discovery.walk_forward, "cwalk", "series_id horizon fold n predictions correct ~accuracy ~coverage")
_add("rule_label_null", discovery.label_null, None, "series_id horizon n predictions correct ~observed ~mean_null ~max_null n_reaching ~p_value")
_add("rule_discovery_null", discovery.discovery_null, None, "series_id horizon fold ~baseline rules ~best_accuracy above ~mean_best ~max_best ~mean_rules ~mean_above")
_add("online_memory", memory.replay, "omem", f"{ID} horizon n evidence level best ~p_bullish ~p_bearish ~p_neutral favored outcome result")
_add("regime_neighbours", nearest.regime_neighbours, "rnear", f"{CASE_ID} k n n_rising n_flat n_falling says ~confidence")
_add("mixed_neighbours", nearest.mixed_neighbours, "mnear", f"{CASE_ID} k n n_rising n_flat n_falling says ~confidence")
# Few states of seven keys come 40 times in a series of some hundred bars: rules from 20 on.
_add("structure_rules", lambda b: rulebook.structure_rules(b, 20, 0.50), "srules", "series_id horizon fold " + " ".join(rulebook.STRUCTURE) + " n n_buy n_sell says ~confidence")
_add("rule_signatures", rulebook.signatures, "rsigs", "series_id horizon rule says n_folds samples n_directions")
_add("feature_usage", rulebook.feature_usage, "rusage", "series_id horizon fold feature n_rules")
_add("redundant_rules", rulebook.redundant, "rredun", "series_id horizon fold rule condition n says")
_add("ingestion_issues", ingest.issue_counts, "iissues", "series_id kind issue n", lambda spark, sf_dir: ingest.layers(ingest.lines(spark, sf_dir), 86_400))
_add("ingested_bars", ingest.normalised, "ibars", f"{ID} source_row ts ~open ~high ~low ~close volume", lambda spark, sf_dir: ingest.layers(ingest.lines(spark, sf_dir), 86_400))
_add("scenario_scores", scenarios.scenario_scores, "scen", f"{ID} horizon ~score_bullish ~score_bearish ~score_neutral ~percent_bullish ~percent_bearish ~percent_neutral")
_add("layer_fusion", scenarios.fused, "fuse", f"{ID} ~fused_bullish ~fused_bearish ~fused_neutral ~trust")
_add("group_votes", scenarios.group_votes, "gvote", "series_id window_no horizon group n n_decided n_hits ~accuracy")
_add("event_independence", scenarios.event_independence, "eindep", "series_id scheme event n_inside n_outside ~rate_inside ~rate_outside only_inside")
_add("config_grid", grids.config_grid, "cgrid", "series_id window_no horizon config k ~halflife regimes policy n_fit n ~accuracy_lift ~brier_lift ~log_loss_lift ~score chosen")
_add("tuned_retrieval", grids.tuned_retrieval, "tuned", f"{CASE_ID} direction selected config ~shrink ~temperature {P}")
_add("regime_scores", regimes.regime_scores, "regimes7", f"{ID} " + " ".join(f"~{r}" for r in regimes.REGIMES) + " ~confidence leader regime")
