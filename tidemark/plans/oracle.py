"""SQL that states the results of the queries, for DuckDB: common table expressions by name, joined into one text a query."""

from __future__ import annotations

import re

from tidemark.plans import behaviour_sql, discovery_sql, fusion_sql, grid_sql, more_sql, regime_sql, scenario_sql, sequence_sql

PART = "PARTITION BY series_id ORDER BY idx"


def rows(a: str, b: str = "CURRENT ROW") -> str:
    return f"OVER ({PART} ROWS BETWEEN {a} AND {b})"


def back(n: int) -> str:
    return rows(f"{n} PRECEDING")


def div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) < 1e-12 THEN 0.0 ELSE ({a}) / ({b}) END)"


LAG = f"OVER ({PART})"
ALL = rows("UNBOUNDED PRECEDING")
BEFORE = rows("UNBOUNDED PRECEDING", "1 PRECEDING")
_ret = {n: f"(CASE WHEN idx >= {n} THEN {div(f'close - lag(close, {n}) {LAG}', f'lag(close, {n}) {LAG}')} ELSE 0.0 END)" for n in (1, 3, 8, 16)}


def _pivots(left: int, right: int, op: str) -> str:
    first, second = f"{left + right} PRECEDING", f"{right + 1} PRECEDING"
    near = rows(f"{right - 1} PRECEDING")
    return f"""CASE WHEN idx >= {left + right} AND lag(high, {right}) {LAG} {op} max(high) {rows(first, second)} AND lag(high, {right}) {LAG} {op} max(high) {near} THEN lag(high, {right}) {LAG} END AS pivot_high,
      CASE WHEN idx >= {left + right} AND -lag(low, {right}) {LAG} {op} -min(low) {rows(first, second)} AND -lag(low, {right}) {LAG} {op} -min(low) {near} THEN lag(low, {right}) {LAG} END AS pivot_low"""


_CARRY = f"""last_value(pivot_high IGNORE NULLS) {ALL} AS last_high, last_value(pivot_low IGNORE NULLS) {ALL} AS last_low,
      coalesce(last_value(high_mark IGNORE NULLS) {ALL}, 'UNKNOWN') AS high_label, coalesce(last_value(low_mark IGNORE NULLS) {ALL}, 'UNKNOWN') AS low_label,
      last_value(CASE WHEN pivot_high IS NOT NULL THEN idx END IGNORE NULLS) {ALL} AS high_seen, last_value(CASE WHEN pivot_low IS NOT NULL THEN idx END IGNORE NULLS) {ALL} AS low_seen"""
_MARK = f"""CASE WHEN pivot_high IS NOT NULL THEN CASE WHEN last_value(pivot_high IGNORE NULLS) {BEFORE} IS NULL OR pivot_high > last_value(pivot_high IGNORE NULLS) {BEFORE} THEN 'HH' ELSE 'LH' END END AS high_mark,
      CASE WHEN pivot_low IS NOT NULL THEN CASE WHEN last_value(pivot_low IGNORE NULLS) {BEFORE} IS NULL OR pivot_low > last_value(pivot_low IGNORE NULLS) {BEFORE} THEN 'HL' ELSE 'LL' END END AS low_mark"""

CTES = {
    "bars": """SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM (
      SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
             last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events WHERE isfinite(value) GROUP BY 1, 2)""",
    "daily": """SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM (
      SELECT 'all' AS series_id, date_trunc('day', o_orderdate) AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
             last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*) AS volume FROM orders WHERE isfinite(o_totalprice) GROUP BY 2)""",
    "resampled": """SELECT series_id, idx // 3 AS g, max(idx) AS end_idx, first(open ORDER BY idx) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY idx) AS close, CAST(sum(volume) AS BIGINT) AS volume
      FROM bars GROUP BY 1, 2 HAVING count(*) = 3""",
    "resampled12": "SELECT series_id, idx // 12 AS g, max(idx) AS end_idx, first(open ORDER BY idx) AS open, last(close ORDER BY idx) AS close FROM bars GROUP BY 1, 2 HAVING count(*) = 12",
    "multi": """SELECT b.series_id, b.idx, b.close, r.close AS close_3, r.open AS open_3, s.close AS close_12, s.open AS open_12 FROM bars b
      ASOF LEFT JOIN resampled r ON b.series_id = r.series_id AND b.idx >= r.end_idx ASOF LEFT JOIN resampled12 s ON b.series_id = s.series_id AND b.idx >= s.end_idx""",
    "audit": f"""SELECT series_id, count(*) AS n_bars, count(*) FILTER (NOT ok) AS n_invalid, count(*) FILTER (NOT coalesce(ok AND isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND least(open, high, low, close) > 0 AND volume >= 0, false)) AS n_contract_invalid,
      count(*) FILTER (ts < was) AS n_disordered, count(*) FILTER (ts = was) AS n_repeated, count(*) - count(DISTINCT ts) AS n_duplicates
      FROM (SELECT *, low <= least(open, close) AND greatest(open, close) <= high AS ok, lag(ts) {LAG} AS was FROM bars) GROUP BY 1""",
    "audited": "SELECT *, CASE WHEN n_invalid + n_disordered > 0 THEN 'FAIL' WHEN n_contract_invalid + n_duplicates > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM audit",
    "deltas": f"SELECT series_id, CAST(epoch(ts) - epoch(lag(ts) {LAG}) AS BIGINT) AS delta FROM bars QUALIFY delta IS NOT NULL",
    "modes": "SELECT series_id, delta AS modal FROM (SELECT series_id, delta, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, delta) AS k FROM deltas GROUP BY 1, 2) WHERE k = 1",
    "gaps": "SELECT series_id, modal, count(*) FILTER (delta > 1.5 * modal) AS n_gaps, max(delta) AS largest, count(*) FILTER (delta <= 0) AS n_backward FROM deltas JOIN modes USING (series_id) GROUP BY 1, 2",
    "stats": """SELECT series_id, first(close ORDER BY idx) AS first_close, last(close ORDER BY idx) AS last_close, max(high) AS max_high, min(low) AS min_low, avg(high - low) AS mean_range,
      quantile_cont(high - low, 0.5) AS median_range, avg(abs(close - open)) AS mean_body, count(volume) AS n_volume, avg(volume) AS mean_volume, min(volume) AS min_volume, max(volume) AS max_volume FROM bars GROUP BY 1""",
    "anatomy": f"""SELECT *, {div('body', 'range')} AS body_share, {div('upper', 'range')} AS upper_share, {div('lower', 'range')} AS lower_share, {div('close - low', 'range')} AS close_location FROM (
      SELECT *, high - low AS range, abs(close - open) AS body, high - greatest(open, close) AS upper, least(open, close) - low AS lower,
             CASE WHEN close > open THEN 'UP' WHEN close < open THEN 'DOWN' ELSE 'FLAT' END AS direction FROM bars)""",
    "feat0": f"""SELECT *, CASE WHEN lag(close) {LAG} IS NULL THEN range ELSE greatest(range, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) END AS true_range,
      {div('range', 'greatest(close, 1e-12)')} AS share_of_close FROM anatomy""",
    "feat1": f"""SELECT *, CASE WHEN count(*) {back(13)} = 14 THEN greatest(avg(true_range) {back(13)}, 1e-12) END AS atr, {', '.join(f'{e} AS r{n}' for n, e in _ret.items())},
      avg(share_of_close) {back(7)} AS recent, coalesce(avg(share_of_close) {rows('31 PRECEDING', '8 PRECEDING')}, 0.0) AS older, avg(range) {back(13)} AS range_atr, avg(close) {back(19)} AS sma20,
      (close - min(low) {back(19)}) / greatest(max(high) {back(19)} - min(low) {back(19)}, 1e-12) AS location20, {div('volume', f'avg(volume) {back(19)}')} AS volume_ratio FROM feat0""",
    "feat": f"SELECT *, {div('recent', '(CASE WHEN older > 1e-12 THEN older ELSE recent + 1e-12 END)')} AS volatility_ratio, coalesce(atr, greatest(range, 1e-12)) AS unit, stddev_pop(r1) {back(19)} AS rolling_volatility FROM feat1",
    "class0": f"SELECT *, CASE WHEN range_atr > 1e-12 THEN range / range_atr ELSE 1.0 END AS relative, CASE WHEN avg(range) {back(19)} > 1e-12 THEN range / avg(range) {back(19)} ELSE 1.0 END AS range_ratio20, body_share AS b, upper_share AS u, lower_share AS lo FROM feat",
    "classes": f"""SELECT *,
      CASE WHEN range <= 1e-12 THEN 'flat' WHEN b <= 0.10 THEN 'doji' WHEN close > open AND b >= 0.65 AND close_location >= 0.75 THEN 'strong_bullish' WHEN close < open AND b >= 0.65 AND {div('high - close', 'range')} >= 0.75 THEN 'strong_bearish'
           WHEN close > open AND b >= 0.5 THEN 'bullish_close_strong' WHEN close < open AND b >= 0.5 THEN 'bearish_close_strong' WHEN lo >= 0.55 AND b <= 0.35 THEN 'hammer_like' WHEN u >= 0.55 AND b <= 0.35 THEN 'shooting_star_like' ELSE 'normal' END AS label,
      CASE WHEN range <= 1e-12 THEN 'NO_RANGE' WHEN relative >= 2 THEN 'LARGE_RANGE' WHEN relative >= 1.25 THEN 'EXPANSION' WHEN relative <= 0.6 THEN 'COMPRESSION' ELSE 'NORMAL_RANGE' END AS size_class,
      CASE WHEN b >= 0.8 THEN 'STRONG_BODY' WHEN b >= 0.55 THEN 'MODERATE_BODY' WHEN b <= 0.2 THEN 'SMALL_BODY' ELSE 'BALANCED_BODY' END AS body_class,
      CASE WHEN u >= 0.45 AND u > lo * 1.5 THEN 'UPPER_REJECTION' WHEN lo >= 0.45 AND lo > u * 1.5 THEN 'LOWER_REJECTION' WHEN u >= 0.25 AND lo >= 0.25 THEN 'TWO_SIDED_REJECTION' ELSE 'LOW_WICK_ACTIVITY' END AS wick_class,
      CASE WHEN b <= 0.1 THEN 'DOJI_LIKE' WHEN lo >= 0.5 AND b <= 0.35 THEN 'HAMMER_LIKE' WHEN u >= 0.5 AND b <= 0.35 THEN 'SHOOTING_STAR_LIKE' WHEN b >= 0.85 THEN 'MARUBOZU_LIKE' ELSE 'STANDARD' END AS family,
      CASE WHEN volume_ratio >= 2 THEN 'HIGH_VOLUME' WHEN volume_ratio >= 1.25 THEN 'ABOVE_AVERAGE_VOLUME' WHEN volume_ratio <= 0.5 THEN 'LOW_VOLUME' WHEN volume_ratio <= 0.8 THEN 'BELOW_AVERAGE_VOLUME' ELSE 'NORMAL_VOLUME' END AS volume_state,
      CASE WHEN range_ratio20 >= 1.75 THEN 'VOLATILITY_EXPANSION' WHEN range_ratio20 <= 0.6 THEN 'VOLATILITY_COMPRESSION' WHEN range_ratio20 >= 1.25 THEN 'ELEVATED_VOLATILITY' WHEN range_ratio20 <= 0.8 THEN 'LOW_VOLATILITY' ELSE 'NORMAL_VOLATILITY' END AS volatility_state,
      CASE WHEN location20 >= 0.8 THEN 'NEAR_RANGE_HIGH' WHEN location20 >= 0.6 THEN 'UPPER_RANGE' WHEN location20 <= 0.2 THEN 'NEAR_RANGE_LOW' WHEN location20 <= 0.4 THEN 'LOWER_RANGE' ELSE 'MID_RANGE' END AS location_state FROM class0""",
    "lang0": f"SELECT *, avg(range) {rows('20 PRECEDING', '1 PRECEDING')} AS mr, avg(body) {rows('20 PRECEDING', '1 PRECEDING')} AS mb FROM anatomy",
    "lang1": """SELECT *, CASE WHEN mb > 0 THEN body / mb ELSE 1.0 END AS br, CASE WHEN mr > 0 THEN range / mr ELSE 1.0 END AS rr,
      CASE WHEN (body = 0 OR lower / nullif(body, 0) >= 2) AND lower > upper * 1.25 THEN 'long_lower_rejection' WHEN (body = 0 OR upper / nullif(body, 0) >= 2) AND upper > lower * 1.25 THEN 'long_upper_rejection'
           WHEN body_share <= 0.12 THEN 'doji_like' WHEN upper <= range * 0.08 AND lower <= range * 0.08 THEN 'marubozu_like' ELSE 'balanced' END AS wick_profile FROM lang0""",
    "lang2": "SELECT *, CASE WHEN br >= 1.5 THEN 'large' WHEN br <= 0.6 THEN 'small' ELSE 'medium' END AS body_size, CASE WHEN rr >= 1.5 THEN 'expansion' WHEN rr <= 0.6 THEN 'compression' ELSE 'normal' END AS range_size FROM lang1",
    "language": """SELECT *, coalesce(nullif(concat_ws('+', CASE WHEN range_size <> 'normal' THEN range_size END, CASE WHEN wick_profile LIKE '%rejection%' THEN 'rejection' END, CASE WHEN body_size = 'large' AND range_size = 'expansion' THEN 'momentum' END), ''), 'ordinary') AS behaviours,
      concat_ws(', ', CASE direction WHEN 'UP' THEN 'buying pressure' WHEN 'DOWN' THEN 'selling pressure' ELSE 'short-term hesitation' END, body_size || ' body', replace(wick_profile, '_', ' ')) AS sentence FROM lang2""",
    "ind0": f"SELECT *, close - lag(close) {LAG} AS change, avg(close) {back(49)} AS sma50, avg(range_atr) {back(49)} AS mean_atr FROM feat",
    "ind1": f"SELECT *, avg(CASE WHEN change IS NOT NULL THEN greatest(change, 0.0) END) {back(13)} AS gain, avg(CASE WHEN change IS NOT NULL THEN greatest(-change, 0.0) END) {back(13)} AS loss FROM ind0",
    "indicators": f"""SELECT *, CASE WHEN gain IS NULL OR (gain = 0 AND loss = 0) THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi,
      CASE WHEN idx >= 10 THEN {div(f'close - lag(close, 10) {LAG}', f'lag(close, 10) {LAG}')} * 100 ELSE 0.0 END AS momentum,
      CASE WHEN range_atr > mean_atr * 1.25 THEN 'HIGH' WHEN range_atr < mean_atr * 0.75 THEN 'LOW' ELSE 'NORMAL' END AS atr_regime,
      CASE WHEN close > sma20 AND sma20 > sma50 THEN 'BULLISH' WHEN close < sma20 AND sma20 < sma50 THEN 'BEARISH' ELSE 'NEUTRAL' END AS ma_bias FROM ind1""",
    "ema": """SELECT series_id, idx, close, close AS f, close AS s, CAST(0 AS DOUBLE) AS sig FROM bars WHERE idx = 0 UNION ALL
      SELECT b.series_id, b.idx, b.close, e.f + 2.0 / 13 * (b.close - e.f), e.s + 2.0 / 27 * (b.close - e.s),
             e.sig + 2.0 / 10 * ((e.f + 2.0 / 13 * (b.close - e.f)) - (e.s + 2.0 / 27 * (b.close - e.s)) - e.sig) FROM ema e JOIN bars b ON b.series_id = e.series_id AND b.idx = e.idx + 1""",
    "macd": "SELECT *, CASE WHEN histogram > 1e-9 THEN 'BULLISH' WHEN histogram < -1e-9 THEN 'BEARISH' ELSE 'NEUTRAL' END AS state FROM (SELECT series_id, idx, f - s AS macd, sig AS signal, f - s - sig AS histogram FROM ema)",
    "isl": f"SELECT *, sum(new) {ALL} AS island FROM (SELECT *, CASE WHEN direction = lag(direction) {LAG} THEN 0 ELSE 1 END AS new FROM anatomy)",
    "streaks": "SELECT *, streak * CASE direction WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END AS signed_streak, CASE WHEN streak >= 5 THEN 1 ELSE 0 END AS exhausted FROM (SELECT *, row_number() OVER (PARTITION BY series_id, island ORDER BY idx) AS streak FROM isl)",
    "ctx0": f"""SELECT *, count(*) {back(59)} AS n60, count(*) FILTER (direction = 'UP') {back(59)} AS up60, count(*) FILTER (direction = 'DOWN') {back(59)} AS down60, first_value(close) {back(59)} AS first60,
      avg(body) {back(9)} AS body_recent, avg(body) {rows('19 PRECEDING', '10 PRECEDING')} AS body_before, sum(lower) {back(59)} AS lower60, sum(upper) {back(59)} AS upper60,
      count(*) FILTER (direction = 'UP') {back(4)} / count(*) {back(4)} AS up5, count(*) FILTER (direction = 'DOWN') {back(4)} / count(*) {back(4)} AS down5,
      max(high) {rows('5 PRECEDING', '1 PRECEDING')} AS high5, min(low) {rows('5 PRECEDING', '1 PRECEDING')} AS low5 FROM anatomy""",
    "context": f"""SELECT *, (up60 - down60) / n60 AS imbalance, {div('close - first60', 'first60')} * 100 AS change60,
      CASE WHEN body_recent > body_before * 1.1 THEN 'rising' WHEN body_recent < body_before * 0.9 THEN 'falling' ELSE 'steady' END AS body_momentum,
      CASE WHEN lower60 > upper60 * 1.1 THEN 'lower' WHEN upper60 > lower60 * 1.1 THEN 'upper' ELSE 'balanced' END AS rejection,
      CASE WHEN up5 >= 0.7 THEN 'BUYING' WHEN down5 >= 0.7 THEN 'SELLING' ELSE 'MIXED' END AS pressure,
      CASE WHEN high5 IS NULL THEN 'NONE' WHEN close > high5 THEN 'BREAK_UP' WHEN close < low5 THEN 'BREAK_DOWN' WHEN high > high5 THEN 'FAILED_UP' WHEN low < low5 THEN 'FAILED_DOWN' ELSE 'INSIDE' END AS break_state FROM ctx0""",
    "lev0": f"""SELECT *, CASE WHEN idx >= 20 THEN max(high) {rows('20 PRECEDING', '1 PRECEDING')} END AS prior_high, CASE WHEN idx >= 20 THEN min(low) {rows('20 PRECEDING', '1 PRECEDING')} END AS prior_low,
      CASE WHEN idx >= 9 THEN avg(close) {back(9)} END AS mean10, CASE WHEN idx >= 19 THEN avg(close) {back(19)} END AS mean20, CASE WHEN idx >= 49 THEN avg(close) {back(49)} END AS mean50 FROM feat""",
    "lev1": "SELECT *, CASE WHEN close > prior_high THEN 1 WHEN close < prior_low THEN -1 END AS broke FROM lev0",
    "levels": f"""SELECT *, CASE WHEN broke IS NULL THEN 'NONE' WHEN broke * coalesce(last_value(broke IGNORE NULLS) {BEFORE}, 0) < 0 THEN 'CHOCH' ELSE 'BOS' END AS break_event,
      CASE WHEN low < prior_low AND close > prior_low THEN 'LOW' WHEN high > prior_high AND close < prior_high THEN 'HIGH' ELSE 'NONE' END AS sweep, CASE WHEN body >= 1.5 * unit THEN direction ELSE 'NONE' END AS displacement,
      CAST(coalesce(sign(close - mean10), 0) + coalesce(sign(close - mean20), 0) + coalesce(sign(close - mean50), 0) AS INTEGER) AS alignment, (prior_high - close) / unit AS high_distance, (close - prior_low) / unit AS low_distance FROM lev1""",
    "steps": f"SELECT series_id, idx, coalesce({div(f'close - lag(close) {LAG}', 'unit')}, 0.0) AS p_change, {div('range', 'unit')} AS p_range, sign(close - open) AS p_direction, {div('body', 'unit')} AS p_body FROM feat",
    "path_rows": """SELECT a.series_id, a.idx, k.k, coalesce(b.p_change, 0.0) AS p_change, coalesce(b.p_range, 0.0) AS p_range, coalesce(b.p_direction, 0) AS p_direction, coalesce(b.p_body, 0.0) AS p_body
      FROM steps a CROSS JOIN (SELECT unnest(range(12)) AS k) k LEFT JOIN steps b ON b.series_id = a.series_id AND b.idx = a.idx - 11 + k.k""",
    "path_shown": "SELECT series_id, idx, k, " + ", ".join(f"greatest(least(p_{n}, 1e6), -1e6) AS p_{n}" for n in ("change", "range", "direction", "body")) + " FROM path_rows",
    "pat0": f"""SELECT *, avg(range) OVER (PARTITION BY series_id) AS mean_range, lag(open) {LAG} AS o1, lag(high) {LAG} AS h1, lag(low) {LAG} AS l1, lag(close) {LAG} AS c1, lag(body) {LAG} AS b1, lag(range) {LAG} AS g1, lag(open, 2) {LAG} AS o2, lag(close, 2) {LAG} AS c2 FROM anatomy""",
    "pat1": """SELECT series_id, idx, direction, close, unnest([
      CASE WHEN range > 0 AND body <= range * 0.1 THEN 'DOJI' END, CASE WHEN range > 0 AND lower >= body * 2 AND upper <= greatest(body * 0.75, range * 0.1) AND body <= range * 0.4 THEN 'HAMMER' END,
      CASE WHEN range > 0 AND upper >= body * 2 AND lower <= greatest(body * 0.75, range * 0.1) AND body <= range * 0.4 THEN 'SHOOTING_STAR' END, CASE WHEN range > 0 AND body <= range * 0.35 AND upper >= range * 0.2 AND lower >= range * 0.2 THEN 'SPINNING_TOP' END,
      CASE WHEN range > 0 AND close > open AND body >= range * 0.8 AND upper <= range * 0.1 AND lower <= range * 0.1 THEN 'BULLISH_MARUBOZU' END, CASE WHEN range > 0 AND close < open AND body >= range * 0.8 AND upper <= range * 0.1 AND lower <= range * 0.1 THEN 'BEARISH_MARUBOZU' END,
      CASE WHEN range > 0 AND range >= mean_range * 1.5 THEN 'RANGE_EXPANSION' END,
      CASE WHEN c1 < o1 AND close > open AND open <= c1 AND close >= o1 THEN 'BULLISH_ENGULFING' END, CASE WHEN c1 > o1 AND close < open AND open >= c1 AND close <= o1 THEN 'BEARISH_ENGULFING' END,
      CASE WHEN c1 < o1 AND close > open AND open >= c1 AND close <= o1 THEN 'BULLISH_HARAMI' END, CASE WHEN c1 > o1 AND close < open AND open <= c1 AND close >= o1 THEN 'BEARISH_HARAMI' END,
      CASE WHEN high <= h1 AND low >= l1 THEN 'INSIDE_BAR' END, CASE WHEN high >= h1 AND low <= l1 THEN 'OUTSIDE_BAR' END,
      CASE WHEN c2 < o2 AND b1 <= g1 * 0.35 AND close > open AND close > (o2 + c2) / 2 THEN 'MORNING_STAR' END, CASE WHEN c2 > o2 AND b1 <= g1 * 0.35 AND close < open AND close < (o2 + c2) / 2 THEN 'EVENING_STAR' END,
      CASE WHEN c2 > o2 AND c1 > o1 AND close > open AND c1 > c2 AND close > c1 THEN 'THREE_WHITE_SOLDIERS' END, CASE WHEN c2 < o2 AND c1 < o1 AND close < open AND c1 < c2 AND close < c1 THEN 'THREE_BLACK_CROWS' END]) AS pattern FROM pat0""",
    "patterns": "SELECT series_id, idx, direction, pattern FROM pat1 WHERE pattern IS NOT NULL",
    "pev0": f"SELECT series_id, idx, close, count(*) FILTER (direction = 'UP') {rows('5 PRECEDING', '1 PRECEDING')} AS ub, count(*) FILTER (direction = 'DOWN') {rows('5 PRECEDING', '1 PRECEDING')} AS db, lead(close, 3) {LAG} AS later FROM anatomy",
    "pattern_eval": """SELECT pattern, count(*) AS n, count(*) FILTER (ub > db) AS n_after_up, count(*) FILTER (db > ub) AS n_after_down, count(*) FILTER (later > close) AS n_higher, count(*) FILTER (later < close) AS n_lower, count(*) FILTER (later IS NULL) AS n_pending
      FROM patterns JOIN pev0 USING (series_id, idx) GROUP BY 1""",
    "piv": f"SELECT *, {_pivots(3, 3, '>')} FROM feat",
    "swings": f"SELECT *, {_MARK} FROM piv",
    "st0": f"SELECT *, {_CARRY} FROM swings",
    "st1": "SELECT *, CASE WHEN idx > high_seen AND close > last_high THEN 1 ELSE 0 END AS over_high, CASE WHEN idx > low_seen AND close < last_low THEN 1 ELSE 0 END AS under_low FROM st0",
    "st2": """SELECT *, over_high = 1 AND sum(over_high) OVER (PARTITION BY series_id, high_seen ORDER BY idx ROWS UNBOUNDED PRECEDING) = 1 AS broke_up,
      under_low = 1 AND sum(under_low) OVER (PARTITION BY series_id, low_seen ORDER BY idx ROWS UNBOUNDED PRECEDING) = 1 AS broke_down FROM st1""",
    "st3": "SELECT *, CASE WHEN broke_down THEN 'BEARISH' WHEN broke_up THEN 'BULLISH' END AS turn FROM st2",
    "st4": f"SELECT *, coalesce(last_value(turn IGNORE NULLS) {ALL}, 'NEUTRAL') AS trend, coalesce(last_value(turn IGNORE NULLS) {BEFORE}, 'NEUTRAL') AS trend_before, last_value(CASE WHEN turn IS NOT NULL THEN idx END IGNORE NULLS) {ALL} AS event_index FROM st3",
    "structure": """SELECT *, CASE WHEN broke_up THEN CASE WHEN trend_before = 'BEARISH' THEN 'CHoCH_BULLISH' ELSE 'BOS_BULLISH' END WHEN broke_down THEN CASE WHEN trend_before = 'BULLISH' THEN 'CHoCH_BEARISH' ELSE 'BOS_BEARISH' END ELSE 'NONE' END AS event,
      idx - event_index AS event_age, idx - coalesce(event_index, 0) AS structure_age FROM st4""",
    "spiv": f"SELECT *, {_pivots(2, 2, '>=')} FROM bars",
    "smark": f"SELECT *, {_MARK} FROM spiv",
    "scar": f"SELECT *, {_CARRY} FROM smark",
    "simple": """SELECT *, CASE event WHEN 'BOS_BULLISH' THEN 'bullish' WHEN 'BOS_BEARISH' THEN 'bearish' ELSE CASE WHEN high_label = 'HH' AND low_label = 'HL' THEN 'bullish' WHEN high_label = 'LH' AND low_label = 'LL' THEN 'bearish' ELSE 'range' END END AS trend FROM (
      SELECT *, CASE WHEN idx > high_seen AND close > last_high THEN 'BOS_BULLISH' WHEN idx > low_seen AND close < last_low THEN 'BOS_BEARISH' ELSE 'NONE' END AS event FROM scar)""",
    "ms0": f"SELECT *, lag(close) {LAG} AS k1, lag(close, 2) {LAG} AS k2 FROM structure",
    "ms1": """SELECT *, CASE WHEN abs(close - last_low) <= unit THEN 'NEAR_SUPPORT' WHEN abs(close - last_high) <= unit THEN 'NEAR_RESISTANCE' ELSE 'MID_STRUCTURE' END AS location,
      CASE WHEN volatility_ratio >= 1.35 THEN 'VOL_EXPANSION' WHEN volatility_ratio <= 0.75 THEN 'VOL_CONTRACTION' WHEN trend = 'BULLISH' AND r8 > 0 THEN 'TRENDING_UP' WHEN trend = 'BEARISH' AND r8 < 0 THEN 'TRENDING_DOWN' WHEN trend = 'NEUTRAL' THEN 'RANGING' ELSE 'TRANSITION' END AS regime,
      CASE WHEN r1 > 0 AND r3 > 0 AND r8 > 0 THEN 'BULLISH_ACCELERATION' WHEN r1 < 0 AND r3 < 0 AND r8 < 0 THEN 'BEARISH_ACCELERATION' WHEN r8 > 0 AND r1 < 0 THEN 'BULLISH_MOMENTUM_LOSS' WHEN r8 < 0 AND r1 > 0 THEN 'BEARISH_MOMENTUM_LOSS' ELSE 'MIXED' END AS momentum,
      CASE WHEN idx < 2 THEN 'INITIAL' WHEN event LIKE '%BULLISH' THEN 'BULLISH_BREAK' WHEN event LIKE '%BEARISH' THEN 'BEARISH_BREAK' WHEN close > k1 AND k1 <= k2 THEN 'BULLISH_RESPONSE' WHEN close < k1 AND k1 >= k2 THEN 'BEARISH_RESPONSE'
           WHEN body < 0.25 * greatest(range, 1e-12) THEN 'COMPRESSION' WHEN trend = 'BULLISH' THEN 'RECOVERY_OR_CONTINUATION' WHEN trend = 'BEARISH' THEN 'SELLING_OR_CONTINUATION' ELSE 'MIXED_SEQUENCE' END AS sequence FROM ms0""",
    "states": "SELECT *, concat_ws('|', trend, event, high_label, low_label, location, regime, momentum, sequence) AS state_key FROM ms1",
    "ep0": f"SELECT *, CASE WHEN idx > 0 AND (trend <> lag(trend) {LAG} OR regime <> lag(regime) {LAG} OR sequence <> lag(sequence) {LAG} OR event <> 'NONE') THEN 1 ELSE 0 END AS changed FROM states",
    "ep1": f"SELECT *, sum(changed) {ALL} AS run FROM ep0",
    "ep2": "SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY idx) - 1 AS off FROM ep1",
    "episodes": f"SELECT *, CAST(sum(CASE WHEN changed = 1 OR (off > 0 AND off % 8 = 0) THEN 1 ELSE 0 END) {ALL} AS BIGINT) AS episode FROM ep2",
    "rr0": f"SELECT *, lag(regime) {LAG} AS rb, CASE WHEN regime <> lag(regime) {LAG} THEN 1 ELSE 0 END AS new FROM states",
    "rr1": f"SELECT *, sum(new) {ALL} AS island FROM rr0",
    "regime_runs": f"SELECT *, row_number() OVER (PARTITION BY series_id, island ORDER BY idx) AS persistence, 1 - avg(new) {back(19)} AS stability, CASE WHEN new = 1 THEN rb || '>' || regime ELSE 'NONE' END AS transition FROM rr1",
    "zt": "SELECT series_id, avg(range_atr) * 0.6 AS tol FROM swings GROUP BY 1",
    "zp": "SELECT series_id, price FROM (SELECT series_id, unnest([pivot_high, pivot_low]) AS price FROM swings) WHERE price IS NOT NULL",
    "zn": "SELECT series_id, price, CASE WHEN price - lag(price) OVER (PARTITION BY series_id ORDER BY price) <= tol THEN 0 ELSE 1 END AS new FROM zp JOIN zt USING (series_id)",
    "zz": "SELECT series_id, price, sum(new) OVER (PARTITION BY series_id ORDER BY price RANGE UNBOUNDED PRECEDING) AS zone FROM zn",
    "zones": """SELECT z.series_id, CAST(zone AS BIGINT) AS zone, zl AS zone_low, zh AS zone_high, np AS n_pivots, count(*) AS n_touches, count(*) FILTER (close > zh OR close < zl) AS n_rejections, max(idx) AS last_touch
      FROM (SELECT series_id, zone, min(price) AS zl, max(price) AS zh, count(*) AS np FROM zz GROUP BY 1, 2) z JOIN bars b ON b.series_id = z.series_id AND low <= zh AND high >= zl GROUP BY ALL""",
    "oh": "SELECT unnest([4, 8, 16]) AS horizon",
    "oo0": """SELECT f.series_id, f.idx, f.close, f.atr, h.horizon, t.close AS future, max(n.high) AS fh, min(n.low) AS fl, first(n.idx - f.idx ORDER BY n.high DESC, n.idx) AS th, first(n.idx - f.idx ORDER BY n.low, n.idx) AS tl
      FROM feat f CROSS JOIN oh h LEFT JOIN bars t ON t.series_id = f.series_id AND t.idx = f.idx + h.horizon LEFT JOIN bars n ON n.series_id = f.series_id AND n.idx > f.idx AND n.idx <= f.idx + h.horizon GROUP BY ALL""",
    "oo1": f"SELECT *, future - close AS change, future IS NOT NULL AND atr IS NOT NULL AS complete, {div('future - close', 'atr')} AS atr_return, {div('future - close', 'close')} AS raw_return FROM oo0",
    "outcomes": f"""SELECT *, CASE WHEN complete THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS quality, CASE WHEN complete THEN CASE WHEN atr_return > 0.25 THEN 'UP' WHEN atr_return < -0.25 THEN 'DOWN' ELSE 'NEUTRAL' END END AS direction,
      CASE WHEN future IS NOT NULL THEN CASE WHEN change > greatest(close * 0.001, 1e-9) THEN 'bullish' WHEN -change > greatest(close * 0.001, 1e-9) THEN 'bearish' ELSE 'neutral' END END AS price_direction,
      CASE WHEN complete THEN {div('fh - close', 'atr')} END AS mfe_atr, CASE WHEN complete THEN {div('fl - close', 'atr')} END AS mae_atr, CASE WHEN complete THEN th END AS time_to_high, CASE WHEN complete THEN tl END AS time_to_low FROM oo1""",
    "distribution": """SELECT series_id, horizon, count(*) AS n, avg(CASE WHEN direction = 'UP' THEN 1.0 ELSE 0.0 END) AS up, avg(CASE WHEN direction = 'DOWN' THEN 1.0 ELSE 0.0 END) AS down, avg(CASE WHEN direction = 'NEUTRAL' THEN 1.0 ELSE 0.0 END) AS neutral,
      avg(raw_return) AS mean_return, quantile_cont(raw_return, 0.5) AS median_return, avg(mfe_atr) AS mean_mfe, avg(mae_atr) AS mean_mae FROM outcomes WHERE complete GROUP BY 1, 2""",
    "thresholds_all": """SELECT *, 100.0 * (n_up + n_down) / n - 20.0 * abs(n_up - n_down) / greatest(n_up + n_down, 1) AS score FROM (SELECT horizon, threshold, count(*) FILTER (atr_return > threshold) AS n_up, count(*) FILTER (atr_return < -threshold) AS n_down, count(*) AS n
      FROM outcomes CROSS JOIN (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS threshold) WHERE complete GROUP BY 1, 2)""",
    "wins": """SELECT series_id, w AS window_no, n - 5 * s + w * s AS oos_start, n - 5 * s + w * s + s AS oos_end FROM (SELECT series_id, count(*) AS n, least(81, count(*) // 10) AS s FROM bars GROUP BY 1) CROSS JOIN (SELECT unnest(range(5)) AS w) WHERE s > 0""",
    "exper": """SELECT e.series_id, e.idx, e.trend, e.event, e.high_label, e.low_label, e.location, e.regime, e.momentum, e.sequence, e.state_key, e.episode, e.volatility_ratio, e.r1, e.r3, e.r8, e.r16, e.direction AS candle_direction, e.body / e.unit AS body_ratio, e.range / e.unit AS range_ratio,
      o.horizon, o.direction, o.raw_return, o.atr_return, o.mfe_atr, o.mae_atr FROM episodes e JOIN outcomes o USING (series_id, idx)""",
    "tests": "SELECT * FROM exper JOIN wins USING (series_id) WHERE idx >= oos_start AND idx < oos_end",
    "train": "SELECT * FROM exper JOIN wins USING (series_id) WHERE idx + horizon < oos_start AND direction IS NOT NULL",
    "frequency": """SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n_states, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT series_id, state_key, count(*) AS n FROM states GROUP BY 1, 2) GROUP BY 1""",
    "baseline": """SELECT *, CASE WHEN s > 0 THEN u / s ELSE 1.0 / 3 END AS p_up, CASE WHEN s > 0 THEN d / s ELSE 1.0 / 3 END AS p_down, CASE WHEN s > 0 THEN z / s ELSE 1.0 / 3 END AS p_neutral, s AS support FROM (
      SELECT *, CASE level WHEN 'GLOBAL' THEN gn WHEN 'REGIME' THEN rn ELSE xn END AS s, CASE level WHEN 'GLOBAL' THEN gu WHEN 'REGIME' THEN ru ELSE xu END AS u, CASE level WHEN 'GLOBAL' THEN gd WHEN 'REGIME' THEN rd ELSE xd END AS d, CASE level WHEN 'GLOBAL' THEN gz WHEN 'REGIME' THEN rz ELSE xz END AS z FROM (
        SELECT *, CASE WHEN xn >= 12 THEN 'REGIME+EVENT+SEQUENCE' WHEN rn >= 12 THEN 'REGIME' ELSE 'GLOBAL' END AS level FROM (
          SELECT t.series_id, t.window_no, t.horizon, t.idx, t.direction, count(r.idx) AS gn, count(r.idx) FILTER (r.direction = 'UP') AS gu, count(r.idx) FILTER (r.direction = 'DOWN') AS gd, count(r.idx) FILTER (r.direction = 'NEUTRAL') AS gz,
            count(r.idx) FILTER (r.regime = t.regime) AS rn, count(r.idx) FILTER (r.regime = t.regime AND r.direction = 'UP') AS ru, count(r.idx) FILTER (r.regime = t.regime AND r.direction = 'DOWN') AS rd, count(r.idx) FILTER (r.regime = t.regime AND r.direction = 'NEUTRAL') AS rz,
            count(r.idx) FILTER (r.regime = t.regime AND r.event = t.event AND r.sequence = t.sequence) AS xn, count(r.idx) FILTER (r.regime = t.regime AND r.event = t.event AND r.sequence = t.sequence AND r.direction = 'UP') AS xu,
            count(r.idx) FILTER (r.regime = t.regime AND r.event = t.event AND r.sequence = t.sequence AND r.direction = 'DOWN') AS xd, count(r.idx) FILTER (r.regime = t.regime AND r.event = t.event AND r.sequence = t.sequence AND r.direction = 'NEUTRAL') AS xz
          FROM tests t LEFT JOIN train r ON r.series_id = t.series_id AND r.window_no = t.window_no AND r.horizon = t.horizon GROUP BY ALL)))""",
    "hier": """SELECT *, 1 - p_up - p_down AS p_neutral FROM (SELECT *, (eu + 20.0 * (ku + 20.0 * (gu + 1) / (gn + 3)) / (kn + 20.0)) / (en + 20.0) AS p_up, (ed + 20.0 * (kd + 20.0 * (gd + 1) / (gn + 3)) / (kn + 20.0)) / (en + 20.0) AS p_down FROM (
      SELECT t.series_id, t.window_no, t.horizon, t.idx, t.direction, count(r.idx) AS gn, count(r.idx) FILTER (r.direction = 'UP') AS gu, count(r.idx) FILTER (r.direction = 'DOWN') AS gd,
        count(r.idx) FILTER (r.trend = t.trend AND r.regime = t.regime AND r.momentum = t.momentum AND r.location = t.location) AS kn, count(r.idx) FILTER (r.trend = t.trend AND r.regime = t.regime AND r.momentum = t.momentum AND r.location = t.location AND r.direction = 'UP') AS ku,
        count(r.idx) FILTER (r.trend = t.trend AND r.regime = t.regime AND r.momentum = t.momentum AND r.location = t.location AND r.direction = 'DOWN') AS kd,
        count(r.idx) FILTER (r.state_key = t.state_key) AS en, count(r.idx) FILTER (r.state_key = t.state_key AND r.direction = 'UP') AS eu, count(r.idx) FILTER (r.state_key = t.state_key AND r.direction = 'DOWN') AS ed
      FROM tests t LEFT JOIN train r ON r.series_id = t.series_id AND r.window_no = t.window_no AND r.horizon = t.horizon GROUP BY ALL))""",
    "unseen": "SELECT * FROM tests t WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.series_id = t.series_id AND r.window_no = t.window_no AND r.horizon = t.horizon AND r.state_key = t.state_key)",
    "seen": "SELECT * FROM tests t WHERE EXISTS (SELECT 1 FROM train r WHERE r.series_id = t.series_id AND r.window_no = t.window_no AND r.horizon = t.horizon AND r.state_key = t.state_key)",
}
_facts = ", ".join(f"'{f}=' || {f}" for f in ("trend", "event", "high_label", "low_label", "location", "regime", "momentum", "sequence"))
CTES |= {
    f"{which}_rules": f"""SELECT series_id, idx, horizon, window_no, direction, a AS rule FROM (SELECT *, unnest([{_facts}]) AS a FROM {source}) UNION ALL
      SELECT * FROM (SELECT series_id, idx, horizon, window_no, direction, a || ' & ' || b FROM (SELECT *, unnest([{_facts}]) AS b FROM (SELECT *, unnest([{_facts}]) AS a FROM {source})) WHERE a < b)"""
    for which, source in (("train", "train"), ("test", "tests"))
}
_d = "CASE says WHEN 'UP' THEN bu WHEN 'DOWN' THEN bd ELSE bz END"
_best = "greatest(up, down, neutral)"
CTES |= {
    "rbase": "SELECT horizon, window_no, avg(CASE WHEN direction = 'UP' THEN 1.0 ELSE 0.0 END) AS bu, avg(CASE WHEN direction = 'DOWN' THEN 1.0 ELSE 0.0 END) AS bd, avg(CASE WHEN direction = 'NEUTRAL' THEN 1.0 ELSE 0.0 END) AS bz FROM train GROUP BY 1, 2",
    "rules": f"""SELECT *, confidence / ({_d}) AS lift FROM (SELECT *, {_best} / n AS confidence, CASE WHEN up = {_best} THEN 'UP' WHEN down = {_best} THEN 'DOWN' ELSE 'NEUTRAL' END AS says FROM (
      SELECT horizon, window_no, rule, count(*) AS n, count(*) FILTER (direction = 'UP') AS up, count(*) FILTER (direction = 'DOWN') AS down, count(*) FILTER (direction = 'NEUTRAL') AS neutral FROM train_rules GROUP BY 1, 2, 3 HAVING count(*) >= 20)) JOIN rbase USING (horizon, window_no) WHERE confidence >= 0.45""",
    "rule_check": "SELECT horizon, window_no, rule, says, count(*) AS n_matches, count(*) FILTER (direction = says) AS n_hits FROM test_rules JOIN rules USING (horizon, window_no, rule) WHERE direction IS NOT NULL GROUP BY 1, 2, 3, 4",
    "rule_best": "SELECT series_id, idx, horizon, window_no, t.direction, rule, says, confidence FROM test_rules t JOIN rules USING (horizon, window_no, rule) QUALIFY row_number() OVER (PARTITION BY series_id, idx, horizon, window_no ORDER BY confidence DESC, n DESC, rule DESC) = 1",
    "rule_stable": "SELECT horizon, rule, count(DISTINCT window_no) AS n_windows, min(says) AS says, avg(confidence) AS mean_confidence FROM rules GROUP BY 1, 2 HAVING count(DISTINCT window_no) >= 3 AND count(DISTINCT says) = 1",
}
_FEATS = ("trend", "event", "high_label", "low_label", "location", "regime", "momentum", "sequence")
_W = {"structure": (0.20, 0.22, 0.24), "sequence": (0.16, 0.15, 0.13), "regime": (0.14, 0.16, 0.17), "location": (0.08, 0.08, 0.07), "momentum": (0.12, 0.10, 0.08), "volatility": (0.08, 0.08, 0.09), "candle": (0.06, 0.05, 0.04), "path": (0.16, 0.16, 0.18)}
_same = {f: f"CAST(q.{f} = h.{f} AS INTEGER)" for f in _FEATS}
CTES |= {
    "mp0": f"""SELECT q.series_id, q.window_no, q.horizon, q.idx, q.direction AS actual, q.oos_start, h.idx AS h_idx, h.episode, h.direction, h.atr_return, h.mfe_atr, h.mae_atr, {' + '.join(_same.values())} AS n_same,
      ({_same['trend']} + {_same['event']} + {_same['high_label']} + {_same['low_label']}) / 4 AS structure, {', '.join(f'{_same[f]} AS {f}' for f in ('sequence', 'regime', 'location', 'momentum', 'event'))},
      exp(-abs(q.volatility_ratio - h.volatility_ratio) / 0.35) AS volatility, 0.8 * (0.45 * exp(-abs(q.body_ratio - h.body_ratio) / 0.75) + 0.35 * exp(-abs(q.range_ratio - h.range_ratio) / 0.9)) + 0.2 * CAST(q.candle_direction = h.candle_direction AS INTEGER) AS candle
      FROM tests q JOIN exper h ON h.series_id = q.series_id AND h.horizon = q.horizon AND h.direction IS NOT NULL AND h.idx + h.horizon < q.oos_start AND h.idx <= q.idx - 16""",
    "mp1": "SELECT * FROM (SELECT *, count(*) FILTER (n_same >= 2) OVER qw AS ns, count(*) FILTER (n_same >= 1) OVER qw AS nr FROM mp0 WINDOW qw AS (PARTITION BY series_id, window_no, horizon, idx)) WHERE n_same >= CASE WHEN ns >= 12 THEN 2 WHEN nr >= 12 THEN 1 ELSE 0 END",
    "pcum": "SELECT a.series_id, a.idx, a.k, a.p_change, a.p_range, a.p_direction, a.p_body, sum(b.p_change ORDER BY b.k) AS p_total FROM path_rows a JOIN path_rows b ON b.series_id = a.series_id AND b.idx = a.idx AND b.k <= a.k GROUP BY ALL",
    "mpp": f"""SELECT a.series_id, a.idx, b.idx AS h_idx, sum((0.4 * exp(-abs(a.p_change - b.p_change) / 0.65) + 0.25 * exp(-abs(a.p_total - b.p_total) / 1.25) + 0.2 * (0.65 * exp(-abs(a.p_range - b.p_range) / 0.8) + 0.35 * exp(-abs(a.p_body - b.p_body) / 0.7))
        + CASE WHEN a.p_direction = b.p_direction THEN 0.15 ELSE 0.0 END) * power(0.86, 11 - a.k)) / {sum(0.86 ** k for k in range(12))} AS path
      FROM (SELECT DISTINCT series_id, idx, h_idx FROM mp1) m JOIN pcum a ON a.series_id = m.series_id AND a.idx = m.idx JOIN pcum b ON b.series_id = m.series_id AND b.idx = m.h_idx AND b.k = a.k GROUP BY 1, 2, 3""",
    "mp2": f"""SELECT *, ({' + '.join(f'(CASE horizon WHEN 4 THEN {w[0]} WHEN 8 THEN {w[1]} ELSE {w[2]} END) * {n}' for n, w in _W.items())}) * (0.75 + 0.25 * (0.55 * ({' + '.join(f'CAST({n} > 0 AS INTEGER)' for n in _W)}) / 8 + 0.45 * greatest(structure, sequence, regime))) AS similarity
      FROM mp1 JOIN mpp USING (series_id, idx, h_idx)""",
    "matches": "SELECT * FROM mp2 WHERE similarity >= 0.42 AND NOT ((regime = 0 OR (event = 0 AND structure < 0.25) OR sequence = 0 OR momentum = 0) AND similarity < 0.6)",
    "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, window_no, horizon, idx ORDER BY similarity DESC, h_idx DESC) AS k FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY series_id, window_no, horizon, idx, episode ORDER BY similarity DESC, h_idx DESC) = 1)) WHERE k <= 16",
    "sizes": "SELECT series_id, window_no, horizon, idx, least(16, count(*)) AS lim FROM matches GROUP BY ALL",
    "fill": f"""SELECT series_id, window_no, horizon, idx, list(h_idx) AS sel, any_value(lim) AS lim FROM firsts JOIN sizes USING (series_id, window_no, horizon, idx) GROUP BY 1, 2, 3, 4 UNION ALL
      SELECT series_id, window_no, horizon, idx, list_append(any_value(sel), arg_max(h_idx, struct_pack(a := score, b := similarity, c := h_idx))) AS sel, any_value(lim) AS lim FROM (
        SELECT r.series_id, r.window_no, r.horizon, r.idx, r.sel, r.lim, m.h_idx, m.similarity, round(0.78 * m.similarity - 0.22 * max(1 - ({' + '.join(f'abs(m.{n} - s.{n})' for n in _W)}) / 8), 9) AS score
        FROM fill r JOIN matches m USING (series_id, window_no, horizon, idx) JOIN matches s USING (series_id, window_no, horizon, idx)
        WHERE len(r.sel) < r.lim AND NOT list_contains(r.sel, m.h_idx) AND list_contains(r.sel, s.h_idx) GROUP BY r.series_id, r.window_no, r.horizon, r.idx, r.sel, r.lim, m.h_idx, m.similarity) GROUP BY 1, 2, 3, 4""",
    "whole": "SELECT series_id, window_no, horizon, idx, sel FROM fill WHERE len(sel) = lim",
    "top": "SELECT m.*, row_number() OVER (PARTITION BY m.series_id, m.window_no, m.horizon, m.idx ORDER BY similarity DESC, h_idx DESC) AS rank FROM matches m JOIN whole w USING (series_id, window_no, horizon, idx) WHERE list_contains(w.sel, m.h_idx)",
    "shares": """SELECT series_id, window_no, horizon, idx, actual, count(*) AS n, max(similarity) AS best, sum(CASE WHEN direction = 'UP' THEN similarity ELSE 0 END) / sum(similarity) AS share_up, sum(CASE WHEN direction = 'DOWN' THEN similarity ELSE 0 END) / sum(similarity) AS share_down,
      sum(CASE WHEN direction = 'NEUTRAL' THEN similarity ELSE 0 END) / sum(similarity) AS share_neutral, sum(similarity * atr_return) / sum(similarity) AS mean_return, sum(similarity * mfe_atr) / sum(similarity) AS mean_mfe, sum(similarity * mae_atr) / sum(similarity) AS mean_mae FROM top GROUP BY 1, 2, 3, 4, 5""",
    "de0": "SELECT series_id, window_no, horizon, idx, actual, direction, CASE WHEN count(*) >= 2 THEN avg(exp(-(1 - similarity) / 0.1)) * (1 - exp(-count(*) / 6.0)) ELSE 0.0 END AS e FROM top GROUP BY ALL",
    "de1": "SELECT series_id, window_no, horizon, idx, actual, sum(e) AS t, sum(CASE WHEN direction = 'UP' THEN e ELSE 0 END) AS u, sum(CASE WHEN direction = 'DOWN' THEN e ELSE 0 END) AS d, sum(CASE WHEN direction = 'NEUTRAL' THEN e ELSE 0 END) AS z FROM de0 GROUP BY ALL",
    "de2": "SELECT *, CASE WHEN t > 1e-12 THEN u / t ELSE 1.0 / 3 END AS p_up, CASE WHEN t > 1e-12 THEN d / t ELSE 1.0 / 3 END AS p_down, CASE WHEN t > 1e-12 THEN z / t ELSE 1.0 / 3 END AS p_neutral FROM de1",
    "de3": "SELECT *, greatest(p_up, p_down, p_neutral) AS best, p_up + p_down + p_neutral - greatest(p_up, p_down, p_neutral) - least(p_up, p_down, p_neutral) AS second FROM de2",
    "de4": "SELECT *, best - second AS margin, CASE WHEN best < 0.42 THEN 'LOW_PROBABILITY' WHEN best - second < 0.08 THEN 'LOW_MARGIN' ELSE 'SUPPORTED' END AS reason FROM de3",
    "decisions": "SELECT *, CASE WHEN reason = 'SUPPORTED' THEN CASE WHEN p_up = best THEN 'UP' WHEN p_neutral = best THEN 'NEUTRAL' ELSE 'DOWN' END ELSE 'NEUTRAL' END AS prediction FROM de4",
}
_V = ("r1", "r3", "r8", "r16", "volatility_ratio", "location20")
_dist = lambda a, b: "sqrt(" + " + ".join(f"power({a}z{k} - {b}z{k}, 2)" for k in range(len(_V))) + ")"
CTES |= {
    "vec": "SELECT o.series_id, o.idx, o.horizon, o.direction, window_no, oos_start, oos_end, " + ", ".join(_V) + " FROM outcomes o JOIN feat f USING (series_id, idx) JOIN wins USING (series_id)",
    "vscale": f"SELECT series_id, window_no, horizon, {', '.join(f'avg({v}) AS m_{v}, coalesce(nullif(stddev_samp({v}), 0), 1.0) AS s_{v}' for v in _V)} FROM vec WHERE idx + horizon < oos_start AND direction IS NOT NULL GROUP BY 1, 2, 3",
    "vz": f"SELECT series_id, window_no, horizon, idx, direction, oos_start, oos_end, {', '.join(f'({v} - m_{v}) / s_{v} AS z{k}' for k, v in enumerate(_V))} FROM vec JOIN vscale USING (series_id, window_no, horizon)",
    "vtrain": "SELECT * FROM vz WHERE idx + horizon < oos_start AND direction IS NOT NULL",
    "vtest": "SELECT * FROM vz WHERE idx >= oos_start AND idx < oos_end",
    "knn0": f"SELECT q.series_id, q.window_no, q.horizon, q.idx, q.direction, h.direction AS label, {_dist('q.', 'h.')} AS distance, h.idx AS h_idx FROM vtest q JOIN vtrain h ON h.series_id = q.series_id AND h.window_no = q.window_no AND h.horizon = q.horizon QUALIFY row_number() OVER (PARTITION BY q.series_id, q.window_no, q.horizon, q.idx ORDER BY distance, h.idx DESC) <= 25",
    "knn": "SELECT series_id, window_no, horizon, idx, direction, count(*) AS n, " + ", ".join(f"sum(CASE WHEN label = '{d}' THEN exp(-(distance - least) / 1.25) ELSE 0 END) / sum(exp(-(distance - least) / 1.25)) AS p_{d.lower()}" for d in ("UP", "DOWN", "NEUTRAL")) + " FROM (SELECT *, min(distance) OVER (PARTITION BY series_id, window_no, horizon, idx) AS least FROM knn0) GROUP BY 1, 2, 3, 4, 5",
    "cmean": f"SELECT series_id, window_no, horizon, direction AS label, {', '.join(f'avg(z{k}) AS z{k}' for k in range(len(_V)))} FROM vtrain GROUP BY 1, 2, 3, 4",
    "centroid": f"SELECT q.series_id, q.window_no, q.horizon, q.idx, q.direction, m.label AS prediction FROM vtest q JOIN cmean m ON m.series_id = q.series_id AND m.window_no = q.window_no AND m.horizon = q.horizon QUALIFY row_number() OVER (PARTITION BY q.series_id, q.window_no, q.horizon, q.idx ORDER BY {_dist('q.', 'm.')}, m.label) = 1",
    "online": """SELECT *, greatest(p_bullish, p_bearish, p_neutral) AS best, CASE WHEN p_bullish = greatest(p_bullish, p_bearish, p_neutral) THEN 'bullish' WHEN p_bearish = greatest(p_bullish, p_bearish, p_neutral) THEN 'bearish' ELSE 'neutral' END AS prediction FROM (
      SELECT *, (a + 1) / (support + 3) AS p_bullish, (b + 1) / (support + 3) AS p_bearish, (z + 1) / (support + 3) AS p_neutral FROM (
      SELECT q.series_id, q.idx, q.state_key, q.price_direction AS actual, count(h.idx) AS support, count(h.idx) FILTER (h.price_direction = 'bullish') AS a, count(h.idx) FILTER (h.price_direction = 'bearish') AS b, count(h.idx) FILTER (h.price_direction = 'neutral') AS z
      FROM so q LEFT JOIN so h ON h.series_id = q.series_id AND h.state_key = q.state_key AND h.idx + 4 <= q.idx AND h.price_direction IS NOT NULL GROUP BY ALL))""",
    "so": "SELECT s.series_id, s.idx, s.state_key, o.price_direction FROM states s JOIN outcomes o ON o.series_id = s.series_id AND o.idx = s.idx AND o.horizon = 4",
    "sc": """SELECT *, CASE WHEN said = direction THEN 1 ELSE 0 END AS hit FROM (SELECT *, (power(p_up - CAST(direction = 'UP' AS INTEGER), 2) + power(p_down - CAST(direction = 'DOWN' AS INTEGER), 2) + power(p_neutral - CAST(direction = 'NEUTRAL' AS INTEGER), 2)) / 3 AS brier,
      -ln(greatest(CASE direction WHEN 'UP' THEN p_up WHEN 'DOWN' THEN p_down ELSE p_neutral END, 1e-12)) AS log_loss, greatest(p_up, p_down, p_neutral) AS confidence,
      CASE WHEN p_up = greatest(p_up, p_down, p_neutral) THEN 'UP' WHEN p_down = greatest(p_up, p_down, p_neutral) THEN 'DOWN' ELSE 'NEUTRAL' END AS said FROM baseline WHERE direction IS NOT NULL)""",
    "me0": "SELECT horizon, count(*) AS n, avg(hit) AS accuracy, avg(brier) AS brier, avg(log_loss) AS log_loss, " + ", ".join(f"count(*) FILTER (direction = '{k}') AS i{k}, count(*) FILTER (said = '{k}') AS s{k}, count(*) FILTER (said = '{k}' AND direction = '{k}') AS b{k}" for k in ("UP", "DOWN", "NEUTRAL")) + " FROM sc GROUP BY 1",
    "metrics": "SELECT *, greatest(iUP, iDOWN, iNEUTRAL) / n AS majority, (" + " + ".join(f"coalesce(b{k} / nullif(i{k}, 0), 0)" for k in ("UP", "DOWN", "NEUTRAL")) + ") / 3 AS balanced, (" + " + ".join(f"coalesce(2 * b{k} / nullif(i{k} + s{k}, 0), 0)" for k in ("UP", "DOWN", "NEUTRAL")) + ") / 3 AS macro_f1 FROM me0",
    "confusion": "SELECT horizon, direction AS actual, said, count(*) AS n FROM sc GROUP BY 1, 2, 3",
    "calib": "SELECT horizon, sum(n * gap) / sum(n) AS ece, max(gap) AS mce, count(*) AS n_bins FROM (SELECT horizon, least(floor(confidence * 10), 9) AS bin, count(*) AS n, abs(avg(hit) - avg(confidence)) AS gap FROM sc GROUP BY 1, 2) GROUP BY 1",
    "deciles": "SELECT horizon, CAST((10 * rn - 1) // total AS INTEGER) AS bucket, count(*) AS n, avg(hit) AS mean_value FROM (SELECT horizon, hit, row_number() OVER (PARTITION BY horizon ORDER BY confidence, series_id, idx) AS rn, count(*) OVER (PARTITION BY horizon) AS total FROM (SELECT * REPLACE (round(confidence, 9) AS confidence) FROM sc)) GROUP BY 1, 2",
    "spear": """SELECT horizon, count(*) AS n, corr(ra, rb) AS rho FROM (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY volatility_ratio) + (count(*) OVER (PARTITION BY horizon, volatility_ratio) - 1) / 2 AS ra,
      rank() OVER (PARTITION BY horizon ORDER BY atr_return) + (count(*) OVER (PARTITION BY horizon, atr_return) - 1) / 2 AS rb FROM (SELECT horizon, round(volatility_ratio, 9) AS volatility_ratio, round(atr_return, 9) AS atr_return FROM exper WHERE atr_return IS NOT NULL)) GROUP BY 1""",
    "sh0": "SELECT horizon, said, direction, row_number() OVER (PARTITION BY horizon ORDER BY series_id, idx) - 1 AS rn, count(*) OVER (PARTITION BY horizon) AS total FROM sc",
    "shifted": "SELECT a.horizon, shift, count(*) AS n, avg(CASE WHEN a.said = b.direction THEN 1.0 ELSE 0.0 END) AS accuracy FROM (SELECT *, unnest([0, 7, 13, 29, 53]) AS shift FROM sh0) a JOIN sh0 b ON b.horizon = a.horizon AND b.rn = (a.rn + a.shift) % a.total GROUP BY 1, 2",
    "overlap": "SELECT l.series_id, l.idx, l.horizon, count(r.idx) AS n_overlapping FROM (SELECT series_id, idx, horizon FROM outcomes WHERE future IS NOT NULL) l LEFT JOIN (SELECT series_id, idx, horizon FROM outcomes WHERE future IS NOT NULL) r ON r.series_id = l.series_id AND r.horizon = l.horizon AND r.idx < l.idx AND r.idx + r.horizon >= l.idx + 1 GROUP BY 1, 2, 3",
    "ngram": f"SELECT pattern, horizon, count(*) AS n, count(*) FILTER (price_direction = 'bullish') AS n_bullish, count(*) FILTER (price_direction = 'bearish') AS n_bearish, count(*) FILTER (price_direction = 'neutral') AS n_neutral FROM (SELECT series_id, idx, lag(d, 2) {LAG} || lag(d) {LAG} || d AS pattern FROM (SELECT series_id, idx, left(direction, 1) AS d FROM anatomy)) JOIN outcomes USING (series_id, idx) WHERE pattern IS NOT NULL AND price_direction IS NOT NULL GROUP BY 1, 2",
    "transitions": f"SELECT prev, regime, count(*) AS n FROM (SELECT regime, lag(regime) {LAG} AS prev FROM states) WHERE prev IS NOT NULL GROUP BY 1, 2",
    "relv": f"SELECT series_id, idx, range, quantile_cont(CASE WHEN range > 0 THEN range END, 0.5) {rows('20 PRECEDING', '1 PRECEDING')} AS med, volume, quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.5) {rows('20 PRECEDING', '1 PRECEDING')} AS vmed FROM anatomy",
    "relative": "SELECT *, CASE WHEN med IS NULL THEN 'UNKNOWN' WHEN range / med < 0.5 THEN 'VERY_SMALL' WHEN range / med < 0.8 THEN 'SMALL' WHEN range / med <= 1.25 THEN 'NORMAL' WHEN range / med <= 1.75 THEN 'LARGE' ELSE 'VERY_LARGE' END AS size_state, CASE WHEN vmed IS NULL THEN 'UNKNOWN' WHEN volume / vmed >= 2 THEN 'VERY_HIGH' WHEN volume / vmed >= 1.3 THEN 'HIGH' WHEN volume / vmed <= 0.6 THEN 'LOW' ELSE 'NORMAL' END AS volume_state FROM relv",
    "report": "SELECT series_id, horizon, direction, GROUPING(series_id) + 2 * GROUPING(horizon) + 4 * GROUPING(direction) AS level, count(*) AS n, avg(atr_return) AS mean_return FROM exper WHERE direction IS NOT NULL GROUP BY GROUPING SETS ((), (horizon), (direction), (series_id, horizon))",
    "prints": "SELECT series_id, idx, sha256(concat_ws('|', series_id, CAST(ts AS VARCHAR), printf('%.6f', open), printf('%.6f', high), printf('%.6f', low), printf('%.6f', close), CAST(volume AS VARCHAR))) AS fingerprint FROM bars",
    "cutrows": "SELECT DISTINCT series_id, cut FROM (SELECT series_id, unnest([greatest(floor(n * 0.1), 1), greatest(floor(n * 0.25), 1), greatest(floor(n * 0.5), 1), greatest(floor(n * 0.75), 1)]) AS cut FROM (SELECT series_id, count(*) AS n FROM bars GROUP BY 1))",
    "nothing": "SELECT CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, count(*) AS n_compared FROM bars JOIN cutrows USING (series_id) WHERE idx < cut",
    "zone_inputs": "SELECT series_id, count(*) AS n_inputs, count(*) FILTER (h_idx > idx) AS n_violations FROM top GROUP BY 1",
}

CTES |= more_sql.CTES | fusion_sql.CTES | behaviour_sql.CTES | sequence_sql.CTES | scenario_sql.CTES | discovery_sql.CTES | grid_sql.CTES | regime_sql.CTES


def state(source: str, columns: str) -> str:
    """``columns`` of ``source`` (those marked ~ rounded to 7 places) with every expression it stands on."""
    need: dict[str, None] = {}

    def visit(name: str, seen: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", CTES[name])):
            if word in CTES and word != name and word not in seen:
                visit(word, (*seen, name))
        need.setdefault(name)

    visit(source)
    picked = ", ".join(f"round({c[1:]}, 7) + 0.0 AS {c[1:]}" if c[0] == "~" else f'"{c}"' for c in columns.split())
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in need) + f"\nSELECT {picked} FROM {source}"
