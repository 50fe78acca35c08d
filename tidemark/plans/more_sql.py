"""Further expressions for ``oracle``: contexts, levels, other labels, and the measures of skill."""

from __future__ import annotations

PART = "PARTITION BY series_id ORDER BY idx"
LAG = f"OVER ({PART})"
ALL = f"OVER ({PART} ROWS UNBOUNDED PRECEDING)"
Q = "series_id, window_no, horizon, idx"


def w(a: int, b: int = 0) -> str:
    """Rows from a before to b before the current bar."""
    return f"OVER ({PART} ROWS BETWEEN {a} PRECEDING AND {'CURRENT ROW' if b == 0 else f'{b} PRECEDING'})"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) < 1e-12 THEN 0.0 ELSE ({a}) / ({b}) END)"


def back(n: int) -> str:
    return f"(CASE WHEN idx >= {n} THEN {div(f'close - lag(close, {n}) {LAG}', f'lag(close, {n}) {LAG}')} ELSE 0.0 END)"


CTES = {
    "sq0": f"""SELECT *, count(*) {w(19)} AS n, lag(close) {LAG} AS before, close - lag(close) {LAG} AS change, lag(direction) {LAG} AS was, lag(direction, 2) {LAG} AS was2 FROM anatomy""",
    "sq1": "SELECT *, CASE WHEN abs(before) > 1e-12 THEN change / before END AS r FROM sq0",
    "sq2": f"""SELECT *, avg(range) {w(2)} AS range_recent, avg(range) {w(19, 3)} AS range_rest, avg(r) {w(2)} AS r_recent, avg(r) {w(18, 3)} AS r_rest, avg(change) {w(1)} AS step_recent, avg(change) {w(3, 2)} AS step_before,
      max(high) {w(19, 1)} AS top, min(low) {w(19, 1)} AS bottom, max(high) {w(19)} AS hk, min(low) {w(19)} AS lk, avg(volume) {w(19, 1)} AS vb, count(volume) {w(19)} AS nv, count(*) FILTER (direction = 'UP') {w(4)} AS nu, count(*) FILTER (direction = 'DOWN') {w(4)} AS nd FROM sq1""",
    "sq3": "SELECT *, range_recent / range_rest AS rc, volume / vb AS vc, CASE WHEN hk - lk <= 1e-12 THEN 0.5 ELSE (close - lk) / (hk - lk) END AS place FROM sq2",
    "seqctx": """SELECT *, CASE WHEN change > 1e-12 THEN 'UP' WHEN change < -1e-12 THEN 'DOWN' ELSE 'FLAT' END AS movement,
      CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' WHEN was = 'UP' AND direction = 'UP' AND change >= 0 THEN 'BULLISH_FOLLOW_THROUGH' WHEN was = 'DOWN' AND direction = 'DOWN' AND change <= 0 THEN 'BEARISH_FOLLOW_THROUGH' ELSE 'NO_CLEAR_FOLLOW_THROUGH' END AS follow_two,
      CASE WHEN idx < 2 THEN 'INSUFFICIENT_HISTORY' WHEN direction = 'UP' AND was = 'UP' AND was2 = 'UP' THEN 'BULLISH_FOLLOW_THROUGH' WHEN direction = 'DOWN' AND was = 'DOWN' AND was2 = 'DOWN' THEN 'BEARISH_FOLLOW_THROUGH' WHEN direction = 'UP' AND was = 'DOWN' THEN 'BULLISH_RESPONSE' WHEN direction = 'DOWN' AND was = 'UP' THEN 'BEARISH_RESPONSE' ELSE 'MIXED_FOLLOW_THROUGH' END AS follow_three,
      CASE WHEN range <= 1e-12 THEN 'NO_RANGE' WHEN lower_share >= 0.45 AND lower_share > upper_share THEN 'LOWER_PRICE_REJECTION' WHEN upper_share >= 0.45 AND upper_share > lower_share THEN 'HIGHER_PRICE_REJECTION' WHEN body_share >= 0.75 THEN 'STRONG_BODY' ELSE 'NO_STRONG_REJECTION' END AS rejection,
      CASE WHEN n < 6 THEN 'INSUFFICIENT_DATA' WHEN range_rest <= 1e-12 THEN 'UNDEFINED' WHEN rc >= 1.5 THEN 'EXPANSION' WHEN rc <= 0.67 THEN 'COMPRESSION' ELSE 'STABLE' END AS range_state,
      CASE WHEN n < 6 THEN 'INSUFFICIENT_DATA' WHEN r_recent > r_rest THEN 'MOMENTUM_INCREASING' WHEN r_recent < r_rest THEN 'MOMENTUM_DECREASING' ELSE 'MOMENTUM_STABLE' END AS pace,
      CASE WHEN n < 5 THEN 'INSUFFICIENT_DATA' WHEN step_recent > step_before THEN 'ACCELERATING_UP' WHEN step_recent < step_before THEN 'ACCELERATING_DOWN' ELSE 'NO_CLEAR_ACCELERATION' END AS acceleration,
      CASE WHEN n < 5 THEN 'INSUFFICIENT_DATA' WHEN close > top THEN 'UPSIDE_BREAK' WHEN close < bottom THEN 'DOWNSIDE_BREAK' WHEN high > top THEN 'POSSIBLE_UPSIDE_REJECTION' WHEN low < bottom THEN 'POSSIBLE_DOWNSIDE_REJECTION' ELSE 'NO_RANGE_BREAK' END AS break_state,
      CASE WHEN nv < 5 THEN 'NO_VOLUME_CONTEXT' WHEN vb <= 1e-12 THEN 'UNDEFINED_VOLUME' WHEN vc >= 1.5 THEN 'VOLUME_EXPANSION' WHEN vc <= 0.67 THEN 'VOLUME_CONTRACTION' ELSE 'NORMAL_VOLUME' END AS volume_state,
      CASE WHEN place >= 0.8 THEN 'NEAR_RANGE_HIGH' WHEN place <= 0.2 THEN 'NEAR_RANGE_LOW' ELSE 'MID_RANGE' END AS place_state,
      CASE WHEN nu >= 4 THEN 'PERSISTENT_BULLISH_PRESSURE' WHEN nd >= 4 THEN 'PERSISTENT_BEARISH_PRESSURE' WHEN nu > nd THEN 'BULLISH_SEQUENCE' WHEN nd > nu THEN 'BEARISH_SEQUENCE' ELSE 'BALANCED_SEQUENCE' END AS pressure FROM sq3""",
    "ph0": " UNION ALL ".join(f"SELECT {n} AS length, count(*) FILTER (direction = 'UP') {w(n - 1)} AS u, count(*) FILTER (direction = 'DOWN') {w(n - 1)} AS d FROM anatomy" for n in (5, 10, 20)),
    "pressures": "SELECT length, CASE WHEN u >= length - 1 THEN 'PERSISTENT_BULLISH_PRESSURE' WHEN d >= length - 1 THEN 'PERSISTENT_BEARISH_PRESSURE' WHEN u > d THEN 'BULLISH_SEQUENCE' WHEN d > u THEN 'BEARISH_SEQUENCE' ELSE 'BALANCED_SEQUENCE' END AS pressure, count(*) AS n FROM ph0 GROUP BY 1, 2",
    "ty0": f"""SELECT *, {', '.join(f"{div(f'max(high) {w(n - 1)} - min(low) {w(n - 1)}', 'close')} AS span{n}" for n in (4, 8, 16))}, lag(rolling_volatility, 10) {LAG} AS vb, avg(close) {w(49)} AS s50, avg(close) {w(199)} AS s200, lag(range_atr) {LAG} AS ab FROM feat""",
    "types": f"""SELECT *, CASE WHEN body_share < 0.1 THEN 'doji' WHEN body_share > 0.7 THEN 'strong' WHEN lower_share > 0.5 THEN 'lower_rejection' WHEN upper_share > 0.5 THEN 'upper_rejection' ELSE 'normal' END AS type,
      CASE WHEN body_share >= 0.7 THEN 'STRONG' WHEN body_share >= 0.4 THEN 'MODERATE' WHEN body_share >= 0.2 THEN 'WEAK' ELSE 'VERY_WEAK' END AS strength, CASE WHEN vb > 1e-12 THEN rolling_volatility / vb ELSE 1.0 END AS volatility_change, {div('range_atr - ab', 'ab')} AS atr_change,
      CASE WHEN close > sma20 AND sma20 > s50 AND s50 > s200 THEN 'BULLISH' WHEN close < sma20 AND sma20 < s50 AND s50 < s200 THEN 'BEARISH' ELSE 'NEUTRAL' END AS long_bias, CASE WHEN volume_ratio >= 1.5 THEN 'HIGH' WHEN volume_ratio <= 0.5 THEN 'LOW' ELSE 'NORMAL' END AS volume_level FROM ty0""",
    "ls0": f"""SELECT *, CASE WHEN idx >= 5 THEN max(high) {w(20, 1)} END AS resistance, CASE WHEN idx >= 5 THEN min(low) {w(20, 1)} END AS support, CASE WHEN idx >= 11 THEN max(high) {w(51, 2)} END AS oh, CASE WHEN idx >= 11 THEN min(low) {w(51, 2)} END AS ol FROM (SELECT * REPLACE (CASE WHEN unit > 1e-9 THEN unit END AS unit) FROM levels)""",
    "ls1": """SELECT *, CASE WHEN high > prior_high THEN 1 ELSE 0 END AS candidate_high, CASE WHEN low < prior_low THEN 1 ELSE 0 END AS candidate_low, CASE WHEN high > oh THEN 1 ELSE 0 END AS hh, CASE WHEN high < oh THEN 1 ELSE 0 END AS lh, CASE WHEN low > ol THEN 1 ELSE 0 END AS hl, CASE WHEN low < ol THEN 1 ELSE 0 END AS ll,
      CASE WHEN low <= support AND close > support THEN 1 ELSE 0 END AS support_rejection, CASE WHEN high >= resistance AND close < resistance THEN 1 ELSE 0 END AS resistance_rejection, CASE WHEN close < support THEN 1 ELSE 0 END AS support_break, CASE WHEN close > resistance THEN 1 ELSE 0 END AS resistance_break,
      (close - support) / unit AS support_distance, (resistance - close) / unit AS resistance_distance, (close - support) / close * 100 AS support_percent, body / unit AS strength,
      CASE sweep WHEN 'LOW' THEN (prior_low - low) / unit WHEN 'HIGH' THEN (high - prior_high) / unit ELSE 0.0 END AS sweep_depth FROM ls0""",
    "ls2": "SELECT *, CASE WHEN hh = 1 AND hl = 1 THEN 2 WHEN lh = 1 AND ll = 1 THEN -2 WHEN hh = 1 OR hl = 1 THEN 1 WHEN lh = 1 OR ll = 1 THEN -1 ELSE 0 END AS swing_score FROM ls1",
    "levelstr": """SELECT *, CASE WHEN abs(support_distance) <= 1 THEN 1 ELSE 0 END AS near_support, CASE WHEN abs(resistance_distance) <= 1 THEN 1 ELSE 0 END AS near_resistance, swing_score + CASE WHEN break_event <> 'NONE' THEN broke ELSE 0 END AS bias,
      CASE WHEN break_event = 'CHOCH' THEN 5 * broke WHEN break_event = 'BOS' THEN 3 * broke WHEN sweep = 'LOW' THEN 2 WHEN sweep = 'HIGH' THEN -2 ELSE 0 END AS event_code FROM ls2""",
    "sc0": "SELECT *, " + ", ".join(f"{div(f'close - first_value(close) {w(n - 1)}', f'first_value(close) {w(n - 1)}')} AS change{n}, count(*) FILTER (direction = 'UP') {w(n - 1)} - count(*) FILTER (direction = 'DOWN') {w(n - 1)} AS balance{n}" for n in (20, 60, 120)) + " FROM anatomy",
    "sc1": "SELECT *, " + ", ".join(f"CASE WHEN change{n} > 0 AND balance{n} > 0 THEN 1 WHEN change{n} < 0 AND balance{n} < 0 THEN -1 ELSE 0 END AS direction{n}" for n in (20, 60, 120)) + " FROM sc0",
    "scales": """SELECT *, direction20 + 2 * direction60 + 3 * direction120 AS vote, CASE WHEN direction20 + 2 * direction60 + 3 * direction120 >= 2 THEN 'BULLISH' WHEN direction20 + 2 * direction60 + 3 * direction120 <= -2 THEN 'BEARISH' ELSE 'MIXED' END AS integrated,
      abs(direction20 + 2 * direction60 + 3 * direction120) / 6.0 AS confidence, CASE WHEN direction20 = direction60 AND direction60 = direction120 AND direction20 <> 0 THEN 1 ELSE 0 END AS aligned FROM sc1""",
    "regfreq": "SELECT series_id, integrated, count(*) AS n FROM scales GROUP BY 1, 2",
    "sg0": f"""SELECT *, {', '.join(f'{back(n)} AS r{n}' for n in (5, 10, 20, 40))}, avg(CASE WHEN direction = 'UP' THEN 1.0 ELSE 0.0 END) {w(59)} AS up_share, avg(CASE WHEN direction = 'DOWN' THEN 1.0 ELSE 0.0 END) {w(59)} AS down_share, stddev_pop(r1) {w(9)} AS vs, stddev_pop(r1) {w(59)} AS vl,
      max(close) {w(59)} AS hn, min(close) {w(59)} AS ln, {div(f'covar_pop(close, idx) {w(59)}', f'var_pop(idx) {w(59)}')} AS slope, avg(range) {w(29)} AS rl, avg(range) {w(59, 30)} AS re, avg(body) {w(29)} AS bl, avg(body) {w(59, 30)} AS be FROM feat""",
    "segs": f"""SELECT *, up_share - down_share AS imbalance, CASE WHEN vl > 1e-12 THEN vs / vl ELSE 1.0 END AS vol_ratio, CASE WHEN hn - ln > 1e-12 THEN (close - ln) / (hn - ln) ELSE 0.5 END AS place, {div('slope', 'close')} AS slope_share, r5 - r10 / 2 AS acceleration,
      CASE WHEN re IS NULL THEN 'UNKNOWN' WHEN rl > re * 1.1 THEN 'RISING' WHEN rl < re * 0.9 THEN 'FALLING' ELSE 'STEADY' END AS range_half, CASE WHEN be IS NULL THEN 'UNKNOWN' WHEN bl > be * 1.1 THEN 'RISING' WHEN bl < be * 0.9 THEN 'FALLING' ELSE 'STEADY' END AS body_half FROM sg0""",
    "segst": """SELECT *, CASE WHEN vol_ratio >= 1.25 THEN 'HIGH' WHEN vol_ratio <= 0.75 THEN 'LOW' ELSE 'NORMAL' END AS volatility_state, CASE WHEN place >= 0.67 THEN 'UPPER' WHEN place <= 0.33 THEN 'LOWER' ELSE 'MIDDLE' END AS location_state,
      CASE WHEN r20 > 0.002 THEN 'UP' WHEN r20 < -0.002 THEN 'DOWN' ELSE 'FLAT' END AS direction_state, CASE WHEN acceleration > 0 THEN 'RISING' WHEN acceleration < 0 THEN 'FALLING' ELSE 'FLAT' END AS momentum_state, CASE WHEN imbalance >= 0.2 THEN 'BUYING' WHEN imbalance <= -0.2 THEN 'SELLING' ELSE 'BALANCED' END AS pressure_state FROM segs""",
    "signal0": f"""SELECT series_id, idx, [r1, r3, r8, r16, {back(32)}, {', '.join(div(f'max(high) {w(n - 1)} - min(low) {w(n - 1)}', 'close') for n in (4, 8, 16))}, body / unit, range / unit, upper / unit, lower / unit, CASE WHEN unit > 1e-9 THEN coalesce((last_high - close) / unit, 999.0) ELSE 999.0 END, CASE WHEN unit > 1e-9 THEN coalesce((close - last_low) / unit, 999.0) ELSE 999.0 END,
      {', '.join(f'CASE WHEN {x} IS NULL THEN 999.0 ELSE (idx - {x}) / 32.0 END' for x in ('high_seen', 'low_seen', 'event_index'))}, volatility_ratio, ln(1 + volume_ratio), {', '.join(f'CAST({x} AS INTEGER)' for x in ("trend = 'BULLISH'", "trend = 'BEARISH'", "event LIKE '%BULLISH'", "event LIKE '%BEARISH'", "regime = 'VOL_EXPANSION'", "regime = 'VOL_CONTRACTION'"))}] AS v FROM states""",
    "signal": "SELECT series_id, idx, k, v[k + 1] AS value FROM signal0 CROSS JOIN (SELECT unnest(range(25)) AS k)",
    "pv": """SELECT series_id, idx AS seen, idx - 3 AS pivot_idx, 'HIGH' AS kind, pivot_high AS price, high_mark AS mark FROM swings WHERE pivot_high IS NOT NULL UNION ALL SELECT series_id, idx, idx - 3, 'LOW', pivot_low, low_mark FROM swings WHERE pivot_low IS NOT NULL""",
    "al0": "SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY series_id ORDER BY pivot_idx, kind) THEN 0 ELSE 1 END AS new FROM pv",
    "al1": "SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY pivot_idx, kind ROWS UNBOUNDED PRECEDING) AS run FROM al0",
    "altern": "SELECT series_id, CAST(run AS BIGINT) AS run, kind, first(price ORDER BY CASE kind WHEN 'HIGH' THEN price ELSE -price END DESC, pivot_idx DESC) AS price, first(pivot_idx ORDER BY CASE kind WHEN 'HIGH' THEN price ELSE -price END DESC, pivot_idx DESC) AS pivot_idx, count(*) AS n FROM al1 GROUP BY 1, 2, 3",
    "sp0": """SELECT *, max(price) OVER t AS top, min(price) OVER t AS bottom, count(*) OVER t AS held, sum(CASE WHEN mark IN ('HH', 'HL') THEN 1 ELSE -1 END) OVER (PARTITION BY series_id ORDER BY seen, kind ROWS 5 PRECEDING) AS score FROM pv WINDOW t AS (PARTITION BY series_id ORDER BY seen, kind ROWS 9 PRECEDING)""",
    "sp1": "SELECT * FROM sp0 QUALIFY row_number() OVER (PARTITION BY series_id, seen ORDER BY kind DESC) = 1",
    "sp2": "SELECT b.series_id, b.idx, CASE WHEN held >= 2 AND top - bottom > 1e-12 THEN (close - bottom) / (top - bottom) ELSE 0.5 END AS place, CAST(coalesce(score, 0) AS INTEGER) AS score FROM bars b ASOF LEFT JOIN sp1 s ON s.series_id = b.series_id AND b.idx >= s.seen",
    "places": "SELECT *, CASE WHEN place >= 0.67 THEN 'HIGH' WHEN place <= 0.33 THEN 'LOW' ELSE 'MIDDLE' END AS location, CASE WHEN score >= 2 THEN 'BULLISH' WHEN score <= -2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label_trend FROM sp2",
    "pz0": "SELECT series_id, idx AS last_idx, close AS last_close, greatest(0.6 * range_atr, 0.001 * close) AS tol FROM feat QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) = 1",
    "pz1": "SELECT p.series_id, kind, price, tol, last_idx, last_close, row_number() OVER (PARTITION BY p.series_id, kind ORDER BY price) AS k FROM pv p JOIN pz0 z ON z.series_id = p.series_id WHERE pivot_idx >= last_idx - 240",
    "pz2": """SELECT series_id, kind, k, CAST(0 AS BIGINT) AS zone, price AS total, CAST(1 AS BIGINT) AS n FROM pz1 WHERE k = 1 UNION ALL
      SELECT p.series_id, p.kind, p.k, CASE WHEN abs(p.price - z.total / z.n) > tol THEN z.zone + 1 ELSE z.zone END, CASE WHEN abs(p.price - z.total / z.n) > tol THEN p.price ELSE z.total + p.price END, CASE WHEN abs(p.price - z.total / z.n) > tol THEN 1 ELSE z.n + 1 END
      FROM pz2 z JOIN pz1 p ON p.series_id = z.series_id AND p.kind = z.kind AND p.k = z.k + 1""",
    "pz3": "SELECT series_id, CASE p.kind WHEN 'HIGH' THEN 'RESISTANCE' ELSE 'SUPPORT' END AS kind, zone, min(price) - any_value(tol) * 0.25 AS zone_low, max(price) + any_value(tol) * 0.25 AS zone_high, last(z.total ORDER BY k) / last(z.n ORDER BY k) AS center, count(*) AS n_swings, any_value(last_idx) AS last_idx, any_value(last_close) AS last_close FROM pz2 z JOIN pz1 p USING (series_id, kind, k) GROUP BY 1, 2, 3",
    "pzones": """SELECT z.series_id, z.kind, z.zone, z.zone_low, z.zone_high, z.center, z.n_swings, z.last_close, count(b.idx) AS n_tests, count(b.idx) FILTER ((z.kind = 'RESISTANCE' AND b.close < z.center) OR (z.kind = 'SUPPORT' AND b.close > z.center)) AS n_rejections, max(b.idx) AS last_test
      FROM pz3 z LEFT JOIN bars b ON b.series_id = z.series_id AND b.idx >= z.last_idx - 240 AND b.high >= z.zone_low AND b.low <= z.zone_high GROUP BY ALL""",
    "nzones": "SELECT *, CASE WHEN center < last_close THEN 'BELOW' ELSE 'ABOVE' END AS side, abs(center - last_close) AS distance FROM pzones WHERE center <> last_close QUALIFY row_number() OVER (PARTITION BY series_id, kind, center < last_close ORDER BY abs(center - last_close), zone) = 1",
    "memo": "SELECT series_id, state_key, count(*) AS count, count(*) FILTER (price_direction = 'bullish') AS n_bullish, count(*) FILTER (price_direction = 'bearish') AS n_bearish, count(*) FILTER (price_direction = 'neutral') AS n_neutral FROM so WHERE price_direction IS NOT NULL GROUP BY 1, 2",
    "labels0": "SELECT *, CASE WHEN change = 0 THEN NULL WHEN change > 0 THEN mfe_atr ELSE -mae_atr END AS al, CASE WHEN change = 0 THEN NULL WHEN change > 0 THEN -mae_atr ELSE mfe_atr END AS ag FROM outcomes WHERE complete",
    "labels": """SELECT *, greatest(mfe_atr, 0.0) AS mfe_clipped, greatest(-mae_atr, 0.0) AS mae_clipped, CASE WHEN al IS NULL THEN 0.0 ELSE greatest(al, 0.0) END AS along, CASE WHEN ag IS NULL THEN 0.0 ELSE greatest(ag, 0.0) END AS against,
      CASE WHEN change <> 0 THEN CASE WHEN atr_return >= 1 THEN 'STRONG_UP' WHEN atr_return <= -1 THEN 'STRONG_DOWN' WHEN change > 0 THEN 'UP' ELSE 'DOWN' END END AS strength, CASE WHEN change > 0 THEN 1 WHEN change < 0 THEN 0 END AS two_way,
      CASE WHEN raw_return > 0.0005 THEN 'UP' WHEN raw_return < -0.0005 THEN 'DOWN' ELSE 'NEUTRAL' END AS b05, CASE WHEN raw_return >= 0.0015 THEN 'UP' WHEN raw_return <= -0.0015 THEN 'DOWN' ELSE 'NEUTRAL' END AS b15,
      CASE WHEN raw_return > 0.0003 THEN 'UP' WHEN raw_return < -0.0003 THEN 'DOWN' ELSE 'NEUTRAL' END AS b03, CASE WHEN raw_return > 0.0001 THEN 'UP' WHEN raw_return < -0.0001 THEN 'DOWN' ELSE 'NEUTRAL' END AS b01 FROM labels0""",
    "excursions": "SELECT horizon, strength, count(*) AS n, avg(along) AS mean_along, avg(against) AS mean_against FROM labels GROUP BY 1, 2",
    "thresholds": """SELECT *, 100.0 * (n_up + n_down) / n - 20.0 * abs(n_up - n_down) / greatest(n_up + n_down, 1) AS score FROM (SELECT horizon, window_no, threshold, count(*) FILTER (atr_return > threshold) AS n_up, count(*) FILTER (atr_return < -threshold) AS n_down, count(*) AS n
      FROM train CROSS JOIN (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS threshold) GROUP BY 1, 2, 3)""",
    "threshold": "SELECT * FROM thresholds QUALIFY row_number() OVER (PARTITION BY horizon, window_no ORDER BY round(score, 9) DESC, threshold) = 1",
    "ovp": "SELECT series_id, idx, idx + 4 AS stop FROM outcomes WHERE horizon = 4 AND future IS NOT NULL",
    "overpairs": "SELECT l.series_id, l.idx, r.idx AS later_idx FROM ovp l JOIN ovp r ON r.series_id = l.series_id AND l.idx < r.idx AND l.stop > r.idx",
    "wgaps": "SELECT series_id, modal, count(*) FILTER (delta > modal) AS n_above_mode, count(*) FILTER (delta < 0) AS n_negative, count(*) FILTER (delta = 0) AS n_zero, max(delta) AS largest FROM deltas JOIN modes USING (series_id) GROUP BY 1, 2",
    "dsc": """SELECT *, CASE WHEN said = actual THEN 1 ELSE 0 END AS hit FROM (SELECT *, (power(p_up - CAST(actual = 'UP' AS INTEGER), 2) + power(p_down - CAST(actual = 'DOWN' AS INTEGER), 2) + power(p_neutral - CAST(actual = 'NEUTRAL' AS INTEGER), 2)) / 3 AS brier,
      -ln(greatest(CASE actual WHEN 'UP' THEN p_up WHEN 'DOWN' THEN p_down ELSE p_neutral END, 1e-12)) AS log_loss, CASE WHEN p_up = greatest(p_up, p_down, p_neutral) THEN 'UP' WHEN p_down = greatest(p_up, p_down, p_neutral) THEN 'DOWN' ELSE 'NEUTRAL' END AS said FROM decisions WHERE actual IS NOT NULL)""",
    "fp": f"SELECT {Q}, r.actual, " + ", ".join(f"{t}.{n} AS {t}_{n}" for t in "rb" for n in ("p_up", "p_down", "p_neutral", "brier", "log_loss", "hit", "said")) + f" FROM dsc r JOIN sc b USING ({Q})",
    "shapes": "SELECT horizon, count(*) AS n, " + ", ".join(f"avg(-({' + '.join(f'CASE WHEN {t}_{p} > 1e-12 THEN {t}_{p} * ln({t}_{p}) ELSE 0.0 END' for p in ('p_up', 'p_down', 'p_neutral'))}) / ln(3.0)) AS {name}" for t, name in (("r", "retrieval_entropy"), ("b", "baseline_entropy"))) + ", avg((abs(r_p_up - b_p_up) + abs(r_p_down - b_p_down) + abs(r_p_neutral - b_p_neutral)) / 2) AS total_variation, avg((" + " + ".join(f"CASE WHEN {s}_{p} > 1e-12 THEN {s}_{p} * ln({s}_{p} / ((r_{p} + b_{p}) / 2)) ELSE 0.0 END" for s in "rb" for p in ("p_up", "p_down", "p_neutral")) + ") / 2 / ln(2.0)) AS divergence FROM fp GROUP BY 1",
    "iv0": "SELECT horizon, count(*) AS n, avg(b_brier - r_brier) AS brier_lift, avg(b_log_loss - r_log_loss) AS log_loss_lift, avg(r_hit - b_hit) AS accuracy_lift, avg(CASE WHEN b_brier - r_brier > 1e-12 THEN 1.0 ELSE 0.0 END) AS share_better FROM fp GROUP BY 1",
    "incval": "SELECT *, concat_ws(',', CASE WHEN brier_lift > 1e-12 THEN 'brier' END, CASE WHEN log_loss_lift > 1e-12 THEN 'log_loss' END, CASE WHEN accuracy_lift > 1e-12 THEN 'accuracy' END) AS improves FROM iv0",
    "mr": f"SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY similarity DESC, h_idx DESC) AS place, count(*) OVER (PARTITION BY {Q}) AS n FROM matches",
    "di0": f"""SELECT {Q}, n, avg(similarity) FILTER (place <= greatest(1, n // 10)) AS ts, avg(similarity) FILTER (place > greatest(1, n // 10)) AS rs, sum(CASE WHEN place <= greatest(1, n // 10) THEN similarity ELSE 0 END) / sum(similarity) AS mass,
      avg(CASE WHEN direction = actual THEN 1.0 WHEN direction <> actual THEN 0.0 END) FILTER (place <= greatest(1, n // 10)) AS ta, avg(CASE WHEN direction = actual THEN 1.0 WHEN direction <> actual THEN 0.0 END) FILTER (place > greatest(1, n // 10)) AS ra FROM mr GROUP BY ALL""",
    "discrim": "SELECT horizon, count(*) AS n_queries, avg(n) AS mean_matches, avg(ts - rs) AS separation, avg(CASE WHEN ts - rs > 0.05 THEN 1.0 WHEN ts - rs <= 0.05 THEN 0.0 END) AS share_separated, avg(mass) AS mean_mass, avg(ta) AS top_agree, avg(ra) AS rest_agree FROM di0 GROUP BY 1",
    "mra": f"SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY similarity DESC, h_idx DESC) AS place, count(*) OVER (PARTITION BY {Q}) AS n FROM matches WHERE actual IS NOT NULL",
    "thirds": "SELECT horizon, CAST((3 * place - 1) // n AS INTEGER) AS third, count(*) AS n, avg(similarity) AS mean_similarity, avg(CASE WHEN direction = actual THEN 1.0 ELSE 0.0 END) AS agreement FROM (SELECT * FROM mra WHERE n >= 3) GROUP BY 1, 2",
    "ap0": f"SELECT horizon, series_id, window_no, idx, actual, r_said, b_said, row_number() OVER (PARTITION BY horizon ORDER BY series_id, window_no, idx) AS place FROM fp",
    "ap1": "SELECT *, unnest(range(1, 251)) AS perm FROM ap0",
    "ap2": "SELECT horizon, perm, actual, row_number() OVER (PARTITION BY horizon, perm ORDER BY md5(concat_ws('|', perm, series_id, window_no, idx))) AS place FROM ap1",
    "ap3": "SELECT a.horizon, a.perm, sum(CAST(d.actual = a.r_said AS INTEGER) - CAST(d.actual = a.b_said AS INTEGER)) AS gain FROM ap1 a JOIN ap2 d ON d.horizon = a.horizon AND d.perm = a.perm AND d.place = a.place GROUP BY 1, 2",
    "ap4": "SELECT horizon, CAST(sum(CAST(actual = r_said AS INTEGER) - CAST(actual = b_said AS INTEGER)) AS BIGINT) AS real, count(*) AS n FROM ap0 GROUP BY 1",
    "accperm": "SELECT horizon, n, real / n AS difference, avg(gain) / n AS null_mean, stddev_pop(gain) / n AS null_std, (count(*) FILTER (gain >= real) + 1) / 251.0 AS p_value FROM ap3 JOIN ap4 USING (horizon) GROUP BY horizon, n, real",
    "bo0": "SELECT horizon, round(b_brier - r_brier, 9) AS lift, row_number() OVER (PARTITION BY horizon ORDER BY series_id, window_no, idx) AS place FROM fp",
    "bo1": "SELECT horizon, n, k, unnest(range(1, 501)) AS rep FROM (SELECT horizon, n, unnest(range(1, n + 1)) AS k FROM (SELECT horizon, count(*) AS n FROM bo0 GROUP BY 1))",
    "bo2": "SELECT horizon, rep, CAST('0x' || substr(md5(concat_ws('|', rep, k, horizon)), 1, 12) AS BIGINT) % n + 1 AS place FROM bo1",
    "bo3": "SELECT horizon, rep, avg(lift) AS m FROM bo2 JOIN bo0 USING (horizon, place) GROUP BY 1, 2",
    "boot": "SELECT horizon, avg(m) AS mean_lift, max(m) FILTER (k = 13) AS low, max(m) FILTER (k = 487) AS high FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY m, rep) AS k FROM bo3) GROUP BY 1",
    "si0": "SELECT *, round(b_brier - r_brier, 9) AS lift, unnest(range(1, 501)) AS flip FROM fp",
    "si1": "SELECT horizon, flip, sum(CASE WHEN CAST('0x' || substr(md5(concat_ws('|', flip, series_id, window_no, idx, horizon)), 1, 1) AS INTEGER) < 8 THEN lift ELSE -lift END) AS total FROM si0 GROUP BY 1, 2",
    "si2": "SELECT horizon, sum(lift) AS real, count(*) AS n, count(*) FILTER (lift > 0) AS n_better, count(*) FILTER (lift < 0) AS n_worse FROM bo0 GROUP BY 1",
    "signs": "SELECT horizon, n, n_better, n_worse, real / n AS mean_lift, (count(*) FILTER (abs(total) >= abs(real) - 1e-7) + 1) / 501.0 AS p_value FROM si1 JOIN si2 USING (horizon) GROUP BY horizon, n, n_better, n_worse, real",
    "lp0": "SELECT horizon, series_id, window_no, idx, direction, says, row_number() OVER (PARTITION BY horizon ORDER BY series_id, window_no, idx) AS place FROM rule_best WHERE direction IS NOT NULL",
    "lp1": "SELECT *, unnest(range(1, 101)) AS perm FROM lp0",
    "lp2": "SELECT horizon, perm, direction, row_number() OVER (PARTITION BY horizon, perm ORDER BY md5(concat_ws('|', perm, series_id, window_no, idx))) AS place FROM lp1",
    "lp3": "SELECT a.horizon, a.perm, count(*) FILTER (a.says = d.direction) AS hits FROM lp1 a JOIN lp2 d ON d.horizon = a.horizon AND d.perm = a.perm AND d.place = a.place GROUP BY 1, 2",
    "lp4": "SELECT horizon, count(*) FILTER (says = direction) AS real, count(*) AS n FROM lp0 GROUP BY 1",
    "labperm": "SELECT horizon, n, real / n AS accuracy, avg(hits) / n AS null_accuracy, (count(*) FILTER (hits >= real) + 1) / 101.0 AS p_value FROM lp3 JOIN lp4 USING (horizon) GROUP BY horizon, n, real",
    "co0": "SELECT horizon, series_id, idx, round(atr_return, 9) AS y, unnest(['r1', 'r3', 'r8', 'volatility_ratio']) AS feature, round(unnest([r1, r3, r8, volatility_ratio]), 9) AS x FROM exper WHERE direction IS NOT NULL",
    "co1": "SELECT *, row_number() OVER (PARTITION BY horizon, feature ORDER BY x, series_id, idx) AS k, count(*) OVER (PARTITION BY horizon, feature) AS n FROM co0",
    "corrs": "SELECT horizon, feature, count(*) AS n, corr(x, y) AS pearson, avg(y) FILTER (k > n - n // 4) - avg(y) FILTER (k <= n // 4) AS lift FROM co1 GROUP BY 1, 2",
    "stb0": "SELECT horizon, window_no, avg(hit) AS accuracy, greatest(count(*) FILTER (direction = 'UP'), count(*) FILTER (direction = 'DOWN'), count(*) FILTER (direction = 'NEUTRAL')) / count(*) AS majority, avg(CASE WHEN level <> 'GLOBAL' THEN 1.0 ELSE 0.0 END) AS coverage FROM sc GROUP BY 1, 2",
    "stb1": "SELECT horizon, count(*) AS n_windows, avg(accuracy) AS mean_accuracy, quantile_cont(accuracy, 0.5) AS median_accuracy, stddev_samp(accuracy) AS deviation, min(accuracy) AS worst, max(accuracy) AS best, count(*) FILTER (accuracy > majority) AS n_above, avg(coverage) AS coverage, avg(accuracy - majority) AS lift FROM stb0 GROUP BY 1",
    "stable": "SELECT *, 100 * (0.35 * mean_accuracy + 0.25 * coverage + 0.20 * (1 - least(1.0, coalesce((best - worst) / nullif(mean_accuracy, 0), 1.0))) + 0.20 * greatest(0.0, least(1.0, 0.5 + lift))) AS composite FROM stb1",
    "cg0": "SELECT s.*, a.shrink, b.temperature, exp(ln(greatest(p_up, 1e-12)) / temperature) AS eu, exp(ln(greatest(p_down, 1e-12)) / temperature) AS ed, exp(ln(greatest(p_neutral, 1e-12)) / temperature) AS ez FROM sc s CROSS JOIN (SELECT unnest([0.0, 0.15, 0.35, 0.55, 0.75]::DOUBLE[]) AS shrink) a CROSS JOIN (SELECT unnest([0.75, 1.0, 1.5, 2.0]::DOUBLE[]) AS temperature) b",
    "cg1": "SELECT *, -ln(greatest(shrink / 3 + (1 - shrink) * CASE direction WHEN 'UP' THEN eu WHEN 'DOWN' THEN ed ELSE ez END / (eu + ed + ez), 1e-12)) AS loss FROM cg0",
    "cg2": "SELECT horizon, shrink, temperature, avg(loss) FILTER (window_no < 4) AS fit_loss, avg(loss) FILTER (window_no = 4) AS test_loss FROM cg1 GROUP BY 1, 2, 3",
    "calgrid": "SELECT * FROM cg2 QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY round(fit_loss, 9), shrink, temperature) = 1",
    "cs0": "SELECT horizon, level, count(*) FILTER (round(confidence, 9) >= level) AS n_kept, count(*) AS n, sum(CASE WHEN round(confidence, 9) >= level THEN hit ELSE 0 END) AS hits FROM (SELECT * EXCLUDE (level) FROM sc) CROSS JOIN (SELECT unnest([0.34, 0.4, 0.45, 0.5, 0.55, 0.6]::DOUBLE[]) AS level) GROUP BY 1, 2",
    "cs1": "SELECT *, n_kept / n AS coverage, CASE WHEN n_kept > 0 THEN hits / n_kept ELSE 0.0 END AS accuracy FROM cs0",
    "sweep": "SELECT *, accuracy * sqrt(coverage) AS score, CASE WHEN row_number() OVER (PARTITION BY horizon ORDER BY round(accuracy * sqrt(coverage), 9) DESC, level) = 1 THEN 1 ELSE 0 END AS chosen FROM cs1",
    "covsum": "SELECT horizon, reason, count(*) AS n, count(*) FILTER (prediction = actual) AS n_hits, avg(margin) AS mean_margin FROM decisions GROUP BY 1, 2",
    "simhist": "SELECT horizon, CAST(round(similarity, 9) >= 0.5 AS INTEGER) + CAST(round(similarity, 9) >= 0.6 AS INTEGER) + CAST(round(similarity, 9) >= 0.7 AS INTEGER) + CAST(round(similarity, 9) >= 0.8 AS INTEGER) AS bucket, count(*) AS n, avg(CASE WHEN direction = actual THEN 1.0 ELSE 0.0 END) AS agreement FROM top WHERE actual IS NOT NULL GROUP BY 1, 2",
    "failures": "SELECT horizon, trend, regime, momentum, location, count(*) AS n, count(*) FILTER (hit = 0) AS n_failed, count(*) FILTER (hit = 0) / count(*) AS rate FROM (SELECT series_id, idx, horizon, hit FROM sc) JOIN (SELECT series_id, idx, horizon, trend, regime, momentum, location FROM exper) USING (series_id, idx, horizon) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 5",
    "integrity": "SELECT horizon, count(*) AS n, count(*) FILTER (h_idx = idx) AS n_self, count(*) FILTER (h_idx > idx) AS n_future, count(*) FILTER (idx - h_idx < 16) AS n_near, count(*) FILTER (h_idx + horizon >= oos_start) AS n_crossing FROM top GROUP BY 1",
    "dr0": "SELECT horizon, window_no, " + ", ".join(f"quantile_cont(round({n}, 9), 0.25) AS a_{n}, quantile_cont(round({n}, 9), 0.75) AS b_{n}" for n in ("r1", "r3", "r8", "r16", "volatility_ratio")) + " FROM train GROUP BY 1, 2",
    "dr1": "SELECT horizon, window_no, direction, unnest([" + ", ".join(f"'{n}=' || CASE WHEN round({n}, 9) <= a_{n} THEN 'LOW' WHEN round({n}, 9) >= b_{n} THEN 'HIGH' ELSE 'MID' END" for n in ("r1", "r3", "r8", "r16", "volatility_ratio")) + "]) AS rule FROM train JOIN dr0 USING (horizon, window_no)",
    "dr2": "SELECT horizon, window_no, rule, count(*) AS n, count(*) FILTER (direction = 'UP') AS up, count(*) FILTER (direction = 'DOWN') AS down, count(*) FILTER (direction = 'NEUTRAL') AS neutral FROM dr1 GROUP BY 1, 2, 3 HAVING count(*) >= 20",
    "drules": "SELECT *, greatest(up, down, neutral) / n AS confidence, CASE WHEN up = greatest(up, down, neutral) THEN 'UP' WHEN down = greatest(up, down, neutral) THEN 'DOWN' ELSE 'NEUTRAL' END AS says, (up + down) / n AS directional_rate, greatest(up, down) / nullif(up + down, 0) * ((up + down) / n) AS score FROM dr2 WHERE greatest(up, down, neutral) / n >= 0.5",
}
