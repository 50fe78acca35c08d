"""Further expressions for ``oracle``: the 26 features of a bar, the rules of one and two conditions over them, and their walk-forward test."""

from __future__ import annotations

PART = "PARTITION BY series_id ORDER BY idx"
LAG = f"OVER ({PART})"
LAST20 = f"OVER ({PART} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
BEFORE20 = f"OVER ({PART} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
SPAN = "greatest(high - low, 1e-12)"
KEYS = "series_id, horizon, fold"

_NUMBERS = (
    "return_5 return_10 return_20 return_30 return_60 bullish_ratio bearish_ratio directional_imbalance volatility volatility_ratio location_in_range "
    "normalized_slope momentum_acceleration recent_body_ratio recent_upper_wick recent_lower_wick"
).split()
_KINDS = (
    "latest_candle directional_regime volatility_regime location_state trend_consistency pressure range_event swing_high_state swing_low_state structure_regime"
).split()


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) < 1e-12 THEN 0.0 ELSE ({a}) / ({b}) END)"


def _back(n: int) -> str:
    return f"CASE WHEN idx >= {n} THEN {_div(f'close - lag(close, {n}) {LAG}', f'lag(close, {n}) {LAG}')} ELSE 0.0 END AS return_{n}"


_BINS = ", ".join(f"CASE WHEN {n} <= lo_{n} THEN 'q1' WHEN {n} >= hi_{n} THEN 'q3' ELSE 'q2' END AS {n}" for n in _NUMBERS)
_CUTS = ", ".join(f"quantile_cont({n}, 0.25) AS lo_{n}, quantile_cont({n}, 0.75) AS hi_{n}" for n in _NUMBERS)
_FACTS = ", ".join(f"'{n}=' || {n}" for n in (*_NUMBERS, *_KINDS))

LAST60 = f"OVER ({PART} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_STRUCTURE = "return_15 return_30 return_60 bullish_ratio bearish_ratio directional_imbalance volatility volatility_ratio location_in_range normalized_slope".split()
_MIXED = "directional_regime trend_consistency volatility_regime location_state momentum_state pressure range_event".split()


def _counts(*labels: str) -> str:
    return ", ".join(f"count(*) FILTER (label = '{x}') AS {y}" for x, y in zip(labels, ("n_rising", "n_flat", "n_falling"), strict=True))


CTES = {
    "f26a": f"""SELECT *, {", ".join(_back(n) for n in (5, 10, 20, 30, 60))},
        CASE WHEN idx >= 1 AND abs(lag(close) {LAG}) >= 1e-12 THEN (close - lag(close) {LAG}) / lag(close) {LAG} END AS move,
        count(*) FILTER (close > open) {LAST20} AS ups, count(*) FILTER (close < open) {LAST20} AS downs, max(high) {LAST20} AS high20, min(low) {LAST20} AS low20,
        max(high) {BEFORE20} AS prior_high, min(low) {BEFORE20} AS prior_low, abs(close - open) / {SPAN} AS recent_body_ratio,
        (high - greatest(open, close)) / {SPAN} AS recent_upper_wick, (least(open, close) - low) / {SPAN} AS recent_lower_wick
      FROM bars""",
    "f26b": f"""SELECT *, CASE WHEN count(move) {LAST20} >= 2 THEN stddev_pop(move) {LAST20} ELSE 0.0 END AS volatility, {_div("ups", "ups + downs")} AS bullish_ratio,
        {_div("downs", "ups + downs")} AS bearish_ratio, {_div("close - low20", "high20 - low20")} AS location_in_range, return_60 AS normalized_slope,
        return_10 - return_20 AS momentum_acceleration FROM f26a""",
    "f26c": f"""SELECT *, bullish_ratio - bearish_ratio AS directional_imbalance, CASE WHEN idx >= 11 THEN lag(volatility, 10) {LAG} ELSE volatility END AS vol_was
      FROM f26b""",
    "f26d": f"SELECT *, {_div('volatility', 'vol_was')} AS volatility_ratio FROM f26c",
    "f26e": f"""SELECT *,
        CASE WHEN recent_body_ratio <= CAST(0.10 AS DOUBLE) THEN 'doji'
             WHEN close > open AND recent_body_ratio >= CAST(0.65 AS DOUBLE) AND (close - low) / {SPAN} >= 0.75 THEN 'strong_bullish'
             WHEN close < open AND recent_body_ratio >= CAST(0.65 AS DOUBLE) AND (high - close) / {SPAN} >= 0.75 THEN 'strong_bearish'
             WHEN close > open AND recent_body_ratio >= 0.50 THEN 'bullish_close_strong' WHEN close < open AND recent_body_ratio >= 0.50 THEN 'bearish_close_strong'
             WHEN recent_lower_wick >= CAST(0.55 AS DOUBLE) AND recent_body_ratio <= CAST(0.35 AS DOUBLE) THEN 'hammer_like'
             WHEN recent_upper_wick >= CAST(0.55 AS DOUBLE) AND recent_body_ratio <= CAST(0.35 AS DOUBLE) THEN 'shooting_star_like' ELSE 'normal' END AS latest_candle,
        CASE WHEN return_60 > CAST(0.002 AS DOUBLE) THEN 'bullish' WHEN return_60 < CAST(-0.002 AS DOUBLE) THEN 'bearish' ELSE 'neutral' END AS directional_regime,
        CASE WHEN volatility_ratio > CAST(1.15 AS DOUBLE) THEN 'expanding' WHEN volatility_ratio < CAST(0.85 AS DOUBLE) THEN 'contracting' ELSE 'stable' END
          AS volatility_regime,
        CASE WHEN location_in_range >= 0.75 THEN 'upper_range' WHEN location_in_range <= 0.25 THEN 'lower_range' ELSE 'middle_range' END AS location_state,
        CASE WHEN abs(return_60) >= CAST(0.003 AS DOUBLE) THEN 'strong' WHEN abs(return_60) >= CAST(0.001 AS DOUBLE) THEN 'moderate' ELSE 'weak' END AS trend_consistency,
        CASE WHEN directional_imbalance > CAST(0.15 AS DOUBLE) THEN 'bullish' WHEN directional_imbalance < CAST(-0.15 AS DOUBLE) THEN 'bearish' ELSE 'neutral' END AS pressure,
        CASE WHEN location_in_range >= CAST(0.9 AS DOUBLE) THEN 'near_high' WHEN location_in_range <= CAST(0.1 AS DOUBLE) THEN 'near_low' ELSE 'inside_range' END AS range_event,
        CASE WHEN idx < 20 THEN 'unknown' WHEN high > prior_high THEN 'higher_high' WHEN high < prior_high THEN 'lower_high' ELSE 'equal_high' END AS swing_high_state,
        CASE WHEN idx < 20 THEN 'unknown' WHEN low < prior_low THEN 'lower_low' WHEN low > prior_low THEN 'higher_low' ELSE 'equal_low' END AS swing_low_state
      FROM f26d""",
    "feat26": """SELECT *, CASE WHEN directional_regime = 'bullish' AND swing_high_state = 'higher_high' THEN 'up_structure'
        WHEN directional_regime = 'bearish' AND swing_low_state = 'lower_low' THEN 'down_structure' ELSE 'mixed_structure' END AS structure_regime FROM f26e""",
    "rec0": """SELECT a.*, h.horizon, b.close AS future FROM feat26 a, (VALUES (4), (8), (16)) h(horizon)
      JOIN bars b ON b.series_id = a.series_id AND b.idx = a.idx + h.horizon WHERE a.idx >= 60 AND a.close > 0""",
    "rec1": """SELECT *, CASE WHEN (future - close) / close > CAST(0.0005 AS DOUBLE) THEN 'BUY' WHEN (future - close) / close < CAST(-0.0005 AS DOUBLE) THEN 'SELL'
        ELSE 'NEUTRAL' END AS outcome, row_number() OVER (PARTITION BY series_id, horizon ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY series_id, horizon) AS n
      FROM rec0""",
    "recf": """SELECT r.*, f.fold, place < fold * (n // 5) AS calibrates FROM rec1 r, (VALUES (1), (2), (3), (4)) f(fold)
      WHERE n >= 5 AND place < (fold + 1) * (n // 5)""",
    "rcuts": f"SELECT {KEYS}, {_CUTS} FROM recf WHERE calibrates GROUP BY ALL",
    "rbins": f"SELECT {KEYS}, idx, calibrates, outcome, {_BINS}, {', '.join(_KINDS)} FROM recf JOIN rcuts USING ({KEYS})",
    "rfacts": f"SELECT {KEYS}, idx, calibrates, outcome, [{_FACTS}] AS facts FROM rbins",
    "rcells": f"""SELECT {KEYS}, idx, calibrates, outcome, i, j, CASE WHEN i = j THEN facts[i] ELSE facts[i] || ' & ' || facts[j] END AS rule
      FROM rfacts, range(1, 27) a(i), range(1, 27) b(j) WHERE i <= j""",
    "rcount": f"""SELECT {KEYS}, rule, count(*) AS n, count(*) FILTER (outcome = 'BUY') AS b, count(*) FILTER (outcome = 'SELL') AS s, count(*) FILTER (outcome = 'NEUTRAL') AS z
      FROM rcells WHERE calibrates GROUP BY ALL HAVING count(*) >= 20""",
    "crules": f"""SELECT {KEYS}, rule, n, CASE WHEN b = greatest(b, s, z) THEN 'BUY' WHEN s = greatest(b, s, z) THEN 'SELL' ELSE 'NEUTRAL' END AS says,
        greatest(b, s, z) / n AS confidence FROM rcount WHERE greatest(b, s, z) / n >= 0.5""",
    "cbest": f"""SELECT x.series_id, x.horizon, x.fold, x.idx, x.outcome, r.says, row_number() OVER (PARTITION BY x.series_id, x.horizon, x.fold, x.idx
          ORDER BY r.confidence DESC, r.n DESC, CASE WHEN i = j THEN 0 ELSE 1 END, i, j) AS k
      FROM rcells x JOIN crules r ON r.series_id = x.series_id AND r.horizon = x.horizon AND r.fold = x.fold AND r.rule = x.rule WHERE NOT calibrates""",
    "csaid": f"SELECT {KEYS}, count(*) AS predictions, count(*) FILTER (says = outcome) AS correct FROM cbest WHERE k = 1 GROUP BY ALL",
    "ctest": f"SELECT {KEYS}, count(*) AS n FROM recf WHERE NOT calibrates GROUP BY ALL",
    "cwalk": f"""SELECT *, {_div("correct", "predictions")} AS accuracy, {_div("predictions", "n")} AS coverage
      FROM (SELECT {KEYS}, n, coalesce(predictions, 0) AS predictions, coalesce(correct, 0) AS correct FROM ctest LEFT JOIN csaid USING ({KEYS}))""",
    # Neighbours: every pair of a test row and a training row, ranked.
    "sf0": f"""SELECT *, CASE WHEN idx >= 1 AND lag(close) {LAG} <> 0 THEN (close - lag(close) {LAG}) / lag(close) {LAG} END AS move,
        {", ".join(f"{_div(f'close - lag(close, {k}) {LAG}', f'lag(close, {k}) {LAG}')} AS return_{n}" for n, k in ((15, 15), (30, 30), (60, 59)))},
        count(*) FILTER (close > open) {LAST60} / CAST(60 AS DOUBLE) AS bullish_ratio, count(*) FILTER (close < open) {LAST60} / CAST(60 AS DOUBLE) AS bearish_ratio,
        max(high) {LAST60} AS high60, min(low) {LAST60} AS low60 FROM bars""",
    "sf1": f"""SELECT *, stddev_pop(move) OVER ({PART} ROWS BETWEEN 58 PRECEDING AND CURRENT ROW) AS volatility, stddev_pop(move) {LAST20} AS recent,
        bullish_ratio - bearish_ratio AS directional_imbalance, {_div("close - low60", "high60 - low60")} AS location_in_range, return_60 AS normalized_slope FROM sf0""",
    "sf2": f"""SELECT *, {_div("recent", "volatility")} AS volatility_ratio,
        CAST(return_15 > CAST(0.001 AS DOUBLE) AS INTEGER) - CAST(return_15 < CAST(-0.001 AS DOUBLE) AS INTEGER)
        + CAST(return_30 > CAST(0.002 AS DOUBLE) AS INTEGER) - CAST(return_30 < CAST(-0.002 AS DOUBLE) AS INTEGER)
        + CAST(return_60 > CAST(0.003 AS DOUBLE) AS INTEGER) - CAST(return_60 < CAST(-0.003 AS DOUBLE) AS INTEGER)
        + CAST(directional_imbalance > CAST(0.05 AS DOUBLE) AS INTEGER) - CAST(directional_imbalance < CAST(-0.05 AS DOUBLE) AS INTEGER) AS score
      FROM sf1 WHERE idx >= 59 AND close > 0""",
    "sf3": f"""SELECT series_id, idx, close, {", ".join(_STRUCTURE)},
        CASE WHEN score >= 3 THEN 'bullish' WHEN score >= 1 THEN 'bullish_bias' WHEN score <= -3 THEN 'bearish' WHEN score <= -1 THEN 'bearish_bias' ELSE 'neutral' END
          AS regime,
        CASE WHEN volatility_ratio >= CAST(1.15 AS DOUBLE) THEN 'expanding' WHEN volatility_ratio <= CAST(0.85 AS DOUBLE) THEN 'contracting' ELSE 'stable' END
          AS volatility_regime FROM sf2""",
    "sf4": """SELECT f.*, h.horizon, CASE WHEN b.close IS NULL THEN NULL WHEN (b.close - f.close) / f.close >= CAST(0.0015 AS DOUBLE) THEN 'bullish'
        WHEN (b.close - f.close) / f.close <= CAST(-0.0015 AS DOUBLE) THEN 'bearish' ELSE 'neutral' END AS direction
      FROM sf3 f CROSS JOIN (VALUES (4), (8), (16)) h(horizon) LEFT JOIN bars b ON b.series_id = f.series_id AND b.idx = f.idx + h.horizon""",
    "sfq": "SELECT f.*, window_no FROM sf4 f JOIN wins w ON w.series_id = f.series_id AND f.idx >= oos_start AND f.idx < oos_end",
    "sft": """SELECT f.*, window_no FROM sf4 f JOIN wins w ON w.series_id = f.series_id AND f.idx + f.horizon < oos_start WHERE direction IS NOT NULL""",
    "sfs": f"""SELECT series_id, window_no, horizon, {", ".join(f"avg({v}) AS m_{v}, CASE WHEN stddev_pop({v}) > 1e-12 THEN stddev_pop({v}) ELSE 1.0 END AS s_{v}" for v in _STRUCTURE)}
      FROM sft GROUP BY 1, 2, 3""",
    "sfn": f"""SELECT q.series_id, q.window_no, q.horizon, q.idx, t.direction AS label, row_number() OVER (PARTITION BY q.series_id, q.window_no, q.horizon, q.idx
          ORDER BY round(sqrt({" + ".join(f"power((q.{v} - m_{v}) / s_{v} - (t.{v} - m_{v}) / s_{v}, 2)" for v in _STRUCTURE)}), 9), t.idx) AS k
      FROM sfq q JOIN sfs s ON s.series_id = q.series_id AND s.window_no = q.window_no AND s.horizon = q.horizon
        JOIN sft t ON t.series_id = q.series_id AND t.window_no = q.window_no AND t.horizon = q.horizon AND t.regime = q.regime AND t.volatility_regime = q.volatility_regime""",
    "sfv": f"""SELECT q.series_id, q.window_no, q.horizon, q.idx, q.direction, m.k, count(label) AS n, {_counts("bullish", "neutral", "bearish")}
      FROM sfq q CROSS JOIN (VALUES (10), (20), (40)) m(k) LEFT JOIN sfn n ON n.series_id = q.series_id AND n.window_no = q.window_no AND n.horizon = q.horizon
        AND n.idx = q.idx AND n.k <= m.k GROUP BY ALL""",
    "rnear": """SELECT *, CASE WHEN n = 0 THEN 'NO TRADE' WHEN n_rising = greatest(n_rising, n_flat, n_falling) THEN 'BUY'
          WHEN n_flat = greatest(n_rising, n_flat, n_falling) THEN 'NO TRADE' ELSE 'SELL' END AS says,
        CASE WHEN n > 0 THEN greatest(n_rising, n_flat, n_falling) / n ELSE 0.0 END AS confidence FROM sfv""",
    "mx0": """SELECT f.*, h.horizon, CASE WHEN return_5 > 0 AND return_10 > 0 THEN 'bullish' WHEN return_5 < 0 AND return_10 < 0 THEN 'bearish' ELSE 'mixed' END AS momentum_state,
        CASE WHEN b.close IS NULL THEN NULL WHEN (b.close - f.close) / f.close > CAST(0.0005 AS DOUBLE) THEN 'BUY'
          WHEN (b.close - f.close) / f.close < CAST(-0.0005 AS DOUBLE) THEN 'SELL' ELSE 'NEUTRAL' END AS direction
      FROM feat26 f CROSS JOIN (VALUES (4), (8), (16)) h(horizon) LEFT JOIN bars b ON b.series_id = f.series_id AND b.idx = f.idx + h.horizon
      WHERE f.idx >= 60 AND f.close > 0""",
    "mxq": "SELECT f.*, window_no FROM mx0 f JOIN wins w ON w.series_id = f.series_id AND f.idx >= oos_start AND f.idx < oos_end",
    "mxn": f"""SELECT q.series_id, q.window_no, q.horizon, q.idx, t.direction AS label, row_number() OVER (PARTITION BY q.series_id, q.window_no, q.horizon, q.idx
          ORDER BY round(sqrt({" + ".join(f"power((q.{v} - t.{v}) / greatest(abs(q.{v}), abs(t.{v}), 0.0001), 2)" for v in _NUMBERS if v != "volatility")}
            + {" + ".join(f"CAST(q.{v} <> t.{v} AS INTEGER)" for v in _MIXED)}), 9), t.idx) AS k
      FROM mxq q JOIN wins w ON w.series_id = q.series_id AND w.window_no = q.window_no
        JOIN mx0 t ON t.series_id = q.series_id AND t.horizon = q.horizon AND t.idx + t.horizon < w.oos_start AND t.direction IS NOT NULL""",
    "mxv": f"""SELECT q.series_id, q.window_no, q.horizon, q.idx, q.direction, m.k, count(label) AS n, {_counts("BUY", "NEUTRAL", "SELL")}
      FROM mxq q CROSS JOIN (VALUES (10), (20), (40)) m(k) LEFT JOIN mxn n ON n.series_id = q.series_id AND n.window_no = q.window_no AND n.horizon = q.horizon
        AND n.idx = q.idx AND n.k <= m.k GROUP BY ALL""",
    "mnear": """SELECT *, CASE WHEN n_rising + n_falling = 0 THEN 'NO TRADE' WHEN n_rising > n_falling THEN 'BUY' ELSE 'SELL' END AS says,
        CASE WHEN n_rising + n_falling > 0 THEN greatest(n_rising, n_falling) / (n_rising + n_falling) ELSE 0.0 END AS confidence FROM mxv""",
    "srec": """SELECT *, CASE WHEN return_5 > 0 AND return_10 > 0 THEN 'bullish' WHEN return_5 < 0 AND return_10 < 0 THEN 'bearish' ELSE 'mixed' END AS momentum_state
      FROM recf WHERE calibrates""",
    "srule0": f"""SELECT {KEYS}, {", ".join(_MIXED)}, count(*) AS n, count(*) FILTER (outcome = 'BUY') AS n_buy, count(*) FILTER (outcome = 'SELL') AS n_sell
      FROM srec GROUP BY ALL""",
    "srules": """SELECT *, CASE WHEN n_buy >= n_sell THEN 'BUY' ELSE 'SELL' END AS says, greatest(n_buy, n_sell) / (n_buy + n_sell) AS confidence FROM srule0
      WHERE n >= 20 AND n_buy + n_sell > 0 AND greatest(n_buy, n_sell) / (n_buy + n_sell) >= 0.5""",
    "rsig0": f"SELECT {KEYS}, rule, n, says, list_sort(string_split(rule, ' & ')) AS conditions FROM crules",
    "rsig1": """SELECT series_id, horizon, array_to_string(conditions, ' & ') AS rule, says, count(*) AS n_folds, CAST(sum(n) AS BIGINT) AS samples
      FROM rsig0 GROUP BY ALL""",
    "rsigs": "SELECT *, count(*) OVER (PARTITION BY series_id, horizon, rule) AS n_directions FROM rsig1",
    "rusage": f"""SELECT {KEYS}, split_part(condition, '=', 1) AS feature, count(*) AS n_rules FROM (SELECT {KEYS}, unnest(conditions) AS condition FROM rsig0)
      GROUP BY ALL""",
    "rredun": f"""SELECT p.series_id, p.horizon, p.fold, p.rule, s.rule AS condition, p.n, p.says
      FROM rsig0 p JOIN rsig0 s ON s.series_id = p.series_id AND s.horizon = p.horizon AND s.fold = p.fold AND s.n = p.n AND s.says = p.says
        AND list_contains(p.conditions, s.rule) WHERE len(p.conditions) = 2 AND len(s.conditions) = 1""",
    # Ingestion: each rule of the contract on the rows as entered.
    "in0": """SELECT l_returnflag AS series_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber,
          l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount) AS source_row, l_shipdate AS ts,
        l_extendedprice / l_quantity AS price, l_tax, l_discount, l_quantity FROM lineitem""",
    "in1": """SELECT series_id, source_row, ts, floor(price * 100) AS open, floor(price * (1 + l_tax) * 100) AS high,
        floor(price * (1 - l_discount) * 100) AS low, floor(price * (CAST(0.99 AS DOUBLE) + l_discount / 4) * 100) AS close,
        CASE WHEN l_quantity > 3 THEN l_quantity - 10 END AS volume FROM in0""",
    "in2": """SELECT *, low <= least(open, close) AND high >= greatest(open, close) AS fits,
        max(ts) OVER (PARTITION BY series_id ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM in1""",
    "in3": """SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY series_id, ts, fits ORDER BY source_row) END AS nth FROM in2""",
    "in4": """SELECT *, fits AND nth = 1 AS accepted FROM in3""",
    "in5": """SELECT *, CASE WHEN accepted THEN lag(ts) OVER (PARTITION BY series_id, accepted ORDER BY ts) END AS before FROM in4""",
    "iissues": """SELECT series_id, kind, issue, count(*) AS n FROM (
        SELECT series_id, 'error' AS kind, CASE WHEN NOT fits THEN 'INVALID_OHLC' WHEN nth > 1 THEN 'DUPLICATE_TIMESTAMP' END AS issue FROM in5
        UNION ALL SELECT series_id, 'warning', CASE WHEN ts < latest THEN 'OUT_OF_ORDER' END FROM in5
        UNION ALL SELECT series_id, 'warning', CASE WHEN volume < 0 THEN 'INVALID_VOLUME' END FROM in5
        UNION ALL SELECT series_id, 'warning', CASE WHEN epoch(ts) - epoch(before) > 86400 THEN 'TIME_GAP' END FROM in5)
      WHERE issue IS NOT NULL GROUP BY ALL""",
    "ibars": """SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, source_row, ts, open, high, low, close,
        CASE WHEN volume >= 0 THEN volume END AS volume FROM in5 WHERE accepted""",
}
