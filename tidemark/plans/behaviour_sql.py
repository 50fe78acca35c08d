"""Further expressions for ``oracle``: symbols and anatomy, counters, sequences of labels, states with a prior, schemes of splits, ranks of retrieval."""

from __future__ import annotations

PART = "PARTITION BY series_id ORDER BY idx"
LAG = f"OVER ({PART})"
Q = "series_id, window_no, horizon, idx"


def _wick(x: str) -> str:
    return f"CASE WHEN {x} / greatest(range, 1e-6) >= 0.35 THEN 'high' WHEN {x} / greatest(range, 1e-6) >= 0.15 THEN 'medium' ELSE 'low' END AS {x}_class"


_SPLITS = "SELECT series_id, count(*) AS n, CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS cut FROM bars GROUP BY 1"
_RANKED = ("same", "gap", "similarity", "structure", "regime", "path")

CTES = {
    "symb0": f"""SELECT *, CASE WHEN close > open THEN 'B' WHEN close < open THEN 'S' ELSE 'N' END AS side, CASE WHEN body / greatest(range, 1e-6) >= 0.65 THEN 'strong' WHEN body / greatest(range, 1e-6) >= 0.3 THEN 'medium' ELSE 'weak' END AS body_class,
      {_wick('upper')}, {_wick('lower')}, CASE WHEN (close - low) / greatest(range, 1e-6) >= 0.7 THEN 'high' WHEN (close - low) / greatest(range, 1e-6) <= 0.3 THEN 'low' ELSE 'middle' END AS close_class FROM anatomy""",
    "symb": "SELECT *, side || ':' || body_class || ':U' || upper_class || ':L' || lower_class AS symbol FROM symb0",
    "norm0": f"""SELECT *, greatest(range, 1e-12) AS span, coalesce(lag(close) {LAG}, close) AS was, greatest(coalesce(quantile_cont(range, 0.5) OVER ({PART} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), unit), 1e-12) AS usual FROM feat""",
    "norm1": "SELECT *, (close - low) / span AS place, span / usual AS growth, body / span AS bs FROM norm0",
    "norm": """SELECT *, body / unit AS body_atr, span / unit AS span_atr, ((open + close) / 2 - low) / span AS body_place, CASE WHEN range > 1e-9 THEN abs(close - was) / span END AS efficiency, CASE WHEN usual > 1e-9 THEN growth END AS expansion,
      CASE WHEN bs <= 0.15 THEN 'DOJI' WHEN bs >= 0.7 AND direction = 'UP' THEN 'STRONG_BODY_UP' WHEN bs >= 0.7 AND direction = 'DOWN' THEN 'STRONG_BODY_DOWN' WHEN lower >= body * CAST(1.8 AS DOUBLE) AND place >= 0.6 THEN 'BULLISH_REJECTION'
        WHEN upper >= body * CAST(1.8 AS DOUBLE) AND place <= 0.4 THEN 'BEARISH_REJECTION' WHEN growth >= 1.8 AND direction = 'UP' THEN 'WIDE_RANGE_UP' WHEN growth >= 1.8 AND direction = 'DOWN' THEN 'WIDE_RANGE_DOWN' WHEN growth <= 0.65 THEN 'COMPRESSION' ELSE 'NORMAL' END AS type,
      CASE WHEN lower >= greatest(body * 1.5, span * CAST(0.45 AS DOUBLE)) AND place > 0.55 THEN 'BULLISH' WHEN upper >= greatest(body * 1.5, span * CAST(0.45 AS DOUBLE)) AND place < 0.45 THEN 'BEARISH' ELSE 'NONE' END AS rejection,
      CASE WHEN place >= 0.75 AND direction = 'UP' THEN 'BUYING' WHEN place <= 0.25 AND direction = 'DOWN' THEN 'SELLING' ELSE 'MIXED' END AS pressure FROM norm1""",
    # Each bar is joined with the bars of its window, and its swings are found and compared among those alone.
    "wc0": "SELECT b.series_id, b.idx, s.idx AS s_idx, s.high, s.low, s.direction FROM anatomy b JOIN anatomy s ON s.series_id = b.series_id AND s.idx BETWEEN b.idx - 29 AND b.idx",
    "wc1": """SELECT *, lag(direction) OVER w AS was, high > lag(high) OVER w AND high > lead(high) OVER w AS top, low < lag(low) OVER w AND low < lead(low) OVER w AS bottom FROM wc0 WINDOW w AS (PARTITION BY series_id, idx ORDER BY s_idx)""",
    "wc2": "SELECT series_id, idx, count(*) FILTER (was = 'UP' AND direction = 'UP') AS n_bullish, count(*) FILTER (was = 'DOWN' AND direction = 'DOWN') AS n_bearish, count(*) FILTER (was <> direction AND was <> 'FLAT' AND direction <> 'FLAT') AS n_changes FROM wc1 GROUP BY 1, 2",
    "wch": "SELECT series_id, idx, count(*) FILTER (high > b) AS n_hh, count(*) FILTER (high < b) AS n_lh FROM (SELECT *, lag(high) OVER (PARTITION BY series_id, idx ORDER BY s_idx) AS b FROM wc1 WHERE top) GROUP BY 1, 2",
    "wcl": "SELECT series_id, idx, count(*) FILTER (low > b) AS n_hl, count(*) FILTER (low < b) AS n_ll FROM (SELECT *, lag(low) OVER (PARTITION BY series_id, idx ORDER BY s_idx) AS b FROM wc1 WHERE bottom) GROUP BY 1, 2",
    "wc3": "SELECT wc2.*, coalesce(n_hh, 0) AS n_hh, coalesce(n_lh, 0) AS n_lh, coalesce(n_hl, 0) AS n_hl, coalesce(n_ll, 0) AS n_ll FROM wc2 LEFT JOIN wch USING (series_id, idx) LEFT JOIN wcl USING (series_id, idx)",
    "wcount": "SELECT *, CASE WHEN n_hh > n_lh AND n_hl >= n_ll THEN 'bullish_structure' WHEN n_lh > n_hh AND n_ll >= n_hl THEN 'bearish_structure' ELSE 'mixed_structure' END AS context FROM wc3",
    "lseq0": f"SELECT series_id, idx, list(label) OVER ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ls FROM classes",
    "lseq1": "SELECT series_id, idx, k AS length, array_to_string(ls[-k:], '>') AS labels FROM (SELECT *, unnest([2, 3, 4, 5]) AS k FROM lseq0) WHERE len(ls) >= k",
    "lseq2": "SELECT horizon, length, labels, count(*) AS n, count(*) FILTER (direction = 'UP') AS u, count(*) FILTER (direction = 'DOWN') AS d, count(*) FILTER (direction = 'NEUTRAL') AS z FROM lseq1 JOIN outcomes USING (series_id, idx) WHERE direction IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20",
    "lseq3": "SELECT *, greatest(u, d, z) / n AS confidence, CASE WHEN u = greatest(u, d, z) THEN 'UP' WHEN d = greatest(u, d, z) THEN 'DOWN' ELSE 'NEUTRAL' END AS says FROM lseq2 WHERE greatest(u, d, z) / n >= 0.2",
    "lseq": "SELECT *, row_number() OVER (PARTITION BY horizon, length ORDER BY confidence DESC, n DESC, labels) AS rank FROM lseq3 QUALIFY rank <= 10",
    "prior0": "SELECT series_id, window_no, horizon, state_key, count(*) FILTER (direction = 'UP') AS up, count(*) AS n FROM train WHERE direction <> 'NEUTRAL' GROUP BY 1, 2, 3, 4",
    "prior1": "SELECT series_id, window_no, horizon, sum(up) AS all_up, sum(n) AS all_n FROM prior0 GROUP BY 1, 2, 3",
    "prior": """SELECT t.series_id, t.window_no, t.horizon, t.idx, t.direction, t.state_key, CASE WHEN n IS NOT NULL THEN 'STATE' WHEN all_n IS NOT NULL THEN 'GLOBAL' ELSE 'NONE' END AS source, CAST(coalesce(n, all_n, 0) AS BIGINT) AS samples,
      coalesce((up + 2.0) / (n + 4.0), (all_up + 2.0) / (all_n + 4.0), 0.5) AS p_up FROM tests t LEFT JOIN prior0 USING (series_id, window_no, horizon, state_key) LEFT JOIN prior1 USING (series_id, window_no, horizon)""",
    "schemes0": _SPLITS,
    "schemes1": "SELECT *, cut + k * greatest(50, (n - cut) // 5) AS start, CASE WHEN k = 4 THEN n ELSE least(n, cut + (k + 1) * greatest(50, (n - cut) // 5)) END AS stop FROM (SELECT *, unnest(range(5)) AS k FROM schemes0 WHERE n >= 200)",
    "schemes": """SELECT series_id, 'ratio' AS scheme, CAST(row_number() OVER (PARTITION BY series_id ORDER BY k) AS INTEGER) AS window_no, start AS oos_start, stop AS oos_end FROM schemes1 WHERE start >= 150 AND stop - start >= 50
      UNION ALL SELECT series_id, 'folds', CAST(k AS INTEGER), k * (n // 5), (k + 1) * (n // 5) FROM (SELECT *, unnest(range(1, 5)) AS k FROM schemes0) WHERE n >= 5 UNION ALL SELECT series_id, 'chronological', 1, cut, n FROM schemes0 WHERE cut > 0""",
    "confbins": "SELECT horizon, CAST(least(floor(round(confidence, 9) * 5), 4) AS INTEGER) AS bin, count(*) AS n, avg(hit) AS accuracy, avg(round(confidence, 9)) AS mean_confidence FROM sc GROUP BY 1, 2",
    "cd0": f"SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY similarity DESC, h_idx DESC) AS rank, CAST(direction = actual AS INTEGER) AS same, idx - h_idx AS gap FROM matches WHERE actual IS NOT NULL",
    "cd1": f"SELECT {Q}, k, {', '.join(f'avg({x}) AS {x}' for x in _RANKED)} FROM (SELECT *, unnest([1, 5, 10, 25]) AS k FROM cd0) WHERE rank <= k GROUP BY ALL",
    "canddiag": f"SELECT horizon, k, count(*) AS n_queries, {', '.join(f'avg({x}) AS mean_{x}' for x in _RANKED)} FROM cd1 GROUP BY 1, 2",
}
