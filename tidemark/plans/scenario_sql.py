"""Further expressions for ``oracle``: scenario scores, fused layers, votes of feature groups, events inside and outside test ranges."""

from __future__ import annotations

PART = "PARTITION BY series_id ORDER BY idx"
PAST = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)"
KINDS = ("bullish", "bearish", "neutral")
_PULLED = ", ".join(f"greatest(0.0, {m} + (raw_{k} - {m}) * CAST(0.7 AS DOUBLE)) AS pulled_{k}" for k, m in zip(KINDS, ("CAST(0.33 AS DOUBLE)", "CAST(0.33 AS DOUBLE)", "CAST(0.34 AS DOUBLE)"), strict=True))


def _capped(k: str, before: tuple[str, ...]) -> str:
    is_first = " AND ".join([f"s_{k} = most", *(f"s_{b} < most" for b in before)])
    return f"""CASE WHEN {is_first} THEN least(s_{k}, CAST(0.8 AS DOUBLE))
        WHEN others > 0 THEN s_{k} + greatest(most - CAST(0.8 AS DOUBLE), 0.0) * s_{k} / others ELSE s_{k} END AS share_{k}"""


def _side(column: str, value: str, weight: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN {weight} ELSE 0.0 END"


def _score(kind: str, up: str, rising: str, wick: str, trusted: str) -> str:
    return f"""CASE WHEN up60 + down60 > 0 THEN 3.0 * {up} / (up60 + down60) ELSE 0.0 END + CASE WHEN {rising} THEN 2.0 ELSE 0.0 END
        + {_side("context", f"{kind}_structure", "2.0")} + CASE WHEN integrated = '{kind.upper()}' AND body_momentum = 'rising' THEN 1.5 ELSE 0.0 END
        + CASE WHEN integrated = '{kind.upper()}' AND rejection = '{wick}' THEN 1.5 ELSE 0.0 END + {_side("integrated", kind.upper(), "1.5 * confidence")}
        + {_side("side", kind.upper(), "stability")} + CASE WHEN support > 0 THEN seen_{kind} / support * least(2.0, support / 10) ELSE 0.0 END
        + CASE WHEN resolved > 0 AND good / resolved {trusted} 0.5 THEN least(2.0, resolved / 20) ELSE 0.0 END AS score_{kind}"""


_GROUPS = {"STRUCTURE": "v_structure", "MOMENTUM": "v_momentum", "CANDLE": "v_candle", "STRUCTURE+MOMENTUM": "v_structure + v_momentum",
           "STRUCTURE+LOCATION": "v_structure + v_location", "ALL": "v_structure + v_momentum + v_candle + v_location"}

CTES = {
    "sc_past": f"""SELECT *, coalesce(count(actual) {PAST}, 0) AS resolved, coalesce(count(*) FILTER (prediction = actual) {PAST}, 0) AS good,
        {", ".join(f"round(p_{k} * (support + 3) - 1, 6) AS seen_{k}" for k in KINDS)} FROM online""",
    "sc_all": f"""SELECT w.series_id, w.idx, w.n60, w.up60, w.down60, w.change60, w.body_momentum, w.rejection, s.integrated, s.confidence, n.context, r.stability,
        CASE r.regime WHEN 'TRENDING_UP' THEN 'BULLISH' WHEN 'TRENDING_DOWN' THEN 'BEARISH' ELSE 'NONE' END AS side, p.support, p.resolved, p.good,
        {", ".join(f"p.seen_{k}, p.p_{k}" for k in KINDS)}
      FROM context w JOIN scales s ON s.series_id = w.series_id AND s.idx = w.idx JOIN wcount n ON n.series_id = w.series_id AND n.idx = w.idx
        JOIN regime_runs r ON r.series_id = w.series_id AND r.idx = w.idx JOIN sc_past p ON p.series_id = w.series_id AND p.idx = w.idx""",
    "sc_score": f"""SELECT *, {_score("bullish", "up60", "change60 > 0", "lower", ">")}, {_score("bearish", "down60", "change60 < 0", "upper", "<")},
        CASE WHEN change60 = 0 THEN 1.0 ELSE 0.0 END + {_side("context", "mixed_structure", "1.0")} + {_side("integrated", "MIXED", "1.0")}
        + CASE WHEN support > 0 THEN seen_neutral / support * least(2.0, support / 10) ELSE 0.0 END AS score_neutral FROM sc_all""",
    "sc_raw": f"""SELECT *, {", ".join(f"score_{k} / CASE WHEN total > 0 THEN total ELSE 1.0 END AS raw_{k}" for k in KINDS)}
      FROM (SELECT *, score_bullish + score_bearish + score_neutral AS total FROM sc_score)""",
    "sc_pull": f"SELECT *, {_PULLED} FROM sc_raw",
    "sc_sum": "SELECT *, pulled_bullish + pulled_bearish + pulled_neutral AS whole FROM sc_pull",
    "sc_share": f"SELECT *, {', '.join(f'CASE WHEN whole > 0 THEN pulled_{k} / whole ELSE 1.0 / 3 END AS s_{k}' for k in KINDS)} FROM sc_sum",
    "sc_most": """SELECT *, greatest(s_bullish, s_bearish, s_neutral) AS most,
        s_bullish + s_bearish + s_neutral - greatest(s_bullish, s_bearish, s_neutral) AS others FROM sc_share""",
    "sc_cap": f"SELECT *, {', '.join(_capped(k, KINDS[:n]) for n, k in enumerate(KINDS))} FROM sc_most",
    "scen0": f"""SELECT *, {", ".join(f"CAST(33.33 AS DOUBLE) + (100 * share_{k} - CAST(33.33 AS DOUBLE)) * (1 - unsure) AS percent_{k}" for k in KINDS[:2])}
      FROM sc_cap CROSS JOIN (VALUES (4, CAST(0.0 AS DOUBLE)), (8, CAST(0.08 AS DOUBLE)), (16, CAST(0.16 AS DOUBLE))) h(horizon, unsure)""",
    "scen": "SELECT *, 100 - percent_bullish - percent_bearish AS percent_neutral FROM scen0",
    "fuse0": """SELECT *, CASE WHEN share_bullish = greatest(share_bullish, share_bearish, share_neutral) THEN 'bullish'
        WHEN share_bearish = greatest(share_bullish, share_bearish, share_neutral) THEN 'bearish' ELSE 'neutral' END AS scenario,
        CASE integrated WHEN 'BULLISH' THEN 'bullish' WHEN 'BEARISH' THEN 'bearish' ELSE 'neutral' END AS scale FROM sc_cap""",
    "fuse1": f"""SELECT *, {", ".join(f"CAST(0.35 AS DOUBLE) * {d} / n60 + CASE WHEN scenario = '{k}' THEN CAST(0.15 AS DOUBLE) ELSE 0.0 END"
        f" + CASE WHEN scale = '{k}' THEN CAST(0.2 AS DOUBLE) ELSE 0.0 END + CAST(0.15 AS DOUBLE) * {r} + CAST(0.15 AS DOUBLE) * p_{k} AS mix_{k}"
        for k, d, r in (
            ("bullish", "up60", "CASE side WHEN 'BULLISH' THEN 0.5 + least(stability, 0.5) WHEN 'BEARISH' THEN 0.5 - least(stability, 0.5) ELSE 1.0 / 3 END"),
            ("bearish", "down60", "CASE side WHEN 'BEARISH' THEN 0.5 + least(stability, 0.5) WHEN 'BULLISH' THEN 0.5 - least(stability, 0.5) ELSE 1.0 / 3 END"),
            ("neutral", "(n60 - up60 - down60)", "CASE side WHEN 'NONE' THEN 1.0 / 3 ELSE 0.0 END")))} FROM fuse0""",
    "fuse2": f"SELECT *, {', '.join(f'mix_{k} / (mix_bullish + mix_bearish + mix_neutral) AS fused_{k}' for k in KINDS)} FROM fuse1",
    "fuse3": """SELECT *, greatest(fused_bullish, fused_bearish, fused_neutral) AS f1, least(fused_bullish, fused_bearish, fused_neutral) AS f3,
        list_sort([fused_bullish, fused_bearish, fused_neutral])[2] AS f2 FROM fuse2""",
    "fuse": "SELECT *, greatest(0.0, least(1.0, CAST(0.6 AS DOUBLE) * (f1 - f3) + CAST(0.4 AS DOUBLE) * (f1 - f2))) AS trust FROM fuse3",
    "gv0": """SELECT e.series_id, e.idx, e.horizon, e.direction, e.trend, e.r8, a.close_location, p.place, window_no, oos_start, oos_end
      FROM exper e JOIN anatomy a ON a.series_id = e.series_id AND a.idx = e.idx JOIN places p ON p.series_id = e.series_id AND p.idx = e.idx
        JOIN wins w ON w.series_id = e.series_id WHERE e.direction IS NOT NULL""",
    "gv1": """SELECT series_id, window_no, horizon, quantile_cont(abs(r8), 0.5) AS lim, quantile_cont(close_location, 0.5) AS mid FROM gv0
      WHERE idx + horizon < oos_start GROUP BY 1, 2, 3""",
    "gv2": """SELECT t.*, CASE trend WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END AS v_structure,
        CASE WHEN (lim > 0 AND r8 > lim) OR (lim = 0 AND r8 > 0) THEN 1 WHEN (lim > 0 AND r8 < -lim) OR (lim = 0 AND r8 < 0) THEN -1 ELSE 0 END AS v_momentum,
        CASE WHEN close_location > mid THEN 1 WHEN close_location < mid THEN -1 ELSE 0 END AS v_candle,
        CASE WHEN trend = 'BULLISH' AND place < 0.5 THEN 1 WHEN trend = 'BEARISH' AND place > 0.5 THEN -1 ELSE 0 END AS v_location
      FROM gv0 t JOIN gv1 USING (series_id, window_no, horizon) WHERE idx >= oos_start AND idx < oos_end""",
    "gv3": " UNION ALL ".join(f"SELECT series_id, window_no, horizon, direction, '{g}' AS grp, {v} AS votes FROM gv2" for g, v in _GROUPS.items()),
    "gv4": """SELECT series_id, window_no, horizon, grp AS "group", count(*) AS n, count(*) FILTER (votes <> 0) AS n_decided,
        count(*) FILTER ((votes > 0 AND direction = 'UP') OR (votes < 0 AND direction = 'DOWN')) AS n_hits FROM gv3 GROUP BY ALL""",
    "gvote": "SELECT *, CASE WHEN n_decided > 0 THEN n_hits / n_decided ELSE 0.0 END AS accuracy FROM gv4",
    "ei0": """SELECT series_id, 'walk_forward' AS scheme, oos_start, oos_end FROM wins UNION ALL SELECT series_id, scheme, oos_start, oos_end FROM schemes""",
    "ei1": """SELECT s.series_id, d.scheme, s.idx, s.event,
        CASE WHEN EXISTS (SELECT 1 FROM ei0 r WHERE r.series_id = s.series_id AND r.scheme = d.scheme AND s.idx >= r.oos_start AND s.idx < r.oos_end) THEN 1 ELSE 0 END AS inside
      FROM structure s JOIN (SELECT DISTINCT series_id, scheme FROM ei0) d ON d.series_id = s.series_id""",
    "ei2": """SELECT series_id, scheme, event, CAST(sum(inside) AS BIGINT) AS n_inside, CAST(sum(1 - inside) AS BIGINT) AS n_outside FROM ei1 GROUP BY 1, 2, 3""",
    "eindep": """SELECT *, n_inside / greatest(sum(n_inside) OVER w, 1) AS rate_inside, n_outside / greatest(sum(n_outside) OVER w, 1) AS rate_outside,
        CAST(n_inside > 0 AND n_outside = 0 AS INTEGER) AS only_inside FROM ei2 WINDOW w AS (PARTITION BY series_id, scheme)""",
}
