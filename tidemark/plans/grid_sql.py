"""Further expressions for ``oracle``: configurations of the retrieval on inner splits and the forecasts of the chosen ones."""

from __future__ import annotations

UPS = ("UP", "DOWN", "NEUTRAL")
_BALANCED = {
    "structure": (0.20, 0.22, 0.24), "sequence": (0.16, 0.15, 0.13), "regime": (0.14, 0.16, 0.17), "location": (0.08, 0.08, 0.07),
    "momentum": (0.12, 0.10, 0.08), "volatility": (0.08, 0.08, 0.09), "candle": (0.06, 0.05, 0.04), "path": (0.16, 0.16, 0.18),
}
_NAMES = tuple(_BALANCED)
_SAME = ("trend", "event", "high_label", "low_label", "sequence", "regime", "location", "momentum")
_weighed = {
    "balanced": " + ".join(f"(CASE horizon WHEN 4 THEN {a} WHEN 8 THEN {b} ELSE {d} END) * {n}" for n, (a, b, d) in _BALANCED.items()),
    "structure_first": " + ".join(f"{w} * {n}" for n, w in zip(_NAMES, (0.24, 0.16, 0.16, 0.08, 0.08, 0.07, 0.07, 0.14), strict=True)),
    "context_first": " + ".join(f"{w} * {n}" for n, w in zip(_NAMES, (0.15, 0.10, 0.25, 0.12, 0.10, 0.09, 0.07, 0.12), strict=True)),
}
_quality = f"(0.75 + 0.25 * (0.55 * ({' + '.join(f'CAST({n} > 0 AS INTEGER)' for n in _NAMES)}) / 8 + 0.45 * greatest(structure, sequence, regime)))"
_clash = "(regime = 0 OR (same_event = 0 AND structure < 0.25) OR sequence = 0 OR momentum = 0)"
_near = "0.4 * exp(-abs(a.p_change - b.p_change) / 0.65) + 0.25 * exp(-abs(a.p_total - b.p_total) / 1.25)"
_form = "0.2 * (0.65 * exp(-abs(a.p_range - b.p_range) / 0.8) + 0.35 * exp(-abs(a.p_body - b.p_body) / 0.7)) + CASE WHEN a.p_direction = b.p_direction THEN 0.15 ELSE 0.0 END"
_PAST = "ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 16 PRECEDING"
_LEVELS = {"e": "series_id, horizon, regime, event, sequence", "r": "series_id, horizon, regime", "g": "series_id, horizon"}
_counts = ", ".join(f"count(*) FILTER (direction = '{d}') OVER (PARTITION BY {keys} {_PAST}) AS {level}_{d}" for level, keys in _LEVELS.items() for d in UPS)
_all = {level: f"({level}_UP + {level}_DOWN + {level}_NEUTRAL)" for level in _LEVELS}


def _base(d: str) -> str:
    return f"""CASE WHEN {_all["e"]} >= 12 THEN e_{d} / {_all["e"]} WHEN {_all["r"]} >= 12 THEN r_{d} / {_all["r"]}
        WHEN {_all["g"]} > 0 THEN g_{d} / {_all["g"]} ELSE CAST(1.0 AS DOUBLE) / 3 END AS base_{d}"""


def _said(p: str) -> str:
    """The class of the greatest share, ties to the greater name: UP, NEUTRAL, DOWN."""
    up, down, neutral = (f"round({p}_{d}, 9)" for d in UPS)
    return f"CASE WHEN {up} >= {neutral} AND {up} >= {down} THEN 'UP' WHEN {neutral} >= {down} THEN 'NEUTRAL' ELSE 'DOWN' END"


def _brier(p: str) -> str:
    return "(" + " + ".join(f"power({p}_{d} - CASE WHEN direction = '{d}' THEN 1.0 ELSE 0.0 END, 2)" for d in UPS) + ")"


def _actual(p: str) -> str:
    return "CASE direction " + " ".join(f"WHEN '{d}' THEN {p}_{d}" for d in UPS) + " END"


def _loss(p: str) -> str:
    return f"(-ln(greatest(1e-12, least(1.0, {_actual(p)}))))"


def _calibrated(d: str) -> str:
    power = lambda x: f"power(greatest(1e-12, p_{x}), 1 / CAST(temperature AS DOUBLE))"
    return f"CAST(shrink AS DOUBLE) / 3 + (1 - CAST(shrink AS DOUBLE)) * {power(d)} / ({' + '.join(power(x) for x in UPS)})"


_R = "series_id, window_no, horizon"
CTES = {
    "gr_split": """SELECT *, CAST(floor(CAST(0.55 AS DOUBLE) * usable) AS BIGINT) AS fit_end, CAST(floor(CAST(0.8 AS DOUBLE) * usable) AS BIGINT) AS select_end
      FROM (SELECT series_id, window_no, oos_start, oos_end, horizon, oos_start - horizon AS usable FROM (SELECT *, unnest([4, 8, 16]) AS horizon FROM wins)) WHERE usable > 0""",
    "gr_part": """SELECT * FROM (SELECT s.series_id, s.window_no, s.horizon, x.idx, x.direction,
        CASE WHEN x.idx < fit_end THEN 'fit' WHEN x.idx < select_end THEN 'select' WHEN x.idx < usable THEN 'calibrate' WHEN x.idx >= oos_start AND x.idx < oos_end THEN 'test' END AS part,
        usable >= 90 AND fit_end >= 50 AND select_end - fit_end >= 30 AND usable - select_end >= 30 AS wide
      FROM gr_split s JOIN exper x ON x.series_id = s.series_id AND x.horizon = s.horizon) WHERE part = 'test' OR (part IS NOT NULL AND direction IS NOT NULL)""",
    "gr_asked": "SELECT DISTINCT series_id, horizon, idx FROM gr_part WHERE part <> 'fit'",
    "gr_pair": f"""SELECT q.series_id, q.horizon, q.idx, h.idx AS h_idx, h.episode, h.direction, CAST(q.event = h.event AS INTEGER) AS same_event,
        ({" + ".join(f"CAST(q.{f} = h.{f} AS INTEGER)" for f in _SAME[:4])}) / 4 AS structure, {", ".join(f"CAST(q.{f} = h.{f} AS INTEGER) AS {f}" for f in _SAME[4:])},
        exp(-abs(q.volatility_ratio - h.volatility_ratio) / 0.35) AS volatility, 0.8 * (0.45 * exp(-abs(q.body_ratio - h.body_ratio) / 0.75)
          + 0.35 * exp(-abs(q.range_ratio - h.range_ratio) / 0.9)) + 0.2 * CAST(q.candle_direction = h.candle_direction AS INTEGER) AS candle
      FROM gr_asked a JOIN exper q ON q.series_id = a.series_id AND q.horizon = a.horizon AND q.idx = a.idx
        JOIN exper h ON h.series_id = q.series_id AND h.horizon = q.horizon AND h.direction IS NOT NULL AND h.idx <= q.idx - 16""",
    "gr_path": f"""SELECT a.series_id, a.idx, b.idx AS h_idx, sum(({_near} + {_form}) * power(0.86, 11 - a.k)) / {sum(0.86**k for k in range(12))} AS path
      FROM (SELECT DISTINCT series_id, idx, h_idx FROM gr_pair) m JOIN pcum a ON a.series_id = m.series_id AND a.idx = m.idx
        JOIN pcum b ON b.series_id = m.series_id AND b.idx = m.h_idx AND b.k = a.k GROUP BY 1, 2, 3""",
    "gr_like": f"SELECT *, {', '.join(f'round(({w}) * {_quality}, 9) AS like_{p}' for p, w in _weighed.items())} FROM gr_pair JOIN gr_path USING (series_id, idx, h_idx)",
    "gr_policy": f"""SELECT series_id, horizon, idx, h_idx, episode, direction, regime, {_clash} AS clash, unnest([0, 1, 2]) AS policy_no,
        unnest([like_balanced, like_structure_first, like_context_first]) AS base FROM gr_like""",
    "gr_score": """SELECT *, life_no * 6 + soft * 3 + policy_no AS setting, round(base * CASE WHEN regime = 1 OR soft = 0 THEN 1.0 ELSE 0.35 END
        * (0.7 + 0.3 * CASE WHEN life_no = 0 THEN 1.0 ELSE exp(-ln(2.0) * (idx - h_idx) / 100.0) END), 9) AS score
      FROM gr_policy, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(life_no, soft) WHERE base >= 0.42""",
    "gr_first": """SELECT * FROM gr_score WHERE NOT clash OR score >= 0.6
      QUALIFY row_number() OVER (PARTITION BY series_id, horizon, idx, setting, episode ORDER BY score DESC, base DESC, h_idx) = 1""",
    "gr_rank": "SELECT *, row_number() OVER (PARTITION BY series_id, horizon, idx, setting ORDER BY score DESC, base DESC, h_idx) AS place FROM gr_first",
    "gr_sum": f"""SELECT series_id, horizon, idx, k_no * 12 + setting AS config, count(*) AS n, sum(greatest(0.01, power(score, 4)) / sqrt(place)) AS whole,
        {", ".join(f"count(*) FILTER (direction = '{d}') / count(*) AS h_{d}, coalesce(sum(greatest(0.01, power(score, 4)) / sqrt(place)) FILTER (direction = '{d}'), 0) AS s_{d}" for d in UPS)}
      FROM gr_rank JOIN (VALUES (0, 8), (1, 16), (2, 24)) AS v(k_no, k) ON place <= k GROUP BY 1, 2, 3, 4""",
    "gr_even": f"""SELECT *, CASE WHEN n >= 5 THEN 0.15 + 0.85 * least(1.0, greatest(0.0, 1 + ({" + ".join(f"CASE WHEN h_{d} > 0 THEN h_{d} * ln(h_{d}) ELSE 0 END" for d in UPS)}) / ln(3.0)))
        ELSE 0.0 END AS strength FROM gr_sum""",
    "gr_share": f"""SELECT a.series_id, a.horizon, a.idx, a.config, {", ".join(f"coalesce(CAST(1.0 AS DOUBLE) / 3 + strength * (s_{d} / whole - CAST(1.0 AS DOUBLE) / 3), CAST(1.0 AS DOUBLE) / 3) AS p_{d}" for d in UPS)}
      FROM (SELECT *, unnest(range(36)) AS config FROM gr_asked) a
        LEFT JOIN gr_even e ON e.series_id = a.series_id AND e.horizon = a.horizon AND e.idx = a.idx AND e.config = a.config""",
    "gr_past": f"SELECT series_id, horizon, idx, {_counts} FROM exper",
    "gr_base": f"SELECT series_id, horizon, idx, {', '.join(_base(d) for d in UPS)} FROM gr_past",
    "gr_fit": f"SELECT {_R}, count(*) AS n_fit FROM gr_part WHERE wide AND part = 'fit' GROUP BY 1, 2, 3 HAVING count(*) >= 50",
    "gr_row": f"""SELECT p.*, b.* EXCLUDE (series_id, horizon, idx), s.* EXCLUDE (series_id, horizon, idx) FROM gr_part p JOIN gr_base b ON b.series_id = p.series_id AND b.horizon = p.horizon AND b.idx = p.idx
        JOIN gr_share s ON s.series_id = p.series_id AND s.horizon = p.horizon AND s.idx = p.idx WHERE p.wide AND p.part = 'select'""",
    "gr_lift": f"""SELECT {_R}, config, count(*) AS n, avg(CASE WHEN {_said("p")} = direction THEN 1 ELSE 0 END - CASE WHEN {_said("base")} = direction THEN 1 ELSE 0 END) AS accuracy_lift,
        avg({_brier("base")} - {_brier("p")}) AS brier_lift, avg({_loss("base")} - {_loss("p")}) AS log_loss_lift FROM gr_row GROUP BY 1, 2, 3, 4 HAVING count(*) >= 30""",
    "gr_graded": f"SELECT *, 0.5 * brier_lift + 0.4 * log_loss_lift + 0.1 * accuracy_lift AS score FROM gr_lift JOIN gr_fit USING ({_R})",
    "cgrid": f"""SELECT *, [8, 16, 24][config // 12 + 1] AS k, CAST(CASE WHEN config // 6 % 2 = 0 THEN 0 ELSE 100 END AS DOUBLE) AS halflife, CASE WHEN config // 3 % 2 = 0 THEN 'none' ELSE 'soft' END AS regimes,
        ['balanced', 'structure_first', 'context_first'][config % 3 + 1] AS policy, CASE WHEN row_number() OVER (PARTITION BY {_R}
          ORDER BY round(score, 9) DESC, round(brier_lift, 9) DESC, round(log_loss_lift, 9) DESC, config) = 1 THEN 1 ELSE 0 END AS chosen FROM gr_graded""",
    "gr_mine": f"""SELECT p.*, CASE WHEN g.config IS NULL THEN 0 ELSE 1 END AS selected, coalesce(g.config, 21) AS config FROM gr_part p
        LEFT JOIN (SELECT {_R}, config FROM cgrid WHERE chosen = 1) g ON g.series_id = p.series_id AND g.window_no = p.window_no AND g.horizon = p.horizon WHERE p.part IN ('calibrate', 'test')""",
    "gr_set": "SELECT m.*, s.* EXCLUDE (series_id, horizon, idx, config) FROM gr_mine m JOIN gr_share s ON s.series_id = m.series_id AND s.horizon = m.horizon AND s.idx = m.idx AND s.config = m.config",
    "gr_try": f"""SELECT {_R}, direction, shrink, temperature, {", ".join(f"{_calibrated(d)} AS q_{d}" for d in UPS)}
      FROM gr_set, (SELECT unnest([0.0, 0.15, 0.25, 0.35, 0.5]) AS shrink), (SELECT unnest([0.8, 1.0, 1.2, 1.5]) AS temperature) WHERE part = 'calibrate'""",
    "gr_cal": f"""SELECT {_R}, shrink, temperature FROM (SELECT {_R}, shrink, temperature, avg(-ln(greatest(1e-12, {_actual("q")}))) AS loss FROM gr_try GROUP BY ALL HAVING count(*) >= 30)
      QUALIFY row_number() OVER (PARTITION BY {_R} ORDER BY round(loss, 9), shrink, temperature) = 1""",
    "gr_test": f"SELECT s.*, CAST(coalesce(c.shrink, 0.35) AS DOUBLE) AS shrink, CAST(coalesce(c.temperature, 1.0) AS DOUBLE) AS temperature FROM gr_set s LEFT JOIN gr_cal c USING ({_R}) WHERE s.part = 'test'",
    "tuned": f"SELECT {_R}, idx, direction, selected, config, shrink, temperature, {', '.join(f'{_calibrated(d)} AS p_{d.lower()}' for d in UPS)} FROM gr_test",
}
