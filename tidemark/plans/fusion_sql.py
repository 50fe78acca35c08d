"""Further expressions for ``oracle``: the forecasts of ``operators.fusion``."""

from __future__ import annotations

from tidemark.plans.more_sql import ALL, PART, Q

_Z = [f"z{k}" for k in range(6)]
_UPS = ("UP", "DOWN", "NEUTRAL")
_m = "(" + " + ".join(["g.w[1]", *(f"g.w[{k + 2}] * t.{z}" for k, z in enumerate(_Z))]) + ")"
_p = f"(1 / (1 + exp(-{_m})))"
_err = f"({_p} - t.y) * CASE WHEN t.y = 1 THEN 1.0 / greatest(2 * g.pos, 1) ELSE 1.0 / greatest(2 * (g.n - g.pos), 1) END"
_W = {"structure": (0.20, 0.22, 0.24), "sequence": (0.16, 0.15, 0.13), "regime": (0.14, 0.16, 0.17), "location": (0.08, 0.08, 0.07), "momentum": (0.12, 0.10, 0.08), "volatility": (0.08, 0.08, 0.09), "candle": (0.06, 0.05, 0.04), "path": (0.16, 0.16, 0.18)}
_w = {n: f"(CASE horizon WHEN 4 THEN {w[0]} WHEN 8 THEN {w[1]} ELSE {w[2]} END)" for n, w in _W.items()}
_quality = f"(0.75 + 0.25 * (0.55 * ({' + '.join(f'CAST({n} > 0 AS INTEGER)' for n in _W)}) / 8 + 0.45 * greatest(structure, sequence, regime)))"
_first = {"structure": 0.24, "sequence": 0.16, "regime": 0.16, "location": 0.08, "momentum": 0.08, "volatility": 0.07, "candle": 0.07, "path": 0.14}
_floor = "CASE WHEN regime = 0 OR (event = 0 AND structure < 0.25) OR sequence = 0 OR momentum = 0 THEN 0.6 ELSE 0.42 END"
_whole = " + ".join(f"{_w[n]} * {n}" for n in _W)
_M = ("distance", "swing", "age", "persistence")
_state = "concat_ws('|', trend, event, place, " + ", ".join(f"CASE WHEN {m} <= a_{m} THEN '0' WHEN {m} <= b_{m} OR a_{m} = b_{m} THEN '1' ELSE '2' END" for m in _M) + ")"
_powers = {"power_1": (1, 10**9), "power_2": (2, 10**9), "power_4": (4, 10**9), "top_5": (2, 5), "top_10": (2, 10), "top_20": (2, 20)}
_parts = ("direction", "body_size", "wick_profile", "trend", "volatility_state", "location", "sequence", "event", "high_label", "low_label", "momentum", "regime")
_rets = ("r1", "r3", "r8", "r16")
_paths = ("p_change", "p_range", "p_direction", "p_body")

CTES = {
    # Gradient descent to the same optimum as Newton's method: the ridge makes 200 steps of 0.8 enough for 7 places.
    "lgz": f"SELECT v.series_id, v.window_no, v.horizon, v.idx, v.oos_start, v.oos_end, o.raw_return, {', '.join(f'v.{z}' for z in _Z)} FROM vz v JOIN outcomes o ON o.series_id = v.series_id AND o.idx = v.idx AND o.horizon = v.horizon",
    "lgt": "SELECT *, CASE WHEN raw_return > 0 THEN 1 ELSE 0 END AS y FROM lgz SEMI JOIN vtrain USING (series_id, window_no, horizon, idx) WHERE raw_return <> 0",
    "lgm": f"""SELECT series_id, window_no, horizon, count(*) AS n, sum(y) AS pos, 0 AS e, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS w FROM lgt GROUP BY 1, 2, 3 UNION ALL
      SELECT g.series_id, g.window_no, g.horizon, g.n, g.pos, g.e + 1, [any_value(g.w[1]) - 0.8 * sum({_err}), {', '.join(f'any_value(g.w[{k + 2}]) - 0.8 * (sum({_err} * t.{z}) + 0.75 * any_value(g.w[{k + 2}]))' for k, z in enumerate(_Z))}]
      FROM lgm g JOIN lgt t ON t.series_id = g.series_id AND t.window_no = g.window_no AND t.horizon = g.horizon WHERE g.e < 200 GROUP BY g.series_id, g.window_no, g.horizon, g.n, g.pos, g.e""",
    "logit": f"""SELECT t.series_id, t.window_no, t.horizon, t.idx, CASE WHEN raw_return > 0 THEN 1 WHEN raw_return < 0 THEN 0 END AS rose, g.n AS n_train, CASE WHEN g.pos = 0 THEN 0.0 WHEN g.pos = g.n THEN 1.0 ELSE {_p} END AS p_up
      FROM lgz t JOIN lgm g ON t.series_id = g.series_id AND t.window_no = g.window_no AND t.horizon = g.horizon AND g.e = 200 WHERE t.idx >= t.oos_start AND t.idx < t.oos_end""",
    "en0": f"""SELECT {Q}, l.rose, l.n_train, s.en AS support, l.p_up AS p_logistic, CASE WHEN k.p_up + k.p_down > 1e-12 THEN k.p_up / (k.p_up + k.p_down) ELSE 0.5 END AS p_neighbours, CASE WHEN s.p_up + s.p_down > 1e-12 THEN s.p_up / (s.p_up + s.p_down) ELSE 0.5 END AS p_state
      FROM logit l JOIN knn k USING ({Q}) JOIN hier s USING ({Q})""",
    "en1": "SELECT *, least(greatest(0.55 * p_logistic + 0.25 * p_neighbours + 0.2 * p_state, 0.001), 0.999) AS p_up, 1 - (abs(p_logistic - p_neighbours) + abs(p_logistic - p_state) + abs(p_neighbours - p_state)) / 3 AS agreement FROM en0",
    "en2": "SELECT *, 2 * abs(p_up - 0.5) AS margin, 0.55 * 2 * abs(p_up - 0.5) + 0.25 * agreement + 0.1 * least(support / 20, 1.0) + 0.1 * least(n_train / 500, 1.0) AS confidence FROM en1",
    "ensem": "SELECT *, CASE WHEN round(confidence, 9) < 0.45 OR round(margin, 9) < 0.02 THEN 'ABSTAIN' WHEN p_up >= 0.5 THEN 'UP' ELSE 'DOWN' END AS says FROM en2",
    "qm0": f"SELECT series_id, idx, trend, event, close, last_high, last_low, event_age, structure_age, persistence, last_high - last_low AS span, last_value(CASE WHEN broke_down THEN last_low WHEN broke_up THEN last_high END IGNORE NULLS) {ALL} AS broken FROM regime_runs",
    "qm1": """SELECT *, round(least(greatest(CASE WHEN trend = 'BULLISH' AND span > 0 THEN (close - last_low) / span WHEN trend = 'BEARISH' AND span > 0 THEN (last_high - close) / span ELSE 0.5 END, 0), 1), 9) AS pl FROM qm0""",
    "qmeas": """SELECT series_id, idx, trend, event, CASE WHEN pl < 0.33 THEN 'LOW' WHEN pl > 0.66 THEN 'HIGH' ELSE 'MID' END AS place, round(coalesce(abs(CASE trend WHEN 'BULLISH' THEN close - broken WHEN 'BEARISH' THEN broken - close ELSE 0.0 * broken END / greatest(abs(broken), 1e-12)), 0.0), 9) AS distance,
      round(coalesce(abs(span), 0.0), 9) AS swing, CAST(least(coalesce(event_age, structure_age), 1000) AS DOUBLE) AS age, CAST(least(persistence, 10) AS DOUBLE) AS persistence FROM qm1""",
    "qtrain": f"SELECT t.series_id, t.window_no, t.horizon, t.idx, t.direction, m.* EXCLUDE (series_id, idx) FROM train t JOIN qmeas m ON m.series_id = t.series_id AND m.idx = t.idx",
    "qcuts": "SELECT series_id, window_no, horizon, " + ", ".join(f"quantile_cont({m}, 1.0 / 3) AS a_{m}, quantile_cont({m}, 2.0 / 3) AS b_{m}" for m in _M) + " FROM qtrain GROUP BY 1, 2, 3",
    "qseen": f"SELECT series_id, window_no, horizon, {_state} AS state, count(*) AS samples, count(*) FILTER (direction = 'UP') AS up FROM qtrain JOIN qcuts USING (series_id, window_no, horizon) WHERE direction <> 'NEUTRAL' GROUP BY 1, 2, 3, 4",
    "qall": "SELECT series_id, window_no, horizon, sum(up) / sum(samples) AS g FROM qseen GROUP BY 1, 2, 3",
    "qtest": f"SELECT t.series_id, t.window_no, t.horizon, t.idx, t.direction, {_state} AS state FROM (SELECT series_id, window_no, horizon, idx, direction FROM tests) t JOIN qmeas USING (series_id, idx) JOIN qcuts USING (series_id, window_no, horizon)",
    "qst0": """SELECT *, coalesce(g, 0.5) AS global_up, CASE WHEN samples IS NULL THEN 'GLOBAL_BASELINE' WHEN samples >= 8 THEN 'STRUCTURAL_STATE' ELSE 'GLOBAL_BASELINE_LOW_SAMPLE' END AS source,
      CASE WHEN samples >= 8 THEN (up + 12.0 * coalesce(g, 0.5)) / (samples + 12.0) ELSE coalesce(g, 0.5) END AS p_up FROM qtest LEFT JOIN qseen USING (series_id, window_no, horizon, state) LEFT JOIN qall USING (series_id, window_no, horizon)""",
    "qstates": "SELECT * REPLACE (coalesce(samples, 0) AS samples), CASE WHEN round(p_up, 9) >= 0.52 THEN 'UP' WHEN round(p_up, 9) <= 0.48 THEN 'DOWN' WHEN global_up >= 0.5 THEN 'UP' ELSE 'DOWN' END AS prediction FROM qst0",
    "tp0": "SELECT horizon, window_no = 4 AS last, direction = 'UP' AS rose, least(greatest(p_up, 1e-6), 1 - 1e-6) AS p, unnest(range(16, 321)) / 80.0 AS temperature FROM qstates WHERE direction <> 'NEUTRAL'",
    "tp1": "SELECT *, 1 / (1 + exp(-ln(p / (1 - p)) / temperature)) AS q FROM tp0",
    "tp2": "SELECT horizon, temperature, avg(l) FILTER (NOT last) AS fit_loss, avg(l) FILTER (last) AS test_loss FROM (SELECT *, -ln(greatest(CASE WHEN rose THEN q ELSE 1 - q END, 1e-12)) AS l FROM tp1) GROUP BY 1, 2",
    "temper": "SELECT * FROM (SELECT *, max(CASE WHEN temperature = 1.0 THEN test_loss END) OVER (PARTITION BY horizon) AS plain_loss FROM tp2) QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY round(fit_loss, 9), temperature) = 1",
    "er0": f"SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY round(similarity, 9) DESC, h_idx DESC) AS pl FROM matches WHERE actual IS NOT NULL",
    "er1": " UNION ALL ".join(
        [f"SELECT {Q}, actual, '{n}' AS rule, direction, round(sum(power(similarity, {p})), 9) AS v, CASE direction WHEN 'UP' THEN 0 WHEN 'DOWN' THEN 1 ELSE 2 END AS t FROM er0 WHERE pl <= {k} GROUP BY ALL" for n, (p, k) in _powers.items()]
        + [f"SELECT {Q}, actual, 'vote_{k}' AS rule, direction, count(*) AS v, min(pl) AS t FROM er0 WHERE pl <= {k} GROUP BY ALL" for k in (5, 10, 20)]
    ),
    "er2": f"SELECT *, CASE WHEN direction = actual THEN 1 ELSE 0 END AS hit FROM er1 QUALIFY row_number() OVER (PARTITION BY {Q}, rule ORDER BY v DESC, t) = 1",
    "er3": "SELECT horizon, rule, count(*) FILTER (window_no < 4) AS n_fit, avg(hit) FILTER (window_no < 4) AS fit_accuracy, count(*) FILTER (window_no = 4) AS n_test, avg(hit) FILTER (window_no = 4) AS test_accuracy FROM er2 GROUP BY 1, 2",
    "evrules": "SELECT *, CASE WHEN row_number() OVER (PARTITION BY horizon ORDER BY round(fit_accuracy, 9) DESC, rule) = 1 THEN 1 ELSE 0 END AS chosen FROM er3",
    "shr0": f"SELECT *, ({' + '.join(f'{w} * {n}' for n, w in _first.items())}) * {_quality} AS base FROM matches",
    "shr1": "SELECT *, round(base * CASE WHEN regime = 1 THEN 1.0 ELSE 0.35 END * (0.7 + 0.3 * exp(-ln(2.0) * (idx - h_idx) / 250.0)), 9) AS score FROM shr0 WHERE round(base, 9) >= 0.42",
    "shr2": f"SELECT * FROM shr1 QUALIFY row_number() OVER (PARTITION BY {Q}, episode ORDER BY score DESC, round(base, 9) DESC, h_idx) = 1",
    "shr3": f"SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY score DESC, round(base, 9) DESC, h_idx) AS pl FROM shr2",
    "shr4": f"SELECT {Q}, actual, direction, count(*) AS k, sum(greatest(0.01, power(score, 4)) / sqrt(pl)) AS s FROM shr3 WHERE pl <= 16 GROUP BY ALL",
    "shr5": f"SELECT {Q}, any_value(actual) AS actual, CAST(sum(k) AS BIGINT) AS n, " + ", ".join(f"coalesce(sum(s) FILTER (direction = '{d}'), 0) / sum(s) AS s_{d}, coalesce(sum(k) FILTER (direction = '{d}'), 0) / sum(k) AS h_{d}" for d in _UPS) + " FROM shr4 GROUP BY ALL",
    "shr6": "SELECT *, CASE WHEN n >= 5 THEN 1 + (" + " + ".join(f"CASE WHEN h_{d} > 0 THEN h_{d} * ln(h_{d}) ELSE 0 END" for d in _UPS) + ") / ln(3.0) ELSE 0.0 END AS homogeneity FROM shr5",
    "shrunk": "SELECT *, " + ", ".join(f"1.0 / 3 + CASE WHEN n >= 5 THEN 0.15 + 0.85 * homogeneity ELSE 0 END * (s_{d} - 1.0 / 3) AS p_{d.lower()}" for d in _UPS) + " FROM shr6",
    "ab0": f"SELECT {Q}, actual, h_idx, direction, {_floor} AS fl, unnest([{', '.join(repr(n) for n in ('none', *_W))}]) AS dropped, round(unnest([({_whole}) * {_quality}, {', '.join(f'({_whole} - {_w[n]} * {n}) / (1 - {_w[n]}) * {_quality}' for n in _W)}]), 9) AS score FROM matches WHERE actual IS NOT NULL",
    "ab1": f"SELECT * FROM ab0 WHERE score >= fl QUALIFY row_number() OVER (PARTITION BY {Q}, dropped ORDER BY score DESC, h_idx DESC) <= 16",
    "ab2": f"SELECT {Q}, actual, dropped, direction, avg(exp(-(1 - score) / 0.1)) * (1 - exp(-count(*) / 6.0)) AS e FROM ab1 GROUP BY ALL",
    "ab3": f"SELECT {Q}, actual, dropped, " + ", ".join(f"CASE WHEN sum(e) > 1e-12 THEN coalesce(sum(e) FILTER (direction = '{d}'), 0) / sum(e) ELSE 1.0 / 3 END AS p_{d.lower()}" for d in _UPS) + " FROM ab2 GROUP BY ALL",
    "ablate": "SELECT horizon, dropped, count(*) AS n, avg(CASE WHEN actual = CASE WHEN p_up = greatest(p_up, p_down, p_neutral) THEN 'UP' WHEN p_down = greatest(p_up, p_down, p_neutral) THEN 'DOWN' ELSE 'NEUTRAL' END THEN 1.0 ELSE 0.0 END) AS accuracy, avg((" + " + ".join(f"power(p_{d.lower()} - CAST(actual = '{d}' AS INTEGER), 2)" for d in _UPS) + ") / 3) AS brier FROM ab3 GROUP BY 1, 2",
    "fl0": "SELECT s.series_id, s.window_no, s.horizon, s.idx, s.said, s.hit, s.p_up, s.p_down, s.p_neutral, e.trend, e.momentum, e.regime AS in_regime FROM sc s JOIN exper e ON e.series_id = s.series_id AND e.idx = s.idx AND e.horizon = s.horizon",
    "fl1": "SELECT a.series_id, a.window_no, a.horizon, a.idx, any_value(a.said) AS said, any_value(a.p_up) AS p_up, any_value(a.p_down) AS p_down, any_value(a.p_neutral) AS p_neutral, count(b.idx) AS samples, count(b.idx) FILTER (b.hit = 0) AS failures FROM fl0 a LEFT JOIN fl0 b ON b.horizon = a.horizon AND b.said = a.said AND b.trend = a.trend AND b.momentum = a.momentum AND b.in_regime = a.in_regime AND b.window_no < a.window_no GROUP BY 1, 2, 3, 4",
    "fl2": "SELECT *, CASE WHEN failures <= 0 THEN CAST(0 AS DOUBLE) WHEN failures < 50 THEN 0.05 WHEN failures < 100 THEN 0.1 WHEN failures < 200 THEN 0.15 ELSE 0.2 END AS stepped, CASE WHEN samples > 0 THEN 0.25 * (failures / samples) * least(1.0, sqrt(samples / 100)) * 0.65 ELSE 0.0 END AS adaptive FROM fl1",
    "fpen": "SELECT *, " + ", ".join(f"p_up - CASE WHEN said = 'UP' THEN least(p_up, {x}) ELSE 0 END AS {x}_up, p_down - CASE WHEN said = 'DOWN' THEN least(p_down, {x}) ELSE 0 END AS {x}_down, p_neutral + CASE said WHEN 'UP' THEN least(p_up, {x}) WHEN 'DOWN' THEN least(p_down, {x}) ELSE 0 END AS {x}_neutral" for x in ("stepped", "adaptive")) + " FROM fl2",
    "nb0": "SELECT series_id, window_no, horizon, CASE WHEN u >= d AND u >= z THEN 'UP' WHEN d >= z THEN 'DOWN' ELSE 'NEUTRAL' END AS majority FROM (SELECT series_id, window_no, horizon, count(*) FILTER (direction = 'UP') AS u, count(*) FILTER (direction = 'DOWN') AS d, count(*) FILTER (direction = 'NEUTRAL') AS z FROM train GROUP BY 1, 2, 3)",
    "nb1": """SELECT horizon, direction, unnest(['majority', 'momentum', 'last_candle', 'random']) AS method, unnest([majority, CASE WHEN r3 > 0 THEN 'UP' WHEN r3 < 0 THEN 'DOWN' ELSE 'NEUTRAL' END, CASE candle_direction WHEN 'FLAT' THEN 'NEUTRAL' ELSE candle_direction END,
      CASE CAST('0x' || substr(md5(concat_ws('|', series_id, idx, horizon)), 1, 8) AS BIGINT) % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'NEUTRAL' END]) AS said FROM tests JOIN nb0 USING (series_id, window_no, horizon) WHERE direction IS NOT NULL""",
    "naive": "SELECT horizon, method, count(*) AS n, avg(CASE WHEN said = direction THEN 1.0 ELSE 0.0 END) AS accuracy FROM nb1 GROUP BY 1, 2",
    "dst0": "SELECT horizon, said, lag(said) OVER (PARTITION BY series_id, window_no, horizon ORDER BY idx) AS was FROM sc",
    "dstab": "SELECT horizon, said, count(*) FILTER (said = was) AS n_same, count(*) FILTER (said <> was) AS n_changed, avg(CASE WHEN said = was THEN 1.0 ELSE 0.0 END) AS stability FROM dst0 WHERE was IS NOT NULL GROUP BY 1, 2",
    "tt0": "SELECT series_id, horizon, state_key, count(direction) AS resolved FROM exper GROUP BY 1, 2, 3",
    "tiers": """SELECT horizon, CASE WHEN resolved = 0 THEN 'not_available' WHEN resolved < 5 THEN 'very_early' WHEN resolved < 15 THEN 'developing' WHEN resolved < 30 THEN 'moderate_sample' WHEN resolved < 60 THEN 'strong_sample' ELSE 'large_sample' END AS level,
      CASE WHEN resolved = 0 THEN CAST(0 AS DOUBLE) WHEN resolved < 5 THEN 20.0 WHEN resolved < 15 THEN 40.0 WHEN resolved < 30 THEN 60.0 WHEN resolved < 60 THEN 75.0 ELSE 90.0 END AS score, count(*) AS n_keys, CAST(sum(resolved) AS BIGINT) AS n_outcomes FROM tt0 GROUP BY 1, 2, 3""",
    "six": f"SELECT series_id, idx, string_agg(left(direction, 1), '' ORDER BY idx) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS pattern FROM anatomy QUALIFY idx >= 5",
    "ps0": "SELECT pattern, horizon, count(*) AS o, count(price_direction) AS r, greatest(count(*) FILTER (price_direction = 'bullish'), count(*) FILTER (price_direction = 'bearish'), count(*) FILTER (price_direction = 'neutral')) AS m FROM six JOIN outcomes USING (series_id, idx) GROUP BY 1, 2",
    "ps1": "SELECT pattern, max(o) AS occurrences, CAST(sum(r) AS BIGINT) AS resolved, coalesce(avg(100.0 * m / r) FILTER (r > 0), 0.0) AS accuracy FROM ps0 GROUP BY 1",
    "pscore": "SELECT *, 0.6 * accuracy + 20 * least(occurrences / 20, 1.0) + 20 * least(resolved / (occurrences * 3), 1.0) AS score FROM ps1",
    "sim0": "SELECT series_id, arg_max(pattern, idx) AS current FROM six GROUP BY 1",
    "sim1": "SELECT pattern, count(*) AS occurrences FROM six GROUP BY 1 HAVING count(*) >= 3",
    "sim2": "SELECT series_id, current, pattern, occurrences, (" + " + ".join(f"CAST(substr(current, {k}, 1) = substr(pattern, {k}, 1) AS INTEGER)" for k in range(1, 7)) + ") / 6 AS similarity FROM sim0 CROSS JOIN sim1",
    "simpat": "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY similarity DESC, occurrences DESC, pattern) AS rank FROM sim2 WHERE similarity > 0 QUALIFY rank <= 10",
    "lc0": "SELECT p.series_id, z.last_close, price, row_number() OVER (PARTITION BY p.series_id ORDER BY price) AS k FROM pv p JOIN pz0 z ON z.series_id = p.series_id WHERE pivot_idx >= last_idx - 240",
    "lc1": """SELECT series_id, k, CAST(0 AS BIGINT) AS level_no, price AS total, CAST(1 AS BIGINT) AS n FROM lc0 WHERE k = 1 UNION ALL
      SELECT p.series_id, p.k, CASE WHEN abs(p.price - z.total / z.n) / abs(z.total / z.n) <= 0.0015 THEN z.level_no ELSE z.level_no + 1 END, CASE WHEN abs(p.price - z.total / z.n) / abs(z.total / z.n) <= 0.0015 THEN z.total + p.price ELSE p.price END, CASE WHEN abs(p.price - z.total / z.n) / abs(z.total / z.n) <= 0.0015 THEN z.n + 1 ELSE 1 END
      FROM lc1 z JOIN lc0 p ON p.series_id = z.series_id AND p.k = z.k + 1""",
    "lc2": "SELECT series_id, level_no, last(total ORDER BY k) / last(n ORDER BY k) AS price, count(*) AS touches FROM lc1 GROUP BY 1, 2",
    "lclus": "SELECT l.*, CASE WHEN round(price, 7) < round(last_close, 7) THEN 'SUPPORT' WHEN round(price, 7) > round(last_close, 7) THEN 'RESISTANCE' ELSE 'AT' END AS side FROM lc2 l JOIN pz0 USING (series_id)",
    "ur0": f"""SELECT series_id, idx, {", ".join(f"list({p} ORDER BY k) AS {p}, list(round({p}, 6) ORDER BY k) AS kept_{p}" for p in _paths)}
      FROM path_rows GROUP BY 1, 2""",
    "ur1": f"""SELECT s.series_id, s.idx,
        [{", ".join(f"s.{p}" if p not in ("body_size", "wick_profile", "volatility_state") else p for p in _parts)}] AS parts,
        [{", ".join(f"s.{r}" for r in _rets)}] AS rets, [{", ".join(f"round(s.{r}, 10)" for r in _rets)}] AS kept_rets,
        {", ".join(f"u.{p}, u.kept_{p}" for p in _paths)}
      FROM states s JOIN (SELECT series_id, idx, body_size, wick_profile FROM language) USING (series_id, idx)
        JOIN (SELECT series_id, idx, volatility_state FROM classes) USING (series_id, idx) JOIN ur0 u USING (series_id, idx)""",
    "urb": f"""SELECT *, min(idx) OVER (PARTITION BY series_id, parts, kept_rets, {", ".join(f"kept_{p}" for p in _paths)}) AS bucket FROM ur1""",
    "ur2": f"""SELECT q.series_id, q.idx, h.bucket, q.bucket = h.bucket AS own, price_direction, CASE WHEN q.bucket = h.bucket THEN 1.0 ELSE
        round(0.55 * ({" + ".join(f"CAST(q.parts[{k}] = h.parts[{k}] AS INTEGER)" for k in range(1, 13))}) / 12
        + 0.2 * ({" + ".join(f"1 / (1 + 25 * abs(q.rets[{k}] - h.kept_rets[{k}]))" for k in range(1, 5))}) / 4
        + 0.25 * ({" + ".join("1 / (1 + (" + " + ".join(f"abs(q.{p}[{k}] - h.kept_{p}[{k}])" for p in _paths) + ") / 4)" for k in range(1, 13))}) / 12, 9) END
        AS score
      FROM urb q JOIN wins w ON w.series_id = q.series_id AND q.idx >= oos_start AND q.idx < oos_end
        JOIN urb h ON h.series_id = q.series_id AND h.idx + 4 <= q.idx JOIN so o ON o.series_id = h.series_id AND o.idx = h.idx
      WHERE price_direction IS NOT NULL""",
    "ur3": """SELECT series_id, idx, bucket, own, score, count(*) AS n, count(*) FILTER (price_direction = 'bullish') AS bullish,
        count(*) FILTER (price_direction = 'bearish') AS bearish, count(*) FILTER (price_direction = 'neutral') AS neutral
      FROM ur2 WHERE score >= 0.34 GROUP BY ALL""",
    "ur4": """SELECT *, CASE WHEN own THEN 1.0 ELSE score * least(1.0, n / 20) END AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id, idx, own ORDER BY score DESC, n DESC, bucket) AS k FROM ur3) WHERE own OR k <= 25""",
    "ur5": """SELECT series_id, idx, count(*) FILTER (NOT own) AS n, sum(n) AS evidence, max(score) FILTER (NOT own) AS best,
        sum(bullish * weight) AS b, sum(bearish * weight) AS s, sum(neutral * weight) AS z FROM ur4 GROUP BY 1, 2""",
    "ur6": """SELECT q.series_id, q.idx, coalesce(n, 0) AS n, CAST(coalesce(evidence, 0) AS BIGINT) AS evidence, best, coalesce(b, 0.0) AS b,
        coalesce(s, 0.0) AS s, coalesce(z, 0.0) AS z
      FROM bars q JOIN wins w ON w.series_id = q.series_id AND q.idx >= oos_start AND q.idx < oos_end
        LEFT JOIN ur5 u ON u.series_id = q.series_id AND u.idx = q.idx""",
    "unified": """SELECT *, (b + 1) / (b + s + z + 3) AS p_bullish, (s + 1) / (b + s + z + 3) AS p_bearish, (z + 1) / (b + s + z + 3) AS p_neutral,
        CASE WHEN b + s + z <= 0 THEN 'NONE' WHEN evidence < 20 THEN 'WEAK' WHEN evidence < 100 THEN 'MODERATE' ELSE 'STRONG' END AS level,
        CASE WHEN b >= s AND b >= z THEN 'bullish' WHEN s >= z THEN 'bearish' ELSE 'neutral' END AS favored FROM ur6""",
    # The same for every bar and three horizons, each bar against all earlier ones.
    "om0": f"""SELECT q.series_id, q.idx, h.idx AS h_idx, h.bucket, q.bucket = h.bucket AS own, CASE WHEN q.bucket = h.bucket THEN 1.0 ELSE
        round(0.55 * ({" + ".join(f"CAST(q.parts[{k}] = h.parts[{k}] AS INTEGER)" for k in range(1, 13))}) / 12
        + 0.2 * ({" + ".join(f"1 / (1 + 25 * abs(q.rets[{k}] - h.kept_rets[{k}]))" for k in range(1, 5))}) / 4
        + 0.25 * ({" + ".join("1 / (1 + (" + " + ".join(f"abs(q.{p}[{k}] - h.kept_{p}[{k}])" for p in _paths) + ") / 4)" for k in range(1, 13))}) / 12, 9) END
        AS score FROM urb q JOIN urb h ON h.series_id = q.series_id AND h.idx + 4 <= q.idx""",
    "om1": """SELECT a.series_id, a.idx, horizon, bucket, own, score, count(*) AS n, count(*) FILTER (price_direction = 'bullish') AS bullish,
        count(*) FILTER (price_direction = 'bearish') AS bearish, count(*) FILTER (price_direction = 'neutral') AS neutral
      FROM om0 a JOIN outcomes o ON o.series_id = a.series_id AND o.idx = a.h_idx AND a.h_idx + o.horizon <= a.idx
      WHERE score >= 0.34 AND price_direction IS NOT NULL GROUP BY ALL""",
    "om2": """SELECT *, CASE WHEN own THEN 1.0 ELSE score * least(1.0, n / 20) END AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id, idx, horizon, own ORDER BY score DESC, n DESC, bucket) AS k FROM om1) WHERE own OR k <= 25""",
    "om3": """SELECT series_id, idx, horizon, count(*) FILTER (NOT own) AS n, sum(n) AS evidence, max(score) FILTER (NOT own) AS best,
        sum(bullish * weight) AS b, sum(bearish * weight) AS s, sum(neutral * weight) AS z FROM om2 GROUP BY 1, 2, 3""",
    "om4": """SELECT o.series_id, o.idx, o.horizon, o.price_direction AS outcome, coalesce(n, 0) AS n, CAST(coalesce(evidence, 0) AS BIGINT) AS evidence, best,
        coalesce(b, 0.0) AS b, coalesce(s, 0.0) AS s, coalesce(z, 0.0) AS z
      FROM outcomes o LEFT JOIN om3 u ON u.series_id = o.series_id AND u.idx = o.idx AND u.horizon = o.horizon""",
    "om5": """SELECT *, (b + 1) / (b + s + z + 3) AS p_bullish, (s + 1) / (b + s + z + 3) AS p_bearish, (z + 1) / (b + s + z + 3) AS p_neutral,
        CASE WHEN b + s + z <= 0 THEN 'NONE' WHEN evidence < 20 THEN 'WEAK' WHEN evidence < 100 THEN 'MODERATE' ELSE 'STRONG' END AS level,
        CASE WHEN b >= s AND b >= z THEN 'bullish' WHEN s >= z THEN 'bearish' ELSE 'neutral' END AS favored FROM om4""",
    "omem": """SELECT *, CASE WHEN outcome IS NULL THEN NULL WHEN outcome = 'neutral' OR favored = 'neutral' THEN 'neutral'
        WHEN outcome = favored THEN 'confirmed' ELSE 'not_confirmed' END AS result FROM om5""",
}
