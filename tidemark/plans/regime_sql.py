"""Further expressions for ``oracle``: regime scores over three scales."""

from __future__ import annotations

_W = "PARTITION BY series_id ORDER BY idx"
_SCALES = (20, 60, 120)
_NAMES = ("bullish_trend", "bearish_trend", "range", "breakout", "high_volatility", "low_volatility", "transition")


def _swing(kind: str, price: str, op: str) -> str:
    near = " AND ".join(f"{price} {op} {f}({price}, {k}) OVER ({_W})" for f in ("lag", "lead") for k in (1, 2))
    return f"SELECT series_id, idx, '{kind}' AS kind, {price} AS price FROM bars QUALIFY {near}"


def _scale(n: int) -> str:
    half, lead = n // 2, max(2.0, n * 0.05)
    return f"""CASE WHEN n_up > n_down + {lead} THEN 'bullish' WHEN n_down > n_up + {lead} THEN 'bearish' ELSE 'mixed' END AS direction{n},
        CASE WHEN late_move > early_move * CAST(1.1 AS DOUBLE) THEN 'increasing' WHEN late_move < early_move * CAST(0.9 AS DOUBLE) THEN 'decreasing' ELSE 'stable' END AS momentum{n},
        CASE WHEN late_span > early_span * CAST(1.1 AS DOUBLE) THEN 'expanding' WHEN late_span < early_span * CAST(0.9 AS DOUBLE) THEN 'contracting' ELSE 'stable' END AS volatility{n}
      FROM (SELECT series_id, idx, count(*) FILTER (close > open) OVER ({_W} ROWS {n - 1} PRECEDING) AS n_up, count(*) FILTER (close < open) OVER ({_W} ROWS {n - 1} PRECEDING) AS n_down,
        abs(lag(close, {half}) OVER ({_W}) - lag(close, {n - 1}) OVER ({_W})) AS early_move, abs(close - lag(close, {half - 1}) OVER ({_W})) AS late_move,
        avg(greatest(high - low, 0)) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND {half} PRECEDING) AS early_span, avg(greatest(high - low, 0)) OVER ({_W} ROWS {half - 1} PRECEDING) AS late_span FROM bars)"""


def _sum(*terms: tuple[float, str]) -> str:
    return " + ".join(f"CAST(CASE WHEN {condition} THEN {weight} ELSE 0 END AS DOUBLE)" for weight, condition in terms)


def _trend(side: str) -> str:
    return _sum(*((2.0, f"{what}{n} = '{side}'") for what in ("direction", "structure") for n in _SCALES), (2.0, f"momentum60 = 'increasing' AND direction60 = '{side}'"))


def _count(value: str) -> str:
    return "(" + " + ".join(f"CAST(volatility{n} = '{value}' AS INTEGER)" for n in _SCALES) + ")"


def _agreed(side: str) -> str:
    return " AND ".join([*(f"direction{n} = '{side}'" for n in _SCALES), f"structure60 = '{side}'"])


_first = " ".join(f'WHEN "{n}" = most THEN \'{n}\'' for n in _NAMES)
CTES = {
    "rg_swing": _swing("top", "high", ">=") + " UNION ALL SELECT * FROM (" + _swing("bottom", "low", "<=") + ")",
    "rg_step": "SELECT *, lag(idx) OVER (PARTITION BY series_id, kind ORDER BY idx) AS before, sign(price - lag(price) OVER (PARTITION BY series_id, kind ORDER BY idx)) AS step FROM rg_swing",
    # Both swings of a step lie two bars or more inside the window.
    "rg_good": f"""SELECT b.series_id, b.idx, {", ".join(f"count(*) FILTER (s.step = {v} AND s.before >= b.idx - {n - 3}) AS {name}{n}" for n in _SCALES for name, v in (("good", 1), ("bad", -1)))}
      FROM bars b JOIN rg_step s ON s.series_id = b.series_id AND s.idx <= b.idx - 2 AND s.before >= b.idx - 117 GROUP BY 1, 2""",
    **{f"rg_{n}": f"SELECT series_id, idx, {_scale(n)}" for n in _SCALES},
    "rg_all": f"""SELECT b.series_id, b.idx, {", ".join(f"a{n}.direction{n}, a{n}.momentum{n}, a{n}.volatility{n}" for n in _SCALES)}, {", ".join(
        f"CASE WHEN coalesce(good{n}, 0) > coalesce(bad{n}, 0) + 1 THEN 'bullish' WHEN coalesce(bad{n}, 0) > coalesce(good{n}, 0) + 1 THEN 'bearish' ELSE 'range' END AS structure{n}" for n in _SCALES)}
      FROM bars b JOIN rg_20 a20 ON a20.series_id = b.series_id AND a20.idx = b.idx JOIN rg_60 a60 ON a60.series_id = b.series_id AND a60.idx = b.idx
        JOIN rg_120 a120 ON a120.series_id = b.series_id AND a120.idx = b.idx LEFT JOIN rg_good g ON g.series_id = b.series_id AND g.idx = b.idx WHERE b.idx >= 119""",
    "rg_score": f"""SELECT *, {_trend("bullish")} AS bullish_trend, {_trend("bearish")} AS bearish_trend,
        {_sum(*((2.0, f"structure{n} = 'range'") for n in _SCALES), (4.0, "structure20 = 'range' AND structure60 = 'range'"))} AS "range",
        {_sum((3.0, "volatility20 = 'expanding' AND volatility60 = 'expanding'"))} AS breakout, {_sum((3.0, f"{_count('expanding')} >= 2"))} AS high_volatility,
        {_sum((3.0, f"{_count('expanding')} < 2 AND {_count('contracting')} >= 2"))} AS low_volatility, {_sum((4.0, "direction20 <> direction60 AND direction60 = direction120"))} AS transition FROM rg_all""",
    "rg_most": f"""SELECT *, greatest({", ".join(f'"{n}"' for n in _NAMES)}) AS most, {" + ".join(f'"{n}"' for n in _NAMES)} AS total FROM rg_score""",
    "regimes7": f"""SELECT *, CASE WHEN total > 0 THEN most / total * 100 ELSE 0 END AS confidence, CASE {_first} END AS leader,
        CASE WHEN {_agreed("bullish")} THEN 'bullish_trend' WHEN {_agreed("bearish")} THEN 'bearish_trend' {_first} END AS regime FROM rg_most""",
}
