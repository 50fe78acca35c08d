"""Further expressions for ``oracle``: acceptance and retest of breaks, the sequence machine, exponential means."""

from __future__ import annotations

PART = "PARTITION BY series_id ORDER BY idx"
ALL = f"OVER ({PART} ROWS UNBOUNDED PRECEDING)"
LAST8 = f"OVER ({PART} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"

CTES = {
    "ema_lines": "SELECT series_id, idx, f AS ema_12, s AS ema_26 FROM ema",
    "acc0": f"""SELECT *,
        coalesce(last_value(CASE WHEN event LIKE '%BULLISH' THEN 'BULLISH' WHEN event LIKE '%BEARISH' THEN 'BEARISH' END IGNORE NULLS) {ALL}, 'NONE')
          AS event_direction,
        last_value(CASE WHEN event LIKE '%BULLISH' THEN last_high WHEN event LIKE '%BEARISH' THEN last_low END IGNORE NULLS) {ALL} AS event_level
      FROM structure""",
    # The bars since the event are joined and counted one by one.
    "acc1": """SELECT a.series_id, a.idx,
        count(*) FILTER (CASE a.event_direction WHEN 'BULLISH' THEN b.close > a.event_level ELSE b.close < a.event_level END) AS closes_beyond
      FROM acc0 a JOIN bars b ON b.series_id = a.series_id AND b.idx BETWEEN a.event_index AND a.idx GROUP BY 1, 2""",
    "acc2": """SELECT acc0.*, closes_beyond,
        CASE event_direction WHEN 'BULLISH' THEN close - event_level WHEN 'BEARISH' THEN event_level - close END AS beyond
      FROM acc0 LEFT JOIN acc1 USING (series_id, idx)""",
    "acc3": """SELECT *, coalesce(beyond / unit, 0.0) AS break_distance, greatest(coalesce(beyond / unit, 0.0), 0.0) AS break_strength,
        CASE WHEN event_age IS NULL OR event_age = 0 THEN 'NONE' WHEN beyond < 0 AND event_age <= 4 THEN 'REJECTED'
             WHEN closes_beyond >= least(3, event_age + 1) THEN 'ACCEPTED' ELSE 'PENDING' END AS acceptance,
        CASE WHEN event_age >= 1 AND abs(close - event_level) <= unit THEN CASE WHEN beyond > 0 THEN 'HOLD' ELSE 'FAIL' END ELSE 'NONE' END AS retest
      FROM acc2""",
    "acc": """SELECT *, CASE WHEN event_age IS NULL THEN 'NEUTRAL' WHEN event_age = 0 THEN 'BREAK'
        WHEN acceptance = 'ACCEPTED' THEN 'POST_BREAK' ELSE 'TRANSITION' END AS phase FROM acc3""",
    "mach0": """SELECT a.series_id, a.idx, a.event, a.event_direction, a.trend, a.acceptance, a.retest, n.direction, n.type, n.rejection, n.growth, n.bs
      FROM acc a JOIN norm n ON n.series_id = a.series_id AND n.idx = a.idx""",
    "mach1": f"""SELECT *, count(*) FILTER (bs >= 0.6 AND growth >= CAST(1.1 AS DOUBLE)) {LAST8} AS impulses,
        CASE trend WHEN 'BULLISH' THEN count(*) FILTER (direction = 'DOWN') {LAST8} WHEN 'BEARISH' THEN count(*) FILTER (direction = 'UP') {LAST8}
                   ELSE 0 END AS pullbacks,
        count(*) FILTER (type = 'COMPRESSION' OR growth <= CAST(0.7 AS DOUBLE)) {LAST8} AS compressions, growth >= CAST(1.35 AS DOUBLE) AS expands
      FROM mach0""",
    # A running statement, bar by bar, as the machine is defined: each state from the one before it.
    "mach2": "SELECT series_id, idx, 'INITIAL' AS sequence, 'INITIAL' AS before FROM (SELECT series_id, min(idx) - 1 AS idx FROM bars GROUP BY 1) UNION ALL "
    """SELECT m.series_id, m.idx, CASE
          WHEN m.event <> 'NONE' THEN m.event_direction || '_BREAK' WHEN m.acceptance = 'REJECTED' THEN 'FAILED_BREAK'
          WHEN m.retest = 'HOLD' THEN 'BREAK_RETEST_HOLD' WHEN m.impulses >= 2 AND m.pullbacks >= 1 THEN 'IMPULSE_PULLBACK'
          WHEN p.sequence = 'IMPULSE_PULLBACK' AND m.trend <> 'NEUTRAL' AND m.direction = CASE m.trend WHEN 'BULLISH' THEN 'UP' ELSE 'DOWN' END
            THEN 'PULLBACK_CONTINUATION'
          WHEN p.sequence = 'IMPULSE_PULLBACK' AND m.direction = CASE m.trend WHEN 'BULLISH' THEN 'DOWN' ELSE 'UP' END THEN 'PULLBACK_FAILURE'
          WHEN m.compressions >= 3 AND m.expands THEN 'COMPRESSION_EXPANSION' WHEN m.rejection <> 'NONE' AND m.event <> 'NONE' THEN 'EXHAUSTION_REVERSAL'
          WHEN m.expands THEN 'IMPULSE' WHEN m.compressions >= 3 THEN 'COMPRESSION' WHEN m.trend <> 'NEUTRAL' THEN 'TREND_CONTINUATION' ELSE 'MIXED' END,
        p.sequence
      FROM mach2 p JOIN mach1 m ON m.series_id = p.series_id AND m.idx = p.idx + 1""",
    "machine": """SELECT s.series_id, s.idx, s.sequence, CASE WHEN s.sequence <> s.before THEN s.before || '->' || s.sequence ELSE 'NONE' END AS transition,
        m.impulses, m.pullbacks, m.compressions FROM mach2 s JOIN mach1 m ON m.series_id = s.series_id AND m.idx = s.idx""",
}
