"""Scores of seven regimes from candles and fractal swings of the last 20, 60 and 120 bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import case, over, series

c = F.col
SCALES = (20, 60, 120)
#: Regimes in the order that decides ties (fixed values).
REGIMES = ("bullish_trend", "bearish_trend", "range", "breakout", "high_volatility", "low_volatility", "transition")


def _swing_steps(bars: DataFrame) -> DataFrame:
    """Bars whose high (low) no bar within two on either side exceeds, with the step from the one before: 1, 0 or -1."""
    near = [f(x, k).over(series()) for x in ("high",) for f in (F.lag, F.lead) for k in (1, 2)]
    below = [f(x, k).over(series()) for x in ("low",) for f in (F.lag, F.lead) for k in (1, 2)]
    is_top = F.forall(F.array(*near), lambda x: x <= c("high"))
    is_bottom = F.forall(F.array(*below), lambda x: x >= c("low"))
    f = bars.withColumns({"top": F.when(is_top, c("high")), "bottom": F.when(is_bottom, c("low"))})
    step = lambda x: F.when(c(x).isNotNull(), F.coalesce(F.signum(c(x) - F.last(x, ignorenulls=True).over(over(None, -1))), F.lit(0.0)).cast("int"))
    return f.withColumns({"top_step": step("top"), "bottom_step": step("bottom")})


def _steps(sign: int, n: int) -> Column:
    """Steps of that sign between swings that both lie in the last ``n`` bars and are confirmed there: the first swing has none inside."""
    inside = over(3 - n, -2)
    count = lambda x: F.count_if(c(x) == sign).over(inside) - F.coalesce((F.first(x, ignorenulls=True).over(inside) == sign).cast("int"), F.lit(0))
    return count("top_step") + count("bottom_step")


def scale_states(bars: DataFrame) -> DataFrame:
    """direction, momentum, volatility and structure over the last 20, 60 and 120 bars, for bars with 120 of them."""
    f = _swing_steps(bars).withColumns({"up": (c("close") > c("open")).cast("int"), "down": (c("close") < c("open")).cast("int"), "span": F.greatest(c("high") - c("low"), F.lit(0.0))})
    at = lambda k: F.lag("close", k).over(series()) if k else c("close")
    for n in SCALES:
        half, lead = n // 2, max(2.0, n * 0.05)
        f = f.withColumns({
            "n_up": F.sum("up").over(over(1 - n)), "n_down": F.sum("down").over(over(1 - n)), "early_move": F.abs(at(half) - at(n - 1)), "late_move": F.abs(at(0) - at(half - 1)),
            "early_span": F.avg("span").over(over(1 - n, -half)), "late_span": F.avg("span").over(over(1 - half)), "good": _steps(1, n), "bad": _steps(-1, n),
        })
        grown = lambda a, b, more, less: case((c(a) > c(b) * 1.10, more), (c(a) < c(b) * 0.90, less), otherwise="stable")
        f = f.withColumns({
            f"direction{n}": case((c("n_up") > c("n_down") + lead, "bullish"), (c("n_down") > c("n_up") + lead, "bearish"), otherwise="mixed"),
            f"momentum{n}": grown("late_move", "early_move", "increasing", "decreasing"), f"volatility{n}": grown("late_span", "early_span", "expanding", "contracting"),
            f"structure{n}": case((c("good") > c("bad") + 1, "bullish"), (c("bad") > c("good") + 1, "bearish"), otherwise="range"),
        })
    return f.withColumn("n_bars", F.count("*").over(over(1 - max(SCALES)))).filter(c("n_bars") == max(SCALES))


def regime_scores(bars: DataFrame) -> DataFrame:
    """Seven scores a bar, the highest (ties: first in order), its share of all in percent, and the regime after agreement of all directions overrides it."""
    short, medium, high = SCALES
    given = lambda weight, *conditions: sum((F.when(x, weight).otherwise(0.0) for x in conditions[1:]), F.when(conditions[0], weight).otherwise(0.0))
    is_ = lambda name, value, *scales: [c(f"{name}{n}") == value for n in scales or SCALES]
    both = lambda name, value: is_(name, value, short)[0] & is_(name, value, medium)[0]
    number = lambda value: sum((x.cast("int") for x in is_("volatility", value)), F.lit(0))
    trend = lambda side: given(2.0, *is_("direction", side), *is_("structure", side), (c(f"momentum{medium}") == "increasing") & (c(f"direction{medium}") == side))
    wide = number("expanding") >= 2
    f = scale_states(bars).withColumns({
        "bullish_trend": trend("bullish"), "bearish_trend": trend("bearish"), "range": given(2.0, *is_("structure", "range")) + given(4.0, both("structure", "range")),
        "breakout": given(3.0, both("volatility", "expanding")), "high_volatility": given(3.0, wide), "low_volatility": given(3.0, ~wide & (number("contracting") >= 2)),
        "transition": given(4.0, (c(f"direction{short}") != c(f"direction{medium}")) & (c(f"direction{medium}") == c(f"direction{high}"))),
    })
    most, total = F.greatest(*REGIMES), sum((c(r) for r in REGIMES[1:]), c(REGIMES[0]))
    agreed = lambda side: is_("direction", side)[0] & is_("direction", side)[1] & is_("direction", side)[2] & (c(f"structure{medium}") == side)
    return f.withColumns({
        "confidence": F.when(total > 0, most / total * 100).otherwise(0.0), "leader": case(*((c(r) == most, r) for r in REGIMES)),
        "regime": case((agreed("bullish"), "bullish_trend"), (agreed("bearish"), "bearish_trend"), *((c(r) == most, r) for r in REGIMES)),
    })
