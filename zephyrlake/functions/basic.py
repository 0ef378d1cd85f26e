"""Small Column helpers: clipping, banding, usable numbers and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def bands(x: Column, edges: list[tuple[float, str]], last: str, missing: str | None = None) -> Column:
    """The label of the first upper edge that x is below, else ``last``; null gives ``missing``."""
    out = F.when(x.isNull(), F.lit(missing))
    for edge, label in edges:
        out = out.when(x < edge, F.lit(label))
    return out.otherwise(F.lit(last))


def usable(x: Column) -> Column:
    """A finite, non-negative number, else null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def number(text: Column) -> Column:
    """A numeric string; empty, NA and unreadable ones are null."""
    return F.when(~F.upper(F.trim(text)).isin("", "NA", "NAN", "NONE", "NULL"), text.try_cast("double"))


def truthy(text: Column) -> Column:
    """Whether a string says yes."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def trimmed(x: Column, digits: int = 4) -> Column:
    """A number as text with at most ``digits`` decimals and no trailing zeros; null is empty.

    Rounding goes by the double's exact binary value, half to even, as C and Python print it; Java's %f goes by the
    shortest decimal that names the double, half up. Digits beyond those of that decimal are not made up.
    """
    x = x.cast("double")
    named = F.isnan(x) | (F.abs(x) == float("inf"))
    text = F.when(named, x.cast("string")).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0")))
    return F.coalesce(F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text), F.lit(""))


def slots(anchor: Column, hours: int) -> Column:
    """Array of ``hours`` hourly instants ending at the anchor."""
    return F.sequence(anchor - F.expr(f"INTERVAL {hours - 1} HOURS"), anchor, F.expr("INTERVAL 1 HOUR"))
