"""Arithmetic with explicit rules for missing values.

Spark's own ``sum`` skips NULL and its division raises on zero; the analysis
needs both the propagating and the skipping sum, and undefined ratios as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_sum(name: str) -> Column:
    """Sum of a column that is NULL as soon as one value of the group is NULL."""
    return F.expr(f"CASE WHEN count(1) = count(`{name}`) THEN sum(`{name}`) END")


def na_rm_sum(name: str) -> Column:
    """Sum of the values present; 0 when there are none."""
    return F.expr(f"coalesce(sum(`{name}`), 0D)")


def zero_if_na(c: Column | str) -> Column:
    """0 for NULL and for NaN."""
    return F.coalesce(F.nanvl(as_col(c), F.lit(0.0)), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, NULL when the denominator is zero."""
    return F.try_divide(as_col(a), as_col(b))


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is NULL, not ``no``, when the test is NULL."""
    return F.when(test, yes).when(~test, no)


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest`` would drop it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def floor_to(c: Column | str, digits: int) -> Column:
    """Truncate towards minus infinity, keeping doubles throughout."""
    scale = float(10**digits)
    return F.floor(as_col(c) * scale).cast("double") / scale
