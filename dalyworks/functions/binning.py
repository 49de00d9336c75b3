"""Right-closed binning with labels such as ``(1,1.5]``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x: Column, breaks: Column) -> Column:
    """1-based bin of ``x`` among ascending ``breaks``.

    Bins are open on the left and closed on the right. NULL for a NULL value,
    for one at or below the first break, and for one above the last.
    """
    below = F.size(F.filter(breaks, lambda b: b < x))
    return F.when(x.isNotNull() & (below >= 1) & (below < F.size(breaks)), below)


def significant(x: Column, digits: int) -> Column:
    """Text of ``x`` to ``digits`` significant digits, without trailing zeros."""
    places = F.lit(digits - 1) - F.floor(F.log10(x))
    scale = F.pow(F.lit(10.0), places)
    text = (F.rint(x * scale) / scale).cast("decimal(38,16)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def break_label(x: Column, fixed: Sequence[float]) -> Column:
    """Label of a data-dependent break: three significant digits, or as many
    more (to twelve) as it takes to differ from the fixed breaks."""
    taken = [f"{b:g}" for b in fixed]
    options = [significant(x, d) for d in range(3, 13)]
    return F.coalesce(*[F.when(~o.isin(taken), o) for o in options], options[-1])
