"""Differences from the baseline estimate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import codes


def diff_from_baseline(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = codes.METRICS) -> DataFrame:
    """Add ``<metric>_diff``: the value minus the group's baseline estimate.

    ``keys`` identify a row but for its estimate, so a partition holds at most
    one row per estimate. Rows without an estimate get NULL differences.
    """
    group = Window.partitionBy(*keys)
    is_baseline = F.col("estimate_id") == codes.GBD
    return df.withColumns(
        {
            f"{m}_diff": F.col(m) - F.first(F.when(is_baseline, F.col(m)), ignorenulls=True).over(group)
            for m in metrics
        }
    )


def yearly_change(df: DataFrame, keys: Sequence[str], value: str, year: str = "year", frame: int = 3) -> DataFrame:
    """Add the change from the year before and the mean of the last ``frame`` years.

    Years are told by their number, not by the row before: a year that is missing, or has no
    value, gives a NULL change in the next one; the mean is of the years present, with their
    count. ``keys`` and ``year`` identify a row, so a partition holds a row a year.
    """
    along = Window.partitionBy(*keys).orderBy(year)
    before, last = along.rangeBetween(-1, -1), along.rangeBetween(1 - frame, 0)
    return df.withColumns(
        {
            f"{value}_change": F.col(value) - F.first(value).over(before),
            f"{value}_mean": F.avg(value).over(last),
            f"{value}_years": F.count(value).over(last),
        }
    )
