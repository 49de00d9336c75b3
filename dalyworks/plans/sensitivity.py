"""Summaries of the sensitivity draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import codes
from ..operators.draws import attributable_deaths
from ..operators.quantiles import grouped_quantiles

INTERVAL = {"p025": 0.025, "p500": 0.5, "p975": 0.975}


def summarize(
    df: DataFrame, keys: Sequence[str], value: str = "deaths_mh", moments: dict[str, Column] | None = None
) -> DataFrame:
    """Count, mean, standard deviation, median and 95% interval per group.

    Draws without a value do not count; a group of such draws has a row all the same.
    """
    moments = {
        **(moments or {}),
        "draws": F.count(value),
        "mean": F.avg(value),
        "sd": F.stddev_samp(value),
    }
    return grouped_quantiles(df, keys, value, INTERVAL, moments)


def deaths_summary(draws: DataFrame, keys: Sequence[str] = (), moments: dict[str, Column] | None = None) -> DataFrame:
    return summarize(attributable_deaths(draws), [*keys, "formula"], moments=moments)


def with_axis_limit(summary: DataFrame, unit: float = 1e6) -> DataFrame:
    """Add the upper end of the figure's axis: the largest draw of all groups."""
    largest = F.max("largest").over(Window.partitionBy(F.lit(0)))  # a row per group of the figure
    return summary.withColumn("axis_limit", largest / unit)


def in_published_band(draws: DataFrame) -> DataFrame:
    """Flag draws whose relative risk lies in the published 95% interval."""
    _, low, high = codes.RISK_CI
    return draws.withColumn("in_band", F.col("relative_risk").between(low, high))
