"""Evidence counts behind the burden estimates, by region and cause group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import codes
from ..functions.nulls import ratio
from ..functions.reshape import gather, position

INPUT_COLUMNS = ("inputs_mental", "inputs_maternal", "inputs_all")


def inputs_long(inputs: DataFrame) -> DataFrame:
    """(region, input, count) of real regions and of the two charted inputs."""
    kept = inputs.filter(~F.col("ihme_region").isin(*codes.NOT_A_REGION))
    long = gather(kept.select("ihme_region", *INPUT_COLUMNS), INPUT_COLUMNS, "input", "count")
    return long.filter(F.col("input") != "inputs_all")


def inputs_share(inputs: DataFrame) -> DataFrame:
    """Each region's share of an input's total."""
    per_input = Window.partitionBy("input")
    return inputs_long(inputs).withColumn("share", ratio("count", F.sum("count").over(per_input)))


def inputs_stack(inputs: DataFrame, order: Sequence[str] = codes.REGION_ORDER["ihme_region"]) -> DataFrame:
    """Stacked bars: where each region's segment starts and ends, and the total.

    Segments follow the display order; regions it does not list come last.
    """
    per_input = Window.partitionBy("input")
    stacked = per_input.orderBy(F.col("region_rank").asc_nulls_last(), "ihme_region")
    ranked = inputs_long(inputs).withColumn("region_rank", position("ihme_region", order))
    end = F.sum("count").over(stacked)
    return ranked.withColumns(
        {"stack_start": end - F.col("count"), "stack_end": end, "input_total": F.sum("count").over(per_input)}
    )
