"""Headline numbers drawn from the tables, one row per slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.nulls import floor_to, ratio
from ..operators.rollup import SECTIONS
from .tables import MILLION, TRILLION


#: Numbers as the summary words them: floored, rounded, or as in the tables.
SUMMARY = (
    "dalys_composite_rounded",
    "percent_composite_floor",
    "dalys_gbd_rounded",
    "cost_composite_floor",
    "highest_share_regions",
    "highest_share",
    "lowest_share_regions",
    "lowest_share",
    "dalys_gbd_floor",
    "percent_gbd_rounded",
    "percent_realloc_floor",
    "dalys_realloc_floor",
    "dalys_high_income",
    "dalys_low_income",
    "cost_composite",
    "cost_realloc",
    "cost_gbd",
)


def headline_metrics(
    levels: DataFrame,
    number_unit: float = MILLION,
    cost_unit: float = TRILLION,
    earlier: float = codes.EARLIER_PROJECTION,
    slices: Sequence[str] = codes.SLICES,
) -> DataFrame:
    """Numbers and wording flags of the summary text, one row per slice.

    They are computed from table values, that is after the tables' rounding. One
    aggregation over the level table picks all of them; the regions that tie for
    an extreme are joined by "; ".
    """

    def cell(section: str, place: str | None, estimate: int, bound: str, amount: Column) -> Column:
        wanted = (
            (F.col("section") == SECTIONS[section])
            & (F.col("measure_id") == codes.DALYS)
            & (F.col("estimate_id") == estimate)
            & (F.col("numeric_name") == bound)
        )
        if place:
            wanted = wanted & (F.col("place") == place)
        cells = F.when(wanted, amount)
        clash = F.raise_error(F.lit(f"two values for one cell: {section} {place or ''} {bound}"))
        return F.when(F.min(cells).eqNullSafe(F.max(cells)), F.max(cells)).otherwise(clash)

    number = F.bround(F.col("number") / number_unit, 1)
    percent = F.bround("percent", 1)
    cost = F.bround(F.col("cost_who1") / cost_unit, 2)
    world = "world", None
    regional = (
        (F.col("section") == SECTIONS["region"])
        & (F.col("measure_id") == codes.DALYS)
        & (F.col("estimate_id") == codes.COMPOSITE)
        & (F.col("numeric_name") == "val")
    )
    share = ratio("cost_who1", "gdp") * 100.0
    picked = levels.groupBy(*slices).agg(
        cell(*world, codes.COMPOSITE, "val", number).alias("dalys_composite"),
        cell(*world, codes.COMPOSITE, "val", percent).alias("percent_composite"),
        cell(*world, codes.GBD, "val", number).alias("dalys_gbd"),
        cell(*world, codes.GBD, "val", percent).alias("percent_gbd"),
        cell(*world, codes.REALLOCATION, "val", number).alias("dalys_realloc"),
        cell(*world, codes.REALLOCATION, "val", percent).alias("percent_realloc"),
        cell("income", "High income", codes.COMPOSITE, "val", number).alias("dalys_high"),
        cell("income", "Low income", codes.COMPOSITE, "val", number).alias("dalys_low"),
        cell(*world, codes.COMPOSITE, "val", cost).alias("cost_composite"),
        cell(*world, codes.REALLOCATION, "val", cost).alias("cost_realloc"),
        cell(*world, codes.GBD, "val", cost).alias("cost_gbd"),
        cell(*world, codes.COMPOSITE, "lower", cost).alias("cost_lower"),
        cell(*world, codes.COMPOSITE, "upper", cost).alias("cost_upper"),
        # One entry per region, so the list is as short as the region table.
        F.collect_list(
            F.when(
                regional & share.isNotNull(), F.struct(share.alias("share"), F.col("place").alias("region"))
            )
        ).alias("shares"),
    )
    ends = picked.withColumns(
        {
            "top": F.array_max("shares.share"),
            "bottom": F.array_min("shares.share"),
        }
    )

    def regions_at(end: str) -> Column:
        hits = F.filter("shares", lambda s: s["share"] == F.col(end))
        return F.array_join(F.array_sort(F.transform(hits, lambda s: s["region"])), "; ")

    whole = ends.select(
        "*",
        F.bround("dalys_composite", 0).alias("dalys_composite_rounded"),
        F.floor("percent_composite").cast("double").alias("percent_composite_floor"),
        F.bround("dalys_gbd", 0).alias("dalys_gbd_rounded"),
        floor_to("cost_composite", 1).alias("cost_composite_floor"),
        regions_at("top").alias("highest_share_regions"),
        F.bround("top", 1).alias("highest_share"),
        regions_at("bottom").alias("lowest_share_regions"),
        F.bround("bottom", 1).alias("lowest_share"),
        F.floor("dalys_gbd").cast("double").alias("dalys_gbd_floor"),
        F.bround("percent_gbd", 0).alias("percent_gbd_rounded"),
        F.floor("percent_realloc").cast("double").alias("percent_realloc_floor"),
        F.floor("dalys_realloc").cast("double").alias("dalys_realloc_floor"),
        F.bround("dalys_high", 0).alias("dalys_high_income"),
        F.bround("dalys_low", 0).alias("dalys_low_income"),
    )
    income_ratio = ratio("dalys_high_income", "dalys_low_income")
    return whole.select(
        *slices,
        *SUMMARY,
        (ratio("dalys_composite_rounded", "dalys_gbd_rounded") > 3).alias("more_than_threefold"),
        F.when(income_ratio > 2.4, "over twice")
        .when(income_ratio > 2, "roughly twice")
        .when(income_ratio.isNotNull(), "approximately twice")
        .alias("income_gradient"),
        (F.col("dalys_composite_rounded") - F.col("dalys_realloc_floor")).alias("added_by_composite"),
        floor_to(F.col("cost_composite") - F.col("cost_realloc"), 1).alias("cost_over_realloc"),
        floor_to(F.col("cost_composite") - F.col("cost_gbd"), 1).alias("cost_over_gbd"),
        (F.col("dalys_composite_rounded") - F.col("dalys_gbd_floor")).alias("underestimate"),
        F.bround(ratio(F.col("dalys_composite_rounded") - F.col("dalys_gbd_floor"), F.col("dalys_composite_rounded")) * 100.0, 0).alias(
            "underestimate_percent"
        ),
        floor_to(F.col("cost_composite_floor") - earlier, 1).alias("over_earlier_projection"),
        floor_to("cost_lower", 1).alias("cost_range_low"),
        floor_to("cost_upper", 1).alias("cost_range_high"),
    )
