"""Joins to the country dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.joins import null_safe_join


def enrich(df: DataFrame, crosswalk: DataFrame, income: DataFrame) -> DataFrame:
    """Add iso_code and income_level.

    Places without a code (the world, aggregates) have a NULL code that matches
    a NULL code. Repeated rows of the dimensions are removed first, so they do
    not multiply the facts.
    """
    iso = crosswalk.select("location_id", "iso_code").distinct()
    return null_safe_join(df.join(iso, "location_id", "left"), income.distinct(), "iso_code")


def region_full_join(df: DataFrame, region: DataFrame) -> DataFrame:
    """Full outer join to the regions: places without a region and regions'
    places without burden both stay.

    The burden side keeps its partitions: it is joined to the small region table
    from the left, and the region rows that no burden matches are added. A full
    outer join would bring all places without a code into one task.
    """
    named = region.select("iso_code", *codes.SCHEMES)
    seen = df.select(F.col("iso_code").alias("__seen")).distinct()
    alone = named.join(seen, named["iso_code"].eqNullSafe(F.col("__seen")), "left_anti")
    return null_safe_join(df, named, "iso_code").unionByName(alone, allowMissingColumns=True)


def map_join(boundary: DataFrame, df: DataFrame) -> DataFrame:
    """Point estimates with the polygon attributes of their place.

    Polygons without burden have no bound and drop out, so the outer join is
    one-sided; burden without a polygon stays, with ``on_map`` false.
    """
    points = df.filter(F.col("numeric_name") == "val")
    polygons = boundary.select("iso_code", "gu_a3", "adm0_a3", F.lit(True).alias("__polygon"))
    joined = null_safe_join(points, polygons, "iso_code")
    return joined.withColumn("on_map", F.col("__polygon").isNotNull()).drop("__polygon")


def region_members(region: DataFrame, scheme: str) -> DataFrame:
    """Sorted list of the places of every region."""
    return (
        region.filter(F.col(scheme).isNotNull())
        .groupBy(scheme)
        .agg(F.array_join(F.array_sort(F.collect_set("iso_code")), ",").alias("members"))
    )
