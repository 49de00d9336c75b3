"""The published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.reshape import inline_rows, position

BOUND_ORDER = ("val", "lower", "upper")
TABLE_ESTIMATES = tuple(codes.ESTIMATES[i] for i in codes.SHOWN_ESTIMATES)
TABLE1_METRICS = ("number", "percent")
TABLE1_COLUMNS = tuple(f"{b}_{m}_{e}" for e in TABLE_ESTIMATES for m in TABLE1_METRICS for b in BOUND_ORDER)
TABLE2_COLUMNS = tuple(f"{b}_{e}" for e in TABLE_ESTIMATES for b in BOUND_ORDER)
PLACE_ORDER = ("section", "place_rank", "location_name")
# Order of the rows within a slice; every slice is a table of its own.
TABLE1_ORDER = ("measure_name", *PLACE_ORDER)
TABLE2_ORDER = ("name", *PLACE_ORDER)
MILLION = 1e6
TRILLION = 1e12


def _only(name: str, table: str) -> Column:
    """The one value of a cell; two that differ are an error, not a choice."""
    clash = f"raise_error('two values for one cell of {table}')"
    return F.expr(f"CASE WHEN min(`{name}`) <=> max(`{name}`) THEN max(`{name}`) ELSE {clash} END")


def _strip(amount: Column) -> Column:
    """Two-decimal text without trailing zeros."""
    return F.regexp_replace(amount.cast("decimal(30,2)").cast("string"), r"\.?0+$", "")


def table1_long(levels: DataFrame, unit: float = MILLION, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Burden per slice, measure, place, bound and estimate: number and percent."""
    place = F.col("place").alias("location_name")
    ids = [*slices, "measure_name", place, "section", "place_rank", "numeric_name", "estimate"]
    rows = [
        {"metric": F.lit("number"), "point": F.bround(F.col("number") / unit, 1)},
        {"metric": F.lit("percent"), "point": F.bround("percent", 1)},
    ]
    return inline_rows(levels, ids, rows)


def table1(levels: DataFrame, unit: float = MILLION, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """One row per slice, measure and place, bounds x metrics x estimates across."""
    key = F.concat_ws("_", "numeric_name", "metric", "estimate")
    long = table1_long(levels, unit, slices).withColumn("key", key)
    return (
        long.groupBy(*slices, "measure_name", *PLACE_ORDER)
        .pivot("key", list(TABLE1_COLUMNS))
        .agg(_only("point", "table 1"))
        .select(*slices, "measure_name", "location_name", "section", "place_rank", *[F.col(f"`{c}`") for c in TABLE1_COLUMNS])
    )


def table2_long(levels: DataFrame, unit: float = TRILLION, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Value per slice, valuation, place, bound and estimate, with display ranks."""
    dalys = levels.filter(F.col("measure_id") == codes.DALYS)
    ids = [
        *slices, F.col("place").alias("location_name"), "section", "place_rank", "numeric_name", "estimate",
        position("numeric_name", BOUND_ORDER).alias("bound_rank"),
        position("estimate", TABLE_ESTIMATES).alias("estimate_rank"),
    ]
    rows = [{"name": F.lit(c), "value": F.bround(F.col(c) / unit, 2)} for c in codes.COSTS]
    return inline_rows(dalys, ids, rows)


def table2(levels: DataFrame, unit: float = TRILLION, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """One row per slice, valuation and place, bounds x estimates across."""
    long = table2_long(levels, unit, slices).withColumn("key", F.concat_ws("_", "numeric_name", "estimate"))
    return (
        long.groupBy(*slices, "name", *PLACE_ORDER)
        .pivot("key", list(TABLE2_COLUMNS))
        .agg(_only("value", "table 2"))
        .select(*slices, "name", "location_name", "section", "place_rank", *[F.col(f"`{c}`") for c in TABLE2_COLUMNS])
    )


def table_appendix(world: DataFrame, unit: float = TRILLION, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """World values of each slice transposed: one column per estimate and bound, all text.

    ``world`` holds the world's valued rows.
    """
    order = [(e, b) for e in sorted(TABLE_ESTIMATES) for b in BOUND_ORDER]
    picked = (
        world.filter((F.col("measure_id") == codes.DALYS) & (F.col("estimate_id") != codes.PAF))
        .withColumn("cell", F.concat_ws("|", "estimate", "numeric_name"))
        .withColumn("column", position("cell", [f"{e}|{b}" for e, b in order]))
    )
    rows = [
        {"row_order": F.lit(1), "field": F.lit("estimate"), "text": F.col("estimate")},
        {"row_order": F.lit(2), "field": F.lit("numeric_name"), "text": F.col("numeric_name")},
        *[
            {"row_order": F.lit(i), "field": F.lit(c), "text": _strip(F.bround(F.col(c) / unit, 2))}
            for i, c in enumerate(codes.APPENDIX_COSTS, 3)
        ],
    ]
    long = inline_rows(picked, [*slices, "column"], rows)
    columns = list(range(1, len(order) + 1))
    return long.groupBy(*slices, "row_order", "field").pivot("column", columns).agg(_only("text", "the appendix"))
