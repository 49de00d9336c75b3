"""Scans of the inputs from CSV, Parquet or .xlsx workbooks.

Schemas are declared, never inferred. Columns are found by name, wherever they
stand. In CSV text, ``NA`` and nothing mean a missing value; anything else that is
not of the declared type is an error, as is a missing column. Parquet is preferred
for the fact tables, where column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import codes
from . import schemas, workbook


MISSING = "NA"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text."""
    options = {"header": True, "nullValue": MISSING, "escape": '"', "mode": "FAILFAST"}
    return spark.read.options(**options).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", sheet: int | str = 1) -> DataFrame:
    """The columns of ``schema``, by name; further columns are left out. ``sheet`` is for "xlsx"."""
    if fmt == "xlsx":
        return workbook.read_sheet(spark, path, schema, sheet)
    stored = read_text(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    absent = [f.name for f in schema if f.name not in stored.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}; it has {', '.join(stored.columns)}")
    return stored.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_gbd(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Burden extract, or a prevalence extract of the same shape."""
    return read_table(spark, path, schemas.GBD, fmt)


def read_crosswalk(spark: SparkSession, path: str, fmt: str = "parquet", sheet: int | str = 1) -> DataFrame:
    return read_table(spark, path, schemas.CROSSWALK, fmt, sheet)


def read_income(spark: SparkSession, path: str, fmt: str = "parquet", sheet: int | str = 1) -> DataFrame:
    """Income levels of one year; ``income_levels`` takes them from a history."""
    return read_table(spark, path, schemas.INCOME, fmt, sheet)


def read_region(spark: SparkSession, path: str, fmt: str = "parquet", sheet: int | str = 1) -> DataFrame:
    return read_table(spark, path, schemas.REGION, fmt, sheet)


def read_boundary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Attributes of the map polygons, one row per polygon."""
    return read_table(spark, path, schemas.BOUNDARY, fmt)


def read_inputs(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Evidence counts by region; the unnamed trailing column is dropped."""
    return read_table(spark, path, schemas.INPUTS, fmt)


def read_wide(spark: SparkSession, path: str, fmt: str = "csv", sheet: int | str = 1) -> DataFrame:
    """Indicator table with one column per year, as text when read from CSV or a workbook."""
    if fmt == "xlsx":
        return workbook.read_wide_sheet(spark, path, sheet)
    if fmt == "csv":
        return read_text(spark, path)
    return spark.read.format(fmt).load(path)


def year_column(df: DataFrame, year: int) -> str:
    """Name of the column for ``year``: plain, or with the X prefix that
    name-mangling readers add."""
    for name in (f"X{year}", str(year)):
        if name in df.columns:
            return name
    raise ValueError(f"no column for {year} among {df.columns}")


def indicator(wide: DataFrame, alias: str, year: int = 2019, key: str = "iso_code") -> DataFrame:
    """(iso_code, value of one year) from a wide indicator table."""
    return wide.select(
        F.col(key).alias("iso_code"), F.col(f"`{year_column(wide, year)}`").cast("double").alias(alias)
    )


def income_levels(history: DataFrame, year: int = 2019, key: str = "iso_code") -> DataFrame:
    """(iso_code, income_level) of one year from a wide classification history."""
    return history.select(
        F.col(key).alias("iso_code"), F.col(f"`{year_column(history, year)}`").alias("income_level")
    )


def repair_iso(boundary: DataFrame) -> DataFrame:
    """Polygon attributes keyed by iso_code; South Sudan's code is corrected."""
    return boundary.withColumn(
        "iso_code", F.when(F.col("adm0_a3") == "SDS", F.lit("SSD")).otherwise(F.col("gu_a3"))
    )


def prevalence(extract: DataFrame, slices=codes.SLICES) -> DataFrame:
    """Prevalence of mental disorders as (location, slice, bound, fraction)."""
    long = extract.filter(F.col("cause_id") == codes.MENTAL).select("location_id", *slices, *codes.BOUNDS)
    return long.unpivot(["location_id", *slices], list(codes.BOUNDS), "numeric_name", "prevalence")
