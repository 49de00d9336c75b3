"""Output of finished tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row_index(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_index", within: Sequence[str] = ()
) -> DataFrame:
    """Number rows 1..n in ``order``, anew for each value of ``within``.

    For finished report tables (a few rows per place): the rows of one slice come
    into one sorted partition, different slices do not.
    """
    window = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    index = F.row_number().over(window.orderBy(*order)).alias(name)
    return df.select(index, *[F.col(f"`{c}`") for c in df.columns])


def write_indexed_csv(
    df: DataFrame, order: Sequence[Column | str], path: str, keep: Sequence[str], within: Sequence[str] = ()
) -> None:
    """Write a report table as CSV with a leading unnamed index column.

    Without ``within`` it is one file; with it, one folder per slice and one file in each.
    """
    out = with_row_index(df, order, within=within)
    named = out.select(F.col("row_index").alias(""), *within, *[F.col(f"`{c}`") for c in keep if c not in within])
    placed = named.repartition(*within) if within else named.coalesce(1)
    ordered = placed.sortWithinPartitions(*within, "") if within else placed
    writer = ordered.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*within) if within else writer).csv(path)


def write_named_csv(
    df: DataFrame, name: str, order: str, columns: Sequence[str], path: str, within: Sequence[str] = ()
) -> None:
    """Write a transposed table as CSV: row names in an unnamed first column.

    Without ``within`` it is one file; with it, one folder per slice and one file in each.
    """
    placed = (df.repartition(*within) if within else df.coalesce(1)).sortWithinPartitions(*within, order)
    shown = placed.select(F.col(name).alias(""), *within, *[F.col(f"`{c}`") for c in columns])
    writer = shown.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*within) if within else writer).csv(path)
