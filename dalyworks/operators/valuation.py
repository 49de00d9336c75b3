"""Money values of DALYs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.joins import null_safe_join
from ..functions.nulls import ratio


def with_gdp(df: DataFrame, gdp: DataFrame, gdp_ppp: DataFrame) -> DataFrame:
    """GDP and GDP per head, in current dollars and in purchasing power.

    The world has no code of its own in the facts: it takes the indicator's
    world row, which is an input and not a sum.
    """
    lookup_code = F.when(F.col("location_id") == codes.WORLD_LOCATION, F.lit(codes.WORLD_ISO)).otherwise(
        F.col("iso_code")
    )
    joined = df.withColumn("__gdp_code", lookup_code)
    for table in (gdp, gdp_ppp):
        joined = null_safe_join(joined, table.withColumnRenamed("iso_code", "__gdp_code"), "__gdp_code")
    return joined.drop("__gdp_code").withColumns(
        {
            "gdp_per_capita": ratio("gdp", "population"),
            "gdp_ppp_per_capita": ratio("gdp_ppp", "population"),
        }
    )


def value(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add the six valuations; 0 for measures other than DALYs.

    Columns are read as ``number``, ``gdp_per_capita`` and ``gdp_ppp_per_capita``
    and added with ``prefix`` before their names.
    """
    daly_values = {
        "cost_cc1": f"number * {codes.COPENHAGEN_LOW}D",
        "cost_who1": "number * gdp_per_capita",
        "cost_who3": "number * gdp_ppp_per_capita",
    }
    multiples = {
        "cost_cc2": ("cost_cc1", codes.COPENHAGEN_FACTOR),
        "cost_who2": ("cost_who1", codes.GDP_FACTOR),
        "cost_who4": ("cost_who3", codes.GDP_FACTOR),
    }
    # A NULL measure (a place without burden) has a NULL cost, not 0.
    single = {
        f"{prefix}{name}": F.expr(
            f"CASE WHEN measure_id = {codes.DALYS} THEN {amount} WHEN measure_id IS NOT NULL THEN 0D END"
        )
        for name, amount in daly_values.items()
    }
    times = {
        f"{prefix}{name}": F.expr(f"`{prefix}{base}` * {factor}D") for name, (base, factor) in multiples.items()
    }
    return df.withColumns(single).withColumns(times)
