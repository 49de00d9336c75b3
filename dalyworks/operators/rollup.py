"""Roll-ups of country results to regions, income groups and the world.

Two costs exist for a group of countries and are kept apart: regions value the
region's DALYs at the region's GDP per head, income groups add up the costs of
their countries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import codes
from ..functions.nulls import na_rm_sum, na_sum, ratio
from ..functions.reshape import gather, lookup
from .valuation import value

ROW_KEYS = ("estimate_id", "estimate", "measure_id", "measure_name", "numeric_name", "paf_formula")


def pooled_rates(df: DataFrame) -> DataFrame:
    """Rates of a group from its sums (not means of its members' rates)."""
    people = F.col("pop100k") * 100000.0
    return df.withColumns(
        {
            "rate_per_100k": ratio("number", "pop100k"),
            "percent": ratio("number", "measure_total") * 100.0,
            "population": people,
            "gdp_per_capita": ratio(F.col("gdp"), people),
            "gdp_ppp_per_capita": ratio(F.col("gdp_ppp"), people),
        }
    )


def region_sums(
    df: DataFrame, schemes: Sequence[str] = codes.SCHEMES, slices: Sequence[str] = codes.SLICES
) -> DataFrame:
    """Sums per (scheme, region) and row key, for all schemes in one pass.

    Places without a region form one group per scheme.
    """
    belongs = [F.struct(F.lit(s).alias("scheme"), F.col(s).alias("region")) for s in schemes]
    return (
        df.select("*", F.inline(F.array(*belongs)))
        .groupBy("scheme", "region", *ROW_KEYS, *slices)
        .agg(
            na_sum("population_100k").alias("pop100k"),
            na_sum("number").alias("number"),
            na_sum("measure_total").alias("measure_total"),
            na_rm_sum("gdp").alias("gdp"),
            na_rm_sum("gdp_ppp").alias("gdp_ppp"),
        )
    )


def region_rollup(
    df: DataFrame, schemes: Sequence[str] = codes.SCHEMES, slices: Sequence[str] = codes.SLICES
) -> DataFrame:
    """Region results with the region's own GDP per head as the value of a DALY."""
    return value(pooled_rates(region_sums(df, schemes, slices)))


def with_scheme_names(df: DataFrame, scheme: str) -> DataFrame:
    """One scheme's rows, its name in the columns: ``<scheme>``, ``<scheme>_<metric>``."""
    base = ("pop100k", "measure_total", "gdp", "gdp_ppp", "population", "gdp_per_capita", "gdp_ppp_per_capita")
    names = [c for c in (*base, *codes.METRICS, *[f"{m}_diff" for m in codes.METRICS]) if c in df.columns]
    renamed = {"region": scheme, **{c: f"{scheme}_{c}" for c in names}}
    return df.filter(F.col("scheme") == scheme).drop("scheme").withColumnsRenamed(renamed)


def shown(df: DataFrame) -> DataFrame:
    """Leave out the PAF estimate, and rows without an estimate."""
    return df.filter(F.col("estimate_id") != codes.PAF)


def income_burden(df: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Number, total and percent per income group, from the group's own totals."""
    keys = ["income_level", "measure_id", "measure_name", "numeric_name", "estimate_id", "estimate", *slices]
    sums = shown(df).filter(F.col("income_level").isNotNull()).groupBy(*keys).agg(
        na_sum("number").alias("number"), na_sum("measure_total").alias("measure_total")
    )
    return sums.withColumn("percent", ratio("number", "measure_total") * 100.0)


def income_rank(df: DataFrame) -> DataFrame:
    """Add the rank and full name of the income level."""
    return df.withColumns(
        {
            "income_rank": lookup("income_level", {k: r for k, (r, _) in codes.INCOME_LEVELS.items()}),
            "income_name": lookup("income_level", {k: n for k, (_, n) in codes.INCOME_LEVELS.items()}),
        }
    )


def cost_long(df: DataFrame) -> DataFrame:
    """One row per valuation, as (name, value), for DALYs only."""
    keep = [c for c in df.columns if c not in codes.COSTS]
    dalys = shown(df).filter(F.col("measure_id") == codes.DALYS)
    return gather(dalys.select(*keep, *codes.COSTS), codes.COSTS, "name", "value")


def income_costs(df: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Country costs added up per income group, one column per valuation."""
    keys = ["income_level", "numeric_name", "estimate_id", "estimate", *slices]
    costs = cost_long(df.select(*keys, "measure_id", *codes.COSTS))
    return (
        costs.filter(F.col("income_level").isNotNull())
        .groupBy(*keys)
        .pivot("name", list(codes.COSTS))
        .agg(na_rm_sum("value"))
    )


SECTIONS = {"world": 1, "income": 2, "region": 3}


def with_levels(df: DataFrame) -> DataFrame:
    """Repeat every row for the levels it belongs to: the world, its income
    group, its region. Adds (section, place, place_rank)."""
    names = {k: n for k, (_, n) in codes.INCOME_LEVELS.items()}
    ranks = {k: r for k, (r, _) in codes.INCOME_LEVELS.items()}
    levels = {
        "world": (F.lit(codes.WORLD_NAME), F.lit(1), F.col("location_id") == codes.WORLD_LOCATION),
        "income": (
            lookup("income_level", names), lookup("income_level", ranks), F.col("income_level").isNotNull()
        ),
        "region": (F.col("ihme_region"), F.lit(1), F.col("ihme_region").isNotNull()),
    }
    rows = []
    for section, (place, rank, belongs) in levels.items():
        row = F.struct(
            F.lit(SECTIONS[section]).alias("section"), place.alias("place"), rank.alias("place_rank")
        )
        rows.append(F.when(belongs, row))
    return df.select("*", F.inline(F.array_compact(F.array(*rows))))


def level_rollup(df: DataFrame, slices: Sequence[str] = codes.SLICES, costs: bool = True) -> DataFrame:
    """World, income groups and regions in one aggregation.

    The input is computed and shuffled a single time. Each cost has the meaning
    of its level: the world's own, the sum over an income group's countries, or
    a region's DALYs at the region's GDP per head.
    """
    keys = [
        "section", "place", "place_rank",
        "measure_id", "measure_name", "numeric_name", "estimate_id", "estimate", *slices,
    ]
    sums = {"number": na_sum("number"), "measure_total": na_sum("measure_total")}
    if costs:
        sums["pop100k"] = na_sum("population_100k")
        for name in ("gdp", "gdp_ppp"):
            sums[name] = na_rm_sum(name)
        for cost in codes.COSTS:
            sums[f"own_{cost}"] = na_sum(cost)
            sums[f"added_{cost}"] = na_rm_sum(cost)
    rolled = (
        with_levels(shown(df)).groupBy(*keys).agg(*[expr.alias(name) for name, expr in sums.items()])
    )
    if not costs:
        percent = ratio("number", "measure_total") * 100.0
        return rolled.select(*keys, "number", "measure_total", percent.alias("percent"))
    rates = value(pooled_rates(rolled), prefix="regional_")
    by_level = [
        F.expr(
            f"CASE section WHEN {SECTIONS['world']} THEN own_{cost} WHEN {SECTIONS['income']} THEN added_{cost}"
            f" ELSE regional_{cost} END AS {cost}"
        )
        for cost in codes.COSTS
    ]
    return rates.select(*keys, "number", "measure_total", "percent", "gdp", *by_level)


def cube_sums(df: DataFrame, dims: Sequence[str], strict: Sequence[str], loose: Sequence[str] = (), level: str = "level") -> DataFrame:
    """Sums over every subset of ``dims``, in one pass over ``df``.

    ``strict`` columns are NULL as soon as one value of the cell is, ``loose`` ones (named
    ``<column>_known``) skip missing values. ``level`` has a bit for each dimension that a row
    sums over, the first dimension the highest, and tells a total from a missing key.
    """
    sums = [na_sum(c).alias(c) for c in strict] + [na_rm_sum(c).alias(f"{c}_known") for c in loose]
    return df.cube(*dims).agg(F.grouping_id().cast("int").alias(level), *sums)


def top_places(df: DataFrame, within: Sequence[str], value: str, k: int, name: str = "place_rank") -> DataFrame:
    """The rows of the ``k`` largest values of each group, with their rank; ties share one and all stay.

    Rows without a value have no rank and go. Each task first keeps the ranks up to ``k`` of what
    it holds, so a group of any size sends k rows a task, ties aside, and is never sorted as a whole.
    """
    order = Window.partitionBy(*within).orderBy(F.col(value).desc())
    return df.filter(F.col(value).isNotNull()).withColumn(name, F.rank().over(order)).filter(F.col(name) <= k)
