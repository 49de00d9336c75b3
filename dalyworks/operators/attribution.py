"""Re-attribution of burden to mental disorders.

Fact rows stay wide in their bounds up to the first (and only large) shuffle,
which is a partial-aggregating ``groupBy`` on the fact's own key. The second one
collapses the causes, again with map-side combination, and leaves country-scale
data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import codes
from ..functions.nulls import if_else, na_sum, ratio, zero_if_na
from ..functions.reshape import inline_rows, literal_table, lookup

_MEASURED = ("metric_id", "metric_name", *codes.BOUNDS)


def unpivot_bounds(extract: DataFrame) -> DataFrame:
    """One row per bound instead of three bound columns."""
    ids = [c for c in extract.columns if c not in codes.BOUNDS]
    return extract.unpivot(ids, list(codes.BOUNDS), "numeric_name", "est")


def _single(metric: int, bound: str) -> Column:
    """The value of one metric within a key; repeated rows must agree."""
    value = f"CASE WHEN metric_id = {metric} THEN `{bound}` END"
    clash = f"raise_error('conflicting rows for one burden key: metric {metric}, {bound}')"
    return F.expr(f"CASE WHEN min({value}) <=> max({value}) THEN max({value}) ELSE {clash} END")


def number_rate_join(extract: DataFrame) -> DataFrame:
    """Numbers beside rates, one row per burden key and bound.

    Equivalent to joining the number rows to the rate rows, but in one
    aggregation that also drops repeated rows. Keys without a number row are
    left out; a missing rate is NULL.
    """
    keys = [c for c in extract.columns if c not in _MEASURED]
    wanted = extract.filter(F.col("metric_id").isin(codes.NUMBER, codes.RATE))
    pairs = {"number": codes.NUMBER, "rate": codes.RATE}
    aggs = [_single(m, b).alias(f"{n}_{b}") for n, m in pairs.items() for b in codes.BOUNDS]
    wide = (
        wanted.groupBy(*keys)
        .agg(*aggs, F.count_if(F.col("metric_id") == codes.NUMBER).alias("__numbers"))
        .filter(F.col("__numbers") > 0)
    )
    rows = [
        {"numeric_name": F.lit(b), "number": F.col(f"number_{b}"), "rate": F.col(f"rate_{b}")}
        for b in codes.BOUNDS
    ]
    return inline_rows(wide, keys, rows)


def population(extract: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Burden numbers with the population implied by number and rate.

    Prevalence rows are removed before the shuffle.
    """
    keys = ["measure_id", "measure_name", "location_id", "location_name", "cause_id", *slices]
    burden = extract.filter(F.col("measure_id") != codes.PREVALENCE).select(*keys, *_MEASURED)
    people = ratio("number", "rate")
    return number_rate_join(burden).select(
        *keys,
        "numeric_name",
        "number",
        people.alias("population_100k"),
        (people * 100000.0).alias("population"),
    )


def factor_table(spark: SparkSession) -> DataFrame:
    """Weights and relative risks by cause and bound (36 + 6 rows)."""
    rows = []
    for bound in codes.BOUNDS:
        pain = codes.PAIN_SHARE[bound]
        for cause in codes.FULL_CAUSES:
            rows.append((cause, bound, 1.0 if cause == codes.MENTAL else None, 1.0, None))
        rows += [(cause, bound, None, pain, None) for cause in codes.PAIN_CAUSES]
        rows += [(cause, bound, None, 0.5 * pain, None) for cause in codes.HALF_PAIN_CAUSES]
        rows += [(cause, bound, None, None, risk[bound]) for cause, risk in codes.RELATIVE_RISK.items()]
    return literal_table(
        spark,
        "cause_id int, numeric_name string, original_weight double, realloc_weight double, relative_risk double",
        rows,
    )


def allocate(burden: DataFrame, factors: DataFrame) -> DataFrame:
    """Original allocation and 2016 reallocation: number x weight, 0 without one.

    The default factors are literals of known size, which the planner broadcasts.
    """
    joined = burden.join(factors, ["cause_id", "numeric_name"], "left")
    return joined.withColumns(
        {
            "original_value": F.col("number") * zero_if_na("original_weight"),
            "realloc_value": F.col("number") * zero_if_na("realloc_weight"),
        }
    )


def paf_population(p: Column | str, rr: Column | str) -> Column:
    """Attributable fraction when prevalence is that of the population."""
    excess = _excess(p, rr)
    return ratio(excess, excess + 1.0)


def paf_cases(p: Column | str, rr: Column | str) -> Column:
    """Attributable fraction when prevalence is that among cases."""
    p, rr = (F.col(c) if isinstance(c, str) else c for c in (p, rr))
    return p * ratio(rr - 1.0, rr)


def _excess(p, rr) -> Column:
    p, rr = (F.col(c) if isinstance(c, str) else c for c in (p, rr))
    return p * (rr - 1.0)


PAF_EXPRESSIONS = {codes.PAF_POPULATION: paf_population, codes.PAF_CASES: paf_cases}


def attribute(allocated: DataFrame, prevalence: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Attributable burden under both formulas: number x PAF, 0 without a PAF."""
    joined = allocated.join(prevalence, ["location_id", *slices, "numeric_name"], "left")
    for formula, paf in PAF_EXPRESSIONS.items():
        joined = joined.withColumn(formula, zero_if_na(paf("prevalence", "relative_risk")))
        joined = joined.withColumn(f"{formula}_value", F.col("number") * F.col(formula))
    return joined


def paf_long(attributed: DataFrame) -> DataFrame:
    """One row per formula, as (paf_formula, paf, paf_value)."""
    names = {f for f in codes.FORMULAS} | {f"{f}_value" for f in codes.FORMULAS}
    ids = [c for c in attributed.columns if c not in names]
    rows = [
        {"paf_formula": F.lit(f), "paf": F.col(f), "paf_value": F.col(f"{f}_value")} for f in codes.FORMULAS
    ]
    return inline_rows(attributed, ids, rows)


def cause_totals(attributed: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Attributed values summed over causes, beside the all-cause total.

    A place and measure without an all-cause row has no denominator and
    vanishes.
    """
    keys = ["location_id", "location_name", "measure_id", "measure_name", *slices, "numeric_name"]
    all_causes = F.col("cause_id") == codes.ALL_CAUSES

    def of_all_causes(name: str) -> Column:
        return F.expr(f"max(CASE WHEN cause_id = {codes.ALL_CAUSES} THEN `{name}` END)")

    sums = {
        "original_agg": "original_value",
        "realloc_agg": "realloc_value",
        **{f"{f}_agg": f"{f}_value" for f in codes.FORMULAS},
    }
    return (
        attributed.groupBy(*keys)
        .agg(
            *[na_sum(v).alias(k) for k, v in sums.items()],
            of_all_causes("number").alias("measure_total"),
            of_all_causes("population_100k").alias("population_100k"),
            of_all_causes("population").alias("population"),
            of_all_causes("prevalence").alias("prevalence"),
            F.count_if(all_causes).alias("__all"),
        )
        .filter(F.col("__all") > 0)
        .drop("__all")
    )


def composite(
    totals: DataFrame, formulas: Sequence[str] = (codes.PAF_POPULATION,), slices: Sequence[str] = codes.SLICES
) -> DataFrame:
    """Composite burden per formula.

    YLDs come from the reallocation, YLLs and deaths from the attributable
    fractions, and DALYs are the sum of those YLDs and YLLs.
    """
    aggs = [f"{f}_agg" for f in codes.FORMULAS]
    ids = [c for c in totals.columns if c not in aggs]
    rows = [{"paf_formula": F.lit(f), "paf_agg": F.col(f"{f}_agg")} for f in formulas]
    long = inline_rows(totals, ids, rows)
    measure = F.col("measure_id")
    ylds = if_else(measure == codes.YLDS, F.col("realloc_agg"), F.lit(0.0))
    ylls = if_else(measure == codes.YLLS, F.col("paf_agg"), F.lit(0.0))
    # At most one row per measure and formula, so the partitions are tiny.
    group = Window.partitionBy("location_id", *slices, "numeric_name", "paf_formula")
    complete = (F.count(F.lit(1)).over(group) == F.count(ylds).over(group)) & (
        F.count(F.lit(1)).over(group) == F.count(ylls).over(group)
    )
    dalys = F.when(complete, F.sum(ylds).over(group) + F.sum(ylls).over(group))
    return long.withColumn("composite_dalys", dalys).withColumn(
        "composite",
        F.when(measure == codes.DALYS, F.col("composite_dalys"))
        .when(measure == codes.YLDS, F.col("realloc_agg"))
        .when(measure.isin(codes.YLLS, codes.DEATHS), F.col("paf_agg")),
    )


def estimates(combined: DataFrame) -> DataFrame:
    """Four estimates as rows, with number, rate per 100,000 and percent."""
    sources = {
        codes.GBD: "original_agg",
        codes.REALLOCATION: "realloc_agg",
        codes.PAF: "paf_agg",
        codes.COMPOSITE: "composite",
    }
    ids = [c for c in combined.columns if c not in {*sources.values(), "composite_dalys"}]
    rows = [
        {"estimate": F.lit(codes.ESTIMATES[i]), "number": F.col(c)} for i, c in sources.items()
    ]
    long = inline_rows(combined, ids, rows)
    ids_by_label = {label: i for i, label in codes.ESTIMATES.items()}
    return long.withColumns(
        {
            "estimate_id": lookup("estimate", ids_by_label),
            "rate_per_100k": ratio("number", "population_100k"),
            "percent": ratio("number", "measure_total") * 100.0,
        }
    )


def group_totals(df: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Keep every row and add NULL-propagating sums over its group, in one pass.

    For groups that are small by nature, such as the causes of one place, measure,
    bound and slice.
    """
    group = Window.partitionBy(*keys)
    return df.withColumns(
        {n: F.when(F.count(c).over(group) == F.count(F.lit(1)).over(group), F.sum(c).over(group)) for n, c in sums.items()}
    )
