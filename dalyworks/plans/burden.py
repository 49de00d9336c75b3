"""From the inputs to the valued, region-labelled country table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import codes
from ..operators import attribution, compare, dimensions, rollup, valuation
from ..runtime import stage
from ..sources import readers

REGION_KEYS = ("scheme", "region", "measure_id", "numeric_name", "paf_formula", *codes.SLICES)
NATIONAL_KEYS = ("location_id", "measure_id", "numeric_name", "paf_formula", *codes.SLICES)


@dataclass(frozen=True)
class Inputs:
    """The input tables of one analysis."""

    gbd: DataFrame
    gbd_prev: DataFrame
    crosswalk: DataFrame
    income: DataFrame
    gdp: DataFrame
    gdp_ppp: DataFrame
    region: DataFrame
    boundary: DataFrame


def attributed(inputs: Inputs) -> DataFrame:
    """Per place, measure, cause and bound: numbers and attributed values."""
    spark = inputs.gbd.sparkSession
    burden = attribution.population(inputs.gbd)
    allocated = attribution.allocate(burden, attribution.factor_table(spark))
    return attribution.attribute(allocated, readers.prevalence(inputs.gbd_prev))


def totals(inputs: Inputs) -> DataFrame:
    return attribution.cause_totals(attributed(inputs))


def estimates(inputs: Inputs, formula: str = codes.PAF_POPULATION) -> DataFrame:
    """Four estimates with rates and percents.

    The formula is chosen before its values become rows, so the alternative is
    never expanded.
    """
    combined = attribution.composite(totals(inputs), (formula,))
    return attribution.estimates(combined)


def located(inputs: Inputs, formula: str = codes.PAF_POPULATION) -> DataFrame:
    """Estimates with iso code and income level."""
    return dimensions.enrich(estimates(inputs, formula), inputs.crosswalk, inputs.income)


def valued(inputs: Inputs, formula: str = codes.PAF_POPULATION) -> DataFrame:
    """Located estimates with GDP and the six costs."""
    money = valuation.with_gdp(located(inputs, formula), inputs.gdp, inputs.gdp_ppp)
    return valuation.value(money)


def national_diff(inputs: Inputs) -> DataFrame:
    return compare.diff_from_baseline(valued(inputs), NATIONAL_KEYS)


def regional(inputs: Inputs) -> DataFrame:
    """Valued country rows with their regions; region-only places included.

    The country table is staged: it is read for its rows and for its codes.
    """
    return dimensions.region_full_join(stage(valued(inputs), "valued"), inputs.region)


def region_results(inputs: Inputs, schemes: Sequence[str] = codes.SCHEMES) -> DataFrame:
    return rollup.region_rollup(regional(inputs), schemes)


def region_diff(inputs: Inputs, schemes: Sequence[str] = codes.SCHEMES) -> DataFrame:
    """Regional results and their differences from the baseline estimate."""
    return compare.diff_from_baseline(region_results(inputs, schemes), REGION_KEYS)


def levels(inputs: Inputs) -> DataFrame:
    """World, income-group and region results, as the value tables report them."""
    return rollup.level_rollup(regional(inputs))


def burden_levels(inputs: Inputs) -> DataFrame:
    """The same levels without money: no GDP source is read."""
    regions = dimensions.region_full_join(stage(located(inputs), "located"), inputs.region)
    return rollup.level_rollup(regions, costs=False)
