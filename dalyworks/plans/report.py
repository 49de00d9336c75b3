"""All outputs of the analysis from one valued country table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..operators import charts, compare, dimensions, rollup
from ..runtime import stage
from ..sources import sinks
from . import burden, headlines, tables
from .burden import Inputs


@dataclass(frozen=True)
class Report:
    """The tables of one report; all of them come from ``country``."""

    country: DataFrame
    table1: DataFrame
    table2: DataFrame
    appendix: DataFrame
    headlines: DataFrame
    charts: dict[str, DataFrame]


def report(inputs: Inputs, number_unit: float = tables.MILLION, cost_unit: float = tables.TRILLION) -> Report:
    """The burden is attributed and valued once; every output starts from that table."""
    country = stage(burden.valued(inputs), "country")
    places = dimensions.region_full_join(country, inputs.region)
    levels = stage(rollup.level_rollup(places), "levels")
    results = compare.diff_from_baseline(rollup.region_rollup(places), burden.REGION_KEYS)
    results = stage(results, "regions")
    national = dimensions.map_join(inputs.boundary, compare.diff_from_baseline(country, burden.NATIONAL_KEYS))
    on_map = dimensions.map_join(inputs.boundary, places)
    return Report(
        country=country,
        table1=tables.table1(levels, number_unit),
        table2=tables.table2(levels, cost_unit),
        appendix=tables.table_appendix(country.filter(F.col("location_id") == codes.WORLD_LOCATION), cost_unit),
        headlines=headlines.headline_metrics(levels, number_unit, cost_unit),
        charts={
            "national_choropleth": charts.national_choropleth(national),
            "national_pct_gdp": charts.pct_gdp(national),
            "region_choropleth": charts.region_choropleth(on_map, results),
            "region_pct_gdp": charts.region_pct_gdp(on_map, results),
            "region_bars": charts.region_bars(results),
            "region_bars_gdp": charts.region_bars_gdp(results),
            **{f"bins_{m}": charts.binned_rates(results, m) for m in codes.RATE_BREAKS},
            "extreme_regions": charts.extreme_regions(results),
        },
    )


def write(made: Report, path: str) -> None:
    """Tables 1 and 2 and the appendix as CSV by slice, headlines and chart tables as Parquet."""
    slices = list(codes.SLICES)
    sinks.write_indexed_csv(made.table1, tables.TABLE1_ORDER, f"{path}/table1", ["measure_name", "location_name", *tables.TABLE1_COLUMNS], slices)
    sinks.write_indexed_csv(made.table2, tables.TABLE2_ORDER, f"{path}/table2", ["name", "location_name", *tables.TABLE2_COLUMNS], slices)
    columns = [str(i) for i in range(1, len(tables.TABLE2_COLUMNS) + 1)]
    sinks.write_named_csv(made.appendix, "field", "row_order", columns, f"{path}/table_appendix", slices)
    made.headlines.write.mode("overwrite").parquet(f"{path}/headlines")
    for name, chart in made.charts.items():
        chart.write.mode("overwrite").parquet(f"{path}/charts/{name}")
