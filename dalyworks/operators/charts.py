"""Chart-ready datasets.

Where a plotting script would loop over metrics, comparisons and measures, one
long table carries all of them as columns (metric, comparison, measure).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import codes
from ..functions.binning import bin_index, break_label
from ..functions.joins import null_safe_join
from ..functions.nulls import clamp, ratio
from ..functions.reshape import inline_rows, lookup, position

RATE_METRICS = ("rate_per_100k", "percent")
COMPARISONS = {"abs": "", "diff": "_diff"}
POINT_KEYS = ("measure_id", "estimate_id")


def _metric_rows(
    df: DataFrame, ids: Sequence[str], metrics: Sequence[str], scale: Column | None = None
) -> DataFrame:
    """Levels for three estimates and differences for the two that have one."""
    rows = []
    for metric in metrics:
        for comparison, suffix in COMPARISONS.items():
            plotted = F.col(f"{metric}{suffix}")
            rows.append(
                {
                    "metric": F.lit(metric),
                    "comparison": F.lit(comparison),
                    "value": plotted if scale is None else ratio(plotted, scale) * 100.0,
                }
            )
    chosen = df.filter(F.col("estimate_id").isin(*codes.SHOWN_ESTIMATES))
    long = inline_rows(chosen, ids, rows)
    return long.filter((F.col("comparison") == "abs") | (F.col("estimate_id") != codes.GBD))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("estimate_label", lookup("estimate_id", codes.ESTIMATE_LABELS))


def _points(df: DataFrame) -> DataFrame:
    return df.filter(F.col("numeric_name") == "val")


def national_choropleth(mapped: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Rates and percents per place; ``mapped`` is a map-joined diff table."""
    ids = ["iso_code", "location_id", "on_map", *POINT_KEYS, *slices]
    return _labelled(_metric_rows(mapped, ids, RATE_METRICS))


def pct_gdp(mapped: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Costs as percent of GDP per place, raw and limited to the colour scale."""
    dalys = mapped.filter(F.col("measure_id") == codes.DALYS)
    ids = ["iso_code", "location_id", "on_map", *POINT_KEYS, *slices]
    long = _metric_rows(dalys, ids, codes.CHART_COSTS, F.col("gdp"))
    return _labelled(long.withColumn("clamped", clamp("value", *codes.PCT_GDP_LIMITS)))


REGION_IDS = ("scheme", "region")
MAP_IDS = ("iso_code", "gu_a3", "on_map", "location_id")


def _placed(mapped: DataFrame, results: DataFrame, slices: Sequence[str]) -> DataFrame:
    """Map rows with the results of their region, once per scheme.

    ``mapped`` is a map-joined country table with region names: only places with
    burden are on it, and those without a region share one group. ``results`` are
    the regions' rows, few enough to be sent to the map rows.
    """
    keys = [*REGION_IDS, *POINT_KEYS, "paf_formula", *slices]
    belongs = [F.struct(F.lit(s).alias("scheme"), F.col(s).alias("region")) for s in codes.SCHEMES]
    places = mapped.select(*MAP_IDS, *POINT_KEYS, "paf_formula", *slices, F.inline(F.array(*belongs)))
    return null_safe_join(places, _points(results), keys, "inner")


def region_choropleth(mapped: DataFrame, results: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Regional rates and percents as fill values of the places on the map."""
    ids = [*REGION_IDS, *MAP_IDS, *POINT_KEYS, *slices]
    return _labelled(_metric_rows(_placed(mapped, results, slices), ids, RATE_METRICS))


def region_pct_gdp(mapped: DataFrame, results: DataFrame, slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Regional costs as percent of regional GDP, raw and limited."""
    dalys = mapped.filter(F.col("measure_id") == codes.DALYS)
    ids = [*REGION_IDS, *MAP_IDS, *POINT_KEYS, *slices]
    long = _metric_rows(_placed(dalys, results, slices), ids, codes.CHART_COSTS, F.col("gdp"))
    return _labelled(long.withColumn("clamped", clamp("value", *codes.PCT_GDP_LIMITS)))


def _bars(rolled, metrics, order, slices, scale=None) -> DataFrame:
    named = _points(rolled).filter(F.col("region").isNotNull())
    long = _metric_rows(named, [*REGION_IDS, *POINT_KEYS, *slices], metrics, scale)
    rank = F.coalesce(
        *[F.when(F.col("scheme") == scheme, position("region", places)) for scheme, places in order.items()]
    )
    return _labelled(long.withColumns({"region_rank": rank, "label": F.bround("value", 1)}))


def region_bars(
    rolled: DataFrame,
    order: Mapping[str, Sequence[str]] = codes.REGION_ORDER,
    slices: Sequence[str] = codes.SLICES,
) -> DataFrame:
    """Percent of burden per region, in display order, with a 1-decimal label."""
    return _bars(rolled, ("percent",), order, slices)


def region_bars_gdp(
    rolled: DataFrame,
    order: Mapping[str, Sequence[str]] = codes.REGION_ORDER,
    slices: Sequence[str] = codes.SLICES,
) -> DataFrame:
    """Cost as percent of GDP per region; not limited."""
    dalys = rolled.filter(F.col("measure_id") == codes.DALYS)
    return _bars(dalys, codes.CHART_COSTS, order, slices, F.col("gdp"))


def binned_rates(
    rolled: DataFrame, measure: int, scheme: str = "ihme_region", slices: Sequence[str] = codes.SLICES
) -> DataFrame:
    """Regional rates in the bins of the map legend.

    The largest rate among the regions shown closes the last bin. Places
    without a region and regions without a rate do not take part in it.
    """
    fixed = codes.RATE_BREAKS[measure]
    rates = (
        _points(rolled)
        .filter((F.col("measure_id") == measure) & (F.col("scheme") == scheme) & F.col("region").isNotNull())
        .filter(F.col("estimate_id").isin(*codes.SHOWN_ESTIMATES))
        .select(
            "region",
            *POINT_KEYS,
            *slices,
            (F.col("rate_per_100k") / codes.RATE_SCALE[measure]).alias("rate"),
        )
    )
    # One row per region and estimate, so a window over all of them is small.
    largest = F.max("rate").over(Window.partitionBy(*slices))
    breaks = F.array_sort(F.array(*[F.lit(float(b)) for b in fixed], F.col("largest")))
    texts = F.array(*[F.lit(f"{b:g}") for b in fixed])
    edges = F.array(*[F.lit(float(b)) for b in fixed])
    labels = F.transform(
        F.col("breaks"), lambda b: F.coalesce(F.get(texts, F.array_position(edges, b).cast("int") - 1), "top_label")
    )
    binned = (
        rates.withColumn("largest", largest)
        .withColumns({"breaks": breaks, "top_label": break_label(F.col("largest"), fixed)})
        .withColumn("bin", bin_index(F.col("rate"), F.col("breaks")))
        .withColumn("labels", labels)
    )
    edge = {"bin_low": F.col("bin"), "bin_high": F.col("bin") + 1}
    binned = binned.withColumns({n: F.get("breaks", i - 1) for n, i in edge.items()})
    text = F.concat(
        F.lit("("), F.get("labels", F.col("bin") - 1), F.lit(","), F.get("labels", F.col("bin")), F.lit("]")
    )
    return _labelled(binned.withColumn("bin_label", text).drop("breaks", "labels", "top_label", "largest"))


def extreme_regions(rolled: DataFrame, scheme: str = "ihme_region", slices: Sequence[str] = codes.SLICES) -> DataFrame:
    """Regions with the highest and lowest cost as percent of GDP; ties stay.

    Regions without a name or a value are left out first.
    """
    values = (
        _points(rolled)
        .filter((F.col("measure_id") == codes.DALYS) & (F.col("estimate_id") == codes.COMPOSITE))
        .filter(F.col("scheme") == scheme)
        .select(
            "region",
            *slices,
            (ratio("cost_who1", "gdp") * 100.0).alias("regional_percent"),
        )
        .filter(F.col("region").isNotNull() & F.col("regional_percent").isNotNull())
    )
    # One row per region, so a window over all of them is small.
    everywhere = Window.partitionBy(*slices)
    ends = {
        "highest": F.max("regional_percent").over(everywhere),
        "lowest": F.min("regional_percent").over(everywhere),
    }
    kinds = F.array_compact(
        F.array(
            F.when(F.col("regional_percent") == F.col("highest"), F.lit("max")),
            F.when(F.col("regional_percent") == F.col("lowest"), F.lit("min")),
        )
    )
    return values.withColumns(ends).select(
        "region", *slices, "regional_percent", F.explode(kinds).alias("extreme")
    )
