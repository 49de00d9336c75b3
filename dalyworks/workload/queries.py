"""One query per operator key, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codes
from ..functions.exact import exact_sum
from ..functions.joins import null_safe_join
from ..functions.nulls import na_rm_sum, na_sum, ratio
from ..functions.reshape import column_range
from ..operators import attribution, charts, compare, dimensions, draws, evidence, rollup, sketches, temporal, valuation
from ..plans import burden, headlines, report, sensitivity, tables
from ..plans.burden import Inputs
from ..runtime import shared_path, stage
from ..sources import readers, workbook
from ..sources.order_tables import OrderTables
from ..sources.sinks import with_row_index

# The driver's tables carry far less burden than the world does, so the report
# tables are made in smaller units; the rounding digits are the published ones.
NUMBER_UNIT = 1e2
COST_UNIT = 1e6
# Slices that vary in the extract; age is one class there.
SLICES = ("sex_id", "year")
WHO_ORDER = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
IHME_ORDER = tuple(f"{r}-{i}" for r in WHO_ORDER for i in (1, 0))

# Output digits per column: enough to tell results apart, few enough not to
# depend on the order in which doubles were added.
DIGITS = {
    "number": 2, "rate": 6, "rate_per_100k": 4, "percent": 6, "population_100k": 8, "population": 3,
    "measure_total": 2, "prevalence": 10, "pop100k": 6, "gdp": 2, "gdp_ppp": 2, "gdp_per_capita": 6,
    "gdp_ppp_per_capita": 6, "original_value": 4, "realloc_value": 4, "paf2": 10, "paf4": 10, "paf": 10,
    "paf_value": 4, "original_agg": 2, "realloc_agg": 2, "paf2_agg": 2, "paf4_agg": 2, "paf_agg": 2,
    "composite": 2, "composite_dalys": 2, "value": 5, "clamped": 5, "est": 6, "share": 10,
    "regional_percent": 6, **{c: 0 for c in codes.COSTS},
}


def rounded(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Round the double columns in double arithmetic, ties to even.

    A first rounding, four digits finer, removes the noise of summation order,
    so that exact halves are seen as such.
    """
    digits = {**DIGITS, **(digits or {})}
    out = []
    for field in df.schema.fields:
        stem = field.name.removesuffix("_diff")
        for scheme in codes.SCHEMES:
            stem = stem.removeprefix(f"{scheme}_")
        if field.dataType.typeName() == "double" and stem in digits:
            fine, scale = (f"{10.0 ** (digits[stem] + more):.1f}D" for more in (4, 0))
            snapped = f"(rint(`{field.name}` * {fine}) / {fine})"
            out.append(f"rint({snapped} * {scale}) / {scale} + 0D AS `{field.name}`")
        else:
            out.append(f"`{field.name}`")
    return df.selectExpr(*out)


class Context:
    """Input tables of one query run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = OrderTables(spark, folder)

    @cached_property
    def gdp(self) -> DataFrame:
        return readers.indicator(self.tables.gdp_wide, "gdp")

    @cached_property
    def gdp_ppp(self) -> DataFrame:
        return readers.indicator(self.tables.gdp_ppp_wide, "gdp_ppp")

    @cached_property
    def inputs(self) -> Inputs:
        t = self.tables
        return Inputs(
            gbd=t.gbd,
            gbd_prev=t.gbd_prev,
            crosswalk=t.crosswalk,
            income=t.income,
            gdp=self.gdp,
            gdp_ppp=self.gdp_ppp,
            region=t.region,
            boundary=readers.repair_iso(t.boundary),
        )


REGISTRY: dict[str, Callable[[Context], DataFrame]] = {}


def query(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    """Register under the function's name; a trailing underscore only keeps
    the name apart from an imported one."""
    REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


# ---- scans and dimensions -------------------------------------------------


@query
def unpivot_bounds(c):
    long = attribution.unpivot_bounds(c.tables.gbd)
    return rounded(long.select("measure_id", "location_id", *SLICES, "cause_id", "metric_id", "numeric_name", "est"))


@query
def enrich_dims(c):
    facts = dimensions.enrich(c.tables.gbd, c.tables.crosswalk, c.tables.income).distinct()
    cols = ["measure_id", "location_id", *SLICES, "location_name", "cause_id", "metric_id", "iso_code", "income_level"]
    return rounded(facts.select(*cols, "val", "upper", "lower"), {"val": 6, "upper": 6, "lower": 6})


@query
def nullsafe_join(c):
    """Without removing repeated dimension rows first, places with a NULL code
    match every NULL row of the income table."""
    located = c.tables.gbd.join(c.tables.crosswalk.select("location_id", "iso_code"), "location_id", "left")
    joined = null_safe_join(located, c.tables.income, "iso_code")
    return joined.groupBy("location_id", "iso_code", "income_level").agg(F.count(F.lit(1)).alias("rows"))


@query
def workbook_dims(c):
    """People by the dimensions of their places, which come from the sheets of one workbook."""
    t, path = c.tables, shared_path(c.spark, "dims") + ".xlsx"
    history = t.income.select("iso_code", F.lit("L").alias("2018"), F.col("income_level").alias("2019"))
    workbook.write_workbook({"crosswalk": t.crosswalk, "history": history, "regions": t.region}, path)
    income = readers.income_levels(readers.read_wide(c.spark, path, "xlsx", sheet=2)).distinct()
    located = readers.read_crosswalk(c.spark, path, "xlsx").join(t.population, "location_id")
    found = null_safe_join(located, income, "iso_code")
    found = null_safe_join(found, readers.read_region(c.spark, path, "xlsx", sheet="regions"), "iso_code")
    return found.select("location_id", "location_name", "iso_code", "sex_id", "income_level", "who_region", "ihme_region", "people")


@query
def iso_repair(c):
    """Every customer's polygon, counted per repaired code."""
    iso = readers.repair_iso(c.tables.boundary)
    people = c.tables.population.join(c.tables.crosswalk.select("location_id", "iso_code"), "location_id")
    return null_safe_join(iso, people.select("iso_code", "sex_id", "people"), "iso_code").select(
        "gu_a3", "adm0_a3", "iso_code", "sex_id", "people"
    )


@query
def scan_gdp(c):
    return rounded(c.gdp)


@query
def world_gdp_override(c):
    people = c.tables.population.withColumnRenamed("people", "population").join(
        c.tables.crosswalk.select("location_id", "iso_code"), "location_id"
    )
    located = valuation.with_gdp(people, c.gdp, c.gdp_ppp)
    return rounded(located.select("location_id", "sex_id", "iso_code", "gdp", "gdp_ppp"))


# ---- attribution ------------------------------------------------------------


@query
def number_rate_join(c):
    facts = attribution.number_rate_join(c.tables.gbd)
    return rounded(facts.select("measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "number", "rate"))


@query
def population(c):
    people = attribution.population(c.tables.gbd)
    cols = ["measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "number", "population_100k", "population"]
    return rounded(people.select(*cols))


def _allocated(c):
    return attribution.allocate(attribution.population(c.tables.gbd), attribution.factor_table(c.spark))


@query
def original_values(c):
    cols = ["measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "number", "original_value"]
    return rounded(_allocated(c).select(*cols))


@query
def realloc_values(c):
    cols = ["measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "number", "realloc_value"]
    return rounded(_allocated(c).select(*cols))


@query
def paf(c):
    cols = ["measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "prevalence", "relative_risk", "paf2", "paf4"]
    return rounded(burden.attributed(c.inputs).select(*cols))


@query
def paf_values(c):
    long = attribution.paf_long(burden.attributed(c.inputs))
    cols = ["measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "paf_formula", "paf", "paf_value"]
    return rounded(long.select(*cols))


@query
def window_totals(c):
    cols = ["measure_id", "location_id", *SLICES, "cause_id", "numeric_name", "realloc_value", "original_value"]
    keys = ["measure_id", "location_id", *SLICES, "numeric_name"]
    sums = {"realloc_agg": "realloc_value", "original_agg": "original_value"}
    return rounded(attribution.group_totals(_allocated(c).select(*cols), keys, sums))


@query
def cause_totals(c):
    return rounded(burden.totals(c.inputs).drop("location_name", "measure_name", "age_id"))


def _composite(c):
    return attribution.composite(burden.totals(c.inputs), codes.FORMULAS)


@query
def composite_dalys(c):
    dalys = _composite(c).filter(F.col("measure_id") == codes.DALYS)
    return rounded(dalys.select("location_id", *SLICES, "numeric_name", "paf_formula", "composite_dalys"))


@query
def composite_estimates(c):
    cols = ["location_id", *SLICES, "measure_id", "numeric_name", "paf_formula", "original_agg", "realloc_agg", "paf_agg"]
    named = _composite(c).select(*cols, "composite", F.lit("Mental disorders").alias("cause_name"))
    return rounded(named)


@query
def estimate_ids(c):
    cols = ["location_id", *SLICES, "measure_id", "numeric_name", "paf_formula", "estimate", "estimate_id", "number"]
    return rounded(burden.estimates(c.inputs).select(*cols))


@query
def burden_rates(c):
    cols = ["location_id", *SLICES, "measure_id", "numeric_name", "estimate_id", "number", "rate_per_100k", "percent"]
    return rounded(burden.estimates(c.inputs).select(*cols))


# ---- valuation --------------------------------------------------------------


@query
def gdp_per_capita(c):
    located = dimensions.enrich(burden.totals(c.inputs), c.tables.crosswalk, c.tables.income)
    money = valuation.with_gdp(located, c.inputs.gdp, c.inputs.gdp_ppp)
    cols = ["location_id", *SLICES, "measure_id", "numeric_name", "gdp", "gdp_per_capita", "gdp_ppp", "gdp_ppp_per_capita"]
    return rounded(money.select(*cols))


def _valuation(c, formula):
    cols = ["location_id", *SLICES, "measure_id", "numeric_name", "paf_formula", "estimate_id", *codes.COSTS]
    return rounded(burden.valued(c.inputs, formula).select(*cols))


@query
def valuation_(c):
    return _valuation(c, codes.PAF_POPULATION)



@query
def valuation_paf4(c):
    return _valuation(c, codes.PAF_CASES)


@query
def diff_national(c):
    compared = burden.national_diff(c.inputs)
    diffs = column_range(compared, f"{codes.METRICS[0]}_diff", f"{codes.METRICS[-1]}_diff")
    cols = ["location_id", *SLICES, "measure_id", "numeric_name", "estimate_id"]
    return rounded(compared.select(*cols, *diffs))


# ---- regions ----------------------------------------------------------------


@query
def region_full_join(c):
    cols = ["iso_code", "location_id", *SLICES, "measure_id", "numeric_name", "estimate_id", *codes.SCHEMES, "number"]
    return rounded(burden.regional(c.inputs).select(*cols))


@query
def region_members(c):
    """Members of every region, for both schemes."""
    parts = [
        dimensions.region_members(c.tables.region, s).select(F.lit(s).alias("scheme"), F.col(s).alias("region"), "members")
        for s in codes.SCHEMES
    ]
    return parts[0].unionByName(parts[1])


REGION_KEYS = (*SLICES, "measure_id", "numeric_name", "estimate_id")


@query
def na_sum_(c):
    """Regional GDP that is NULL when one country's is missing."""
    rows = burden.regional(c.inputs)
    return rounded(rows.groupBy("who_region", *REGION_KEYS).agg(na_sum("gdp").alias("gdp")))



@query
def na_rm_sum_(c):
    """Regional GDP over the countries that have one."""
    rows = burden.regional(c.inputs)
    sums = {"gdp": "gdp", "gdp_ppp": "gdp_ppp"}
    aggs = [na_rm_sum(v).alias(k) for k, v in sums.items()]
    return rounded(rows.groupBy("who_region", *REGION_KEYS).agg(*aggs))



@query
def region_rollup(c):
    """Burden of named regions, rounded for the tables."""
    rows = rollup.shown(burden.regional(c.inputs)).filter(F.col("ihme_region").isNotNull())
    sums = rollup.region_sums(rows, ["ihme_region"])
    percent = F.bround(ratio("number", "measure_total") * 100.0, 1)
    cols = [F.col("region").alias("ihme_region"), *SLICES, "measure_name", "numeric_name", "estimate"]
    return sums.select(*cols, F.bround(F.col("number") / NUMBER_UNIT, 1).alias("number"), percent.alias("percent"))


@query
def region_rates(c):
    rates = rollup.pooled_rates(rollup.region_sums(burden.regional(c.inputs), ["who_region"]))
    cols = [F.col("region").alias("who_region"), *REGION_KEYS, "rate_per_100k", "percent", "gdp_per_capita", "gdp_ppp_per_capita"]
    return rounded(rates.select(*cols))


def _rolled(c, scheme):
    cols = ["number", "measure_total", "gdp", "gdp_ppp", "pop100k", "rate_per_100k", "percent", *codes.COSTS]
    named = rollup.with_scheme_names(burden.region_results(c.inputs, [scheme]), scheme)
    return rounded(named.select(scheme, *REGION_KEYS, *[f"{scheme}_{x}" for x in cols]))


@query
def who_region_rollup(c):
    return _rolled(c, "who_region")


@query
def ihme_region_rollup(c):
    return _rolled(c, "ihme_region")


def _region_diff(c, scheme):
    named = rollup.with_scheme_names(burden.region_diff(c.inputs, [scheme]), scheme)
    return rounded(named.select(scheme, *REGION_KEYS, *[f"{scheme}_{m}_diff" for m in codes.METRICS]))


@query
def who_region_diff(c):
    return _region_diff(c, "who_region")


@query
def ihme_region_diff(c):
    return _region_diff(c, "ihme_region")


@query
def income_burden(c):
    cols = ["income_level", *SLICES, "measure_name", "numeric_name", "estimate", "number", "measure_total", "percent"]
    return rounded(rollup.income_burden(burden.valued(c.inputs)).select(*cols))


@query
def income_ranked(c):
    ranked = rollup.income_rank(rollup.income_burden(burden.valued(c.inputs)))
    cols = [*SLICES, "income_rank", "income_name", "measure_name", "numeric_name", "estimate", "number", "percent"]
    order = ["income_rank", "measure_name", "numeric_name", "estimate"]
    return rounded(with_row_index(ranked.select(*cols), order, within=SLICES))


@query
def income_costs(c):
    costs = rollup.income_rank(rollup.income_costs(burden.valued(c.inputs)))
    return rounded(costs.select("income_level", *SLICES, "income_name", "numeric_name", "estimate", *codes.COSTS))


@query
def cost_long(c):
    long = rollup.cost_long(burden.valued(c.inputs))
    return rounded(long.select("location_id", *SLICES, "numeric_name", "estimate", "name", "value"), {"value": 0})


# ---- charts -------------------------------------------------------------------


@query
def map_join(c):
    joined = dimensions.map_join(c.inputs.boundary, burden.valued(c.inputs))
    cols = ["iso_code", "gu_a3", "adm0_a3", "on_map", "location_id", *SLICES, "measure_id", "estimate_id", "number"]
    return rounded(joined.select(*cols))


def _mapped(c):
    return dimensions.map_join(c.inputs.boundary, burden.national_diff(c.inputs))


@query
def national_choropleth(c):
    return rounded(charts.national_choropleth(_mapped(c)).drop("age_id"))


@query
def pct_gdp_clamped(c):
    return rounded(charts.pct_gdp(_mapped(c)).drop("age_id"))


def _region_map(c):
    """The places on the map, and the results of their regions."""
    places = stage(burden.regional(c.inputs), "places")
    results = compare.diff_from_baseline(rollup.region_rollup(places), burden.REGION_KEYS)
    return dimensions.map_join(c.inputs.boundary, places), results


@query
def region_choropleth(c):
    filled = charts.region_choropleth(*_region_map(c))
    return rounded(filled.drop("age_id"))


@query
def region_pct_gdp(c):
    filled = charts.region_pct_gdp(*_region_map(c))
    return rounded(filled.drop("age_id"))


BAR_ORDER = {"who_region": WHO_ORDER, "ihme_region": IHME_ORDER}


@query
def region_bars(c):
    return rounded(charts.region_bars(burden.region_diff(c.inputs), BAR_ORDER).drop("age_id"))


@query
def region_bars_gdp(c):
    return rounded(charts.region_bars_gdp(burden.region_diff(c.inputs), BAR_ORDER).drop("age_id"))


def _bins(c, measure):
    binned = charts.binned_rates(burden.region_results(c.inputs, ["ihme_region"]), measure)
    return rounded(binned.drop("age_id"), {"rate": 6, "bin_low": 6, "bin_high": 6})


@query
def bins_deaths(c):
    return _bins(c, codes.DEATHS)


@query
def bins_dalys(c):
    return _bins(c, codes.DALYS)


@query
def bins_ylds(c):
    return _bins(c, codes.YLDS)


@query
def bins_ylls(c):
    return _bins(c, codes.YLLS)


@query
def extreme_regions(c):
    rolled = burden.region_results(c.inputs, ["ihme_region"])
    return rounded(charts.extreme_regions(rolled).drop("age_id"))


@query
def inputs_share(c):
    return rounded(evidence.inputs_share(c.tables.inputs))


@query
def inputs_stack(c):
    return evidence.inputs_stack(c.tables.inputs, IHME_ORDER)


# ---- tables ---------------------------------------------------------------------


@query
def table1_long(c):
    return tables.table1_long(burden.burden_levels(c.inputs), NUMBER_UNIT).drop("age_id", "section", "place_rank")


@query
def table1(c):
    return tables.table1(burden.burden_levels(c.inputs), NUMBER_UNIT).drop("age_id", "section", "place_rank")


@query
def table1_indexed(c):
    wide = tables.table1(burden.burden_levels(c.inputs), NUMBER_UNIT)
    return with_row_index(wide, tables.TABLE1_ORDER, within=codes.SLICES).drop("age_id", "section", "place_rank")


@query
def table2_long(c):
    return tables.table2_long(burden.levels(c.inputs), COST_UNIT).drop("age_id", "section", "place_rank")


@query
def table2(c):
    wide = tables.table2(burden.levels(c.inputs), COST_UNIT)
    return with_row_index(wide, tables.TABLE2_ORDER, within=codes.SLICES).drop("age_id", "section", "place_rank")


@query
def table_appendix(c):
    inputs = c.inputs
    world = burden.valued(inputs).filter(F.col("location_id") == codes.WORLD_LOCATION)
    return tables.table_appendix(world, COST_UNIT).drop("age_id", "row_order")


@query
def headline_metrics(c):
    return headlines.headline_metrics(burden.levels(c.inputs), NUMBER_UNIT, COST_UNIT).drop("age_id")


# ---- the report, written and read again -----------------------------------------


def _report(c):
    path = shared_path(c.spark, "report")
    made = report.report(c.inputs, NUMBER_UNIT, COST_UNIT)
    report.write(made, path)
    return made, path


@query
def report_table1(c):
    """Table 1 as a reader of the report finds it: an index, then the columns by name."""
    made, path = _report(c)
    names = ["measure_name", "location_name", *tables.TABLE1_COLUMNS]
    stored = c.spark.read.option("header", True).csv(f"{path}/table1")
    kinds = dict(made.table1.dtypes)
    return stored.select(
        F.col("_c0").cast("int").alias("row_index"), *[F.col(s).cast("int").alias(s) for s in SLICES],
        *[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in names],
    )


@query
def report_appendix(c):
    """The appendix as a reader of the report finds it: row names, then nine columns of text."""
    _, path = _report(c)
    stored = c.spark.read.option("header", True).csv(f"{path}/table_appendix")
    return stored.withColumnRenamed("_c0", "field").drop("age_id").select(
        *[F.col(s).cast("int").alias(s) for s in SLICES], "field", *[F.col(f"`{i}`") for i in range(1, 10)]
    )


# ---- cubes, years and largest places ---------------------------------------------------


def _place_years(c):
    """All-cause DALYs of each place and slice, with the burden's value at the place's GDP where it is known."""
    dalys = c.tables.numbers.filter((F.col("cause_id") == codes.ALL_CAUSES) & (F.col("measure_id") == codes.DALYS) & (F.col("location_id") > 1))
    located = dalys.select("location_id", *SLICES, F.col("val").alias("number")).join(c.tables.crosswalk.select("location_id", "iso_code"), "location_id")
    priced = null_safe_join(located, c.gdp, "iso_code")
    return priced.select("location_id", *SLICES, "number", (F.col("number") * F.col("gdp") / 1e9).alias("priced"))


CUBE_DIGITS = {"number": 2, "priced": 2, "priced_known": 2, "number_change": 2, "number_mean": 2}


@query
def burden_cube(c):
    """Sums over every subset of sex, year and place, by both rules for missing values."""
    return rounded(rollup.cube_sums(_place_years(c), ["location_id", *SLICES], ["number", "priced"], ["priced"]), CUBE_DIGITS)


@query
def yearly_change(c):
    """Change and moving mean by year, place and sex; every fifth year of a place is not known."""
    known = _place_years(c).filter((F.col("location_id") + F.col("year")) % 5 != 0).drop("priced")
    return rounded(compare.yearly_change(known, ["location_id", "sex_id"], "number"), CUBE_DIGITS)


@query
def largest_places(c):
    """The three places of most DALYs in each slice; counts of thousands, so that places tie."""
    coarse = _place_years(c).select(*SLICES, "location_id", F.floor(F.col("number") / 1000).cast("int").alias("thousands"))
    return rollup.top_places(coarse, SLICES, "thousands", 3)


@query
def distinct_customers(c):
    """Customers with orders by place and year: states of months united, beside the exact count."""
    customers = c.tables.table("customer").select("c_custkey", (F.col("c_nationkey") + 2).alias("location_id"))
    orders = c.tables.table("orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    placed = stage(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("location_id", "year", "month", "o_custkey"), "placed")
    keys = ["location_id", "year"]
    months = stage(sketches.distinct_states(placed, [*keys, "month"], "o_custkey"), "members")
    told = sketches.unite_states(months, keys).select(*keys, sketches.distinct_count().alias("told"))
    exact = placed.groupBy(*keys).agg(F.countDistinct("o_custkey").alias("customers"))
    within = F.abs(F.col("told") - F.col("customers")) <= F.greatest(F.lit(1.0), 5 * sketches.distinct_error() * F.col("customers"))
    return exact.join(told, keys).select(*keys, "customers", within.alias("within"))


# ---- joins by time and by interval ----------------------------------------------------


@query
def asof_indicator(c):
    """Each order with its place's latest monthly turnover, known for every third month only."""
    customers = c.tables.table("customer").select("c_custkey", (F.col("c_nationkey") + 2).alias("location_id"))
    orders = c.tables.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    month = F.trunc("day", "month")
    sums = orders.filter((F.month("day") + F.col("location_id")) % 3 == 0).groupBy("location_id", F.add_months(month, 1).alias("known_on"))
    known = sums.agg((exact_sum("o_totalprice")).cast("double").alias("turnover"))
    found = temporal.asof_join(orders.drop("o_totalprice"), known, ["location_id"], "day", "known_on", ["turnover"])
    return rounded(found.select("o_orderkey", "location_id", F.col("day").cast("string").alias("day"), F.col("known_on").cast("string").alias("known_on"), "turnover"), {"turnover": 2})


@query
def interval_overlap(c):
    """For each place's rate the places whose uncertainty interval holds it, in its measure and slice."""
    rates = c.tables.gbd.filter((F.col("cause_id") == codes.ALL_CAUSES) & (F.col("metric_id") == codes.RATE)).dropDuplicates(["measure_id", "location_id", *SLICES])
    rates = stage(rates.select("measure_id", *SLICES, "location_id", "val", "lower", "upper"), "rates")
    keys = ["measure_id", *SLICES]
    held = temporal.interval_join(
        rates.select(*keys, "location_id", F.col("val").alias("rate")), rates.select(*keys, F.col("location_id").alias("other"), "lower", "upper"), keys, "rate", "lower", "upper", 0.01
    )
    return rounded(
        held.groupBy(*keys, "location_id", "rate").agg(F.count(F.lit(1)).alias("holders"), F.min("other").alias("first_holder"), F.max("other").alias("last_holder")), {"rate": 6}
    )


# ---- uncertainty draws: one draw per order ------------------------------------------


def _places(c):
    """Prevalence and deaths of each place and slice, with their bounds."""
    keys = ["location_id", *SLICES]
    prevalence = readers.prevalence(c.tables.gbd_prev).groupBy(*keys)
    prevalence = prevalence.pivot("numeric_name", list(codes.BOUNDS)).agg(F.max("prevalence"))
    deaths = c.tables.numbers.filter(
        (F.col("cause_id") == codes.ALL_CAUSES) & (F.col("measure_id") == codes.DEATHS)
    ).select(*keys, *[F.col(b).alias(f"deaths_{b}") for b in codes.BOUNDS])
    # One row per place and slice. An order whose place lacks one of them stays, without values.
    return stage(prevalence.join(deaths, keys, "full"), "place-parameters")


def _orders(c):
    """Orders as draws, with the prevalence and deaths of their place and slice."""
    return c.tables.order_places.select(
        F.col("o_orderkey").alias("draw_id"), (F.col("nation") + 2).alias("location_id"), *SLICES
    ).join(_places(c), ["location_id", *SLICES], "left")


PREVALENCE = ("val", "lower", "upper")
DEATHS = ("deaths_val", "deaths_lower", "deaths_upper")


def _drawn(c, scenario):
    """Draws of one scenario around the deaths of each order's place."""
    deaths = tuple(F.col(d) for d in DEATHS)
    if scenario == 1:
        made = draws.published_intervals(_orders(c), prevalence=tuple(F.col(p) for p in PREVALENCE), deaths=deaths)
    else:
        made = (draws.risk_grid if scenario == 2 else draws.wide_risk)(_orders(c), deaths=deaths)
    return made.select("draw_id", "location_id", *SLICES, "prevalence", "relative_risk", "deaths")


#: The published number of draws.
PLACE_DRAWS = 1000
SUMMARY_DIGITS = {"smallest": 6, "mean": 6, "sd": 6, "p025": 6, "p500": 6, "p975": 6, "largest": 6, "axis_limit": 8}


@query
def mc_ci(c):
    """Draws around the prevalence and deaths of each place and slice."""
    return rounded(sensitivity.deaths_summary(_drawn(c, 1), ["location_id", *SLICES]), SUMMARY_DIGITS)


@query
def mc_place_range(c):
    """The published number of draws for each place and slice, made from a range and folded at once."""
    keys = ["location_id", *SLICES]
    ids = draws.place_draws(_places(c), keys, PLACE_DRAWS)
    made = draws.published_intervals(ids, prevalence=tuple(F.col(p) for p in PREVALENCE), deaths=tuple(F.col(d) for d in DEATHS))
    long = draws.attributable_deaths(made.select(*keys, "prevalence", "relative_risk", "deaths"))
    moments = {"draws": F.count("deaths_mh"), "mean": F.avg("deaths_mh"), "sd": F.stddev_samp("deaths_mh"), "smallest": F.min("deaths_mh"), "largest": F.max("deaths_mh")}
    return rounded(long.groupBy(*keys, "formula").agg(*[m.alias(n) for n, m in moments.items()]), SUMMARY_DIGITS)


@query
def mc_sketch_runs(c):
    """Quantile states of two runs, stored and merged over runs and slices, beside the exact quantiles."""
    fine, coarse = ["location_id", *SLICES, "formula"], ["location_id", "formula"]
    drawn = stage(draws.attributable_deaths(_drawn(c, 1)).select("draw_id", *fine, "deaths_mh"), "drawn")
    path = shared_path(c.spark, "states")
    for run in (0, 1):
        sketches.add_run(sketches.quantile_states(drawn.filter(F.col("draw_id") % 2 == run), fine, "deaths_mh"), path, str(run))
    merged = sketches.merge_states(sketches.stored_states(c.spark, path), coarse)
    estimates = stage(sketches.state_quantiles(merged, sensitivity.INTERVAL), "estimates")
    fits = sketches.within_rank_error(drawn, estimates, coarse, "deaths_mh", sensitivity.INTERVAL, 2 * sketches.rank_error())
    exact = sensitivity.grouped_quantiles(drawn, coarse, "deaths_mh", sensitivity.INTERVAL)
    found = exact.join(estimates.select(*coarse, "draws"), coarse).join(fits, coarse, "left")
    return rounded(found.select(*coarse, "draws", *sensitivity.INTERVAL, "within"), SUMMARY_DIGITS)


def _long(c, scenario):
    long = draws.attributable_deaths(_drawn(c, scenario))
    digits = {"prevalence": 10, "relative_risk": 10, "deaths": 6, "paf": 10, "deaths_mh": 6}
    return rounded(long.select("draw_id", "formula", "prevalence", "relative_risk", "deaths", "paf", "deaths_mh"), digits)


@query
def mc_paf_long(c):
    return _long(c, 1)


@query
def mc_grid_long(c):
    return _long(c, 2)


@query
def mc_wide_long(c):
    return _long(c, 3)


@query
def mc_uniform(c):
    """Distribution, by place, of the two uniformly drawn parameters."""
    grid = _drawn(c, 2).select("location_id", F.lit("prevalence").alias("variable"), F.col("prevalence").alias("x"))
    wide = _drawn(c, 3).select("location_id", F.lit("relative_risk").alias("variable"), F.col("relative_risk").alias("x"))
    return rounded(sensitivity.summarize(grid.unionByName(wide), ["location_id", "variable"], "x"), {k: 8 for k in SUMMARY_DIGITS})


@query
def mc_rr_grid(c):
    return rounded(sensitivity.deaths_summary(_drawn(c, 2), ["relative_risk"]), SUMMARY_DIGITS)


@query
def mc_walker(c):
    flagged = sensitivity.in_published_band(_drawn(c, 3))
    summary = sensitivity.deaths_summary(flagged, ["in_band"], {"largest": F.max("deaths_mh")})
    return rounded(sensitivity.with_axis_limit(summary), SUMMARY_DIGITS)


def bind(fn: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Context(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(fn) for name, fn in REGISTRY.items()}
