"""Valuation, roll-ups, comparisons, charts, tables and headlines."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dalyworks import codes
from dalyworks.operators import charts, compare, dimensions, evidence, rollup, valuation
from dalyworks.plans import burden, headlines, report, tables
from dalyworks.sources import readers, sinks

VALUED = (
    "location_id int, iso_code string, income_level string, who_region string, ihme_region string,"
    " estimate_id int, estimate string, measure_id int, measure_name string, numeric_name string, paf_formula string,"
    " sex_id int, age_id int, year int, number double, measure_total double, population_100k double,"
    " population double, gdp double, gdp_ppp double"
)
# place, iso, income, regions, number factor, population in 100k, gdp
PLACES = [
    (1, None, None, None, None, 10.0, 100.0, 5e9),
    (2, "AAA", "H", "West", "W-0", 1.0, 10.0, 4e8),
    (3, "BBB", "H", "West", "W-0", 2.0, 20.0, None),
    (4, "CCC", "L", "West", "W-1", 3.0, 30.0, 1e8),
    (5, "DDD", None, "East", None, 4.0, 40.0, 0.0),
]


@pytest.fixture(scope="module")
def valued(spark):
    records = []
    for place, iso, income, who, ihme, factor, people, gdp in PLACES:
        for estimate, label in codes.ESTIMATES.items():
            for measure in (codes.DALYS, codes.YLDS):
                for bound, width in (("val", 1.0), ("lower", 0.5), ("upper", 2.0)):
                    records.append(
                        (place, iso, income, who, ihme, estimate, label, measure, codes.MEASURE_NAMES[measure], bound,
                         "paf2", 3, 22, 2019, factor * 100 * estimate * width, factor * 1000.0, people, people * 1e5,
                         gdp, gdp)
                    )
    df = spark.createDataFrame(records, VALUED)
    ratio = {"gdp_per_capita": F.col("gdp") / F.col("population"), "gdp_ppp_per_capita": F.col("gdp_ppp") / F.col("population")}
    rates = {"rate_per_100k": F.col("number") / F.col("population_100k"), "percent": F.col("number") / F.col("measure_total") * 100}
    return valuation.value(df.withColumns({**ratio, **rates}).withColumn("location_name", F.col("iso_code")))


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k).eqNullSafe(v))
    (row,) = df.collect()
    return row


def test_valuations(valued):
    row = one(valued, location_id=2, estimate_id=1, measure_id=2, numeric_name="val")
    assert row.cost_cc1 == 100 * 1000 and row.cost_cc2 == 5 * row.cost_cc1
    assert row.cost_who1 == pytest.approx(100 * 4e8 / 1e6) and row.cost_who2 == 3 * row.cost_who1
    assert row.cost_who1 / row.gdp * 100 == pytest.approx(row.number / row.population * 100)
    other = one(valued, location_id=2, estimate_id=1, measure_id=3, numeric_name="val")
    assert [other[c] for c in codes.COSTS] == [0.0] * 6
    missing = one(valued, location_id=3, estimate_id=1, measure_id=2, numeric_name="val")
    assert missing.cost_who1 is None and missing.cost_cc1 == 200000


def test_world_takes_the_world_gdp_row(spark):
    df = spark.createDataFrame([(1, None, 100.0), (2, "AAA", 10.0), (3, None, 5.0)], "location_id int, iso_code string, population double")
    gdp = spark.createDataFrame([("AAA", 20.0), ("WLD", 500.0)], "iso_code string, gdp double")
    out = valuation.with_gdp(df, gdp, gdp.withColumnRenamed("gdp", "gdp_ppp"))
    got = {r.location_id: (r.gdp, r.gdp_per_capita) for r in out.collect()}
    assert got == {1: (500.0, 5.0), 2: (20.0, 2.0), 3: (None, None)}


def test_regions_and_income_groups_value_differently(valued):
    rolled = rollup.region_rollup(valued, ["who_region"])
    west = one(rolled, region="West", estimate_id=4, measure_id=2, numeric_name="val")
    assert west.number == 2400 and west.gdp == 5e8 and west.pop100k == 60
    assert west.cost_who1 == pytest.approx(2400 * 5e8 / 6e6)
    income = one(rollup.income_costs(valued), income_level="H", estimate_id=4, numeric_name="val")
    assert income.cost_who1 == pytest.approx(400 * 4e8 / 1e6)
    assert income.cost_cc1 == 1200 * 1000


def test_places_without_a_region_form_a_group(valued):
    rolled = rollup.region_rollup(valued, ["ihme_region"])
    row = one(rolled, region=None, estimate_id=1, measure_id=3, numeric_name="val")
    assert row.number == 1400 and row.cost_who1 == 0.0


def test_one_pass_rolls_up_both_schemes(valued):
    both = rollup.region_rollup(valued)
    single = [rollup.region_rollup(valued, [s]) for s in codes.SCHEMES]
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(both) == key(single[0].unionByName(single[1]))


def test_region_numbers_add_up_to_located_countries(valued):
    rolled = rollup.region_sums(valued, ["who_region"]).filter("region IS NOT NULL")
    countries = valued.filter("who_region IS NOT NULL")
    keys = ["estimate_id", "measure_id", "numeric_name"]
    a = {tuple(r) for r in rolled.groupBy(*keys).agg(F.sum("number")).collect()}
    assert a == {tuple(r) for r in countries.groupBy(*keys).agg(F.sum("number")).collect()}


def test_differences_from_the_baseline(spark, valued):
    keys = ["location_id", "measure_id", "numeric_name", "paf_formula"]
    out = compare.diff_from_baseline(valued, keys)
    row = one(out, location_id=4, estimate_id=4, measure_id=2, numeric_name="upper")
    assert row.number_diff == 3 * 100 * 3 * 2 and row.cost_cc1_diff == row.number_diff * 1000
    orphan = spark.createDataFrame([(None, "X", None)], "estimate_id int, k string, number double")
    assert compare.diff_from_baseline(orphan, ["k"], ["number"]).first().number_diff is None


def test_full_join_keeps_both_sides(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "AAA", 6.0)], "location_id int, iso_code string, number double")
    region = spark.createDataFrame([("AAA", "W", "W-0"), ("ZZZ", "E", "E-0")], "iso_code string, who_region string, ihme_region string")
    got = {(r.location_id, r.iso_code, r.who_region) for r in dimensions.region_full_join(df, region).collect()}
    assert got == {(1, None, None), (2, "AAA", "W"), (None, "ZZZ", "E")}
    members = dimensions.region_members(region, "who_region")
    assert {tuple(r) for r in members.collect()} == {("W", "AAA"), ("E", "ZZZ")}


def test_enrich_ignores_repeated_dimension_rows(spark):
    facts = spark.createDataFrame([(1, 5.0), (2, 6.0)], "location_id int, number double")
    crosswalk = spark.createDataFrame([(1, None), (2, "AAA")], "location_id int, iso_code string")
    income = spark.createDataFrame([("AAA", "H"), (None, None), (None, None)], "iso_code string, income_level string")
    assert dimensions.enrich(facts, crosswalk, income).count() == 2


def test_map_join_keeps_burden_without_a_polygon(spark):
    boundary = readers.repair_iso(spark.createDataFrame([("AAA", "AAA"), ("X05", "SDS"), ("QQQ", "QQQ")], "gu_a3 string, adm0_a3 string"))
    df = spark.createDataFrame([("AAA", "val"), ("SSD", "val"), ("BBB", "val"), ("AAA", "upper")], "iso_code string, numeric_name string")
    got = {(r.iso_code, r.gu_a3, r.on_map) for r in dimensions.map_join(boundary, df).collect()}
    assert got == {("AAA", "AAA", True), ("SSD", "X05", True), ("BBB", None, False)}


def test_extremes_keep_ties_and_skip_missing(spark):
    records = [("ihme_region", r, 2, 4, "val", 3, 22, 2019, c, g) for r, c, g in
               (("a", 8.0, 100.0), ("b", 16.0, 200.0), ("c", 1.0, 100.0), ("d", 5.0, 0.0), (None, 90.0, 100.0))]
    df = spark.createDataFrame(records, "scheme string, region string, measure_id int, estimate_id int, numeric_name string,"
                               " sex_id int, age_id int, year int, cost_who1 double, gdp double")
    got = {(r.region, r.regional_percent, r.extreme) for r in charts.extreme_regions(df).collect()}
    assert got == {("a", 8.0, "max"), ("b", 8.0, "max"), ("c", 1.0, "min")}


def test_chart_rows(valued):
    keys = ["location_id", "measure_id", "numeric_name", "paf_formula"]
    mapped = compare.diff_from_baseline(valued, keys).withColumn("on_map", F.lit(True))
    mapped = mapped.filter("numeric_name = 'val'")
    out = charts.national_choropleth(mapped)
    # 5 places x 2 measures x 2 metrics x (3 levels + 2 differences)
    assert out.count() == 5 * 2 * 2 * 5
    assert one(out, location_id=2, measure_id=2, estimate_id=4, metric="percent", comparison="diff").value == 30.0
    pct = charts.pct_gdp(mapped)
    row = one(pct, location_id=2, estimate_id=4, metric="cost_cc2", comparison="abs")
    assert row.value == pytest.approx(400 * 5000 / 4e8 * 100) and row.clamped == row.value
    assert one(pct, location_id=5, estimate_id=4, metric="cost_cc2", comparison="abs").clamped is None


def test_binned_rates(spark):
    records = [("ihme_region", r, 1, 1, "val", 3, 22, 2019, x) for r, x in
               (("a", 0.0), ("b", 0.5), ("c", 1.0), ("d", 140.0), ("e", 152.4), ("f", None), (None, 999.0))]
    df = spark.createDataFrame(records, "scheme string, region string, measure_id int, estimate_id int, numeric_name string,"
                               " sex_id int, age_id int, year int, rate_per_100k double")
    got = {r.region: r.bin_label for r in charts.binned_rates(df, codes.DEATHS).collect()}
    assert got == {"a": None, "b": "(0,1]", "c": "(0,1]", "d": "(130,140]", "e": "(140,152]", "f": None}


# Published counts per region: mental disorders, maternal and neonatal disorders.
INPUTS = [
    ("South Asia", 58, 270), ("Central Sub-Saharan Africa", 2, 39), ("Central Europe", 224, 430),
    ("Western Europe", 1107, 1181), ("North Africa and Middle East", 118, 347), ("Southern Latin America", 60, 173),
    ("Central Asia", 22, 297), ("Western Sub-Saharan Africa", 15, 283), ("Caribbean", 93, 630),
    ("Australasia", 122, 183), ("Eastern Sub-Saharan Africa", 30, 237), ("Eastern Europe", 116, 287),
    ("Andean Latin America", 39, 122), ("Tropical Latin America", 93, 146), ("High-income Asia Pacific", 147, 265),
    ("Southern Sub-Saharan Africa", 14, 90), ("High-income North America", 292, 265), ("East Asia", 97, 148),
    ("Oceania", 11, 124), ("Central Latin America", 161, 365), ("Southeast Asia", 49, 267),
    ("Other/Duplicates", 214, -85), ("Global", 3084, 6064),
]


def test_evidence_inputs(spark, tmp_path):
    path = tmp_path / "inputs.csv"
    path.write_text("ihme_region,inputs_mental,inputs_maternal,inputs_all,\n" + "".join(f"{r},{m},{n},,\n" for r, m, n in INPUTS))
    inputs = readers.read_inputs(spark, str(path))
    stack = evidence.inputs_stack(inputs)
    assert {r.input: r.input_total for r in stack.collect()} == {"inputs_mental": 2870, "inputs_maternal": 6149}
    first = one(stack, input="inputs_mental", region_rank=1)
    assert (first.ihme_region, first.stack_start, first.stack_end) == ("East Asia", 0, 97)
    shares = evidence.inputs_share(inputs).groupBy("input").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    assert all(r.s == pytest.approx(1.0) and r.n == 21 for r in shares.collect())


# Published table values used as level rows: DALYs in millions, percent, and
# value at one GDP per head in trillions.
WORLD = {1: ((125.3, 4.9, 1.42), (93.0, 4.1, 1.06), (163.2, 5.8, 1.85)),
         2: ((321.2, 12.7, 3.64), (198.6, 8.7, 2.25), (505.2, 18.0, 5.73)),
         4: ((417.7, 16.5, 4.74), (276.7, 12.1, 3.14), (608.4, 21.6, 6.9))}


@pytest.fixture(scope="module")
def levels(spark):
    def row(section, place, rank, estimate, bound, number, percent, who1, gdp=None):
        costs = (number * 1e9, number * 5e9, who1 * 1e12, who1 * 3e12, who1 * 1.5e12, who1 * 4.5e12)
        return (section, place, rank, 2, codes.MEASURE_NAMES[2], bound, estimate, codes.ESTIMATES[estimate], 3, 22, 2019,
                number * 1e6, percent, gdp, *costs)

    records = [
        row(1, "Global", 1, e, b, *values)
        for e, bounds in WORLD.items() for b, values in zip(("val", "lower", "upper"), bounds)
    ]
    records += [row(2, "High income", 1, 4, "val", 81.0, 22.1, 3.72), row(2, "Low income", 4, 4, "val", 32.3, 10.7, 0.1)]
    records += [row(3, p, 1, 4, "val", 1.0, 1.0, w, g * 1e12) for p, w, g in (("Reg B", 0.04, 1.0), ("Reg A", 0.08, 1.0), ("Reg C", 0.08, 1.0))]
    costs = ", ".join(f"{c} double" for c in codes.COSTS)
    return spark.createDataFrame(
        records,
        "section int, place string, place_rank int, measure_id int, measure_name string, numeric_name string, estimate_id int,"
        f" estimate string, sex_id int, age_id int, year int, number double, percent double, gdp double, {costs}",
    )


def test_headlines_follow_from_the_published_tables(levels):
    h = headlines.headline_metrics(levels).first()
    assert (h.dalys_composite_rounded, h.percent_composite_floor, h.dalys_gbd_rounded, h.cost_composite_floor) == (418.0, 16.0, 125.0, 4.7)
    assert (h.highest_share_regions, h.highest_share, h.lowest_share_regions, h.lowest_share) == ("Reg A; Reg C", 8.0, "Reg B", 4.0)
    assert (h.dalys_gbd_floor, h.percent_gbd_rounded, h.percent_realloc_floor, h.dalys_realloc_floor) == (125.0, 5.0, 12.0, 321.0)
    assert (h.dalys_high_income, h.dalys_low_income) == (81.0, 32.0)
    assert h.more_than_threefold and h.income_gradient == "over twice"
    assert (h.added_by_composite, h.cost_over_realloc, h.cost_over_gbd) == (97.0, 1.1, 3.3)
    assert (h.underestimate, h.underestimate_percent, h.over_earlier_projection) == (293.0, 70.0, 1.8)
    assert (h.cost_range_low, h.cost_range_high) == (3.1, 6.9)


def test_table1_layout(levels):
    table = tables.table1(levels)
    assert table.columns[7:] == list(tables.TABLE1_COLUMNS) and len(tables.TABLE1_COLUMNS) == 18
    world = one(table, location_name="Global")
    assert [world[f"{b}_number_Composite method"] for b in ("val", "lower", "upper")] == [417.7, 276.7, 608.4]


def test_table2_and_index(levels):
    table = sinks.with_row_index(tables.table2(levels), tables.TABLE2_ORDER)
    order = [(r.name, r.location_name) for r in table.orderBy("row_index").collect()]
    places = ["Global", "High income", "Low income", "Reg A", "Reg B", "Reg C"]
    assert order == [(c, p) for c in codes.COSTS for p in places]
    cc1 = one(table, name="cost_cc1", location_name="Global")["val_Composite method"]
    assert cc1 == 0.42


def test_appendix_is_transposed_text(levels):
    world = levels.filter("section = 1")
    out = tables.table_appendix(world).orderBy("row_order").drop("row_order", *codes.SLICES)
    assert out.columns == ["field"] + [str(i) for i in range(1, 10)]
    got = [list(r) for r in out.collect()]
    assert got[0][1:] == ["2016 reallocation approach"] * 3 + ["Composite method"] * 3 + ["GBD 2019"] * 3
    assert got[1][1:] == ["val", "lower", "upper"] * 3
    assert got[2] == ["cost_cc1", "0.32", "0.2", "0.51", "0.42", "0.28", "0.61", "0.13", "0.09", "0.16"]


def test_two_years_give_two_tables(levels):
    both = levels.unionByName(levels.withColumns({"year": F.lit(2018), **{c: F.col(c) * 2 for c in ("number", "percent", *codes.COSTS)}}))
    world = {r.year: r["val_number_Composite method"] for r in tables.table1(both).filter("location_name = 'Global'").collect()}
    assert world == {2019: 417.7, 2018: 835.4}
    cost = tables.table2(both).filter("location_name = 'Global' AND name = 'cost_who1'")
    assert {r.year: r["val_Composite method"] for r in cost.collect()} == {2019: 4.74, 2018: 9.48}
    cells = tables.table_appendix(both.filter("section = 1")).filter("field = 'cost_cc1'")
    assert {r.year: r["4"] for r in cells.collect()} == {2019: "0.42", 2018: "0.84"}
    assert {r.year: r.cost_composite for r in headlines.headline_metrics(both).collect()} == {2019: 4.74, 2018: 9.48}
    indexed = sinks.with_row_index(tables.table1(both), tables.TABLE1_ORDER, within=codes.SLICES)
    assert sorted((r.year, r.row_index) for r in indexed.collect()) == [(y, i) for y in (2018, 2019) for i in range(1, 7)]


def test_two_values_for_one_cell_fail(levels):
    twice = levels.unionByName(levels.withColumn("number", F.col("number") + 1e6))
    for made in (tables.table1(twice), headlines.headline_metrics(twice)):
        with pytest.raises(PySparkException, match="two values"):
            made.collect()


def test_indexed_csv(spark, levels, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_indexed_csv(tables.table1(levels), tables.TABLE1_ORDER, path, ["measure_name", "location_name"])
    (part,) = (tmp_path / "table").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == '"",measure_name,location_name'
    assert lines[1] == "1,DALYs (Disability-Adjusted Life Years),Global"
    assert len(lines) == 7


def test_wide_indicators(spark, tmp_path):
    path = tmp_path / "gdp.csv"
    path.write_text("Country,iso_code,1960,2018,2019\nA,AAA,1,2,3.5\nWorld,WLD,5,6,\n")
    out = readers.indicator(readers.read_wide(spark, str(path)), "gdp")
    assert sorted(map(tuple, out.collect())) == [("AAA", 3.5), ("WLD", None)]
    history = spark.createDataFrame([("AAA", "H", "UM")], "iso_code string, X2018 string, X2019 string")
    assert readers.income_levels(history).first() == ("AAA", "UM")


def test_extracts_from_csv(spark, tmp_path):
    path = tmp_path / "gbd.csv"
    path.write_text(
        "measure_id,measure_name,location_id,location_name,sex_id,sex_name,age_id,age_name,cause_id,cause_name,"
        "metric_id,metric_name,year,val,upper,lower\n"
        '5,Prevalence,7,Here,3,Both,22,All ages,558,Mental,2,Percent,2019,0.13,0.14,0.12\n'
        '5,Prevalence,7,Here,3,Both,22,All ages,543,"Dementia, other",2,Percent,2019,0.5,0.5,0.5\n'
    )
    extract = readers.read_gbd(spark, str(path), "csv")
    assert extract.schema["val"].dataType.typeName() == "double"
    got = {(r.location_id, r.numeric_name, r.prevalence) for r in readers.prevalence(extract).collect()}
    assert got == {(7, "val", 0.13), (7, "upper", 0.14), (7, "lower", 0.12)}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "crosswalk.csv"
    path.write_text('location_name,extra,iso_code,location_id\n"Cote ""d\'Ivoire""",1,CIV,5\nNowhere,NA,NA,6\n')
    got = sorted(map(tuple, readers.read_crosswalk(spark, str(path), "csv").collect()))
    assert got == [(5, "CIV", 'Cote "d\'Ivoire"'), (6, None, "Nowhere")]
    with pytest.raises(ValueError, match="no column who_region"):
        readers.read_region(spark, str(path), "csv")
    path.write_text("location_id,iso_code,location_name\nfive,CIV,x\n")
    with pytest.raises(PySparkException):
        readers.read_crosswalk(spark, str(path), "csv").collect()


def test_missing_and_malformed_indicators(spark, tmp_path):
    path = tmp_path / "gdp.csv"
    path.write_text("iso_code,2019\nAAA,3.5\nBBB,NA\nCCC,\n")
    wide = readers.read_wide(spark, str(path))
    assert sorted(map(tuple, readers.indicator(wide, "gdp").collect())) == [("AAA", 3.5), ("BBB", None), ("CCC", None)]
    path.write_text("iso_code,2019\nAAA,lots\n")
    with pytest.raises(PySparkException):
        readers.indicator(readers.read_wide(spark, str(path)), "gdp").collect()


def test_map_fills_are_those_of_places_with_burden(spark, valued):
    region = valued.select("iso_code", "who_region", "ihme_region").distinct().filter("iso_code IS NOT NULL")
    region = region.unionByName(spark.createDataFrame([("ZZZ", "West", "W-0")], region.schema))
    places = dimensions.region_full_join(valued.drop("who_region", "ihme_region"), region)
    keys = ["scheme", "region", "measure_id", "numeric_name", "paf_formula", *codes.SLICES]
    results = compare.diff_from_baseline(rollup.region_rollup(places), keys)
    boundary = readers.repair_iso(spark.createDataFrame([("AAA", "AAA"), ("ZZZ", "ZZZ")], "gu_a3 string, adm0_a3 string"))
    fills = charts.region_choropleth(dimensions.map_join(boundary, places), results)
    shown = {(r.scheme, r.region, r.iso_code, r.on_map) for r in fills.collect()}
    assert not any(iso == "ZZZ" for _, _, iso, _ in shown)
    assert ("who_region", "West", "AAA", True) in shown and ("who_region", None, None, False) in shown
    assert ("ihme_region", None, "DDD", False) in shown
    value = one(fills, scheme="who_region", iso_code="AAA", measure_id=2, estimate_id=4, metric="percent", comparison="diff").value
    assert value == pytest.approx(30.0)


def test_from_csv_files_to_table1(spark, tmp_path):
    """The inputs as they come, two years in one extract."""
    names = readers.schemas.GBD.names
    lines, prevalence = [",".join(names)], [",".join(names)]

    def row(measure, place, cause, metric, year, val):
        cells = {
            "measure_id": measure, "measure_name": codes.MEASURE_NAMES[measure], "location_id": place, "location_name": f'"P, {place}"',
            "sex_id": 3, "sex_name": "Both", "age_id": 22, "age_name": "All ages", "cause_id": cause, "cause_name": f"c{cause}",
            "metric_id": metric, "metric_name": codes.METRIC_NAMES[metric], "year": year, "val": val, "upper": val * 1.5, "lower": val / 2,
        }
        return ",".join(str(cells[n]) for n in names)

    for year in (2018, 2019):
        for place, people in ((1, 200.0), (5, 20.0)):
            for measure in (codes.DEATHS, codes.DALYS, codes.YLDS, codes.YLLS):
                for cause, share in ((294, 1.0), (558, 0.05), (409, 0.6), (687, 0.1)):
                    number = share * people * 1e6 * (year - 2017)
                    lines += [row(measure, place, cause, 1, year, number), row(measure, place, cause, 3, year, number / people)]
            prevalence.append(row(5, place, 558, 2, year, 0.13))
    files = {
        "gbd": "\n".join([*lines, lines[1]]), "prev": "\n".join(prevalence), "crosswalk": "iso_code,location_name,location_id\nNA,Global,1\nAAA,A,5",
        "income": "iso_code,2018,2019\nAAA,H,L", "gdp": "iso_code,2019\nAAA,NA\nWLD,1000", "region": "ihme_region,who_region,iso_code\nR-0,R,AAA\nQ-0,Q,ZZZ",
        "boundary": "gu_a3,adm0_a3\nAAA,AAA",
    }
    at = {}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text + "\n")
        at[name] = str(tmp_path / f"{name}.csv")
    inputs = burden.Inputs(
        gbd=readers.read_gbd(spark, at["gbd"], "csv"), gbd_prev=readers.read_gbd(spark, at["prev"], "csv"),
        crosswalk=readers.read_crosswalk(spark, at["crosswalk"], "csv"), income=readers.income_levels(readers.read_wide(spark, at["income"])),
        gdp=readers.indicator(readers.read_wide(spark, at["gdp"]), "gdp"), gdp_ppp=readers.indicator(readers.read_wide(spark, at["gdp"]), "gdp_ppp"),
        region=readers.read_region(spark, at["region"], "csv"), boundary=readers.repair_iso(readers.read_boundary(spark, at["boundary"], "csv")),
    )
    table = tables.table1(burden.burden_levels(inputs))
    assert {(r.year, r.location_name) for r in table.collect()} == {(y, p) for y in (2018, 2019) for p in ("Global", "Low income", "R-0")}
    dalys = {r.year: r for r in table.filter("location_name = 'Global' AND measure_name LIKE 'DALY%'").collect()}
    assert [dalys[y]["val_number_GBD 2019"] for y in (2018, 2019)] == [10.0, 20.0]
    assert dalys[2019]["val_percent_GBD 2019"] == 5.0
    paf = sum(s * 0.13 * (rr - 1) / (0.13 * (rr - 1) + 1) for s, rr in ((0.6, 1.8), (0.1, 7.22)))
    assert dalys[2018]["val_percent_Composite method"] == round((0.05 + paf) * 100, 1)
    whole = report.report(inputs, 1e6, 1e3)
    assert whole.table2.filter("location_name = 'Global' AND name = 'cost_who1' AND year = 2019").count() == 1
    report.write(whole, str(tmp_path / "out"))
    stored = spark.read.option("header", True).csv(str(tmp_path / "out" / "table1"))
    assert stored.count() == table.count() and stored.columns[0] == "_c0"
