"""Attribution steps on hand-made extracts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dalyworks import codes
from dalyworks.operators import attribution as at
from dalyworks.sources.schemas import GBD


def record(measure, cause, metric, val, location=5, sex=3, year=2019, upper=None, lower=None):
    return (
        measure, codes.MEASURE_NAMES[measure], location, f"place {location}", sex, "s", 22, "All ages", cause,
        f"cause {cause}", metric, codes.METRIC_NAMES[metric], year, val,
        val * 1.5 if upper is None and val is not None else upper,
        val / 2 if lower is None and val is not None else lower,
    )


def extract(spark, records):
    return spark.createDataFrame(records, GBD)


def both(measure, cause, number, **kw):
    """Number and rate rows of a place with 2 million people."""
    return [record(measure, cause, 1, number, **kw), record(measure, cause, 3, number / 20, **kw)]


@pytest.fixture(scope="module")
def burden(spark):
    records = []
    for measure in (codes.DEATHS, codes.DALYS, codes.YLDS, codes.YLLS, codes.PREVALENCE):
        for cause, number in ((294, 1000.0), (558, 100.0), (630, 60.0), (639, 60.0), (409, 600.0), (687, 90.0), (1, 5.0)):
            records += both(measure, cause, number * measure)
    return extract(spark, records + records[:4])


@pytest.fixture(scope="module")
def prevalence(spark):
    values = [(5, 3, 22, 2019, b, p) for b, p in (("val", 0.1304), ("upper", 0.14), ("lower", 0.12))]
    return spark.createDataFrame(
        values, "location_id int, sex_id int, age_id int, year int, numeric_name string, prevalence double"
    )


@pytest.fixture(scope="module")
def totals(spark, burden, prevalence):
    allocated = at.allocate(at.population(burden), at.factor_table(spark))
    return at.cause_totals(at.attribute(allocated, prevalence))


def pick(df, measure, bound="val", **where):
    df = df.filter((F.col("measure_id") == measure) & (F.col("numeric_name") == bound))
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    (row,) = df.collect()
    return row


def test_population_is_backed_out_once_per_bound(burden):
    people = at.population(burden)
    assert people.count() == 4 * 7 * 3
    assert people.filter(F.abs(F.col("population") - 2e6) > 1e-3).count() == 0


def test_conflicting_rows_fail_instead_of_being_picked(spark):
    clash = extract(spark, [record(1, 294, 1, 10.0), record(1, 294, 1, 11.0)])
    with pytest.raises(PySparkException, match="conflicting rows"):
        at.population(clash).collect()


def test_missing_rate_and_number(spark):
    df = extract(spark, [record(1, 294, 1, 10.0), record(1, 558, 3, 10.0), record(1, 409, 1, 0.0), record(1, 409, 3, 0.0)])
    out = {(r.cause_id, r.numeric_name): r.population_100k for r in at.population(df).collect()}
    assert set(c for c, _ in out) == {294, 409}
    assert set(out.values()) == {None}


def test_weights_depend_on_the_bound(totals):
    assert pick(totals, 2).realloc_agg == pytest.approx(200 + 120 * 2 / 6 + 120 * 1 / 6)
    assert pick(totals, 2, "upper").realloc_agg == pytest.approx(1.5 * (200 + 120 * 3 / 6 + 120 * 3 / 12))
    assert pick(totals, 2, "lower").realloc_agg == pytest.approx(0.5 * (200 + 120 * 1 / 6 + 120 * 1 / 12))
    assert pick(totals, 2).original_agg == 200.0
    assert pick(totals, 2).measure_total == 2000.0


@pytest.mark.parametrize(
    "rr, population, cases", [(1.8, 0.094465, 0.057956), (7.22, 0.447846, 0.112339), (2.22, 0.137253, 0.071661), (1.0, 0.0, 0.0)]
)
def test_attributable_fractions(spark, rr, population, cases):
    one = spark.createDataFrame([(0.1304, rr)], "p double, rr double")
    row = one.select(at.paf_population("p", "rr"), at.paf_cases("p", "rr")).first()
    assert row[0] == pytest.approx(population, abs=5e-7)
    assert row[1] == pytest.approx(cases, abs=5e-7)


def test_fractions_stay_between_0_and_1(spark):
    grid = spark.range(101).select((F.col("id") / 100).alias("p")).crossJoin(
        spark.range(1, 50).select((F.col("id") / 2 + 0.5).alias("rr"))
    )
    for paf in (at.paf_population("p", "rr"), at.paf_cases("p", "rr")):
        assert grid.filter(~paf.between(0, 1)).count() == 0


def test_paf_only_for_causes_with_a_risk(totals):
    paf2 = 600 * 0.094465 + 90 * 0.447846
    assert pick(totals, 1).paf2_agg == pytest.approx(paf2, rel=1e-5)


def test_composite(totals):
    out = at.composite(totals, codes.FORMULAS)
    for formula in codes.FORMULAS:
        ylds, ylls, dalys, deaths = (
            pick(out, m, paf_formula=formula) for m in (codes.YLDS, codes.YLLS, codes.DALYS, codes.DEATHS)
        )
        assert ylds.composite == ylds.realloc_agg
        assert ylls.composite == ylls.paf_agg
        assert deaths.composite == deaths.paf_agg
        assert dalys.composite == pytest.approx(ylds.composite + ylls.composite)


def test_estimates(totals):
    out = at.estimates(at.composite(totals))
    row = pick(out, 2, estimate_id=codes.GBD)
    assert (row.estimate, row.number, row.percent) == ("GBD 2019", 200.0, 10.0)
    assert row.rate_per_100k == pytest.approx(10.0)
    assert out.count() == 4 * 3 * 4


def test_place_without_all_causes_vanishes(spark, prevalence):
    df = extract(spark, both(2, 558, 10.0) + both(2, 294, 50.0, location=6) + both(2, 558, 20.0, location=6))
    allocated = at.allocate(at.population(df), at.factor_table(spark))
    out = at.cause_totals(at.attribute(allocated, prevalence))
    assert {r.location_id for r in out.collect()} == {6}


def test_missing_number_makes_the_sum_missing(spark, prevalence):
    df = extract(spark, both(2, 294, 50.0) + both(2, 558, 20.0) + [record(2, 630, 1, None), record(2, 630, 3, None)])
    allocated = at.allocate(at.population(df), at.factor_table(spark))
    row = pick(at.cause_totals(at.attribute(allocated, prevalence)), 2)
    assert row.realloc_agg is None and row.measure_total == 50.0


def test_slices_are_kept_apart(spark, prevalence):
    df = extract(spark, both(2, 294, 50.0) + both(2, 558, 20.0) + both(2, 294, 80.0, year=2018) + both(2, 558, 8.0, year=2018))
    allocated = at.allocate(at.population(df), at.factor_table(spark))
    out = at.cause_totals(at.attribute(allocated, prevalence)).filter("numeric_name = 'val'")
    assert {(r.year, r.original_agg, r.measure_total) for r in out.collect()} == {(2019, 20.0, 50.0), (2018, 8.0, 80.0)}


def test_group_totals_keep_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, None)], "k string, x double")
    out = at.group_totals(df, ["k"], {"total": "x"})
    got = sorted([tuple(r) for r in out.collect()], key=str)
    assert got == sorted([("a", 1.0, 3.0), ("a", 2.0, 3.0), (None, 5.0, None), (None, None, None)], key=str)
