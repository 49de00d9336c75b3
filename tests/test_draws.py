"""Random draws and exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dalyworks import codes
from dalyworks.operators import draws
from dalyworks.operators.quantiles import grouped_quantiles
from dalyworks.plans import sensitivity

PROBS = {"p025": 0.025, "p500": 0.5, "p975": 0.975}


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(20000).withColumnRenamed("id", "draw_id")


def test_draws_do_not_depend_on_partitioning(ids):
    def values(parts):
        return sorted(map(tuple, draws.published_intervals(ids.repartition(parts)).collect()))

    assert values(1) == values(8)


def test_seed_changes_the_draws(ids):
    a, b = (draws.risk_grid(ids, seed=s).filter("draw_id = 7").first() for s in (1, 2))
    assert a.prevalence != b.prevalence


def test_scenarios_follow_their_distributions(ids):
    s1 = draws.published_intervals(ids).agg(
        F.avg("prevalence"), F.stddev("prevalence"), F.avg("relative_risk"), F.avg("deaths"),
        F.corr("prevalence", "relative_risk"), F.corr("prevalence", "deaths"), F.corr("relative_risk", "deaths"),
    ).first()
    assert s1[0] == pytest.approx(0.1304, abs=2e-4)
    assert s1[1] == pytest.approx((0.1402 - 0.1212) / 3.92, rel=0.03)
    assert s1[2] == pytest.approx(2.22, abs=2e-3)
    assert s1[3] == pytest.approx(56526959.51, rel=1e-3)
    assert max(abs(c) for c in s1[4:]) < 0.03
    s2 = draws.risk_grid(ids).groupBy("relative_risk").agg(F.count("*"), F.min("prevalence"), F.max("prevalence")).collect()
    assert {r[0] for r in s2} == set(codes.RISK_GRID)
    assert all(3000 < r[1] < 3700 and r[2] >= 0.01 and r[3] <= 0.2 for r in s2)
    s3 = draws.wide_risk(ids).agg(
        F.min("relative_risk"), F.max("relative_risk"), F.avg("prevalence"), F.stddev("prevalence"),
        F.corr("prevalence", "relative_risk"), F.corr("prevalence", "deaths"),
    ).first()
    assert s3[0] >= 1.72 and s3[1] <= 2.72
    assert s3[2] == pytest.approx(0.261, abs=2e-3) and s3[3] == pytest.approx(0.05, rel=0.03)
    assert max(abs(c) for c in s3[4:]) < 0.03


def test_attributable_deaths(ids):
    out = draws.attributable_deaths(draws.risk_grid(ids.limit(500)))
    assert out.count() == 1000
    assert out.filter("relative_risk = 1 AND deaths_mh <> 0").count() == 0
    row = out.filter("formula = 'Cases' AND relative_risk = 2").first()
    assert row.deaths_mh == pytest.approx(row.deaths * row.prevalence / 2)


@pytest.mark.parametrize("accuracy", [3, 50, 10000])
def test_quantiles_are_exact_for_any_sketch(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=4001),
        "heavy": rng.pareto(0.6, size=3000),
        "ties": rng.integers(0, 3, size=2500).astype(float),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
        None: rng.uniform(size=777),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("unknown", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    out = grouped_quantiles(df, ["g"], "x", PROBS, {"n": F.count("x")}, accuracy=accuracy)
    got = {r.g: r for r in out.collect()}
    assert tuple(got.pop("unknown")) == ("unknown", 0, *[None] * len(PROBS))
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12), (g, name)


def test_band_summary(ids):
    out = sensitivity.deaths_summary(sensitivity.in_published_band(draws.wide_risk(ids)), ["in_band"])
    got = {(r.in_band, r.formula): r for r in out.collect()}
    assert len(got) == 4
    assert sum(r.draws for r in got.values()) == 40000
    assert all(r.p025 < r.p500 < r.p975 for r in got.values())
    assert got[(True, "Cases")].draws == pytest.approx(20000 * 0.21, rel=0.1)
