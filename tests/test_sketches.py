import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dalyworks.operators import draws, sketches, temporal

Q = {"p0": 0.0, "p025": 0.025, "p500": 0.5, "p975": 0.975, "p1": 1.0}


def test_merged_states_stay_within_the_stated_error(spark, tmp_path):
    n, path = 1_000_000, str(tmp_path / "states")
    df = spark.range(n).select((F.col("id") % 7).alias("slice"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("g"), F.pow((F.col("id") * 7919 % n).cast("double"), 1.5).alias("x"))
    for run in range(4):
        sketches.add_run(sketches.quantile_states(df.where(f"slice % 4 = {run}"), ["slice", "g"], "x"), path, str(run))
    sketches.add_run(sketches.quantile_states(df.where("slice % 4 = 1"), ["slice", "g"], "x"), path, "1")  # a run again
    states = sketches.stored_states(spark, path)
    assert states.where("run = 3").select("slice").distinct().count() == 1
    merged = sketches.merge_states(states, ["g"])
    found = sketches.state_quantiles(merged, Q)
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert {r.g: r.draws for r in found.collect()} == sizes
    ends = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}
    assert {r.g: (r.p0, r.p1) for r in found.collect()} == ends
    inner = {k: v for k, v in Q.items() if 0 < v < 1}
    bound = 2 * sketches.rank_error()
    assert 0.008 < bound < 0.01
    assert all(r.within for r in sketches.within_rank_error(df, found, ["g"], "x", inner, bound).collect())
    off = found.withColumn("p500", F.col("p500") * 1.1)
    assert not any(r.within for r in sketches.within_rank_error(df, off, ["g"], "x", inner, bound).collect())
    assert max(len(r.state) for r in merged.collect()) < 40_000


def test_null_values_and_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("n", None), (None, 2.0)], "g string, x double")
    found = {r.g: r for r in sketches.state_quantiles(sketches.merge_states(sketches.quantile_states(df, ["g"], "x"), ["g"]), {"m": 0.5}).collect()}
    assert (found["a"].draws, found["a"].m, found[None].m) == (1, 1.0, 2.0) and found["n"].m is None and not found["n"].draws
    assert sketches.state_quantiles(sketches.quantile_states(df.limit(0), ["g"], "x"), Q).collect() == []


def test_distinct_states_unite_without_counting_twice(spark):
    df = spark.range(300_000).selectExpr("id % 5 AS part", "id % 2 AS g", "id % 90000 AS v")
    states = sketches.distinct_states(df, ["part", "g"], "v")
    found = {r.g: r.n for r in sketches.unite_states(states, ["g"]).select("g", sketches.distinct_count().alias("n")).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    assert all(abs(found[g] - n) < 5 * sketches.distinct_error() * n for g, n in exact.items())
    again = sketches.distinct_states(df.repartition(7), ["g"], "v").select("g", sketches.distinct_count().alias("n"))
    assert all(abs(r.n - found[r.g]) < 0.02 * found[r.g] for r in again.collect())
    few = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("n", None)], "g string, v int")
    assert {r.g: r.n for r in sketches.distinct_states(few, ["g"], "v").select("g", sketches.distinct_count().alias("n")).collect()} == {"a": 1, "n": 0}


def test_place_draws_are_the_same_for_any_layout(spark):
    places = spark.createDataFrame([(1, 2000, 0.1), (2, 2000, 0.2), (None, 2001, 0.3)], "place int, year int, share double")
    made = {}
    for parts, chunk in ((2, 64), (9, 1000)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        ids = draws.place_draws(places, ["place", "year"], 300, chunk)
        made[parts] = sorted((r.draw_id, r.u1, r.u4) for r in draws.with_uniforms(ids).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert made[2] == made[9] and len({i for i, *_ in made[2]}) == 900 and made[2][0][0] == "-2001-0"
    assert draws.place_draws(places, ["place"], 0).count() == 0 and draws.place_draws(places, ["place"], 1).count() == 3
    many = draws.place_draws(places.limit(1), ["place", "year"], 10**6)
    row = draws.with_uniforms(many).agg(F.count("*").alias("n"), F.avg("u1").alias("m")).first()
    assert row.n == 10**6 and abs(row.m - 0.5) < 0.002


def plain_asof(left, right):
    best = {}
    for k, t, v in right:
        if t is not None:
            best.setdefault(k, {})
            old = best[k].get(t)
            best[k][t] = max((v, old), key=lambda x: (x is not None, x)) if t in best[k] else v
    out = []
    for i, k, t in left:
        times = [s for s in best.get(k, {}) if t is not None and s <= t]
        out.append((i, k, t, max(times), best[k][max(times)]) if times else (i, k, t, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_asof_join_matches_every_row_tried(spark, parts):
    draw = random.Random(parts)
    day = lambda: date(2020, 1, 1) + timedelta(days=draw.randrange(60))
    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), None if i % 40 == 0 else day()) for i in range(400)] + [(900 + i, "hot", date(2020, 2, 1)) for i in range(300)]
    right = [(key(), None if i % 20 == 0 else day(), None if i % 7 == 0 else draw.random()) for i in range(40)] + [("late", date(2021, 1, 1), 1.0)]
    a = spark.createDataFrame(left, "id int, key string, day date")
    b = spark.createDataFrame(right, "key string, known date, value double")
    got = temporal.asof_join(a, b, ["key"], "day", "known", ["value"], parts)
    assert got.columns == ["id", "key", "day", "known", "value"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_asof(left, right)
    assert temporal.asof_join(a, b.limit(0), ["key"], "day", "known", ["value"]).where("value is null").count() == len(left)
    assert temporal.asof_join(a.limit(0), b, ["key"], "day", "known", ["value"]).collect() == []


def test_interval_join_matches_every_pair_tried(spark):
    draw = random.Random(4)
    inf, nan = float("inf"), float("nan")
    points = [(i, draw.choice("ab"), draw.choice([draw.uniform(-9, 9), draw.uniform(-1e6, 1e6), 0.0, 2.0])) for i in range(200)] + [(900, "a", None), (901, "a", nan), (902, None, 1.0), (903, "a", inf), (904, "b", -inf)]
    spans = [(i, draw.choice("ab"), (x := draw.choice([draw.uniform(-9, 9), draw.uniform(-1e6, 1e6), 0.0])), x + draw.choice([0.0, 1e-9, 0.5, 2.0, 1e4, 3e6])) for i in range(150)]
    spans += [(800, "a", -inf, inf), (801, "a", 3.0, 1.0), (802, "a", None, 1.0), (803, "b", 0.0, nan), (804, "b", 2.0, inf), (805, None, 0.0, 9.0)]
    a = spark.createDataFrame(points, "id int, k string, x double")
    b = spark.createDataFrame(spans, "span int, k string, low double, high double")
    want = sorted((p, s) for p, k, x in points for s, j, lo, hi in spans if k is not None and k == j and None not in (x, lo, hi) and lo <= x <= hi)
    got = temporal.interval_join(a, b, ["k"], "x", "low", "high", 0.5)
    assert sorted((r.id, r.span) for r in got.collect()) == want and len(want) > 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.interval_join(a, b.limit(0), ["k"], "x", "low", "high").collect() == []
