from itertools import chain, combinations

import pytest

from dalyworks.operators import compare, rollup


def test_cube_adds_up_with_both_rules(spark):
    rows = [("a", 1, 2.0, 5.0), ("a", 1, 3.0, None), ("a", 2, 1.0, 1.0), (None, 1, 4.0, 2.0), (None, 2, 8.0, None)]
    df = spark.createDataFrame(rows, "g string, y int, n double, p double")
    got = {(r.level, r.g, r.y): (r.n, r.p, r.p_known) for r in rollup.cube_sums(df, ["g", "y"], ["n", "p"], ["p"]).collect()}
    want = {}
    for kept in chain.from_iterable(combinations(range(2), k) for k in range(3)):
        level = sum(2 ** (1 - d) for d in range(2) if d not in kept)
        for key in {tuple(r[d] if d in kept else None for d in range(2)) for r in rows}:
            cell = [r for r in rows if all(r[d] == key[d] for d in kept)]
            p = [r[3] for r in cell]
            want[(level, *key)] = (sum(r[2] for r in cell), None if None in p else sum(p), sum(x for x in p if x is not None))
    assert got == want and got[(3, None, None)] == (18.0, None, 8.0) and got[(1, None, None)][0] == 12.0
    total = rollup.cube_sums(df.limit(0), ["g", "y"], ["n"]).collect()
    assert [r.level for r in total] in ([], [3])


def test_change_by_year_with_gaps(spark):
    rows = [("a", 2000, 1.0), ("a", 2001, 4.0), ("a", 2003, 10.0), ("a", 2004, None), ("a", 2005, 7.0), (None, 2001, 2.0), (None, 2002, 5.0)]
    got = {(r.g, r.year): (r.x_change, r.x_mean, r.x_years) for r in compare.yearly_change(spark.createDataFrame(rows, "g string, year int, x double"), ["g"], "x").collect()}
    assert got["a", 2000] == (None, 1.0, 1) and got["a", 2001] == (3.0, 2.5, 2) and got["a", 2003] == (None, 7.0, 2)
    assert got["a", 2004] == (None, 10.0, 1) and got["a", 2005] == (None, 8.5, 2) and got[None, 2002] == (3.0, 3.5, 2)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_top_places_keep_ties(spark, k):
    rows = [("a", i, v) for i, v in enumerate([5, 9, 9, 1, None, 7, 7])] + [("b", 1, None), (None, 2, 3)]
    got = rollup.top_places(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], "v", k).collect()
    want = [(g, i, v, rank) for g, i, v in rows if v is not None for rank in [1 + sum(w is not None and w > v for h, _, w in rows if h == g)] if rank <= k]
    assert sorted((tuple((r.g, r.i, r.v, r.place_rank)) for r in got), key=str) == sorted(want, key=str)


def test_top_places_limit_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    plan = rollup.top_places(df, ["g"], "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.rindex("Partial")
