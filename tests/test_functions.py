"""Rules for missing values, rounding, binning and exact sums."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dalyworks.functions.binning import bin_index, break_label
from dalyworks.functions.exact import exact_sum
from dalyworks.functions.joins import null_safe_join
from dalyworks.functions.nulls import clamp, floor_to, if_else, na_rm_sum, na_sum, ratio, zero_if_na
from dalyworks.functions.reshape import column_range, gather, inline_rows, literal_table, lookup, position


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_sums_with_missing_values(spark):
    df = spark.createDataFrame(
        [("full", 1.0), ("full", 2.0), ("part", 1.0), ("part", None), ("none", None)], "g string, x double"
    )
    out = df.groupBy("g").agg(na_sum("x").alias("strict"), na_rm_sum("x").alias("lenient"))
    assert rows(out, "g") == [("full", 3.0, 3.0), ("none", None, 0.0), ("part", None, 1.0)]


def test_null_keys_match_and_form_groups(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20), (None, 30), ("z", 40)], "k string, y int")
    assert rows(null_safe_join(left, right, "k"), "x", "y") == [
        ("a", 1, 10), (None, 2, 20), (None, 2, 30), ("c", 3, None),
    ]
    full = rows(null_safe_join(left, right, "k", "full"), F.col("x").asc_nulls_last(), "y")
    assert full[-1] == ("z", None, 40) and len(full) == 5


def test_division_and_defaults(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, None, 2.0, None]
    nan = spark.sql("SELECT double('NaN') AS x UNION ALL SELECT NULL UNION ALL SELECT 2.5D")
    assert [r[0] for r in nan.select(zero_if_na("x")).collect()] == [0.0, 0.0, 2.5]


def test_if_else_keeps_null_tests(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "m int")
    out = df.select(if_else(F.col("m") == 2, F.lit(1.0), F.lit(0.0)))
    assert [r[0] for r in out.collect()] == [1.0, 0.0, None]


def test_rounding_is_half_to_even_and_floor_truncates(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 1)).collect()] == [0.2, 0.4, 2.5, -2.5]
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [0.0, 0.0, 2.0, -2.0]
    assert spark.sql("SELECT 4.74D AS x").select(floor_to("x", 1)).first()[0] == 4.7


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (25.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clamp("x", 0.0, 20.0)).collect()] == [0.0, 0.0, 20.0, None]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (30.0,), (31.0,), (None,)], "x double")
    breaks = F.array(*[F.lit(float(b)) for b in (0, 1, 20, 30)])
    assert [r[0] for r in df.select(bin_index(F.col("x"), breaks)).collect()] == [None, 1, 1, 2, 3, None, None]


@pytest.mark.parametrize("value, label", [(152.37, "152"), (7.9512, "7.95"), (140.3, "140.3"), (12.0, "12"), (140.0000012, "140.000001"), (0.0000123456, "0.0000123")])
def test_break_labels(spark, value, label):
    fixed = (0, 1, 20, 40, 140)
    assert spark.range(1).select(break_label(F.lit(value), fixed)).first()[0] == label


def test_exact_sum_does_not_depend_on_order(spark):
    rng = random.Random(7)
    values = [round(rng.uniform(-1e5, 1e5), 4) for _ in range(5000)]
    want = sum(Decimal(str(v)) for v in values)
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        assert df.agg(exact_sum("x")).first()[0] == want


def test_exact_sum_has_room(spark):
    df = spark.range(1000).select((F.lit(9e13) + F.col("id") * 0).alias("x"))
    assert df.agg(exact_sum("x")).first()[0] == Decimal("9E+16")


def test_reshaping(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    assert rows(gather(wide, ["a", "b"], "k", "v"), "k") == [(1, "a", 2.0), (1, "b", 3.0)]
    both = inline_rows(wide, ["id"], [{"k": F.lit("a"), "v": F.col("a")}, {"k": F.lit("b"), "v": F.col("b")}])
    assert rows(both, "k") == [(1, "a", 2.0), (1, "b", 3.0)]
    assert column_range(wide, "a", "b") == ["a", "b"]
    table = literal_table(spark, "k string, n int, x double", [("it's", 1, 0.5), (None, 2, None)])
    assert rows(table, "n") == [("it's", 1, 0.5), (None, 2, None)]
    df = spark.createDataFrame([("b",), ("?",), (None,)], "k string")
    assert [r[0] for r in df.select(position("k", ["a", "b"])).collect()] == [2, None, None]
    assert [r[0] for r in df.select(lookup("k", {"b": "B"})).collect()] == ["B", None, None]
