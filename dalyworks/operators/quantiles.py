"""Exact grouped quantiles that hold up under one very large group.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here a bounded sketch only *brackets* each quantile; rows
are counted per bracket segment, and just the narrow segments that contain a
wanted rank are ordered. The sketch decides the amount of work, not the result.

The sketches and the wanted ranks (a few rows per group) are staged, so the
planner knows their size: it broadcasts them when they are small, and then no
pass shuffles the values themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..runtime import stage


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    moments: Mapping[str, Column] | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group with the named quantiles, interpolated between ranks.

    ``moments`` are further aggregates of ``value``, computed in the same pass as
    the sketch. NULL values are ignored; a group of NULL values alone has a row
    without quantiles. The keys and values are staged once, since they are read three
    times: for the sketch, the segment counts, and the few rows around each quantile.
    The first two passes run when this function is called.
    """
    keys, moments = list(keys), dict(moments or {})
    every = stage(df.select(*keys, value), "values")
    data = every.filter(F.col(value).isNotNull())
    slack = 2.0 / accuracy
    cuts = sorted({min(max(p + s, 0.0), 1.0) for p in quantiles.values() for s in (-slack, slack)})
    sketch = every.groupBy(*keys).agg(
        F.percentile_approx(value, cuts, accuracy).alias("__cuts"),
        F.count(value).alias("__n"),
        *[m.alias(name) for name, m in moments.items()],
    )
    sketch = stage(sketch, "sketch")
    steps = " + ".join(f"CAST(`{value}` > __cuts[{i}] AS INT)" for i in range(len(cuts)))
    placed = null_safe_join(data, sketch, keys).withColumn("__segment", F.expr(steps))

    # At most one row per segment of a group, so these partitions are tiny.
    before = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy(*keys, "__n", *moments, "__segment")
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    )
    ranks = ", ".join(
        f"named_struct('name', '{name}', 'rank', {end}((__n - 1) * {p!r}D), 'share', {share})"
        for name, p in quantiles.items()
        for end, share in (
            ("floor", f"1D - ((__n - 1) * {p!r}D - floor((__n - 1) * {p!r}D))"),
            ("ceil", f"(__n - 1) * {p!r}D - floor((__n - 1) * {p!r}D)"),
        )
    )
    targets = (
        sizes.withColumn("__want", F.explode(F.expr(f"array({ranks})")))
        .select(*keys, *moments, "__segment", "__size", "__start", "__want.*")
        .filter("rank >= __start AND rank < __start + __size")
    )
    wanted = targets.groupBy(*keys, *moments, "__segment", "__start").agg(
        F.collect_list(F.struct("name", "rank", "share")).alias("__wanted")
    )
    wanted = stage(wanted, "ranks")
    inside = null_safe_join(placed.select(*keys, "__segment", value), wanted, [*keys, "__segment"], "inner")
    running = Window.partitionBy(*keys, "__segment").orderBy(value)
    ordered = (
        inside.groupBy(*keys, "__segment", value)
        .agg(F.count(F.lit(1)).alias("__count"))
        .withColumn("__last", F.sum("__count").over(running))
    )
    found = (
        null_safe_join(ordered, wanted, [*keys, "__segment"], "inner")
        .withColumn("__last", F.col("__start") + F.col("__last"))
        .select(*keys, *moments, value, "__last", "__count", F.inline("__wanted"))
        .filter("rank < __last AND rank >= __last - __count")
    )
    known = found.groupBy(*keys, *moments).agg(
        *[F.sum(F.when(F.col("name") == n, F.col(value) * F.col("share"))).alias(n) for n in quantiles]
    )
    unknown = sketch.filter("__n = 0").select(*keys, *moments, *[F.lit(None).cast("double").alias(n) for n in quantiles])
    return known.unionByName(unknown)
