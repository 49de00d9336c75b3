"""Joins by nearness and by containment: the latest value as of a time, and intervals that hold a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..runtime import stage


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, known_at: str, values: Sequence[str], parts: int | None = None) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` known at its time or before.

    ``keys`` are equal (NULL matches NULL), and ``known_at`` <= ``at``; the result has the
    columns of ``left``, ``known_at`` and ``values``, which are NULL where nothing is known yet,
    where ``at`` is NULL, or where the latest row holds NULLs. Of right rows of one key and time
    the one of greatest values counts; right rows without a time are left out.

    Both sides are laid out together by ranges of key and time, so a key with any share of the
    rows spreads over as many ranges as it needs. Within a range the last known values are
    filled forward; what is known at the end of a range is carried to the later ranges of its
    key by a table of one row per range and key.
    """
    keys, values = list(keys), list(values)
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    facts = right.filter(F.col(known_at).isNotNull()).groupBy(*keys, known_at).agg(F.max(F.struct(*values)).alias("__of"))
    known = F.struct(F.col(known_at).alias("at"), F.col("__of").alias("of"))
    row = F.struct(*[F.col(c) for c in left.columns])
    shaped = [F.col(k).alias(n) for k, n in named.items()]
    asked = left.select(*shaped, F.col(at).alias("__at"), F.xxhash64(*left.columns).alias("__salt"), row.alias("__row"))
    told = facts.select(*shaped, F.col(known_at).alias("__at"), F.lit(None).cast("long").alias("__salt"), known.alias("__known"))
    both = asked.unionByName(told, allowMissingColumns=True)
    order = [*named.values(), "__at", F.col("__salt").asc_nulls_first()]  # what is told precedes what is asked then
    ranged = stage(both.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "asof")
    within = Window.partitionBy("__part", *named.values()).orderBy("__at", F.col("__salt").asc_nulls_first())
    filled = ranged.withColumn("__last", F.last("__known", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranged.groupBy("__part", *named.values()).agg(F.max_by("__known", F.when(F.col("__known").isNotNull(), F.col("__at"))).alias("__end"))
    before = Window.partitionBy(*named.values()).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end"), "carried")
    joined = null_safe_join(filled.filter(F.col("__row").isNotNull()), carried, ["__part", *named.values()])
    found = F.when(F.col("__at").isNotNull(), F.coalesce("__last", "__carried"))
    taken = joined.select("__row", found.alias("__found"))
    return taken.select("__row.*", F.col("__found.at").alias(known_at), *[F.col(f"__found.of.{v}").alias(v) for v in values])


#: Level of the intervals with an infinite end, which lie in no block.
ENDLESS = 1 << 20


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str, unit: float = 1.0) -> DataFrame:
    """Every point with every interval that holds it: ``keys`` equal, ``low`` <= ``point`` <= ``high``.

    The result has the columns of both (the keys once). NULL keys, points and ends match nothing,
    and so do intervals that end before they begin and points that are no number.

    An interval is entered under the one or two blocks of its own length, rounded up to ``unit``
    times a power of two, that it reaches into; a point asks one block of each length that
    occurs, of which doubles allow some two thousand at most. So wide and narrow intervals are
    found alike by an equality of key and block, which any large join strategy can split.
    """
    keys = list(keys)
    width = F.col(high) - F.col(low)
    endless = (F.abs(F.col(low)) == float("inf")) | (F.abs(F.col(high)) == float("inf"))
    level = F.when(endless, F.lit(ENDLESS)).otherwise(F.ceil(F.log2(F.greatest(width / unit, F.lit(2.0**-1000)))).cast("int"))
    some = intervals.filter((F.col(low) <= F.col(high)) & ~F.isnan(F.col(high).cast("double"))).withColumn("__level", level)
    levels = sorted(r["__level"] for r in some.select("__level").distinct().collect())

    def block(x: Column, of: Column) -> Column:
        size = F.pow(F.lit(2.0), of) * unit
        return F.when(of == ENDLESS, F.lit(0.0)).otherwise(F.floor(x.cast("double") / size).cast("double"))

    first, last = block(F.col(low), F.col("__level")), block(F.col(high), F.col("__level"))
    entered = some.withColumn("__block", F.explode(F.array_distinct(F.array(first, last, F.least(first + 1, last)))))
    asked = points.filter(F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double")))
    asked = asked.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    asked = asked.withColumn("__block", block(F.col(point), F.col("__level")))
    met = asked.join(entered, [*keys, "__level", "__block"])
    return met.filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__level", "__block")
