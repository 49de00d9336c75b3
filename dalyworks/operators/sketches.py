"""Quantile and distinct-count sketches as stored, mergeable states.

A state summarises the values of one group in a few kilobytes, whatever their number. States
are made with partial aggregation where the values are read, stored by run, and merged over
runs and over coarser groups without reading the values again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join

#: Size parameter of the sketches, and how many values the state holds per level.
SIZE = 1000


def rank_error(size: int = SIZE) -> float:
    """Rank error that one quantile of a merged state stays within in 99 of 100 cases.

    The published fit for this family of sketches; it does not depend on the number of values
    or of merges. ``2 * rank_error`` is exceeded less than once in a million.
    """
    return 2.296 / size**0.9021


def quantile_states(df: DataFrame, keys: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """(keys, state, lowest, highest): one sketch of the non-NULL values of each group.

    A group of NULL values alone has a state of none.
    """
    return df.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("state"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )


def add_run(states: DataFrame, path: str, run: str) -> None:
    """Stores the states of one run under ``path``; a run that is stored again replaces itself."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """All runs' states, with the column ``run``; runs can be filtered without reading the others."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/run=*")


def merge_states(states: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """States of the coarser groups ``keys``: over runs, slices or both."""
    return states.groupBy(*keys).agg(F.kll_merge_agg_double("state", size).alias("state"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def count_of(state: str = "state") -> Column:
    return F.kll_sketch_get_n_double(state)


def state_quantiles(states: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """The named quantiles of each state, NULL where it holds no value; ``draws`` counts the values.

    The ends, 0 and 1, are the exact extremes.
    """
    def one(p: float) -> Column:
        if p in (0.0, 1.0):
            return F.col("lowest" if p == 0.0 else "highest").cast("double")
        return F.when(count_of() > 0, F.kll_sketch_get_quantile_double("state", F.lit(p)))

    kept = [c for c in states.columns if c not in ("state", "lowest", "highest")]
    return states.select(*kept, count_of().alias("draws"), *[one(p).alias(n) for n, p in quantiles.items()])


def within_rank_error(df: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], bound: float) -> DataFrame:
    """(keys, within): whether each group's estimates lie no further than ``bound`` from their ranks.

    The rank of an estimate among the values is the share below it up to the share not above it.
    The values are counted in one pass with map-side sums; the estimates are a row per group.
    """
    held = null_safe_join(df.filter(F.col(value).isNotNull()).select(*keys, value), estimates.select(*keys, *[F.col(q).alias(f"__{q}") for q in quantiles]), keys)
    counts = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(value) < F.col(f"__{q}")).alias(f"__{q}_below") for q in quantiles],
        *[F.count_if(F.col(value) <= F.col(f"__{q}")).alias(f"__{q}_upto") for q in quantiles],
    )
    fits = F.lit(True)
    for q, p in quantiles.items():
        fits = fits & (F.col(f"__{q}_below") <= (p + bound) * F.col("__n")) & (F.col(f"__{q}_upto") >= (p - bound) * F.col("__n"))
    return counts.select(*keys, fits.alias("within"))


#: Logarithm of the number of registers of a distinct-count state.
REGISTERS = 12


def distinct_error(registers: int = REGISTERS) -> float:
    """Relative standard error of the count of a state, merged or not."""
    return 1.04 / 2 ** (registers / 2)


def distinct_states(df: DataFrame, keys: Sequence[str], value: str, registers: int = REGISTERS) -> DataFrame:
    """(keys, members): a state of the distinct non-NULL values of each group, the same for any order of rows."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, registers).alias("members"))


def unite_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of the coarser groups ``keys``; a value that lies in several states counts once."""
    return states.groupBy(*keys).agg(F.hll_union_agg("members").alias("members"))


def distinct_count(members: str = "members") -> Column:
    """The estimated number of distinct values of a state."""
    return F.hll_sketch_estimate(members)
