"""Joins whose keys treat NULL as a value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key.

    The key columns appear once in the result, filled from whichever side has
    the row. No size hint is given: the planner broadcasts ``right`` when its
    measured size allows and shuffles otherwise.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"__{k}") for k in keys})
    return joined.drop(*[f"__{k}" for k in keys])
