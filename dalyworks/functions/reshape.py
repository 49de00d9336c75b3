"""Wide/long reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn ``columns`` into rows of (``name``, ``value``)."""
    ids = [c for c in df.columns if c not in set(columns)]
    return df.unpivot(ids, list(columns), name, value)


def inline_rows(df: DataFrame, ids: Sequence[str], rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per entry of ``rows`` for every input row.

    A gather with several value columns at once: a narrow step, no shuffle.
    """
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return df.select(*ids, F.inline(F.array(*structs)))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in column order."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[i : j + 1]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lookup(key: str, mapping: Mapping) -> Column:
    """Constant mapping of column ``key`` as a CASE expression; NULL for an
    unlisted key."""
    cases = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in mapping.items())
    return F.expr(f"CASE `{key}` {cases} END")


def position(key: str, order: Sequence) -> Column:
    """1-based place of column ``key`` in ``order``; NULL when not listed."""
    return lookup(key, {v: i for i, v in enumerate(order, 1)})


def literal_table(spark, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """Small constant table, planned as an in-memory relation of known size."""
    fields = [part.split() for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")
