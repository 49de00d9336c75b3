"""Session-level helpers: where intermediate tables go and how they get there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the session names in ``spark.checkpoint.dir``, if it names one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root.rstrip("/") if root else None


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, or else in the warehouse, which is shared too."""
    root = checkpoint_root(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{root}/dalyworks/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows neither recomputes ``df`` nor depends on
    the executors that made it, and the planner knows the table's true size.
    Where the session names no shared folder the table is left as it is: the
    result is the same, computed anew wherever it is used.
    """
    if not checkpoint_root(df.sparkSession):
        return df
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was staged inside; results must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
