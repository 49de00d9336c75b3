"""Helpers shared by the operators: shared storage, per-text columns, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deletes nothing and lowers A-Z; used with ``bytes.translate``.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Paths that the open scopes of ``scratch`` delete at their ends, the innermost last.
_scopes: list[list[str]] = []


def staged(df: DataFrame, label: str, codec: str = "snappy", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there.

    Inside ``scratch`` the table goes at the end of the scope, or with ``keep`` of the next one out.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    holder = _scopes[:-1] if keep else _scopes
    if holder:
        holder[-1].append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was staged inside; what is still wanted is staged with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until it clashes with none of ``taken`` (case ignored)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def per_text(
    df: DataFrame, text: str, fields: list[T.StructField], values: Callable[[str | None], tuple], drop_text: bool = True
) -> DataFrame:
    """Appends ``fields``, the values of each row's text; other columns pass through as Arrow."""
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType(kept + fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            made = [values(x.as_py()) for x in texts]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the least node of its component.

    Alternating large-star and small-star steps. Each step keeps at most one row per edge;
    minima are combined before they are shuffled, and written out before they are joined, so
    that a join's hot key can be split. Rows with a null end are ignored.
    """
    pairs = (
        edges.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v"))
        .where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now = staged(pairs, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "minima")
        large = (
            both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = staged(large, "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = staged(small.select("e.*").where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node ``u`` has one edge, to a node that has none."""
    chain = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return chain.isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty()
