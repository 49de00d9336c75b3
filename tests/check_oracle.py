"""Compare every registered query with its SQL: ``python tests/check_oracle.py [dir] [keys]``."""

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem documents benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(spark, con, folder: str, key: str) -> str:
    """Empty when names, types and all values agree."""
    df = entry.queries()[key](spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(normal(row[c]) for c in names) for row in df.collect())
    rel = con.sql(entry.oracle_sql()[key])
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    spark_types = {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    if spark_types != duck_types:
        return "types " + str({c: (spark_types[c], duck_types[c]) for c in names if spark_types[c] != duck_types[c]})
    order = [rel.columns.index(c) for c in names]
    want = sorted(tuple(normal(row[i]) for i in order) for row in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ in {names}, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for key in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        try:
            problem = compare(spark, con, folder, key)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4s} {key} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
