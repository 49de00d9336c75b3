"""Small tables for the text operators: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choices(["th", "an", "re", "ing", "ou", "é", "st"], k=draw.randint(1, 3))) for _ in range(n)]
    return "".join(w + (".\n" if i % 11 == 10 else " ") for i, w in enumerate(words))


def documents(spark, rows, extra: bool = False):
    """rows: (doc_id, text) or (doc_id, text, source); ``extra`` adds columns with clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("score", "fingerprint", "component_id", "size", "copies", "salt", "keeper", "bad_id", "slot", "tokens", "found", "runs", "collapsed", "bits", "s", "n", "z", "t", "c", "a", "b", "__s", "row_hash", "text_hash", "shard", "record"):
            df = df.selectExpr("*", f"'kept' as {name}")
    return df


def awkward() -> list[tuple]:
    """Null id, null text, empty and blank texts, repeated rows, a long text, control characters."""
    long = prose(1, 3000)
    return [
        (1, long), (2, None), (3, ""), (4, " \n\t "), (5, prose(2, 40)), (5, prose(2, 40)), (6, prose(2, 40)),
        (None, prose(3, 30)), (None, None), (7, "a"), (8, "x" * 1500), (9, "Zwei Worte   \U0001f600 ### </turn>"), (10, long[:4000]),
    ]
