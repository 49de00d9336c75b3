"""Threshold-scaled sketches of word shingles, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dalyworks.llm.common import fresh, staged

#: Words in a shingle, and the share of all hashes that a sketch retains.
SHINGLE = 5
FRACTION = 1 / 4
#: Documents in a range of doc_ids, about, and ranges at most.
RANGE = 500
RANGES = 100_000


def words(text: Column) -> Column:
    """Runs of characters that are no white space; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def sketch(tokens: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Ascending distinct hashes of the shingles of ``tokens`` that lie below a fixed threshold.

    The threshold is the same for every text, so the sketches of parts can be united and those
    of very unequal texts compared. No hash above it is retained whatever the text's size, so a
    short text may have an empty sketch. Fewer words than a shingle make one shingle.
    ``tokens`` should be a column of its own, not an expression, as it is read at every shingle.
    """
    limit = -(2**63) + int(2**64 * fraction)
    parts = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - shingle), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(shingle)])
    )
    whole = F.array(F.xxhash64(F.array_join(tokens, " ")))
    hashes = F.when(F.size(tokens) >= shingle, parts).when(F.size(tokens) > 0, whole).otherwise(F.array().cast("array<long>"))
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(limit))))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes (Jaccard); null, no estimate, where both sketches are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both.cast("double") / every)


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b holds too; null, no estimate, where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together (shingles across their border aside)."""
    return F.array_sort(F.array_union(a, b))


def as_text(hashes: Column) -> Column:
    """A sketch as text: its hashes as 16 hex digits each, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _below(key: Column, bounds: list[int], equal: bool) -> Column:
    """How many of the ascending ``bounds`` are less than ``key``, or with ``equal`` at most it, by bisection."""
    edges = F.lit(bounds)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        edge = F.get(edges, middle)
        after = edge <= key if equal else edge < key
        open_ = acc["low"] < acc["high"]
        return F.struct(
            F.when(open_ & after, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(open_ & ~after, middle).otherwise(acc["high"]).alias("high"),
        )

    turns = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda acc: acc["low"])


def _range_of(key: Column, tie: Column, bounds: list[int]) -> Column:
    """The range of a row; rows of a key that is several bounds are split among their ranges by ``tie``."""
    if not bounds:
        return F.lit(0)
    low, high = _below(key, bounds, False), _below(key, bounds, True)
    part = (tie.cast("double") / 2.0**64 + 0.5) * (high - low + 1)
    return F.least(high, low + F.floor(part).cast("int"))


def with_next(docs: DataFrame, doc_id: str, values: dict[str, str], tie: str) -> DataFrame:
    """``docs`` with, under the names of ``values``, columns of the row with the next doc_id.

    The last row is followed by the first. A null doc_id counts as the smallest; rows that
    share a doc_id follow one another in the order of a hash of their column ``tie``. Rows are
    dealt by ranges of doc_id and this hash of like size, so that a doc_id of many rows, or none,
    is split too, and the first row of each range is sent to the range before it as well: one
    shuffle serves and no task sees more than a range.
    """
    key, hashed = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), F.xxhash64(tie)
    ids = docs.select(key.alias("key"), hashed.alias("tie"))
    n = ids.count()
    ranges = max(1, min(RANGES, n // RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(ids.agg(F.percentile_approx("key", shares, min(1_000_000, 20 * ranges))).first()[0] or []) if shares else []
    names = {x: fresh([*docs.columns, *values], x) for x in ("range", "key", "first_key", "first_tie", "first_range", "before", "to", "tie")}
    firsts = ids.select("key", "tie", _range_of(F.col("key"), F.col("tie"), bounds).alias("range")).groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first"))
    order = Window.orderBy("range")  # one row per range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = staged(
        firsts.select(
            F.col("range").alias(names["first_range"]),
            F.col("first.key").alias(names["first_key"]),
            F.col("first.tie").alias(names["first_tie"]),
            F.coalesce(F.lag("range").over(order), F.last("range").over(whole)).alias(names["before"]),
        ),
        "firsts",
    )
    rows = docs.withColumns({names["key"]: key, names["tie"]: hashed})
    rows = rows.withColumn(names["range"], _range_of(F.col(names["key"]), F.col(names["tie"]), bounds))
    rows = rows.join(
        firsts,
        (F.col(names["range"]) == F.col(names["first_range"])) & (F.col(names["key"]) == F.col(names["first_key"])) & (F.col(names["tie"]) == F.col(names["first_tie"])),
        "left",
    )
    here = F.struct(F.col(names["range"]).alias("range"), F.lit(0).alias("extra"))
    there = F.struct(F.col(names["before"]).alias("range"), F.lit(1).alias("extra"))
    dealt = rows.withColumn(names["to"], F.explode(F.when(F.col(names["before"]).isNull(), F.array(here)).otherwise(F.array(here, there))))
    along = Window.partitionBy(f"{names['to']}.range").orderBy(F.col(f"{names['to']}.extra"), names["key"], names["tie"])
    found = dealt.select(
        *docs.columns, names["to"], *[F.lead(source).over(along).alias(name) for name, source in values.items()]
    )
    return found.where(F.col(names["to"])["extra"] == 0).drop(names["to"])


def sketched(docs: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """``docs`` with a sketch of each whole text; null and empty texts have an empty one."""
    tokens = fresh([*docs.columns, out], "tokens")
    return docs.withColumn(tokens, words(F.col(text))).withColumn(out, sketch(F.col(tokens))).drop(tokens)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Where both sketches are empty there is no estimate: equal texts are then 1 alike, others 0.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(sketched(base), "doc_id", {"next_text": "text", "next_sketch": "sketch"}, "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    apart = (F.col("text") == F.col("next_text")).cast("double")
    kept = (edited == F.col("text")).cast("double")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", apart.alias("apart"), kept.alias("kept"), edited.alias("edited"))
    rows = sketched(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.coalesce(likeness(F.col("sketch"), F.col("edited_sketch")), "kept").alias("near_edited"),
        F.coalesce(likeness(F.col("sketch"), F.col("next_sketch")), "apart").alias("near_next"),
    )
