"""Mixing sources to target weights: whole epochs, then an exact subset-sum for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dalyworks.llm.common import fresh, staged

#: Parts into which the documents of one source and length are split before they are ranked.
SALTS = 64

PLAN = "source string, size long, source_size long, target double, copies int, extra long"


def word_count(text: Column) -> Column:
    """Number of words between white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
    all sizes. A target stops at ``most`` times its source's size; what is over is shared again
    by weight until none is above. There is one row per source, so the order is a plain window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = staged(sources.withColumn("weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    while True:  # the level only rises, so each turn caps further sources or ends
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        n, used, rest = ranked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (budget - (used or 0.0)) / rest
    return ranked.select("source", "source_size", F.least(F.col("source_size") * most, F.lit(level) * F.col("weight")).alias("target"))


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take for a sum as near ``budget``, from below, as can be.

    All but a few dozen documents' worth is taken first as a proportional share of each size,
    which keeps the mix of lengths, and what that leaves over is filled from the largest size
    down; the remainder is a bounded knapsack: a bit set of reachable sums, with counts split
    into powers of two, walked back from the best sum.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return [c if s else 0 for s, c in zip(sizes, counts, strict=True)]
    usable = [i for i, s in enumerate(sizes) if s and counts[i]]
    slack = 48 * (total // max(1, sum(counts[i] for i in usable)) + 1)
    sure = max(0, budget - slack)
    taken = [c * sure // total if s else 0 for s, c in zip(sizes, counts, strict=True)]
    left = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    for i in sorted(usable, key=lambda i: -sizes[i]):
        if left <= slack:
            break
        more = min(counts[i] - taken[i], (left - slack) // sizes[i])
        if more > 0:
            taken[i] += more
            left -= more * sizes[i]
    steps, sums = [], [1]
    mask = (1 << (left + 1)) - 1
    for i in sorted(usable, key=lambda i: sizes[i]):
        rest, part = min(counts[i] - taken[i], left // sizes[i]), 1
        while rest > 0 and not sums[-1] >> left & 1:
            n = min(part, rest)
            grown = (sums[-1] | sums[-1] << (n * sizes[i])) & mask
            rest, part = rest - n, part * 2
            if grown != sums[-1]:
                steps.append((i, n))
                sums.append(grown)
    at = sums[-1].bit_length() - 1
    for (i, n), before in zip(reversed(steps), reversed(sums[:-1]), strict=True):
        if not before >> at & 1:
            taken[i] += n
            at -= n * sizes[i]
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    size, target = int(group.source_size.iloc[0]), float(group.target.iloc[0])
    copies = int(target // size) if size else 0
    budget = round(target - copies * size)
    group = group.sort_values("size")
    extra = fit(group["size"].tolist(), group["n"].tolist(), budget) if size else [0] * len(group)
    out = group.assign(copies=copies, extra=extra)
    out["source"] = out["source"].astype(object).where(out["source"].notna(), None)
    return out[["source", "size", "source_size", "target", "copies", "extra"]]


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: str | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes each row.

    Documents are counted by source and exact length. A source's target is met by whole epochs
    of all its documents and, for the rest, by a subset whose lengths sum to what is left;
    which documents of a length are in it is decided by a seeded hash of the doc_id. Documents
    of one source and length are ranked within ``SALTS`` parts whose counts are then added up,
    so that no such group meets in one task. Null sources form one source; null texts have size
    0, and rows of size 0 take part in whole epochs only. Rows that repeat a doc_id, a source
    and a size are interchangeable. The added columns are named clear of those of ``docs``:
    ``size`` and so on, lengthened by underscores where a name is taken.
    """
    names: dict[str, str] = {}
    for n in ("size", "source_size", "target", "copies", "salt", "rank", "before", "extra", "s", "n", "z", "t", "c"):
        names[n] = fresh([*docs.columns, *names.values()], n)
    s, null, z, t, c = (names[n] for n in ("s", "n", "z", "t", "c"))
    count = F.col(size) if size else word_count(F.col(text))
    salt = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed + 1)), F.lit(SALTS))
    rows = docs.withColumns({names["size"]: count.cast("long"), names["salt"]: salt})
    keys = rows.select(F.col(source).cast("string").alias("source"), F.col(names["size"]).alias("size"), F.col(names["salt"]).alias("salt"))
    parts = staged(keys.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "lengths")
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    shares = staged(targets(parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    same = lengths["source"].eqNullSafe(shares["source"])
    plan = staged(lengths.join(shares, same).select(lengths["source"], "size", "n", "source_size", "target").groupBy("source").applyInPandas(_plan, PLAN), "plan")
    order = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    same = parts["source"].eqNullSafe(plan["source"]) & (parts["size"] == plan["size"])
    ranked = staged(parts.join(plan, same).select(parts["source"], parts["size"], "salt", "before", "source_size", "target", "copies", "extra"), "ranks")
    side = ranked.select(
        F.coalesce("source", F.lit("")).alias(s), F.isnull("source").alias(null), F.col("size").alias(z), F.col("salt").alias(t),
        F.col("before").alias(names["before"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]),
        F.col("copies").alias(c), F.col("extra").alias(names["extra"]),
    )
    on = [
        F.coalesce(rows[source].cast("string"), F.lit("")) == side[s], rows[source].isNull() == side[null],
        rows[names["size"]] == side[z], rows[names["salt"]] == side[t],
    ]
    within = Window.partitionBy(s, null, z, t).orderBy(F.xxhash64(F.col(doc_id), F.lit(seed)), F.col(doc_id))
    joined = rows.join(side, on).withColumn(names["rank"], F.row_number().over(within) + F.col(names["before"]))
    chosen = F.when(F.col(names["rank"]) <= F.col(names["extra"]), 1).otherwise(0)
    return joined.withColumn(names["copies"], F.col(c) + chosen).drop(
        s, null, z, t, c, names["salt"], names["rank"], names["before"], names["extra"]
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; columns unchanged."""
    taken = mix(docs, **options)
    copies = fresh(docs.columns, "copies")
    return taken.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    slim = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    taken = mix(slim, size="words")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
