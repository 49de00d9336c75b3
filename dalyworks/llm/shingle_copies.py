"""Near copies by SimHash, then a prefix filter for what it leaves apart; exact Jaccard likeness of
word shingles decides every link."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dalyworks.llm import near_copies
from dalyworks.llm.common import components, fresh, per_text, scratch, staged
from dalyworks.llm.near_copies import shingles, simhash

#: Words of a shingle, and the least likeness of a link as a fraction of whole numbers.
SHINGLE = 5
LIKENESS = (4, 5)
#: Documents whose shingles are counted to tell common ones, and common ones kept, at most.
#: They only set the order in which shingles are tried; no result depends on them.
SAMPLE_DOCS = 20_000
COMMON = 1 << 17
#: Bits by which fingerprints differ at most whose texts are proposed first.
RADIUS = 2
#: Rounds in which the documents of a shingle meet one of them only, before all pairs that are
#: still in different components meet.
STARS = 2
#: Shared shingles before one's own by which the last round knows a pair that it has met.
BACK = 8
#: Words of 64 bits in a text's map of shingles, in which each shingle turns one bit.
MAP = 16
#: Buckets of the bit map that tells most texts without a candidate from the rest.
BUCKETS = 1 << 22


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes (signed); a text of fewer words is one shingle."""
    return np.unique(shingles(text, shingle).view(np.int64))


def turned_bits(found: np.ndarray, size: int = MAP) -> list[int]:
    """A map of 64 * ``size`` bits (as signed longs): each shingle turns the bit of its hash.

    Shingles that two sets have in common turn the same bits, so their maps differ in no more
    bits than the sets differ in shingles.
    """
    count = np.bincount((found.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * size), minlength=64 * size)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, likeness: tuple[int, int] = LIKENESS) -> bool:
    """Whether the Jaccard likeness of two sets reaches ``likeness``; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return likeness[1] * both >= likeness[0] * (len(a) + len(b) - both)


def _first(found: np.ndarray, names: np.ndarray, counts: np.ndarray, likeness: tuple[int, int]) -> np.ndarray:
    """The rarest shingles: two sets that reach ``likeness`` share one of those of both."""
    rank = np.zeros(len(found), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, found), len(names) - 1)
        rank = np.where(names[at] == found, counts[at], 0)
    order = np.lexsort((found, rank))
    return found[order[: len(found) + likeness[0] * len(found) // -likeness[1] + 1]]


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that recur in a sample of texts, by hash."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    small = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    each = per_text(small, "text", [T.StructField("found", T.ArrayType(T.LongType()))], lambda x: (shingle_set(x, shingle),))
    seen = each.select(F.explode("found").alias("name")).groupBy("name").count().where("count > 1")
    top = seen.orderBy(F.col("count").desc(), "name").limit(COMMON).toArrow().sort_by("name")
    return top.column(0).to_numpy(), top.column(1).to_numpy()


def _perhaps(keys: DataFrame) -> Callable[[str], Column]:
    """A test that holds for all values of the one long column of ``keys`` and for few others, by
    a bit map of a fixed size."""
    bits = np.zeros(BUCKETS, bool)
    bits[keys.select(F.pmod(keys.columns[0], F.lit(BUCKETS)).alias("k")).distinct().toArrow().column(0).to_numpy()] = True
    packed = np.packbits(bits)

    @F.pandas_udf("boolean")
    def perhaps(value):
        import pandas as pd

        k = value.to_numpy() % BUCKETS
        return pd.Series((packed[k >> 3] >> (7 - (k & 7)) & 1).astype(bool))

    return perhaps


def _verified(pairs: DataFrame, bodies: DataFrame, shingle: int, likeness: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach ``likeness``; only their texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, held = a[i], shingle_set(x[i].as_py(), shingle)
                good[i] = alike(held, shingle_set(y[i].as_py(), shingle), likeness)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good))

    bodies = bodies.where(_perhaps(pairs.select(F.explode(F.array("a", "b")).alias("node")))("node"))
    full = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    full = full.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _could(likeness: tuple[int, int], n: Column, at: Column, m: Column, place: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles whose first common one has these places may reach
    ``likeness``: what follows the places bounds what is common."""
    return F.least(n - at, m - place) * sum(likeness) >= likeness[0] * (n + m)


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two maps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _apart(likeness: tuple[int, int], n: Column, m: Column, differ: Column) -> Column:
    """Whether maps ``differ`` in more bits than sets of ``likeness`` do in shingles."""
    return differ * sum(likeness) > (n + m) * (likeness[1] - likeness[0])


def _proposed(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) by SimHash: a fingerprint's nodes meet its least one, and these meet along the
    edges that connect fingerprints within ``radius`` (all pairs of them compared, as in op2)."""
    prints = staged(nodes.groupBy(F.col("print").alias("fp")).agg(F.min("node").alias("lead")), "prints")
    same = nodes.select("node", F.col("print").alias("fp")).join(prints, "fp").select("node", "lead")
    near = near_copies.links(prints, radius).join(prints.toDF("a", "node"), "a").join(prints.toDF("b", "lead"), "b").select("node", "lead")
    both = same.unionByName(near).where("node != lead")
    return both.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _close(pairs: DataFrame, maps: DataFrame, likeness: tuple[int, int]) -> DataFrame:
    """The rows of ``pairs`` (a, b, more) whose sizes and maps do not tell the nodes apart, with
    ``far``: the share of shingles in which they differ, by the maps."""
    both = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").withColumn("differ", _differ(F.col("x"), F.col("y")))
    both = both.where(_could(likeness, F.col("n"), F.lit(0), F.col("m"), F.lit(0)) & ~_apart(likeness, F.col("n"), F.col("m"), F.col("differ")))
    return both.select(*pairs.columns, (F.col("differ") / (F.col("n") + F.col("m"))).alias("far"))


def _every(now: DataFrame, maps: DataFrame, likeness: tuple[int, int], back: int = BACK) -> DataFrame:
    """Pairs (a, b) with different roots that share a name of ``now`` and may reach ``likeness``.

    A pair's first common name stands for it: it is left out at names before which, among the
    ``back`` last of either node, there is another common one. Only a pair whose common names lie
    far apart comes more than once.
    """
    left = now.withColumn("back", F.collect_list("name").over(Window.partitionBy("node").orderBy("at").rowsBetween(-back, -1)))
    left = left.join(maps.select("node", "bits"), "node")
    right = left.select(*[F.col(c).alias(f"_{c}") for c in ("name", "node", "n", "at", "root", "back", "bits")])
    fits = _could(likeness, F.col("n"), F.col("at"), F.col("_n"), F.col("_at")) & ~F.arrays_overlap("back", "_back")
    fits = fits & ~_apart(likeness, F.col("n"), F.col("_n"), _differ(F.col("bits"), F.col("_bits")))
    met = left.join(right, (F.col("name") == F.col("_name")) & (F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & fits)
    return met.select(F.col("node").alias("a"), F.col("_node").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, shingle: int, likeness: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between rows of ``nodes`` that connect all pairs of at least ``likeness``.

    ``nodes`` has, once for each node, (node, body, size, first, bits, print): the hash of a text's
    shingle set, that of the text, the set's size, its rarest shingles, its map of turned bits and
    its SimHash. First nodes meet whose fingerprints are near. Then two nodes may only be linked where they share one
    of the rarest shingles. In the next rounds a shared shingle proposes one of its nodes to all
    others (at first that of the least hash; later each shingle draws its own), and each node
    meets the one of them that is likest by the maps, if they do not rule it out, so that a large
    group costs one pair per member; in the last
    round all pairs are compared by their maps that are not yet in one component, each at the
    first shingle they share and hardly ever again. Every link is checked on the whole texts.
    """
    maps = nodes.select("node", "size", "bits")
    each = nodes.select("node", F.col("size").alias("n"), F.posexplode("first").alias("at", "name"))
    shared = staged(each.groupBy("name").count().where("count > 1").select("name"), "shared")
    entries = staged(each.join(shared, "name"), "entries")
    wanted = staged(nodes.select("node", "body").join(entries.select("node").distinct(), "node"), "wanted")
    texts = docs.select(F.xxhash64("text").alias("body"), "text").where(_perhaps(wanted.select("body"))("body")).join(wanted, "body")
    bodies = staged(texts.dropDuplicates(["node"]).select("node", "text"), "bodies", "zstd")
    tried = staged(_proposed(nodes, radius), "pairs")
    edges = staged(_verified(staged(_close(tried, maps, likeness).select("a", "b"), "close"), bodies, shingle, likeness), "links")
    for turn in range(STARS + 1):
        roots = staged(components(edges, "a", "b"), "roots")
        now = staged(entries.join(roots, "node", "left").select("name", "node", "n", "at", F.coalesce("root", "node").alias("root")), "round")
        lead = F.min(F.struct(F.xxhash64("node", F.lit(turn), *["name"] * (turn > 0)), "node", "root"))
        open_ = staged(now.groupBy("name").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), lead.alias("lead")).where("lo != hi"), "open")
        if open_.isEmpty():
            break
        if turn < STARS:  # each node meets the one lead that is likest by the maps
            other = open_.select("name", *[F.col(f"lead.{c}").alias(f"_{c}") for c in ("node", "root")])
            met = now.join(other, "name").where("root != _root")
            met = met.select("node", F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
            met = _close(met.join(tried, ["a", "b"], "left_anti"), maps, likeness)
            pairs = met.groupBy("node").agg(F.min(F.struct("far", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        else:  # all pairs that are still apart, less those whose maps tell them apart
            every = _every(now.join(open_.select("name"), "name", "left_semi"), maps, likeness)
            pairs = every.distinct().join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        old = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        edges = staged(old.unionByName(_verified(pairs, bodies, shingle, likeness)), "links")
        tried = tried.unionByName(pairs)
    return edges


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """One row of each group of near copies stays; columns unchanged.

    Two texts are near copies if the Jaccard likeness of their ``shingle``-word sets (A-Z
    lowered, words cut at white space) is at least ``likeness``; groups are the connected
    components. Null, empty and blank texts are copies of each other, texts shorter than a
    shingle only of equal ones. The row that stays is that of the smallest doc_id, null ids
    last, then of the smallest hash of the text and of all columns: rows are told apart by
    these and not by their doc_id, and of rows equal in all of them one stays.
    """
    print_, whole = fresh(docs.columns, "text_hash"), fresh(docs.columns, "row_hash")
    marked = docs.withColumns({print_: F.xxhash64(text), whole: F.xxhash64(*[x for c in docs.columns for x in (F.isnull(c), c)])})
    slim = marked.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(print_).alias("text_hash"), F.col(whole).alias("row_hash")
    )
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash", "row_hash")).alias("first")
    with scratch(docs.sparkSession):
        keepers = _rooted(slim, shingle, likeness).groupBy("root").agg(first)
        keepers = staged(keepers.select(F.col("first.text_hash").alias(print_), F.col("first.row_hash").alias(whole)), "keepers", keep=True)
    kept = marked.join(keepers, [print_, whole], "left_semi")
    return kept.dropDuplicates([print_, whole]).select(*docs.columns)


def _rooted(slim: DataFrame, shingle: int, likeness: tuple[int, int]) -> DataFrame:
    """``slim`` without its text, with ``root``: the least node of its component."""
    names, counts = _common(slim, shingle)

    def values(x: str | None) -> tuple:
        hashes = shingles(x, shingle)
        every = np.unique(hashes.view(np.int64))
        return xxhash.xxh3_64_intdigest(every.tobytes()) - (1 << 63), len(every), _first(every, names, counts, likeness), turned_bits(every), simhash(hashes)

    bits = T.StructField("bits", T.ArrayType(T.LongType()))
    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("first", T.ArrayType(T.LongType())), bits, T.StructField("print", T.LongType())]
    wide = ["body", "size", "first", "bits", "print"]
    with scratch(slim.sparkSession):  # from here on shingles are wanted once for each node only
        every = staged(per_text(slim.withColumn("body", F.xxhash64("text")), "text", fields, values), "every")
        nodes = staged(every.select("node", *wide).dropDuplicates(["node"]), "nodes", keep=True)
        rows = staged(every.drop(*wide), "rows", keep=True)
    roots = components(links(slim.select("text"), nodes, shingle, likeness), "a", "b")
    return staged(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
