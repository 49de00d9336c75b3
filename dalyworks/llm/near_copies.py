"""Near copies by SimHash: fingerprints compared tile by tile, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import LOWER, components, per_text, staged

#: Words of 16 bits whose population counts make up a tile's key.
WORDS = 4
#: Fingerprints in a tile at most.
TILE = 1024


def shingles(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the word shingles in order, repeats included; of fewer words one, of none none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(words) - shingle] + 1)).tolist()
    ends = np.concatenate((gaps[shingle - 1 :], [len(joined)])).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats counted; no words: zero."""
    return simhash(shingles(text, shingle, seed))


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of unsigned hashes, repeats counted; of none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with a long column ``out``. Null text counts as empty."""
    return per_text(docs, text, [T.StructField(out, T.LongType())], lambda x: (fingerprint(x),))


def counts_key(fp: Column) -> Column:
    """The population counts of the four 16-bit words, as digits to the base 17."""
    digits = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(WORDS)]
    key = digits[0]
    for d in digits[1:]:
        key = key * 17 + d
    return key.cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of two keys' digits that ``radius`` differing bits can make."""
    found = [((), 0)]
    for _ in range(WORDS):
        found = [(d + (x,), used + abs(x)) for d, used in found for x in range(-radius, radius + 1) if used + abs(x) <= radius]
    return [d for d, _ in found]


def _later_keys(radius: int) -> Column:
    """Keys, from the tile's own on, whose counts differ by ``radius`` at most in all."""
    steps = []
    for d in _offsets(radius):
        step = 0
        for x in d:
            step = step * 17 + x
        if step >= 0:
            ok = F.lit(True)
            for i, x in enumerate(reversed(d)):
                if x:
                    digit = F.floor(F.col("key") / 17**i) % 17
                    ok = ok & (digit + x).between(0, 16)
            steps.append(F.when(ok, F.col("key") + step))
    return F.array_compact(F.array(*steps))


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between two tiles connect, one per node at most."""
    both = a if same else np.concatenate((a, b))
    label = np.arange(len(both))
    step = max(1, 65536 // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        rows, columns = np.nonzero(near)
        if same:
            later = columns > rows + at
            rows, columns = rows[later], columns[later]
        if not len(rows):
            continue
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for row, group in zip(rows[np.concatenate(([0], cuts))], np.split(columns, cuts), strict=True):
            nodes = np.append(group if same else group + len(a), row + at)
            names = np.unique(label[nodes])
            if len(names) > 1:
                label[np.isin(label, names)] = names[0]
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for a, b, same in zip(*(batch.column(i) for i in range(3)), strict=True):
                x = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = b.values.to_numpy(zero_copy_only=False).view(np.uint64)
                nodes, roots = _forest(x, y, same.as_py(), radius)
                first.append(nodes)
                second.append(roots)
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (first, second)], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``radius``.

    Distinct fingerprints are cut into tiles of like population counts (one count for each
    16-bit word), of ``tile`` fingerprints at most. Two tiles meet only where their counts
    differ by ``radius`` or less in all: flipping a bit moves one count by one, so no link is
    lost. Within a pair of tiles every pair is compared by exclusive-or and bit count, and only
    a spanning forest of the links leaves the task.
    """
    keyed = staged(fps.select("fp", counts_key(F.col("fp")).alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))  # 17^4 rows at most
    cut = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    tiles = staged(cut.groupBy("key", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    left = tiles.select("key", "part", F.col("fps").alias("a"), F.explode(_later_keys(radius)).alias("other"))
    right = tiles.select(F.col("key").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("b"))
    pairs = left.join(right, "other").where("key != other or other_part >= part")
    return pairs.select("a", "b", F.expr("key = other and part = other_part").alias("same")).mapInArrow(_compare(radius), "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    The fingerprint is 16 lower-case hex digits; the component is named after its smallest
    doc_id. Null and empty texts have fingerprint zero, linked like any other. Rows without a
    doc_id take part but name no component, which is null if none of its rows has one. Equal
    texts share a fingerprint, so repeated rows cost one comparison.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = staged(fingerprints(slim, out="fp"), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius), "a", "b").withColumnRenamed("node", "fp")
    rooted = staged(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    members = staged(rooted.join(named, "root").select("fp", "component_id"), "members")
    return prints.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
