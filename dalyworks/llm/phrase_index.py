"""Benchmark decontamination over a positional inverted index that is sharded by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import fresh, scratch, staged

#: Lowers A-Z and turns every byte that is in no word into a space.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of text in one shard of the index; a single longer text makes a shard of its own.
SHARD_BYTES = 4 << 20
#: Words of test items that one pass over the index searches for; more items take more passes.
PASS_WORDS = 2_000_000

INDEX = T.StructType(
    [
        T.StructField("shard", T.StringType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("text_hashes", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.BinaryType()),
        T.StructField("terms", T.BinaryType()),
        T.StructField("bounds", T.BinaryType()),
        T.StructField("postings", T.BinaryType()),
    ]
)


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _shard(name: str, ids: list, hashes: list, texts: list[list[bytes]]) -> dict:
    numbers = _Numbers()
    stream = np.fromiter((numbers[w] for text in texts for w in text), np.int32, sum(map(len, texts)))
    names = np.fromiter(map(_term, numbers), np.uint64, len(numbers))
    order = np.argsort(names)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    stream = place[stream]
    return {
        "shard": name,
        "doc_ids": ids,
        "text_hashes": hashes,
        "doc_starts": np.cumsum([0, *map(len, texts)]).astype(np.int32).tobytes(),
        "terms": names[order].tobytes(),
        "bounds": np.cumsum(np.bincount(stream, minlength=len(names)), dtype=np.int64).astype(np.int32).tobytes(),
        "postings": np.argsort(stream, kind="stable").astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of documents: terms, and for each its positions in the shard's words.

    Terms are 64-bit hashes in ascending order; ``bounds`` holds where each term's list ends in
    ``postings``; positions count through the shard and ``doc_starts`` says where each document
    begins. Null and empty texts are documents without postings. The table can be stored and
    searched any number of times; no document leaves its task, so nothing is shuffled.
    """
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(INDEX)
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        hashes: list = []
        texts: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(f"{task}-{made}", ids, hashes, texts)], schema=schema)

        for batch in batches:
            for i, t, h in zip(*(batch.column(k) for k in range(3)), strict=True):
                found = words(t.as_py())
                ids.append(i.as_py())
                hashes.append(h.as_py())
                texts.append(found)
                held += sum(map(len, found)) + len(found)
                if held >= shard_bytes:
                    yield flush()
                    ids, hashes, texts, held, made = [], [], [], 0, made + 1
        if ids:
            yield flush()

    return source.mapInArrow(run, INDEX)


class Phrases:
    """Test windows of one pass: distinct word sequences, and the items that hold each."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int) -> None:
        held: dict[tuple[bytes, ...], set[int | None]] = {}
        for item, text in items:
            found = words(text)
            for at in range(max(1, len(found) - size + 1) if found else 0):
                held.setdefault(tuple(found[at : at + size]), set()).add(item)
        terms = sorted({w for window in held for w in window})
        number = {w: i for i, w in enumerate(terms)}
        self.size = size
        self.terms = np.fromiter(map(_term, terms), np.uint64, len(terms))
        self.windows = [np.array([number[w] for w in window], np.int32) for window in held]
        self.items = [sorted(x, key=str) for x in held.values()]

    def ranked(self, counts: dict[int, int]) -> None:
        """Offsets of each window by the corpus count of their terms, the rarest first."""
        count = np.array([counts.get(int(t.view(np.int64)), 0) for t in self.terms], np.int64)
        self.orders = [np.argsort(count[w], kind="stable").tolist() for w in self.windows]
        full = [i for i, w in enumerate(self.windows) if len(w) == self.size]
        self.matrix = np.array([self.windows[i] for i in full], np.int32).reshape(len(full), self.size)
        self.full = np.array(full, np.int64)
        self.short = [i for i, w in enumerate(self.windows) if len(w) != self.size]


def _lists(row: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term's positions begin and end in a shard's postings."""
    own = np.frombuffer(row["terms"], np.uint64)
    ends = np.frombuffer(row["bounds"], np.int32)
    at = np.minimum(np.searchsorted(own, terms), max(0, len(own) - 1))
    there = own[at] == terms if len(own) else np.zeros(len(terms), bool)
    starts = np.concatenate(([0], ends))[at] if len(own) else np.zeros(len(terms), np.int64)
    return np.where(there, starts, 0), np.where(there, ends[at] if len(own) else 0, 0)


def _held(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, asked)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == asked


def _exact(phrases: Phrases, k: int, lists: Callable[[int], np.ndarray]) -> np.ndarray:
    """Positions where a window begins: lists less their offsets, intersected from the rarest."""
    window, order = phrases.windows[k], phrases.orders[k]
    at = lists(window[order[0]]) - order[0]
    for offset in order[1:]:
        if not len(at):
            break
        at = at[_held(lists(window[offset]), at + offset)]
    return at


def _near(phrases: Phrases, k: int, lists: Callable[[int], np.ndarray], slop: int) -> np.ndarray:
    """Positions of the rarest term with every other term within ``slop`` words of it."""
    window, order = phrases.windows[k], phrases.orders[k]
    at = lists(window[order[0]])
    for offset in order[1:]:
        other = lists(window[offset])
        if not len(at) or not len(other):
            return at[:0]
        right = np.searchsorted(other, at)
        after = np.abs(other[np.minimum(right, len(other) - 1)] - at)
        before = np.abs(at - other[np.maximum(right - 1, 0)])
        at = at[np.minimum(after, before) <= slop]
    return at


HITS = "shard string, doc_no int, doc_id long, text_hash long, n_words long, hits array<int>, items array<long>"


def _search(phrases: Phrases, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, ends = _lists(row, phrases.terms)
                postings = np.frombuffer(row["postings"], np.int32)
                some = ends > starts
                alive = phrases.full[some[phrases.matrix].all(1)].tolist() if len(phrases.full) else []
                alive += [k for k in phrases.short if some[phrases.windows[k]].all()]
                bounds = np.frombuffer(row["doc_starts"], np.int32)
                hits: dict[int, list[np.ndarray]] = {}
                items: dict[int, set] = {}

                def lists(term: int, starts=starts, ends=ends, postings=postings) -> np.ndarray:
                    return postings[starts[term] : ends[term]]

                for k in alive:
                    span = len(phrases.windows[k])
                    if slop is None:
                        at = _exact(phrases, k, lists)
                    else:
                        at, span = _near(phrases, k, lists, slop), 1
                    if not len(at):
                        continue
                    doc = np.searchsorted(bounds, at, "right") - 1
                    inside = (at >= 0) & (at + span <= bounds[np.minimum(doc + 1, len(bounds) - 1)])
                    for d in np.unique(doc[inside]).tolist():
                        own = at[inside & (doc == d)] - bounds[d]
                        hits.setdefault(d, []).append(np.unique((own[:, None] + np.arange(span)).ravel()))
                        items.setdefault(d, set()).update(phrases.items[k])
                n = len(row["doc_ids"])
                empty = np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n),
                        pa.array(range(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["text_hashes"], pa.int64()),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array([np.unique(np.concatenate(hits[d])) if d in hits else empty for d in range(n)], pa.list_(pa.int32())),
                        pa.array([sorted(items[d], key=str) if d in items else [] for d in range(n)], pa.list_(pa.int64())),
                    ],
                    ["shard", "doc_no", "doc_id", "text_hash", "n_words", "hits", "items"],
                )

    return run


def _term_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                starts, ends = _lists(row, terms)
                total += ends - starts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    return run


def search(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    window: int = 10,
    slop: int | None = None,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """For each document of ``index``, a stored table: n_words, the word positions hit, the items that hit.

    ``slop`` None asks for exact phrases: ``window`` consecutive item words (an item of fewer
    words is one window). A number asks for proximity: all words of a window within so many
    words of its rarest one, in any order; hits are then the rarest word's positions. Items go
    to the tasks in passes of about ``pass_words`` words, which bounds what is broadcast; any
    number of items is searched. Items without words match nothing; items that repeat a text
    each count.
    """
    slim = staged(items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")), "items")
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = 1 + total // (6 * pass_words)
    found = None
    for turn in range(passes):
        own = slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == turn).collect()
        phrases = Phrases([(r.item, r.text) for r in own], window)
        counted = index.select("terms", "bounds").mapInArrow(_term_counts(phrases.terms), "term long, n long")
        phrases.ranked({r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()})
        hits = index.mapInArrow(_search(phrases, slop), HITS)
        found = hits if found is None else found.unionByName(hits)
    if passes > 1:
        found = found.groupBy("shard", "doc_no", "doc_id", "text_hash", "n_words").agg(
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return found.drop("shard", "doc_no")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A null or empty text has no words and no hits; repeated rows are judged each by itself.
    """
    index = staged(build_index(docs), "index")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return search(index, benchmark, window=window).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; columns unchanged."""
    key, mark = fresh(docs.columns, "bad_id"), fresh(docs.columns, "bad_text")
    with scratch(docs.sparkSession):
        found = search(staged(build_index(docs), "index"), benchmark, window=window).where(F.size("hits") > 0)
        bad = staged(found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).distinct(), "bad", keep=True)
    same = docs["doc_id"].cast("long").eqNullSafe(bad[key]) & (F.xxhash64(docs["text"]) == bad[mark])
    return docs.join(bad, same, "left_anti")
