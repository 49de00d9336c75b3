"""Token sequences in training order: fixed-stride records at keyed, dense slots."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import staged

#: Folder of public vocabularies.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How this vocabulary cuts a text into pieces before merging (fixed by the vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Free id of the vocabulary: ends a document and fills a record.
END = 50256
#: Tokens in a record; records in a shard.
LENGTH = 512
SHARD = 4096
#: Before its tokens a record holds doc_id (8 bytes), sequence number and token count (4 each).
HEAD = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4")])
#: Stands for a null doc_id in a record's head.
NO_ID = -(2**63)


def encoder(folder: str, name: str = VOCABULARY):
    """The public vocabulary as a function from text to ids; strings of control tokens are plain text."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def stride(length: int = LENGTH) -> int:
    return HEAD.itemsize + 2 * length


SEQUENCES = T.StructType(
    [
        T.StructField("task", T.IntegerType()),
        T.StructField("number", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("seq_no", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("record", T.BinaryType()),
    ]
)


def _records(doc_id: int | None, ids: list[int], length: int) -> list[bytes]:
    """A document's ids, its end included, as records of ``length`` ids, the last one filled up."""
    count = -(-len(ids) // length)
    body = np.full(count * length, END, "<u2")
    body[: len(ids)] = ids
    head = np.empty(count, HEAD)
    head["doc_id"] = NO_ID if doc_id is None else doc_id
    head["seq_no"] = np.arange(count)
    head["n_tokens"] = np.minimum(length, len(ids) - length * np.arange(count))
    whole = np.concatenate((head.view(np.uint8).reshape(count, -1), body.view(np.uint8).reshape(count, -1)), 1)
    return [row.tobytes() for row in whole]


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, folder: str = TOKENIZERS) -> DataFrame:
    """One row per record of ``length`` token ids; ``number`` counts them within their task.

    Every document, a null or empty text too, ends with ``END`` and so has a record.
    """
    source = docs.select(F.col(doc_id).cast("long"), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, number = encoder(folder), TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[tuple] = []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                name = i.as_py()
                ids = encode(t.as_py() or "")
                ids.append(END)
                for k, record in enumerate(_records(name, ids, length)):
                    held.append((task, number, name, k, min(length, len(ids) - k * length), record))
                    number += 1
                if len(held) >= 2000:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

    return source.mapInArrow(run, SEQUENCES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SEQUENCES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def permute(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network with cycle-walking.

    The network permutes the least power of four that holds ``size``; a value that lands
    outside is sent through again until it lands inside, which takes four turns on average at
    most and keeps the map one to one.
    """
    half = np.uint64(max(1, -(-max(1, int(size - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    out = np.asarray(numbers).astype(np.uint64)
    outside = np.arange(len(out))
    while len(outside):
        left, right = out[outside] >> half, out[outside] & low
        for turn in range(rounds):
            mixed = right + np.uint64((key * 2 * rounds + turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & low)
        out[outside] = (left << half) | right
        outside = outside[out[outside] >= np.uint64(size)]
    return out.astype(np.int64)


def ordered(docs: DataFrame, key: int = 1, length: int = LENGTH, shard: int = SHARD, folder: str = TOKENIZERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, shard, shard_offset, doc_id, seq_no, n_tokens, record), by slot.

    Records are written once as they are cut; with the count of each task their numbers become
    dense without a shuffle, and the permutation gives each number its slot. One shuffle then
    takes ranges of whole shards to their partitions, so that a partition holds consecutive
    slots. ``shard_offset`` is the record's byte offset in its shard: its place times the stride.
    """
    cut = staged(sequences(docs, doc_id, text, length, folder), "sequences")
    counts = staged(cut.groupBy("task").agg(F.count("*").alias("n")), "counts")  # one row per task
    order = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.select("task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "bases")
    size = counts.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(number):
        import pandas as pd

        return pd.Series(permute(number.to_numpy(), size, key))

    spark = docs.sparkSession
    shards = -(-size // shard)
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slotted = cut.join(bases, "task").withColumn("slot", slot(F.col("base") + F.col("number")))
    slotted = slotted.withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))
    ranged = slotted.repartitionById(parts, F.floor(F.col("shard") * parts / max(1, shards)).cast("int"))
    return ranged.sortWithinPartitions("slot").select(
        "slot", "shard", ((F.col("slot") % shard) * stride(length)).alias("shard_offset"), "doc_id", "seq_no", "n_tokens", "record"
    )


def write_shards(records: DataFrame, path: str, length: int = LENGTH, shard: int = SHARD) -> None:
    """Writes ``ordered`` records as shards: one row each, its records laid end to end by slot.

    Spark's committer makes the write whole or absent, whichever executors are lost.
    """
    width = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)]), pa.array([b"".join(held)], pa.binary())], ["shard", "n", "body"])

        for batch in batches:
            for s, r in zip(batch.column(0), batch.column(1), strict=True):
                if s.as_py() != name and held:
                    yield out()
                    held = []
                name = s.as_py()
                held.append(r.as_py())
                if len(held[-1]) != width:
                    raise ValueError(f"a record of {len(held[-1])} bytes; the stride is {width}")
        if held:
            yield out()

    records.select("shard", "record").mapInArrow(run, "shard long, n long, body binary").write.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(slot, doc_id, seq_no, tokens) of written shards from ``slot`` on: where training resumes."""
    width = stride(length)
    schema = "slot long, doc_id long, seq_no int, tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, n, body in zip(*(batch.column(k) for k in range(3)), strict=True):
                first = max(0, slot - s.as_py() * shard)
                raw = np.frombuffer(body.as_py(), np.uint8).reshape(n.as_py(), width)[first:]
                head = np.ascontiguousarray(raw[:, : HEAD.itemsize]).view(HEAD)[:, 0]
                ids = np.ascontiguousarray(raw[:, HEAD.itemsize :]).view("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.as_py() * shard + first + np.arange(len(raw))),
                        pa.array(head["doc_id"], mask=head["doc_id"] == NO_ID),
                        pa.array(head["seq_no"]),
                        pa.array([i[:k].astype(np.int32) for i, k in zip(ids, head["n_tokens"], strict=True)], pa.list_(pa.int32())),
                    ],
                    ["slot", "doc_id", "seq_no", "tokens"],
                )

    shards = spark.read.parquet(path).where(F.col("shard") >= slot // shard)
    return shards.select("shard", "n", "body").mapInArrow(run, schema)
