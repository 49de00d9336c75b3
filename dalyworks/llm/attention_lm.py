"""Whole texts scored by a small causal self-attention model over subword ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  so that pa.compute is there
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import LOWER, staged
from dalyworks.llm.training_order import TOKENIZERS, encoder

#: Bytes of text in a chunk; a single longer text makes a chunk of its own.
CHUNK_BYTES = 12 << 20
#: Ids of the vocabulary; one more event ends a text (first subwords) or a word (later ones).
IDS = 50_257
STOP = IDS
#: Symbols the model reads (frequent ids, one for all rarer ones, the text's start, a blank),
#: and, for first and for later subwords, the classes it predicts and its width.
SYMBOLS = 2048
RARE, START, BLANK = SYMBOLS - 3, SYMBOLS - 2, SYMBOLS - 1
LEAD_SHAPE = (128, 12)
LATER_SHAPE = (384, 16)
#: Scored positions of a window, and all its positions: the rest is context that overlaps.
SCORED, CONTEXT = 16, 32
#: Subwords of its own word that a later subword sees.
IN_WORD = 8
#: Rounds of the fit; in each every task learns from its own chunks, and the weights are averaged.
ROUNDS = 3
#: Share of a chunk's training windows that the rounds together learn from: all of them.
LEARNT = 1.0
#: Steps of a task in a round at least: with little text it goes through it again.
STEPS = 100
#: Times that a round goes through its windows, and its later subwords: a word's subwords are learnt
#: from once for the whole corpus and not once a chunk, so there are few steps.
PASSES = (1, 2)
#: Windows, and later subwords, of a step.
BATCHES = (128, 1024)
#: Logits worked out at a time.
BLOCK = 1 << 16
#: Numbers by which a row's symbols are multiplied to tell rows apart.
MIXERS = np.random.default_rng(11).integers(1 << 62, 1 << 63, IN_WORD + 1, np.uint64) | np.uint64(1)
#: Groups in which the tasks' weights are added up before the driver adds the groups.
GROUPS = 16
#: The end of a text among the words: no word holds a space.
END = b" "
#: Blanks that a word may hold.
BLANKS = re.compile(r"[^\S ]")

CHUNKS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("held", T.BinaryType()),
        T.StructField("starts", T.BinaryType()),
        T.StructField("low", T.BinaryType()),
        T.StructField("high", T.BinaryType()),
        T.StructField("names", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("pieces", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("leads", T.BinaryType()),
    ]
)
#: Words of the corpus that are learnt from and scored together.
PAGE = 1 << 18
PAGES = "chunk long, names binary, totals binary, pieces binary, sizes binary"


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether the CRC-32 of the doc_id as text leaves ``part``; a null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


class Speller:
    """Subword ids of many words at once, as each word after a space has them."""

    def __init__(self, folder: str) -> None:
        self.encode = encoder(folder)
        known = self.encode.__self__
        self.begins = np.array([known.decode_single_token_bytes(i)[:1] == b" " for i in range(known.n_vocab)])

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each word has).

        The vocabulary cuts a text before a space that no other blank stands by, so words in a row
        have the ids that each has alone, and a word's first id begins with the space. Words that
        hold other blanks are spelled one by one.
        """
        odd = [i for i, word in enumerate(words) if BLANKS.search(word)] if BLANKS.search(" ".join(words)) else []
        apart = [self.encode(" " + words[i]) for i in odd]
        if odd:
            left = set(odd)
            words = [word for i, word in enumerate(words) if i not in left]
        pieces = np.array(self.encode(" " + " ".join(words)) if words else [], np.uint16)
        sizes = np.diff(np.flatnonzero(self.begins[pieces]), append=len(pieces)).astype(np.int32)
        if odd:
            before = np.array(odd) - np.arange(len(odd))
            added = np.fromiter(map(len, apart), np.int32, len(apart))
            ends = np.append(0, np.cumsum(sizes))
            pieces = np.insert(pieces, np.repeat(ends[before], added), np.fromiter(chain.from_iterable(apart), np.uint16, int(added.sum())))
            sizes = np.insert(sizes, before, added)
        return pieces, sizes


def chunks(docs: DataFrame, folder: str = TOKENIZERS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents (doc_id, text, held) as numbered words, one row per chunk.

    A chunk has its distinct words once: a 64-bit name, the count in its training documents,
    the subword ids and the first of them; a word number per token, the end of each text included, is held as its
    low and high 16 bits (the high ones are mostly zero and take no room when compressed), and
    ``starts`` says where each document begins. Word number 0 is the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(CHUNKS)
        speller, task, made = Speller(folder), TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            low = [(t or "").encode().translate(LOWER) for t in rows["text"].to_pylist()]
            split = pa.compute.ascii_split_whitespace(pa.array(low, pa.large_string()))
            ends, flat = split.offsets.to_numpy(), split.values
            full = pa.compute.greater(pa.compute.binary_length(flat), 0)  # around a text's outer blanks are empty ones
            ends = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[ends]
            found = flat.filter(full).dictionary_encode()
            starts = ends + np.arange(len(ends))
            stream = np.zeros(starts[-1], np.int32)
            inner = np.ones(len(stream), bool)
            inner[starts[1:] - 1] = False
            stream[inner] = found.indices.to_numpy() + 1
            out = rows["held"].to_numpy()
            mask = np.repeat(~out, np.diff(starts))
            words = found.dictionary.to_pylist()
            pieces, sizes = speller.spell(words)
            numbers = [END, *found.dictionary.cast(pa.large_binary()).to_pylist()]
            row = {
                "chunk": (task << 32) + made,
                "doc_ids": rows["doc_id"].to_pylist(),
                "held": out.astype(np.uint8).tobytes(),
                "starts": starts.astype(np.int64).tobytes(),
                "low": (stream & 0xFFFF).astype(np.uint16).tobytes(),
                "high": (stream >> 16).astype(np.uint16).tobytes(),
                "names": np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers)).tobytes(),
                "counts": np.bincount(stream[mask], minlength=len(numbers)).astype(np.int32).tobytes(),
                "pieces": pieces.tobytes(),
                "sizes": np.append(np.int32(0), sizes).tobytes(),
                "leads": leads_of(pieces, np.append(0, np.cumsum(sizes))).astype(np.uint16).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        held, size = [], 0
        for batch in batches:
            first = 0
            for i, n in enumerate(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                size += n + 1
                if size >= chunk_bytes:
                    held.append(batch.slice(first, i + 1 - first))
                    yield flush()
                    held, size, made, first = [], 0, made + 1, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield flush()

    return docs.select("doc_id", "text", "held").mapInArrow(run, CHUNKS)


def _stream(row: dict) -> np.ndarray:
    return np.frombuffer(row["low"], np.uint16) + (np.frombuffer(row["high"], np.uint16).astype(np.int32) << 16)


def _pieces(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids of the words one after another, where each word ends)."""
    return np.frombuffer(row["pieces"], np.uint16).astype(np.int32), np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            names, counts = np.frombuffer(row["names"], np.int64), np.frombuffer(row["counts"], np.int32).astype(np.int64)
            _, ends = _pieces(row)
            pieces = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((np.append(0, ends) * 2).astype(np.int32)), pa.py_buffer(row["pieces"])])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts), pieces], ["name", "n", "pieces"])


def _word_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            names = np.frombuffer(row["names"], np.int64)
            columns = [pa.array(np.full(len(names), row["chunk"])), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(names)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "number", "name"])


def vocabulary(words: DataFrame, page: int = PAGE) -> DataFrame:
    """Distinct words (name, c, pieces) of the corpus with their training counts, packed as ``PAGES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("chunk", pa.int64()), *((k, pa.binary()) for k in ("names", "totals", "pieces", "sizes"))])
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            pieces = rows["pieces"].to_pylist()
            row = {
                "chunk": (1 << 60) + (task << 32) + made,
                "names": rows["name"].to_numpy().tobytes(),
                "totals": rows["c"].to_numpy().tobytes(),
                "pieces": b"".join(pieces),
                "sizes": (np.fromiter(map(len, pieces), np.int32, len(pieces)) // 2).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= page:
                yield full()
                made, held, size = made + 1, [], 0
        if size:
            yield full()

    return words.select("name", "c", "pieces").mapInArrow(run, PAGES)


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By task: training counts of ids as first (0) and later (1) subwords of a word, words seen
    once by their first subword (2), and words seen at all (3)."""
    total = np.zeros((4, IDS + 1), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["totals"], np.int64)
            pieces, ends = _pieces(row)
            first, size = ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)
            leads = leads_of(pieces, ends)
            weight = np.repeat(counts, size)
            later = np.ones(len(pieces), bool)
            later[first[size > 0]] = False
            np.add.at(total[0], leads, counts)
            np.add.at(total[1], pieces[later], weight[later])
            total[1, STOP] += counts[size > 0].sum()
            total[2] += np.bincount(leads[counts == 1], minlength=IDS + 1)
            total[3, 0] += (counts > 0).sum()
    kinds, ids = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(ids.astype(np.int32)), pa.array(total[kinds, ids])], ["kind", "id", "n"])


def piece_counts(pages: DataFrame) -> np.ndarray:
    """The counts of ``_piece_counts`` over all pages; at most four per vocabulary id."""
    counts = np.zeros((4, IDS + 1), np.int64)
    for r in pages.mapInArrow(_piece_counts, "kind int, id int, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect():
        counts[r.kind, r.id] = r.n
    return counts


@dataclass
class Events:
    """How ids are read (symbols) and predicted (a class, then a place in it by its count)."""

    symbol: np.ndarray
    place: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, classes: int) -> Events:
        """Frequent ids are classes of their own; the rest share classes of like mass."""
        order = np.argsort(-counts, kind="stable")
        smooth = counts[order] + 1.0
        own = classes - 16
        rest = np.cumsum(smooth[own:]) / smooth[own:].sum()
        ranked = np.concatenate((np.arange(own), own + np.minimum(15, (rest * 16 - 1e-9).astype(int))))
        mass = np.bincount(ranked, weights=smooth, minlength=classes)
        symbol, place, within = np.empty(len(counts), np.int32), np.empty(len(counts), np.int32), np.empty(len(counts))
        symbol[order] = np.minimum(np.arange(len(counts)), RARE)
        place[order] = ranked
        within[order] = np.log10(smooth / mass[ranked])
        return cls(symbol, place, within)


def _exponentials(logits: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials in place; (sums of the rows, what was taken off first: each row's largest, or
    nothing where no value is farther than ``reach`` from 0 and that is too near to matter)."""
    off: np.ndarray | float = 0.0
    if not reach < 60:
        off = logits.max(1)
        logits -= off[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32), off


def _longest(rows: np.ndarray) -> float:
    """Length of the longest row."""
    return float(np.sqrt((np.square(rows) @ np.ones(rows.shape[1], np.float32)).max(initial=0)))


def _sums(symbols: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by symbol."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    out = np.zeros((SYMBOLS, values.shape[1]), np.float32)
    if len(first):
        out[ranked[first]] = np.add.reduceat(values.take(order, 0), first, axis=0)
    return out


def _names(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of symbols."""
    total = np.zeros(len(keys), np.uint64)
    for i in range(keys.shape[1]):
        total += keys[:, i].astype(np.uint64) * MIXERS[i]
    return total ^ (total >> np.uint64(31))


def _alike(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that puts equal names side by side, where in it each distinct name begins)."""
    order = np.argsort(names)
    ranked = names[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(names)), bool), ranked[1:] != ranked[:-1])))


class Attention:
    """One causal self-attention layer with relative positions, and a linear layer to classes."""

    def __init__(self, context: int, shape: tuple[int, int], seed: int) -> None:
        draw = np.random.default_rng(seed)
        classes, d = shape
        self.width = d
        self.p = {
            "e": draw.normal(0, 0.3, (SYMBOLS, d)), "q": draw.normal(0, d**-0.5, (d, d)), "k": draw.normal(0, d**-0.5, (d, d)),
            "v": draw.normal(0, d**-0.5, (d, d)), "r": np.zeros(context), "u": draw.normal(0, 0.1, (d, classes)), "c": np.zeros(classes),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def tables(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """What each symbol gives as a query (its projection, 1, itself) and as a key (its projection,
        0 or for a blank a score that hides it, its value, 1); whether scores may be too large to be
        taken to exponentials as they are."""
        p, d = self.p, self.width
        found = p["e"] @ np.concatenate((p["q"] * np.float32(d**-0.5), p["k"], p["v"]), 1)
        one, hides = np.ones((SYMBOLS, 1), np.float32), np.zeros((SYMBOLS, 1), np.float32)
        hides[BLANK] = -1e9
        asked = np.concatenate((found[:, :d], one, p["e"]), 1)
        given = np.concatenate((found[:, d : 2 * d], hides, found[:, 2 * d :], one), 1)
        return asked, given, not _longest(found[:, :d]) * _longest(found[:, d : 2 * d]) + np.abs(p["r"]).max() < 60

    def attend(self, keys: np.ndarray, n: int, tables: tuple[np.ndarray, np.ndarray, bool]) -> tuple:
        """What the ``n`` last positions of each row of symbols hold after attention, with a 1, as rows;
        and what the gradient needs."""
        length, d = keys.shape[1], self.width
        asked, given, large = tables
        back = np.arange(length - n, length)[:, None] - np.arange(length)[None, :]
        seen = back >= 0
        own, read = asked.take(keys[:, length - n :], 0), given.take(keys, 0)
        k, v = read[:, :, : d + 1], read[:, :, d + 1 :]
        a = np.matmul(own[:, :, : d + 1], k.transpose(0, 2, 1))
        a += np.where(seen, self.p["r"][np.where(seen, back, 0)], np.float32(-1e9))
        if large:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        met = np.matmul(a, v)
        total = met[:, :, d:].copy()
        met /= total  # the last column is 1 now
        hidden = met.reshape(-1, d + 1).copy()
        hidden[:, :d] += own[:, :, d + 1 :].reshape(-1, d)
        return hidden, (own, k, v, a, met, total, back, seen)

    def head(self) -> np.ndarray:
        return np.concatenate((self.p["u"], self.p["c"][None, :]))

    def forward(self, keys: np.ndarray, n: int) -> tuple:
        """Logits of the ``n`` last positions of each row of symbols, and what the gradient needs."""
        hidden, kept = self.attend(keys, n, self.tables())
        return hidden @ self.head(), kept

    def room(self) -> np.ndarray:
        """Memory for the logits of some positions, few enough to stay near the processor."""
        classes = len(self.p["c"])
        return np.empty((max(1, BLOCK // classes), classes), np.float32)

    def blocks(self, hidden: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float]]:
        """(first, last, logits, how far from 0 they may be) of the rows of ``hidden``, block by block."""
        head = self.head()
        reach = _longest(hidden) * _longest(head.T)
        for at in range(0, len(hidden), len(room)):
            part = hidden[at : at + len(room)]
            yield at, at + len(part), np.matmul(part, head, out=room[: len(part)]), reach

    def log10(self, keys: np.ndarray, n: int, classes: np.ndarray, block: int = 1 << 11) -> np.ndarray:
        """Log10 probability of each last position's class, batch by batch."""
        out = np.empty(classes.size, np.float64)
        step, room, tables, flat = max(1, block // n), self.room(), self.tables(), classes.ravel()
        for at in range(0, len(keys), step):
            hidden, _ = self.attend(keys[at : at + step], n, tables)
            for first, last, logits, reach in self.blocks(hidden, room):
                part = slice(at * n + first, at * n + last)
                chosen = logits[np.arange(len(logits)), flat[part]]
                sums, off = _exponentials(logits, reach)
                out[part] = (chosen - off - np.log(sums)) / np.float32(np.log(10))
        return out.reshape(classes.shape)

    def log10_at(self, keys: np.ndarray, row: np.ndarray, classes: np.ndarray, block: int = 1 << 10) -> np.ndarray:
        """Log10 probability of each class after the symbols ``keys[row]``; ``row`` ascends, and
        what rows share is worked out once."""
        out, room, tables = np.empty(len(row), np.float64), self.room(), self.tables()
        for at in range(0, len(keys), block):
            hidden, _ = self.attend(keys[at : at + block], 1, tables)
            for first, last, logits, reach in self.blocks(hidden, room):
                begin, end = np.searchsorted(row, (at + first, at + last))
                own = row[begin:end] - (at + first)
                chosen = logits[own, classes[begin:end]]
                sums, off = _exponentials(logits, reach)
                out[begin:end] = (chosen - (off + np.log(sums))[own]) / np.float32(np.log(10))
        return out

    def gradients(self, x: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray | None = None, room: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the classes ``y`` (flat) at the last positions of ``x``; -1 does not count.

        With ``weight`` (one for each of ``y``) it is the weighted mean. What positions give to the
        projections is added up by symbol first: a projection is the same wherever a symbol stands.
        """
        p, length, d = self.p, x.shape[1], self.width
        scale = np.float32(d**-0.5)
        hidden, (own, k, v, a, met, total, back, seen) = self.attend(x, n, self.tables())
        counts = y >= 0
        share = (counts / np.float32(max(1, counts.sum())) if weight is None else weight * counts / weight.sum()).astype(np.float32)
        out, dh = np.zeros((len(p["c"]), d + 1), np.float32), np.empty((len(y), d), np.float32)
        chosen, row = np.maximum(y, 0), np.arange(len(y))
        for first, last, logits, reach in self.blocks(hidden, self.room() if room is None else room):
            sums, _ = _exponentials(logits, reach)
            logits[row[: last - first], chosen[first:last]] -= sums
            each = (share[first:last] / sums)[:, None]
            out += logits.T @ (hidden[first:last] * each)
            np.multiply(logits @ p["u"].T, each, out=dh[first:last])
        g = {"u": out[:, :d].T, "c": out[:, d]}
        dh = dh.reshape(len(x), n, d)
        passed = np.empty((len(x), n, d + 1), np.float32)
        np.divide(dh, total, out=passed[:, :, :d])
        passed[:, :, d] = -np.einsum("bij,bij->bi", passed[:, :, :d], met[:, :, :d])
        ds = np.matmul(passed, v.transpose(0, 2, 1))
        ds *= a
        g["r"] = np.bincount(back[seen], weights=ds.sum(0)[seen], minlength=len(p["r"])).astype(np.float32)
        if n == 1:  # plain products, and none for blanks, which are not seen
            at = np.flatnonzero(x.ravel() != BLANK)
            once = np.concatenate((own[:, 0, :d], passed[:, 0, :d]), 1).take(at // length, 0)
            once[:, :d] *= ds.ravel()[at, None]
            once[:, d:] *= a.ravel()[at, None]
            given = _sums(x.ravel()[at], once)
        else:
            moved = np.empty((len(x), length, 2 * d), np.float32)
            np.matmul(ds.transpose(0, 2, 1), own[:, :, :d], out=moved[:, :, :d])
            np.matmul(a.transpose(0, 2, 1), passed[:, :, :d], out=moved[:, :, d:])
            given = _sums(x.ravel(), moved.reshape(-1, 2 * d))
        moved = np.empty((len(x), n, 2 * d), np.float32)
        np.matmul(ds, k[:, :, :d], out=moved[:, :, :d])
        moved[:, :, d:] = dh
        asked = _sums(x[:, length - n :].ravel(), moved.reshape(-1, 2 * d))
        asked[:, :d] *= scale
        g["q"], g["k"], g["v"] = p["e"].T @ asked[:, :d], p["e"].T @ given[:, :d], p["e"].T @ given[:, d:]
        g["e"] = asked[:, d:] + asked[:, :d] @ p["q"].T + given[:, :d] @ p["k"].T + given[:, d:] @ p["v"].T
        return g

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def restore(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size


class Learner:
    """Adam for one layer, through batches of any number of chunks."""

    def __init__(self, net: Attention, n: int, batch: int, rate: float) -> None:
        self.net, self.n, self.batch, self.rate, self.turn = net, n, batch, rate, 0
        self.whole, at = net.flat(), 0
        for k in sorted(net.p):  # from now on parts of one vector
            net.p[k] = self.whole[at : at + net.p[k].size].reshape(net.p[k].shape)
            at += net.p[k].size
        self.first, self.second = np.zeros_like(self.whole), np.zeros_like(self.whole)
        self.room = net.room()

    def through(self, keys: np.ndarray, classes: np.ndarray, weight: np.ndarray | None = None) -> None:
        """One step for each batch of the rows, in their order."""
        for at in range(0, len(keys), self.batch):
            self.turn += 1
            part = slice(at, at + self.batch)
            g = self.net.gradients(keys[part], self.n, classes[part].ravel(), None if weight is None else weight[part], self.room)
            g = np.concatenate([g[k].ravel() for k in sorted(g)])
            now = self.rate * min(1.0, self.turn / 20)
            self.first += np.float32(0.1) * (g - self.first)
            self.second += np.float32(0.01) * (g * g - self.second)
            size = np.sqrt(self.second * np.float32(1 / (1 - 0.99**self.turn))) + np.float32(1e-6)
            self.whole -= np.float32(now / (1 - 0.9**self.turn)) * self.first / size


@dataclass
class Model:
    """First subwords see the first subwords of the words before; later ones see their word.

    The later subwords of every word together follow a mixture: with ``1 - new`` the counts of
    the known words that begin alike, with ``new`` attention over the word so far, scored once
    for each distinct word of the corpus. ``new`` is, for each first subword, the share of training tokens that are words seen once:
    how often a word that begins so is likely to be new.
    """

    lead: Events
    later: Events
    across: Attention
    inside: Attention
    begun: np.ndarray
    new: np.ndarray

    def windows(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols by window, whether the window before is of the same text, place of each token) of
        texts of first subwords, given as the symbols that stand for them.

        A text starts a window, so that its score does not depend on its neighbours; windows
        follow one another by ``SCORED`` positions and see as many before those.
        """
        size = np.diff(starts)
        count = -(-size // SCORED)
        first = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat(first[:-1] * SCORED - starts[:-1], size)
        place += np.arange(starts[-1])
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[starts[:-1]] = START
        read = np.full(first[-1] * SCORED, BLANK, symbols.dtype)
        read[place] = before
        follows = np.ones(first[-1], bool)
        follows[first[:-1]] = False
        return read.reshape(-1, SCORED), follows, place

    @staticmethod
    def seen(read: np.ndarray, follows: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """All symbols that these windows see: of the window before, if it is of the text, and their own."""
        before = read[windows - 1]
        before[~follows[windows]] = BLANK
        return np.concatenate((before, read[windows]), 1)

    def word_windows(self, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, events, word) of every later subword, the word's end included."""
        size = np.diff(ends, prepend=0)
        word = np.repeat(np.arange(len(ends)), size)
        inside = np.arange(len(pieces)) - (ends - size)[word]
        symbol = self.later.symbol[pieces]
        keys = np.full((len(pieces), IN_WORD), BLANK, np.int32)
        for back in range(min(IN_WORD, len(pieces))):
            keys[back:, IN_WORD - 1 - back] = np.where(inside[back:] >= back, symbol[: len(pieces) - back], BLANK)
        events = np.full(len(pieces), STOP, np.int32)
        events[:-1] = np.where(word[1:] == word[:-1], pieces[1:], STOP) if len(pieces) else 0
        return keys, events, word

    def mix(self, spelled: np.ndarray, count: np.ndarray, begun: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Log10 probability of a word given its first subword: by spelling, and by counts where it is known."""
        share = np.where(begun > 0, new, 1.0)
        return np.log10(share * 10.0**np.maximum(spelled, -300) + (1 - share) * count / np.maximum(begun, 1))

    def word_scores(self, page: dict) -> np.ndarray:
        """Log10 probability of every word of a page given its first subword; nothing follows an end."""
        pieces, ends = _pieces(page)
        lead, count = leads_of(pieces, ends), np.frombuffer(page["totals"], np.int64)
        keys, events, word = self.word_windows(pieces, ends)
        order, first = _alike(_names(keys))
        row, classes = np.repeat(np.arange(len(first)), np.diff(first, append=len(order))), self.later.place[events]
        each = self.later.within[events]
        each[order] += self.inside.log10_at(keys[order[first]], row, classes[order])
        spelled = np.bincount(word, weights=each, minlength=len(ends))
        return np.where(lead == STOP, 0.0, self.mix(spelled, count, self.begun[lead], self.new[lead]))

    def token_scores(self, row: dict, by_word: np.ndarray) -> np.ndarray:
        """Log10 probability of every token of a chunk, whose words score so after their first subwords."""
        lead, stream = np.frombuffer(row["leads"], np.uint16), _stream(row)
        read, follows, place = self.windows(self.lead.symbol[lead][stream], np.frombuffer(row["starts"], np.int64))
        classes = np.zeros(read.size, np.int32)
        classes[place] = self.lead.place[lead][stream]
        scored = self.across.log10(self.seen(read, follows, np.arange(len(read))), SCORED, classes.reshape(read.shape))
        return scored.ravel()[place] + (by_word + self.lead.within[lead])[stream]


def leads_of(pieces: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First subword of each word; the end of a text is ``STOP``."""
    first = ends - np.diff(ends, prepend=0)
    if not len(pieces):
        return np.full(len(ends), STOP, np.int32)
    lead = pieces[np.minimum(first, len(pieces) - 1)].astype(np.int32)
    lead[ends == first] = STOP
    return lead


def _lessons(model: Model, row: dict, turn: int, rounds: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """(symbols, classes) of both layers that a row gives in one round, for later subwords with weights.

    A chunk's training windows are put in a seeded order and dealt out to the rounds; each is
    learnt from once. So is every later subword of the training words of a page (or of a chunk that
    holds its words' counts): what the model reads and
    predicts alike is one row, with the counts of all its words as weight. A row above the mean weight is
    dealt out as several that share it, so that no step is left to one frequent word; none is left
    out.
    """
    draw = np.random.default_rng((seed, row["chunk"]))
    out: list[tuple[np.ndarray, ...]] = [(np.empty((0, CONTEXT), np.int32), np.empty((0, SCORED), np.int32))]
    if "starts" in row:
        lead, stream, starts = np.frombuffer(row["leads"], np.uint16), _stream(row), np.frombuffer(row["starts"], np.int64)
        read, follows, place = model.windows(model.lead.symbol[lead][stream], starts)
        classes = np.full(read.size, -1, np.int32)
        classes[place] = model.lead.place[lead][stream]
        known = np.flatnonzero(np.repeat(np.frombuffer(row["held"], np.uint8) == 0, -(-np.diff(starts) // SCORED)))
        known = draw.permutation(known)[: int(np.ceil(LEARNT * len(known)))][turn::rounds]
        out = [(model.seen(read, follows, known), classes.reshape(read.shape)[known])]
    if "pieces" not in row:
        return out
    keys, events, word = model.word_windows(*_pieces(row))
    counts = np.frombuffer(row["totals"], np.int64) if "totals" in row else np.frombuffer(row["counts"], np.int32)
    n, classes = counts[word], model.later.place[events]
    some = np.flatnonzero(n)
    order, first = _alike((_names(keys) + classes.astype(np.uint64) * MIXERS[-1])[some])
    order = some[order]
    n, one = np.add.reduceat(n[order].astype(np.float64), first) if len(first) else np.empty(0), order[first]
    copies = np.ceil(n * (len(n) / max(1.0, n.sum()))).astype(np.int64)
    dealt = draw.permutation(np.repeat(np.arange(len(n)), copies))[turn::rounds]
    weight = (n[dealt] / copies[dealt]).astype(np.float32)
    rows = one[dealt]
    return [*out, (keys[rows], classes[rows][:, None], weight)]


def _learn(model: Model, turn: int, rounds: int, seed: int):
    """In a task: both layers after its chunks, as one row of weights with the rows they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nets = (model.across, model.inside)
        rate = 0.02 * (1 - turn / rounds)
        learners = [Learner(net, n, size, rate) for net, n, size in zip(nets, (SCORED, 1), BATCHES, strict=True)]
        seen, again = [0, 0], [[], []]
        for batch in batches:
            for i in range(batch.num_rows):
                for k, lesson in enumerate(_lessons(model, batch.slice(i, 1).to_pylist()[0], turn, rounds, seed)):
                    for _ in range(PASSES[k]):
                        learners[k].through(*lesson)
                    seen[k] += len(lesson[0])
                    if learners[k].turn < STEPS:
                        again[k].append(lesson)
                    else:
                        again[k] = []
        for learner, held in zip(learners, again, strict=True):
            while any(len(x[0]) for x in held) and learner.turn < STEPS:
                for lesson in held:
                    learner.through(*lesson)
        for k, net in enumerate(nets):
            if seen[k]:
                task = TaskContext.get().partitionId()
                columns = [pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([float(seen[k])]), pa.array([net.flat().astype(np.float64)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["layer", "task", "seen", "flat"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights by layer, weighed by what they have seen; one row in memory at a time."""
    total: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for k, n, flat in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            before = total.get(k, (0.0, 0.0))
            total[k] = (before[0] + n, before[1] + n * flat.values.to_numpy())
    for k, (n, flat) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([flat], pa.list_(pa.float64()))], ["layer", "seen", "flat"])


def train(cut: DataFrame, pages: DataFrame, counts: np.ndarray, seed: int = 5, rounds: int = ROUNDS) -> Model:
    """Attention weights from the training documents of all chunks and the words of all pages.

    In each round every task starts from the same weights and takes seeded steps over its own
    chunks or pages; the weights, of a fixed size, are averaged in groups of tasks and then over
    ``GROUPS`` groups.
    """
    begun, once = counts[0], counts[2]
    model = Model(
        Events.of(counts[0], LEAD_SHAPE[0]), Events.of(counts[1], LATER_SHAPE[0]), Attention(CONTEXT, LEAD_SHAPE, seed),
        Attention(IN_WORD, LATER_SHAPE, seed + 1), begun, np.minimum(0.9, (once + 1) / (begun + 2)),
    )
    for net, events, known in ((model.across, model.lead, counts[0]), (model.inside, model.later, counts[1])):
        share = np.bincount(events.place, weights=known, minlength=len(net.p["c"])) + 1.0
        net.p["c"][:] = np.log(share / share.sum())
    made_of = [cut.select("chunk", "held", "starts", "low", "high", "leads"), pages.select("chunk", "totals", "pieces", "sizes")]
    for turn in range(rounds):
        parts = [x.mapInArrow(_learn(model, turn, rounds, seed), "layer int, task int, seen double, flat array<double>") for x in made_of]
        dealt = parts[0].unionAll(parts[1]).repartition(GROUPS, F.pmod("task", F.lit(GROUPS))).sortWithinPartitions("task", "layer")
        found = dealt.mapInArrow(_added, "layer int, seen double, flat array<double>").toArrow().sort_by([("layer", "ascending"), ("seen", "ascending")])
        for k, net in enumerate((model.across, model.inside)):
            own = found.filter(pa.compute.equal(found["layer"], k))
            if own.num_rows:
                total = sum(np.asarray(x.values.to_numpy()) for x in own["flat"].combine_chunks())
                net.restore(total / sum(own["seen"].to_pylist()))
    return model


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def language_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    The base is an add-one unigram model over words and the end of a text, with counts from all
    training documents: words are counted by chunk, added up by word, and sent back with their
    spellings' scores to the chunks that hold them, so neither a vocabulary nor a document is
    collected or broadcast.
    The model's score is the log10 probability of the text as subword ids: each first subword
    of a word given the first subwords of up to 31 words before it, each later one, and the
    word's end, given its word so far and, for known words, the words' counts; then the end of
    the text. A null or empty text is its
    end alone. With no training documents all counts are zero and the model is untrained.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held"))
    cut = staged(chunks(source, folder, chunk_bytes), "chunks", "zstd")
    pairs = cut.select("names", "counts", "pieces", "sizes").mapInArrow(_word_counts, "name long, n long, pieces binary")
    words = pairs.groupBy("name", "pieces").agg(F.sum("n").alias("c")).sortWithinPartitions("name")
    pages = staged(vocabulary(words), "pages", "zstd")
    counts = piece_counts(pages)
    total, kinds = int(counts[0].sum()), int(counts[3].sum())
    model = train(cut, pages, counts)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                columns = [np.frombuffer(page["names"], np.int64), np.frombuffer(page["totals"], np.int64), model.word_scores(page).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["name", "c", "spelled"])

    places = cut.select("chunk", "names").mapInArrow(_word_places, "chunk long, number int, name long")
    spelled = pages.mapInArrow(spell, "name long, c long, spelled float")
    back = places.join(spelled, "name").groupBy("chunk").agg(F.collect_list(F.struct("number", "c", "spelled")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known_column = batch.column(batch.schema.get_field_index("known"))
            rows = batch.select([n for n in batch.schema.names if n != "known"])
            for i in range(batch.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                found = known_column[i].values
                stream, starts = _stream(row), np.frombuffer(row["starts"], np.int64)
                c, by_word = np.zeros(len(found), np.int64), np.zeros(len(found))
                number = found.field("number").to_numpy()
                c[number], by_word[number] = found.field("c").to_numpy(), found.field("spelled").to_numpy()
                base = np.log10((c + 1.0) / (total + kinds + 1.0))
                first = starts[:-1]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.frombuffer(row["held"], np.uint8) > 0),
                    pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat((c > 0)[stream].astype(np.int64), first)),
                    pa.array(np.full(len(first), total, np.int64)),
                    pa.array(np.add.reduceat(base[stream], first)),
                    pa.array(np.add.reduceat(model.token_scores(row, by_word), first)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    slim = cut.select("chunk", "doc_ids", "held", "starts", "low", "high", "leads")
    return slim.join(back, "chunk").select(*slim.columns, "known").mapInArrow(run, SCORES)
