"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import fresh

#: Labelled documents that the field is fitted on, and their length in characters, at most.
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 20_000
#: Bytes of text whose lines are scored together.
BLOCK = 2 << 20

_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\r",
    b".,;:?'\"()-",
    b"!",
    b"|",
    b"#$%&*+/<=>@[\\]^_`{}~",
    bytes(range(128, 256)),
)
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_c, np.uint8)] = _i
_STEPS = (0.0, 0.03, 0.12, 0.4)
#: Features of one line, and of a line with its neighbours.
OWN = 6 + (len(_CLASSES) + 1) * (1 + len(_STEPS))
WIDTH = 3 * OWN


@dataclass(frozen=True)
class Field:
    """Weights of the good state, transition scores (from, to), and the document calibration."""

    weights: np.ndarray
    moves: np.ndarray
    scale: float
    shift: float


#: Weights that tell words apart by the sum over their bytes.
_SPREAD = np.random.default_rng(11).integers(1, 2**40, 256)


def _repeats(data: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One at the first byte of each word that equals the word before it, else zero."""
    mark = np.zeros(len(data), np.int8)
    inside = (kinds != 3) & (data != 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.insert(inside[:-1], 0, False)))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    total = np.concatenate(([0], np.cumsum(_SPREAD[data])))
    name = total[ends] - total[starts]
    mark[starts[1:][name[1:] == name[:-1]]] = 1
    return mark


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, first line of each document and the end) of UTF-8 texts laid end to end.

    A line ends at a newline; a text always has one line more than newlines. Each line carries
    its own features and those of the lines before and after it in its document.
    """
    docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(offsets, breaks - 1, "right") - 1
    begins = np.concatenate((offsets[:-1], breaks))
    doc = np.concatenate((np.arange(docs), owner))
    order = np.lexsort((begins, doc))
    begins, doc = begins[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True) if docs else np.zeros(0, bool)
    ends = np.empty_like(begins)
    ends[:-1] = begins[1:] - 1
    ends[last] = offsets[1:]
    length = ends - begins
    kinds = _CLASS[data]
    size = np.maximum(length, 1)
    columns = []
    counts = np.empty((len(_CLASSES) + 1, len(begins)), np.float32)
    for k, marked in enumerate([*(kinds == k for k in range(len(_CLASSES))), _repeats(data, kinds, offsets)] if len(data) else []):
        total = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
        counts[k] = total[ends] - total[begins]
    if not len(data):
        counts[:] = 0
    words = counts[3] + 1
    ratio = counts / size
    ratio[-1] = counts[-1] / words
    columns += [np.ones(len(begins)), length == 0, np.log1p(length) / 8, (length > 0) & (length < 30), length / words / 10]
    tail = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    columns.append((length > 0) & ((tail == 46) | (tail == 33) | (tail == 63)))
    for k in range(len(ratio)):
        columns += [ratio[k], *(ratio[k] > s for s in _STEPS)]
    own = np.stack(columns, 1).astype(np.float32)
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    first = np.insert(last[:-1], 0, True) if len(last) else last
    before[first] = 0
    after = np.zeros_like(own)
    after[:-1] = own[1:]
    after[last] = 0
    starts = np.searchsorted(doc, np.arange(docs + 1))
    return np.concatenate((own, before, after), 1), length, starts


def _chain(score: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition by document, P(good) by line, expected moves by document) in log space.

    Documents advance together, line by line, the longest first, so that those still running
    are a leading slice.
    """
    lines = np.diff(starts)
    order = np.argsort(-lines, kind="stable")
    lines, begin = lines[order], starts[:-1][order]
    n, longest = len(lines), int(lines.max(initial=0))
    alpha = np.zeros((len(score), 2))
    beta = np.zeros((len(score), 2))
    alive = [int(np.searchsorted(-lines, -t, "left")) for t in range(longest + 1)]  # lines > t
    for t in range(longest):
        at = begin[: alive[t]] + t
        if t:
            step = alpha[at - 1][:, :, None] + moves
            alpha[at] = np.logaddexp(step[:, 0], step[:, 1])
        alpha[at, 1] += score[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        step = beta[at + 1] + np.stack((np.zeros(len(at)), score[at + 1]), 1)
        step = moves[None] + step[:, None, :]
        beta[at] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    total = np.zeros(n)
    some = lines > 0
    ends = begin[some] + lines[some] - 1
    total[some] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    by_line = np.repeat(total, lines)
    where = np.repeat(begin - np.concatenate(([0], np.cumsum(lines)[:-1])), lines) + np.arange(lines.sum())
    logz = np.empty(len(score))
    logz[where] = by_line
    good = np.exp(alpha[:, 1] + beta[:, 1] - logz)
    expected = np.zeros((n, 2, 2))
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        pair = alpha[at - 1][:, :, None] + moves + (beta[at] + np.stack((np.zeros(len(at)), score[at]), 1))[:, None, :]
        expected[: alive[t]] += np.exp(pair - logz[at][:, None, None])
    out_total, out_moves = np.empty(n), np.empty((n, 2, 2))
    out_total[order], out_moves[order] = total, expected
    return out_total, good, out_moves


def _weighted(good: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals by document; empty lines weigh one."""
    weight = np.maximum(length, 1)
    cum = np.concatenate(([0], np.cumsum(good * weight)))
    mass = np.concatenate(([0], np.cumsum(weight, dtype=np.int64)))
    return (cum[starts[1:]] - cum[starts[:-1]]) / np.maximum(mass[starts[1:]] - mass[starts[:-1]], 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.05, ridge: float = 1e-4) -> Field:
    """Maximum likelihood with each line labelled as its document, by Adam; then the calibration.

    With no texts, or labels of one kind only, the field says the smoothed share of good
    labels for every document.
    """
    y = np.array(labels, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(_logit(np.array(prior))))
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in raw]))).astype(np.int64)
    x, length, starts = line_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    lines = np.diff(starts)
    share = 1 / np.maximum(lines, 1) / len(lines)
    line_y, line_share = np.repeat(y, lines), np.repeat(share, lines)
    seen = np.zeros((2, 2))
    seen[1, 1] = ((lines - 1) * share * y).sum()
    seen[0, 0] = ((lines - 1) * share * (1 - y)).sum()
    theta = np.zeros(WIDTH + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        score = x @ theta[:WIDTH]
        _, good, moves = _chain(score, starts, theta[WIDTH:].reshape(2, 2))
        grad = np.concatenate((x.T @ ((line_y - good) * line_share), (seen - (moves * share[:, None, None]).sum(0)).ravel()))
        grad -= ridge * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    moves = theta[WIDTH:].reshape(2, 2).copy()
    _, good, _ = _chain(x @ theta[:WIDTH], starts, moves)
    z = _logit(_weighted(good, length, starts))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton, with a weak pull of the scale towards one
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * z).sum() - (a - 1), (y - p).sum() - 0.01 * b])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return Field(theta[:WIDTH].copy(), moves, max(a, 0.0), b)


def score_texts(field: Field, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Calibrated score of each text in a buffer of UTF-8 laid end to end."""
    x, length, starts = line_features(data, offsets)
    _, good, _ = _chain(x.astype(float) @ field.weights, starts, field.moves)
    z = _logit(_weighted(good, length, starts))
    return 1 / (1 + np.exp(-np.clip(field.scale * z + field.shift, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on at most ``sample_docs`` labelled documents of ``sample_chars`` at most.

    They are chosen by a hash of the doc_id, from rows that ``held_out`` does not mark. Null
    labels are left out; of rows that repeat a doc_id in ``labels`` the lower label counts.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        marked = marked.where(~held_out)
    chosen = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs)
    short = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= sample_chars)
    rows = short.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample_docs).collect()
    return fit([r.text for r in rows], [r.quality for r in rows])


def with_score(docs: DataFrame, field: Field, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double ``out`` between 0 and 1; null and empty texts are one empty line."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            begin, held = 0, 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            cuts = []
            for i, n in enumerate(sizes):
                held += int(n)
                if held >= BLOCK:
                    cuts.append((begin, i + 1))
                    begin, held = i + 1, 0
            cuts.append((begin, len(sizes)))
            scores = []
            for a, b in cuts:
                part = pa.compute.fill_null(batch.column(at).slice(a, b - a), "")
                raw = b"".join(x.as_buffer() for x in part)
                offsets = np.concatenate(([0], np.cumsum(sizes[a:b]))).astype(np.int64)
                scores.append(score_texts(field, np.frombuffer(raw, np.uint8), offsets))
            columns = [*batch.columns, pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, out])

    import pyarrow.compute  # noqa: F401  so that pa.compute is there in the tasks as well

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether the CRC-32 of the doc_id as text leaves ``part``; a null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    field = train(docs, labels, held_out=held_out(F.col("doc_id")))
    scored = with_score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more; columns unchanged."""
    field = train(docs, labels, held_out=held_out(F.col("doc_id")))
    out = fresh(docs.columns, "score")
    return with_score(docs, field, out=out).where(F.col(out) >= cut).drop(out)
