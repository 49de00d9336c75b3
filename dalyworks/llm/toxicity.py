"""Toxicity from a bidirectional gated recurrent network with attention over word windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import fresh

#: Labelled documents of each label that the network is fitted on, and their characters, at most.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 8000
#: Words of a window, and words from one window to the next.
WINDOW = 32
STEP = 16
#: Rows of the word and of the character table, their width, and that of a state and of attention.
ROWS = 1 << 13
WIDTH = 8
STATE = 8
FOCUS = 8
#: Words that a task remembers, windows that go through the network together, bytes cut into
#: words at once.
WORDS = 100_000
BATCH = 1024
PIECE = 1 << 20

#: Lowers A-Z; all other ASCII but a-z and 0-9 becomes white space.
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))

Net = dict[str, np.ndarray]


def word_list(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; no word is cut."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        while end < len(text) and _CUT[text[end]] != 32:
            end += 1
        yield text[begin:end].translate(_CUT).split()
        begin = end


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the character table by word, end to end; how many each word has).

    A word has all its trigrams, its two ends marked, and its beginnings of two to six bytes.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint32)
    start = np.cumsum(length + 2) - (length + 2)
    heads = np.clip(length, 1, 6) - 1
    size = length + heads
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    spread = np.uint32(0x01000193)

    def row(name: np.ndarray) -> np.ndarray:
        return ((name ^ (name >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(ROWS)

    three = (data[:-2] * spread + data[1:-1]) * spread + data[2:]
    inside = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    out[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(len(inside))] = row(three[inside])
    name = np.full(len(words), 0x811C9DC5, np.uint32)
    for k in range(1, 7):
        some = np.flatnonzero(length >= k)
        name[some] = (name[some] ^ data[start[some] + k]) * spread
        if k > 1:
            out[begin[some] + length[some] + k - 2] = row(name[some])
    return out, size


class Words:
    """Numbers of distinct words, with their rows in the two tables."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.row, self.flat, self.size = (np.empty(0, np.int64) for _ in range(3))
        self.begin = self.size
        self.new: list[bytes] = []

    def ids(self, words: list[bytes]) -> np.ndarray:
        for w in sorted(set(words).difference(self.number)):
            self.number[w] = len(self.number)
            self.new.append(w)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def settle(self) -> None:
        """Gives the words met since the last time their rows."""
        if self.new:
            flat, size = grams(self.new)
            self.row = np.concatenate((self.row, np.array([zlib.crc32(w) % ROWS for w in self.new])))
            self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
            self.begin = np.cumsum(self.size) - self.size
            self.new = []

    def inputs(self, net: Net, some: np.ndarray, lost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, word rows, character rows end to end, how many each has) of some words.

        Words in ``lost`` get the last row of the word table in place of their own.
        """
        row, size = self.row[some], self.size[some]
        if lost is not None:
            row = np.where(lost, ROWS - 1, row)
        first = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.begin[some] - first, size) + np.arange(int(size.sum()))]
        if not len(some):
            return np.zeros((0, 2 * WIDTH), np.float32), row, flat, size
        chars = np.add.reduceat(net["chars"][flat], first, 0) / size[:, None].astype(np.float32)
        return np.concatenate((net["words"][row], chars), 1), row, flat, size


def new_net(seed: int = 7) -> Net:
    draw = np.random.default_rng(seed)
    shape = {
        "words": (ROWS, WIDTH), "chars": (ROWS, WIDTH), "inward": (2, 2 * WIDTH, 3 * STATE), "shift": (2, 3 * STATE), "across": (2, STATE, 3 * STATE),
        "look": (2 * STATE, FOCUS), "look_shift": (FOCUS,), "focus": (FOCUS,), "out": (2 * STATE,), "bias": (1,),
    }
    scale = {"words": 0.1, "chars": 0.3, "inward": 0.4, "across": 0.3, "look": 0.3, "focus": 0.3, "out": 0.3}
    net = {k: (draw.normal(size=s) * scale.get(k, 0)).astype(np.float32) for k, s in shape.items()}
    net["bias"][:] = -3
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words; every word is in one, most in two."""
    return np.arange(0, max(1, n - (WINDOW - STEP)), STEP)


def forward(net: Net, project: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """(score of each window, with ``keep`` what the backward pass needs).

    ``project`` has each word's inputs to both directions, (2, words, 3 STATE); ``ids`` the words
    of the windows, (windows, WINDOW), -1 where a window has none.
    """
    n, width = len(ids), ids.shape[1]
    turned = np.maximum(ids.T, 0)
    x = np.empty((width, 2, n, 3 * STATE), np.float32)
    there = (ids.T >= 0).astype(np.float32)
    mask = np.empty((width, 2, n, 1), np.float32)
    x[:, 0], x[:, 1] = project[0][turned], project[1][turned[::-1]]
    mask[:, 0, :, 0], mask[:, 1, :, 0] = there, there[::-1]
    states = np.empty((width, 2, n, STATE), np.float32)
    kept = []
    h = np.zeros((2, n, STATE), np.float32)
    for t in range(width):
        a = h @ net["across"]
        gates = _sigmoid(x[t, :, :, : 2 * STATE] + a[:, :, : 2 * STATE])
        fresh_ = np.tanh(x[t, :, :, 2 * STATE :] + gates[:, :, STATE:] * a[:, :, 2 * STATE :])
        open_ = (1 - gates[:, :, :STATE]) * mask[t]
        if keep:
            kept.append((h, a, gates, fresh_, open_))
        h = h + open_ * (fresh_ - h)
        states[t] = h
    both = np.concatenate((states[:, 0], states[::-1, 1]), -1)
    seen = np.tanh(both @ net["look"] + net["look_shift"])
    weight = np.exp(seen @ net["focus"]) * there
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    return pooled @ net["out"] + net["bias"][0], {"kept": kept, "mask": mask, "both": both, "seen": seen, "weight": weight, "pooled": pooled}


def backward(net: Net, kept: dict, slope: np.ndarray) -> tuple[Net, np.ndarray]:
    """(gradients of the weights, of the inputs (WINDOW, 2, windows, 3 STATE)) for d loss / d score."""
    both, seen, weight = kept["both"], kept["seen"], kept["weight"]
    width, n = weight.shape
    grad = {"out": slope @ kept["pooled"], "bias": slope.sum(keepdims=True)}
    pooled = slope[:, None] * net["out"]
    d_both = weight[:, :, None] * pooled
    d_weight = np.einsum("bh,tbh->tb", pooled, both)
    d_focus = weight * (d_weight - (weight * d_weight).sum(0))
    grad["focus"] = np.einsum("tb,tba->a", d_focus, seen)
    d_seen = d_focus[:, :, None] * net["focus"] * (1 - seen * seen)
    grad["look"] = np.einsum("tbh,tba->ha", both, d_seen)
    grad["look_shift"] = d_seen.sum((0, 1))
    d_both += d_seen @ net["look"].T
    grad["across"] = np.zeros_like(net["across"])
    d_x = np.empty((width, 2, n, 3 * STATE), np.float32)
    d_h = np.zeros((2, n, STATE), np.float32)
    back = net["across"].transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        h, a, gates, fresh_, open_ = kept["kept"][t]
        d_h[0] += d_both[t, :, :STATE]
        d_h[1] += d_both[width - 1 - t, :, STATE:]
        d_open = d_h * (fresh_ - h) * kept["mask"][t]
        d_fresh = d_h * open_ * (1 - fresh_ * fresh_)
        z, r = gates[:, :, :STATE], gates[:, :, STATE:]
        d_x[t, :, :, :STATE] = -d_open * z * (1 - z)
        d_x[t, :, :, STATE : 2 * STATE] = d_fresh * a[:, :, 2 * STATE :] * r * (1 - r)
        d_x[t, :, :, 2 * STATE :] = d_fresh
        d_a = d_x[t].copy()
        d_a[:, :, 2 * STATE :] *= r
        grad["across"] += h.transpose(0, 2, 1) @ d_a
        d_h = d_h * (1 - open_) + d_a @ back
    return grad, d_x


def _windowed(ids: np.ndarray) -> np.ndarray:
    at = windows(len(ids))[:, None] + np.arange(WINDOW)
    return np.where(at < len(ids), ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else -1, -1)


def _pool(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Log of the sum of the exponentials of a document's window scores; each has one at least."""
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    top = np.maximum.reduceat(score, begin)
    return top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, np.diff(np.append(begin, len(score))))), begin))


def gradients(net: Net, words: Words, bags: list[np.ndarray], y: np.ndarray, draw: np.random.Generator | None = None, drop: float = 0.0) -> tuple[Net, float]:
    """Gradients of the mean logistic loss of documents (their windows), and the loss."""
    ids = np.concatenate(bags)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    some, at = np.unique(ids[ids >= 0], return_inverse=True)
    local = np.full(ids.shape, -1, np.int64)
    local[ids >= 0] = at
    x, row, flat, size = words.inputs(net, some, draw.random(len(some)) < drop if draw is not None else None)
    project = (x @ net["inward"] + net["shift"][:, None, :]) if len(x) else np.zeros((2, 1, 3 * STATE), np.float32)
    score, kept = forward(net, project, local, keep=True)
    z = _pool(score, owner)
    p = _sigmoid(z)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    slope = ((p - y) / len(y))[owner] * np.exp(score - z[owner])
    grad, d_x = backward(net, kept, slope.astype(np.float32))
    d_project = np.zeros_like(project)
    for way, turned in ((0, local.T), (1, local.T[::-1])):
        inside = turned >= 0
        if inside.any():
            number, value = turned[inside], d_x[:, way][inside]
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[order], prepend=-1))
            d_project[way, number[order][first]] = np.add.reduceat(value[order], first, 0)
    grad["words"], grad["chars"] = np.zeros_like(net["words"]), np.zeros_like(net["chars"])
    grad["shift"] = d_project.sum(1)
    grad["inward"] = x.T @ d_project if len(x) else np.zeros_like(net["inward"])
    if len(x):
        d_input = (d_project @ net["inward"].transpose(0, 2, 1)).sum(0)
        np.add.at(grad["words"], row, d_input[:, :WIDTH])
        np.add.at(grad["chars"], flat, np.repeat(d_input[:, WIDTH:] / size[:, None].astype(np.float32), size, 0))
    return grad, loss


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through weighted labels, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9) * weight
        g = np.array([((y - p) * weight * z).sum() - (a - 1), ((y - p) * weight).sum() - 0.01 * b])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -0.5, 0.5)), b + float(np.clip(step[1], -0.5, 0.5))
    return max(a, 0.05), b


def fit(texts: list[str], labels: list[int], share: float | None = None, rounds: int = 10, steps: int = 350, rate: float = 0.01, group: int = 32, drop: float = 0.5, seed: int = 7) -> Net:
    """A network whose documents' pooled window scores tell label 1, with its calibration.

    Four documents in five are trained on with Adam, in ``rounds`` over all of them or more where
    these are fewer than ``steps``; in each step a word in ``1 / drop`` loses its
    row of the word table, so that characters are learnt too. The fifth calibrates the scores to
    ``share``, the part of label 1 among all labelled documents. With labels of one kind or none
    every document gets their smoothed share.
    """
    y = np.array(labels, np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2)) if share is None else share
    net = new_net(seed)
    if not len(y) or y.min() == y.max():
        return net | {"scale": np.zeros(1), "base": np.array([np.log(prior / (1 - prior))])}
    words = Words()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bags = [_windowed(np.concatenate([np.empty(0, np.int32), *(words.ids(p) for p in word_list(x))])) for x in raw]
    words.settle()
    draw = np.random.default_rng(seed)
    mixed = draw.permutation(len(y))
    aside = mixed[::5] if len(y) >= 50 else mixed
    train = np.setdiff1d(mixed, aside) if len(y) >= 50 else mixed
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    turn = 0
    rounds = max(rounds, -(-steps * group // len(train)))
    for round_ in range(rounds):
        order = draw.permutation(train)
        for k in range(0, len(order), group):
            turn += 1
            some = order[k : k + group]
            grad, _ = gradients(net, words, [bags[i] for i in some], y[some], draw, drop)
            pace = rate * (1 - round_ / rounds)
            for name, value in grad.items():
                first[name] += 0.1 * (value - first[name])
                second[name] += 0.01 * (value * value - second[name])
                net[name] = net[name] - pace * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-8)
    scorer = Scorer(net | {"scale": np.ones(1), "base": np.zeros(1)})
    z = scorer.pooled([raw[i] for i in aside])
    part = float(np.clip(y[aside].mean(), 1e-3, 1 - 1e-3))
    weight = np.where(y[aside] > 0, prior / part, (1 - prior) / (1 - part))
    scale, base = _calibrated(z, y[aside], weight)
    return {k: np.asarray(v, np.float32) for k, v in net.items()} | {"scale": np.array([scale]), "base": np.array([base])}


class Scorer:
    """Scores texts; the inputs of up to ``WORDS`` distinct words are remembered between texts."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.words, self.known, self.project = Words(), 0, np.zeros((2, 1 << 10, 3 * STATE), np.float32)

    def _project(self) -> None:
        self.words.settle()
        new = np.arange(self.known, len(self.words.row))
        if len(new):
            if len(self.words.row) > self.project.shape[1]:
                self.project = np.concatenate((self.project, np.zeros((2, len(self.words.row), 3 * STATE), np.float32)), 1)
            self.project[:, self.known : len(self.words.row)] = self.words.inputs(self.net, new)[0] @ self.net["inward"] + self.net["shift"][:, None, :]
            self.known = len(self.words.row)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        self._project()
        parts = [forward(self.net, self.project, ids[k : k + BATCH])[0] for k in range(0, len(ids), BATCH)]
        return np.concatenate(parts).astype(np.float64)

    def long(self, text: bytes) -> float:
        """The pooled score of one text, a piece at a time; windows reach over pieces."""
        total, rest = -np.inf, []
        for words in word_list(text):
            if len(self.words.number) > WORDS:
                self.forget()
            rest += words
            full = (len(rest) - WINDOW) // STEP
            if full > 0:  # the last window is left for the end: it may be filled further
                ids = self.words.ids(rest[: (full - 1) * STEP + WINDOW])
                total = np.logaddexp(total, np.logaddexp.reduce(self.scores(_windowed(ids))))
                rest = rest[full * STEP :]
        return float(np.logaddexp(total, np.logaddexp.reduce(self.scores(_windowed(self.words.ids(rest))))))

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        bags, places = [], []
        for k, text in enumerate(texts):
            if len(text) > PIECE:
                self._flush(bags, places, out)  # their words may be forgotten
                out[k] = self.long(text)
                continue
            if not bags and len(self.words.number) > WORDS:
                self.forget()
            bags.append(_windowed(np.concatenate([np.empty(0, np.int32), *(self.words.ids(p) for p in word_list(text))])))
            places.append(k)
            if sum(map(len, bags)) >= BATCH or len(self.words.number) > WORDS:
                self._flush(bags, places, out)
        self._flush(bags, places, out)
        return out

    def _flush(self, bags: list[np.ndarray], places: list[int], out: np.ndarray) -> None:
        if bags:
            owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            out[places] = _pool(self.scores(np.concatenate(bags)), owner)
            bags.clear()
            places.clear()

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        z = self.net["scale"][0] * self.pooled(texts) + self.net["base"][0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Net:
    """A network fitted on at most ``sample_docs`` documents of each label, by a hash of the doc_id.

    Documents of more than ``sample_chars`` characters and rows that ``held_out`` marks are not
    learnt from. Null labels are left out; of rows that repeat a doc_id the higher label counts.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        marked = marked.where(~held_out)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [marked.where(F.col("toxic") == y).orderBy(*order).limit(2 * sample_docs) for y in (0, 1)]
    short = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= sample_chars)
    found = short.join(chosen[0].unionByName(chosen[1]), "doc_id")
    rows = [r for y in (0, 1) for r in found.where(F.col("toxic") == y).orderBy(*order, F.xxhash64("text")).limit(sample_docs).collect()]
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    return fit([r.text for r in rows], [r.toxic for r in rows], share)


def with_score(docs: DataFrame, net: Net, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double ``out`` between 0 and 1: how likely the whole text is toxic.

    Every window of the text is scored; null, empty and wordless texts are one empty window.
    Rows are independent of each other, so ids may be null or repeat.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(texts))], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the doc_id as text leaves ``part``; a null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    net = train(docs, labels, held_out=held_out(F.col("doc_id")))
    scored = with_score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``; columns unchanged."""
    net = train(docs, labels, held_out=held_out(F.col("doc_id")))
    out = fresh(docs.columns, "score")
    return with_score(docs, net, out=out).where(F.col(out) < cut).drop(out)
