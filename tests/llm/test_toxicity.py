import functools

import numpy as np
import pytest
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from dalyworks.llm import toxicity as X


def plain_windows(n):
    out = [0]
    while out[-1] + X.WINDOW < n:
        out.append(out[-1] + X.STEP)
    return out


def plain_score(net, words):
    """Every window of a text, one word and one direction at a time, in double precision."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    net = {k: np.asarray(v, float) for k, v in net.items()}

    def inputs(w):
        flat, _ = X.grams([w])
        return np.concatenate((net["words"][X.zlib.crc32(w) % X.ROWS], net["chars"][flat].mean(0)))

    def run(xs, way):
        h, out = np.zeros(X.STATE), []
        for x in xs:
            p, a = x @ net["inward"][way] + net["shift"][way], h @ net["across"][way]
            z, r = sig(p[: X.STATE] + a[: X.STATE]), sig(p[X.STATE : 2 * X.STATE] + a[X.STATE : 2 * X.STATE])
            h = z * h + (1 - z) * np.tanh(p[2 * X.STATE :] + r * a[2 * X.STATE :])
            out.append(h)
        return out

    scores = []
    for a in plain_windows(len(words)):
        xs = [inputs(w) for w in words[a : a + X.WINDOW]]
        pooled = np.zeros(2 * X.STATE)
        if xs:
            states = [np.concatenate(p) for p in zip(run(xs, 0), run(xs[::-1], 1)[::-1])]
            e = np.array([np.exp(np.tanh(s @ net["look"] + net["look_shift"]) @ net["focus"]) for s in states])
            pooled = (e / e.sum()) @ np.array(states)
        scores.append(pooled @ net["out"] + net["bias"][0])
    return np.logaddexp.reduce(scores)


def test_windows_cover_every_word():
    for n in range(200):
        at = X.windows(n).tolist()
        assert at == plain_windows(n)
        assert {i for a in at for i in range(a, min(n, a + X.WINDOW))} == set(range(n))


def test_scores_match_a_plain_forward_pass(monkeypatch):
    net = X.new_net(3) | {"scale": np.ones(1), "base": np.zeros(1)}
    texts = ["", "one", prose(1, 31), prose(2, 32), prose(3, 33), prose(4, 300), "!!!", "Straße über " * 20]
    raw = [t.encode() for t in texts]
    words = [[w for p in X.word_list(r) for w in p] for r in raw]
    assert words[1] == [b"one"] and words[7][:2] == ["straße".encode(), "über".encode()]
    want = [plain_score(net, w) for w in words]
    assert np.allclose(X.Scorer(net).pooled(raw), want, atol=1e-3)
    monkeypatch.setattr(X, "PIECE", 64)  # each text in many pieces, through the path of long texts
    monkeypatch.setattr(X, "WORDS", 40)
    assert [[w for p in X.word_list(r) for w in p] for r in raw] == words
    assert np.allclose(X.Scorer(net).pooled(raw), want, atol=1e-3)


def test_gradients_match_differences():
    words = X.Words()
    bags = [X._windowed(words.ids(t.encode().split())) for t in (prose(1, 50), "", prose(2, 3))]
    words.settle()
    y = np.array([1, 0, 1], np.float32)
    net = {k: v.astype(np.float64) for k, v in X.new_net(5).items()}
    grad, _ = X.gradients(net, words, bags, y)
    draw = np.random.default_rng(1)
    row = int(words.row[0]), int(words.flat[0])
    for name, value in net.items():
        at = (row[0], 3) if name == "words" else (row[1], 2) if name == "chars" else tuple(draw.integers(0, n) for n in value.shape)
        step = np.zeros_like(value)
        step[at] = 1e-2
        high, low = (X.gradients(net | {name: value + s}, words, bags, y)[1] for s in (step, -step))
        assert grad[name][at] == pytest.approx((high - low) / 2e-2, abs=2e-3), name


def training():
    insult = ["rotzel", "schmuk", "blagard"]
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 50).split(" ")
        if i % 3 == 0:
            for k in range(3):
                words.insert((i * 7 + k * 13) % 40, insult[(i + k) % 3] + ("en" if i % 2 else ""))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = training()
    extra = [(-1, prose(900, 2000)), (-2, prose(901, 1000) + " rotzel blagarden schmuk " + prose(902, 1000))]
    table = spark.createDataFrame([*labels, (-1, 0, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in X.toxicity(documents(spark, rows + extra), table).collect()}
    held = [r for r in found.values() if r.held_out and r.doc_id >= 0]
    right = [bool(r.predicted) == (r.doc_id % 3 == 0) for r in held]
    assert len(held) > 40 and np.mean(right) > 0.95 and all((r.score >= 0.3) == bool(r.predicted) for r in held)
    assert found[-2].score > found[-1].score
    docs = documents(spark, rows[:50])
    net = X.fit([t for _, t in rows], [y for *_, y in labels])
    assert all(r.score < 0.3 for r in X.with_score(docs.where("doc_id % 3 <> 0"), net).collect())


def test_awkward_rows_and_columns(spark, monkeypatch):
    monkeypatch.setattr(X, "fit", functools.partial(X.fit, rounds=1, steps=20))
    net = X.new_net() | {"scale": np.ones(1), "base": np.zeros(1)}
    rows = awkward()
    docs = documents(spark, rows, extra=True).withColumn("held_out", F.lit("x"))
    got = X.with_score(docs.drop("score"), net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in X.toxicity(docs, labels).collect()} == {0.5}
    kept = X.keep_civil(docs, labels, cut=0.6)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert X.toxicity(documents(spark, []), labels).collect() == []
    one = labels.union(spark.createDataFrame([(1, 1, 0)], labels.schema))
    assert {round(r.score, 6) for r in X.toxicity(docs, one).collect()} == {round(1 / 3, 6)}


def test_labels_of_held_out_rows_are_not_used(spark, monkeypatch):
    monkeypatch.setattr(X, "fit", functools.partial(X.fit, rounds=1, steps=20))
    rows, labels = training()
    docs = documents(spark, rows[:60])
    table = spark.createDataFrame(labels[:60], "doc_id long, quality int, toxic int")
    turned = table.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted((r.doc_id, r.score) for r in X.toxicity(docs, x).collect()) for x in (table, turned))
    assert first == second
