import itertools

import numpy as np
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from dalyworks.llm import line_quality


def plain_chain(score, moves):
    """Marginals of one chain by trying every labelling."""
    n = len(score)
    total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(score[t] for t in range(n) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return np.log(total), good / total, pairs / total


def test_chain_matches_enumeration():
    draw = np.random.default_rng(2)
    sizes = [1, 4, 2, 6, 1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    score, moves = draw.normal(size=sum(sizes)), draw.normal(size=(2, 2))
    total, good, pairs = line_quality._chain(score, starts, moves)
    for d, (a, b) in enumerate(zip(starts, starts[1:])):
        want = plain_chain(score[a:b], moves)
        assert np.isclose(total[d], want[0]) and np.allclose(good[a:b], want[1]) and np.allclose(pairs[d], want[2])


def test_lines_and_neighbours():
    raw = [b"ab\nCD!\n", b"", b"x x y"]
    x, length, starts = line_quality.line_features(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 7, 7, 12]))
    assert length.tolist() == [2, 3, 0, 0, 5] and starts.tolist() == [0, 3, 4, 5]
    own = line_quality.OWN
    assert np.array_equal(x[1, own : 2 * own], x[0, :own]) and np.array_equal(x[0, 2 * own :], x[1, :own])
    assert not x[0, own : 2 * own].any() and not x[2, 2 * own :].any() and not x[3, own:].any()
    assert np.isclose(x[4, own - 5], 1 / 3)  # one of three words repeats the one before


def training(spark):
    good = [(i, prose(i, 60)) for i in range(1, 80)]
    bad = [(100 + i, prose(i, 10) + "\n" + prose(i, 50).upper().replace(" ", "!! ")) for i in range(1, 40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(900, None, 0)], "doc_id long, quality int, toxic int")
    return good, bad, labels


def test_held_out_documents_are_told_apart(spark):
    good, bad, labels = training(spark)
    found = {r.doc_id: r for r in line_quality.quality(documents(spark, good + bad), labels).collect()}
    held = [r for r in found.values() if r.held_out]
    assert held and all((r.score >= 0.3) == (r.doc_id < 100) == bool(r.predicted) for r in held)


def test_awkward_rows_all_have_a_score(spark):
    good, bad, labels = training(spark)
    rows = awkward()
    docs = documents(spark, rows + good + bad, extra=True)
    found = line_quality.quality(docs, labels).collect()
    assert len(found) == len(rows + good + bad) and all(0 <= r.score <= 1 for r in found)
    alone = line_quality.with_score(documents(spark, rows), line_quality.train(docs, labels)).collect()
    assert len({r.score for r in alone if r.doc_id in (2, 3)}) == 1
    kept = line_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in good}


def test_no_labels_or_one_kind_give_the_prior(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in line_quality.quality(docs, none).collect()} == {0.5}
    one = none.union(spark.createDataFrame([(1, 1, 0)], none.schema))
    assert {round(r.score, 6) for r in line_quality.quality(docs, one).collect()} == {round(2 / 3, 6)}
    assert line_quality.quality(documents(spark, []), none).collect() == []


def test_labels_of_held_out_rows_are_not_used(spark):
    good, bad, labels = training(spark)
    docs = documents(spark, good + bad)
    turned = labels.withColumn("quality", F.when(line_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (sorted((r.doc_id, r.score) for r in line_quality.quality(docs, x).collect()) for x in (labels, turned))
    assert first == second
