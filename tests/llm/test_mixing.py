import random

from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from dalyworks.llm import mixing


def plain_targets(sizes):
    """Targets by source (code point order, null last), resharing what is over until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] for s in capped} | share
        capped |= over


def test_fit_reaches_the_best_sum():
    draw = random.Random(4)
    for _ in range(60):
        sizes = sorted(draw.sample(range(0, 40), 5))
        counts = [draw.randint(0, 6) for _ in sizes]
        budget = draw.randint(0, sum(s * c for s, c in zip(sizes, counts)))
        taken = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and sum(s * t for s, t in zip(sizes, taken)) <= budget
    assert mixing.fit([3, 5], [10, 10], 23) in ([1, 4], [6, 1])
    assert mixing.fit([0, 7], [5, 2], 100) == [0, 2]


def case():
    draw = random.Random(8)
    rows = [(i, prose(i, draw.randint(1, 60)), draw.choice(["a", "a", "a", "B", "é", "zz", None])) for i in range(300)]
    return rows + [(1000 + i, "copy of the same five", "hot") for i in range(200)] + [(2000, "", "empty"), (2001, None, "empty"), (2002, "w", "")]


def test_targets_and_sums(spark):
    rows = case()
    found = mixing.mixture(documents(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken = {}, {}
    for r in found:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        assert r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(abs(taken[s] - want[s]) <= 1 for s in sizes) >= len(sizes) - 2
    again = mixing.mixture(documents(spark, rows, extra=True).repartition(5, F.rand(3))).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_the_mix_keeps_columns_and_repeats_rows(spark):
    docs = documents(spark, case(), extra=True)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r.doc_id: r.taken // r.size for r in mixing.mixture(docs).collect() if r.taken}
    assert {k: v for k, v in counts.items() if k in want} == want and max(counts.values()) <= 2


def test_awkward_and_empty(spark):
    rows = awkward()
    found = mixing.mixture(documents(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert mixing.mixture(documents(spark, [])).collect() == []
    assert [r.taken for r in mixing.mixture(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]
