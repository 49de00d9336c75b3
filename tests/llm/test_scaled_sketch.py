import hashlib

from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from dalyworks.llm import scaled_sketch


def plain_sketch(spark, texts):
    """All shingle hashes below a quarter of their range, by text."""
    words = {t: [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w] for t in texts}
    parts = [(t, w[i : i + 5] if len(w) >= 5 else [" ".join(w)]) for t, w in words.items() for i in range(max(1, len(w) - 4)) if w]
    found = {t: set() for t in texts}
    for size in (1, 5):
        some = [(t, *p) for t, p in parts if len(p) == size]
        if some:
            names = [f"w{k}" for k in range(size)]
            for r in spark.createDataFrame(some, ["t", *names]).select("t", F.xxhash64(*names).alias("h")).collect():
                if r.h < -(2**63) + 2**62:
                    found[r.t].add(r.h)
    return found


def test_fingerprints_and_likeness_match_plain_sketches(spark):
    rows = [(i, prose(i, 3 + 9 * i)) for i in range(40)] + [(50, ""), (51, None), (52, "a b"), (53, "a b"), (54, prose(3, 200)), (55, prose(3, 200) + " more")]
    found = {r.doc_id: r for r in scaled_sketch.edited_likeness(documents(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    prints = plain_sketch(spark, {*texts, *edited})

    def alike(a, b):
        x, y = prints[a], prints[b]
        return len(x & y) / len(x | y) if x | y else float(a == b)

    for (i, _), t, n, e in zip(rows, texts, after, edited):
        r = found[i]
        assert r.fingerprint == "".join(f"{h & (2**64 - 1):016x}" for h in sorted(prints[t]))
        assert r.edited_fingerprint == "".join(f"{h & (2**64 - 1):016x}" for h in sorted(prints[e]))
        assert abs(r.near_edited - alike(t, e)) < 1e-12 and abs(r.near_next - alike(t, n)) < 1e-12


def test_a_hot_id_spreads_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scaled_sketch, "RANGE", 10)
    rows = [(None, f"n {i} {prose(i, 8)}") for i in range(120)] + [(5, f"h {i} {prose(i, 8)}") for i in range(100)] + [(i, f"s {i}") for i in range(90)]
    docs = documents(spark, rows).select("doc_id", "text")
    found = scaled_sketch.with_next(docs, "doc_id", {"after": "text"}, "text").collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    assert {r.text: r.after for r in found} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    spread = docs.select(scaled_sketch._range_of(F.lit(5), F.xxhash64("text"), [1, 5, 5, 5, 9]).alias("k")).distinct().count()
    assert spread == 4


def plain(rows):
    """Rows of the result in the order of doc_id, nulls first, with sketches made one hash at a time."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    out = []
    for at, i in enumerate(order):
        text, after = rows[i][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((rows[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def tell(found):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str)


def test_edited_texts(spark):
    rows = [r for r in awkward() if r[0] not in (None, 5)] + [(None, "only one null id"), (5, prose(2, 40))]
    found = scaled_sketch.edited_likeness(documents(spark, rows, extra=True)).collect()
    assert tell(found) == sorted(plain(rows), key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[5] == prints[6] and prints[2] == prints[3] == prints[4] == ""
    assert {r.near_next for r in found if r.doc_id in (2, 3)} == {1.0, 0.0}


def test_many_ranges_and_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(scaled_sketch, "RANGE", 10)
    rows = [(i * i * 977 - 5000, prose(i, 5 + i % 30)) for i in range(150)]
    found = scaled_sketch.edited_likeness(documents(spark, rows).repartition(7)).collect()
    assert tell(found) == sorted(plain(rows), key=str)
    halves = [r.near_edited for r in found if r.n_chars > 120]
    assert sum(halves) / len(halves) > 5 * sum(r.near_next for r in found) / len(found)


def test_one_row_follows_itself_and_empty_tables(spark):
    one = scaled_sketch.edited_likeness(documents(spark, [(3, prose(1, 50))])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert scaled_sketch.edited_likeness(documents(spark, [])).collect() == []
    repeated = scaled_sketch.edited_likeness(documents(spark, [(1, "a b"), (1, "a b"), (1, "c")])).collect()
    assert len(repeated) == 3


def test_sketches_estimate_and_merge(spark):
    a, b = prose(1, 4000), prose(2, 200)
    rows = scaled_sketch.sketched(documents(spark, [(1, a + b), (2, b), (3, a)])).select("doc_id", "sketch")
    pair = rows.alias("x").join(rows.alias("y")).select(
        F.col("x.doc_id").alias("i"), F.col("y.doc_id").alias("j"),
        scaled_sketch.containment(F.col("x.sketch"), F.col("y.sketch")).alias("c"),
        F.size(scaled_sketch.merged(F.col("x.sketch"), F.col("y.sketch"))).alias("m"),
    )
    found = {(r.i, r.j): r for r in pair.collect()}
    assert found[2, 1].c > 0.9 and found[2, 3].c < 0.1 and found[1, 2].c < 0.15
    assert abs(found[2, 3].m - found[1, 1].m) <= 3
    size = {r.doc_id: len(r.sketch) for r in rows.collect()}
    assert 0.7 < size[3] / (3996 / 4) < 1.3


def test_the_plan_has_no_python(spark):
    plan = scaled_sketch.edited_likeness(documents(spark, [(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
