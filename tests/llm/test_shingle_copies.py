import os
import random

import numpy as np
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

import corpus_pipeline
from dalyworks.llm import common, shingle_copies
from dalyworks.llm.near_copies import fingerprint


def words5(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = words5(a), words5(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, edits, seed):
    words, draw = text.split(), random.Random(seed)
    for at in draw.sample(range(5, len(words) - 5), edits):
        words[at] = f"edit{seed}x{at}"
    return " ".join(words)


def plain_roots(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and likeness(texts[i], texts[j]) >= 0.8:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_edited_copies_go(spark):
    base = [prose(i, 300) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    copies = [(100 + 10 * i + e, edited(t, e, 100 + 10 * i + e)) for i, t in enumerate(base) for e in (1, 2, 4, 6)]
    assert all(0.8 <= likeness(t, base[(i - 100) // 10]) < 1 for i, t in copies)
    other = [(900 + i, edited(t, 20, 900 + i)) for i, t in enumerate(base)]
    assert all(likeness(t, base[i - 900]) < 0.8 for i, t in other)
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows + copies + other), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows + other)


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(shingle_copies, "COMMON", 50)
    line = prose(50, 30)
    texts = [prose(60 + i, draw.randint(20, 60)) + line for i in range(10)]
    for i in range(60):  # chains, large groups and texts that share a line
        source = draw.choice(texts)
        texts.append(edited(source, draw.randint(0, 3), 1000 + i))
    found = shingle_copies.drop_copies(documents(spark, list(enumerate(texts))))
    roots = plain_roots(texts)
    assert 10 <= len(set(roots)) < 60
    assert sorted(r.doc_id for r in found.collect()) == sorted(min(i for i, r in enumerate(roots) if r == x) for x in set(roots))


def test_awkward_rows(spark):
    docs = documents(spark, awkward(), extra=True)
    kept = shingle_copies.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 7, 8, 9, 10]
    assert shingle_copies.drop_copies(documents(spark, [])).collect() == []


def test_rows_not_ids_are_kept(spark):
    same, other, alone = prose(200, 40), prose(201, 40), prose(202, 40)
    rows = [(None, same)] * 5 + [(None, same, "t"), (None, other), (9, other), (9, alone), (9, alone), (4, prose(203, 40)), (4, prose(204, 40))]
    kept = shingle_copies.drop_copies(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("None", same), ("9", other), ("9", alone), ("4", prose(203, 40)), ("4", prose(204, 40))]
    )
    again = shingle_copies.drop_copies(documents(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept))


def test_maps_never_rule_out_a_near_copy():
    draw = random.Random(6)
    for n in (5, 40, 300, 3000):
        text = prose(n, n)
        for edits in (0, 1, 2, 5):
            other = edited(text, min(edits, n - 11), edits) if n > 11 else text
            a, b = (shingle_copies.shingle_set(t) for t in (text, other))
            x, y = (shingle_copies.turned_bits(s) for s in (a, b))
            differ = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
            assert len(x) == shingle_copies.MAP and differ <= len(set(a.tolist()) ^ set(b.tolist()))
    assert draw and any(shingle_copies.turned_bits(shingle_copies.shingle_set(prose(1, 50))))


def test_staged_tables_of_the_stage_go(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir") + "/llm")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {str(x.getPath()) for x in fs.listStatus(path)} if fs.exists(path) else set()
    before = there()
    kept = shingle_copies.drop_copies(documents(spark, [(i, prose(i % 7, 60)) for i in range(30)]))
    assert kept.count() == 7 and len(there() - before) == 1


def test_a_pair_leaves_the_last_join_hardly_more_than_once(spark):
    draw, rows, sets = random.Random(8), [], []
    for i in range(60):  # copies of two texts that share many of their rarest shingles
        sets.append(shingle_copies.shingle_set(edited(prose(i % 2, 300), draw.randint(0, 6), 3000 + i)))
    empty = np.empty(0, np.int64)
    for found in sets:
        first = shingle_copies._first(found, empty, empty, shingle_copies.LIKENESS)
        rows.append((len(rows), len(found), first.tolist(), shingle_copies.turned_bits(found)))
    nodes = spark.createDataFrame(rows, "node long, size int, first array<long>, bits array<long>")
    now = nodes.select("node", F.col("size").alias("n"), F.posexplode("first").alias("at", "name"), F.col("node").alias("root"))
    met = [tuple(r) for r in shingle_copies._every(now, nodes.select("node", "size", "bits"), shingle_copies.LIKENESS).collect()]
    alike = {(i, j) for j in range(60) for i in range(j) if shingle_copies.alike(sets[i], sets[j])}
    assert len(alike) > 300 and alike <= set(met)
    assert len(met) < 1.2 * len(set(met))


def test_texts_of_near_fingerprints_meet_first(spark):
    texts = [edited(prose(i, 800), e, 10 * i + e) if e else prose(i, 800) for i in range(4) for e in (0, 1, 2, 3)]
    prints = [fingerprint(t, shingle_copies.SHINGLE) for t in texts]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, print long")
    root = list(range(len(texts)))
    for a, b in shingle_copies._proposed(nodes, 2).collect():
        root = [root[a] if r == root[b] else r for r in root]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2}
    assert near and all(root[i] == root[j] for i, j in near) and len(set(root)) >= 4


def test_shingles_are_on_disk_once_while_texts_are_compared(spark, monkeypatch, tmp_path):
    seen, verified = [], shingle_copies._verified

    def looked(*a):
        folders = [f"{tmp_path}/llm/{x}" for x in os.listdir(f"{tmp_path}/llm")]
        seen.append(sum("first" in spark.read.parquet(x).columns for x in folders if os.path.exists(f"{x}/_SUCCESS")))
        return verified(*a)

    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(shingle_copies, "_verified", looked)
    rows = [(i, prose(i % 6, 40) + " tail" * (i % 2)) for i in range(12)]
    assert shingle_copies.drop_copies(documents(spark, rows)).count() == 6
    assert seen and set(seen) == {1}
