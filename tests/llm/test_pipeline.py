import random

import pytest
from helpers import awkward, documents, prose

import corpus_pipeline
from dalyworks.llm.common import staged


def tables(spark, folder, seed=1):
    good = [(i, prose(i, 80), "en", f"s{i % 3}", 1) for i in range(1, 60)]
    bad = [(100 + i, prose(500 + i, 60).upper().replace(" ", "!! "), "en", "s0", 1) for i in range(25)]
    item = prose(900, 20)
    copies = [(200, good[0][1], "en", "s9", 1), (201, prose(2, 80), "en", None, 1)]
    leaked = [(300, prose(901, 40) + item + prose(902, 40), "en", "s1", 1)]
    odd = [(None, prose(77, 50), "en", "s1", 1), (400, None, None, None, None), (401, "", "en", "s2", 0)]
    spark.createDataFrame(good + bad + copies + leaked + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_decides_on_what_it_gets(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        ids[name] = [r.doc_id for r in docs.collect()]
        if name != "order":
            assert docs.columns == columns
    good = set(range(1, 60))
    assert good <= set(ids["quality"]) and not set(range(100, 125)) & set(ids["quality"])
    assert not {200, 201} & set(ids["near_dedup"]) and good <= set(ids["near_dedup"])
    assert 300 in ids["near_dedup"] and 300 not in ids["decontaminate"] and good <= set(ids["decontaminate"])
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(ids["mix"].count(i) for i in good) == 2
    assert set(ids["order"]) == set(ids["mix"])
    assert sorted(r.slot for r in docs.collect()) == list(range(len(ids["order"])))


def test_clashing_columns_repeated_ids_and_edited_copies(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    draw, edited = random.Random(2), {}
    for i in range(1, 6):
        words = prose(i, 80).split(" ")
        words[draw.randrange(5, 70)] = "edited"
        edited[i] = " ".join(words)
    rows = [(i, prose(i, 80), "s1") for i in range(1, 40)] + [(500 + i, t, "s2") for i, t in edited.items()] + [(7, prose(600, 60)), (7, prose(601, 60)), (8, prose(8, 80))] + awkward()
    docs = documents(spark, rows, extra=True)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        kept[name] = docs.collect()
        assert name == "order" or docs.columns == columns
    ids = [r.doc_id for r in kept["near_dedup"]]
    assert not {500 + i for i in edited} & set(ids) and set(range(1, 40)) <= set(ids)
    assert sorted(r.text for r in kept["near_dedup"] if r.doc_id == 7) == sorted({prose(7, 80), prose(600, 60), prose(601, 60)} | {r[1] for r in awkward() if r[0] == 7} & {r.text for r in kept["near_dedup"]})
    assert ids.count(8) == len({r[1] for r in rows if r[0] == 8} & {r.text for r in kept["near_dedup"]})
    assert sorted(r.slot for r in kept["order"]) == list(range(len(kept["order"])))


@pytest.mark.parametrize("empty", [("documents",), ("labels", "benchmark")])
def test_empty_tables_go_through_all_stages(spark, tmp_path, empty):
    folder = str(tmp_path / "in")
    tables(spark, folder)
    bare = str(tmp_path / "bare")
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if name in empty else df).write.parquet(f"{bare}/{name}.parquet")
    got = corpus_pipeline.run(spark, bare).collect()
    assert (not got) == ("documents" in empty)
