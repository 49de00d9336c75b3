import hashlib
import re

from helpers import awkward, documents, prose

from dalyworks.llm import phrase_index
from dalyworks.llm.common import staged

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= names
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def case():
    a, b = prose(20, 30), prose(21, 25)
    items = [(1, a), (2, b), (3, "Zwei Worte"), (4, None), (5, "--"), (10, a), (11, "x x x x x x x x x x x x")]
    docs = awkward() + [
        (20, prose(5, 50) + a + prose(6, 10)), (21, a.upper().replace(" ", "-- ")), (22, " ".join(a.split()[:9])), (23, b[: len(b) // 2] + a),
        (24, "x " * 40), (25, "zwei worte"), (26, "zwei, x worte"), (26, "zwei, x worte"),
    ]
    return docs, items


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_hits_match_a_plain_search(spark):
    docs, items = case()
    found = phrase_index.contamination(documents(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert order(found.collect()) == order(plain(docs, items))


def test_passes_and_shards_do_not_change_the_result(spark):
    docs, items = case()
    index = staged(phrase_index.build_index(documents(spark, docs), shard_bytes=50), "index")
    table = spark.createDataFrame(items, "item_id long, text string")
    one = phrase_index.search(index, table).collect()
    many = phrase_index.search(index, table, pass_words=10).collect()
    tell = lambda rows: sorted((str(r.doc_id), r.n_words, tuple(sorted(r.hits)), tuple(sorted(r["items"]))) for r in rows)
    assert tell(one) == tell(many)


def test_proximity(spark):
    index = phrase_index.build_index(documents(spark, [(1, "one two x x three"), (2, "three two one"), (3, "one " + "x " * 30 + "two three"), (4, "one two")]))
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    near = {r.doc_id for r in phrase_index.search(index, items, slop=5).collect() if r.hits}
    assert near == {1, 2}


def test_dropping_and_empty_tables(spark):
    docs, items = case()
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs, extra=True)
    kept = phrase_index.drop_contaminated(frame, table)
    assert kept.columns == frame.columns
    want = [d for d, p in zip(docs, plain(docs, items)) if not p[5]]
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(want)
    assert phrase_index.contamination(documents(spark, []), table).collect() == []
    assert not any(r.contaminated for r in phrase_index.contamination(frame, table.limit(0)).collect())
