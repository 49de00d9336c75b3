import collections
import random
import re
import zlib

import pytest
from helpers import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from dalyworks.llm import spelling_variants as S


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_words(rows):
    found = collections.Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            found[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_groups(words):
    near = {w: [v for v in words if abs(len(w) - len(v)) < 2 and v != w and edits(w, v) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def small_words(seed, n):
    draw = random.Random(seed)
    letters = "abcdéÿx"
    base = ["".join(draw.choices(letters, k=draw.randint(5, 9))) for _ in range(n)]
    for w in list(base):
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(w) + 1)
            base.append(w[:i] + draw.choice(letters) * draw.randint(0, 1) + w[i + draw.randint(0, 1) :])
    return {w: draw.choice([3, 4, 7, 8, 20, 100]) for w in base}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]))
def test_pivots_are_the_cheapest_disjoint_choice(grams):
    places, costs = [p for p, _ in grams], [c for _, c in grams]
    cost = dict(grams)
    pairs = [(cost[a] + cost[b]) for a in places for b in places if b - a >= 2]
    got = S.pivots(places, costs)
    assert (len(got) == 2 and got[1] - got[0] >= 2 and sum(cost[x] for x in got) == min(pairs)) if pairs else got == []


@pytest.mark.parametrize("seed", [1, 2])
def test_no_near_pair_is_missed(spark, seed):
    words = small_words(seed, 250)
    words |= {"aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 30, "abababab": 3, "babababa": 6, "ababab": 3, "bababab": 4, "ab": 5, "b": 5, "xb": 5, "x" * 3000: 4, "x" * 2999 + "y": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = S.near_pairs(df).collect()
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and len(a) > 4 and len(b) > 4 and len(a) < 99 and edits(a, b) == 1}
    want |= {("x" * 3000, "x" * 2999 + "y")}
    assert {(r.a, r.b) for r in got if len(r.a) > 4 and len(r.b) > 4} == want and len(got) == len({(r.a, r.b) for r in got})
    assert all(words[r.a] == r.a_n and words[r.b] == r.b_n for r in got)


def test_query_matches_the_plain_version(spark):
    draw = random.Random(5)
    pool = list(small_words(9, 60))
    rows = [(i, " ".join(draw.choices(pool, k=80)) + "\n" + prose(i, 30).upper()) for i in range(60)] + [r[:2] for r in awkward()] + [(7, "Ärger-Ärger Ärger 5×÷×÷× ×÷×÷× ×÷×÷×")]
    got = S.variants(documents(spark, rows, extra=True))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(plain_words(rows))
    assert {tuple(r) for r in got.collect()} == want and len({r[2] for r in want}) < len(want) - 20


def test_chains_empty_tables_and_ties(spark):
    chain = {"stone": 3, "stones": 6, "stoness": 12, "stonesss": 24, "stonessss": 48, "stonesssss": 96, "other": 5}
    got = {r.word: r for r in S.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert got["stone"].root == "stonesssss" and got["stone"].form == "stones" and got["other"].root == "other" and got["other"].n_near == 0
    tie = spark.createDataFrame([("abcde", 3), ("abcdz", 6), ("abcdf", 6), ("abcdé", 6)], "word string, n long")
    assert {r.word: r.form for r in S.group_variants(tie).collect()}["abcde"] == "abcdf"
    assert S.variants(documents(spark, [])).collect() == [] and S.variants(documents(spark, [(1, None), (2, "")])).collect() == []


def test_staged_tables_go_but_the_result(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir") + "/llm")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = {str(x.getPath()) for x in fs.listStatus(path)} if fs.exists(path) else set()
    S.group_variants(spark.createDataFrame([("abcde", 3), ("abcdf", 6)], "word string, n long")).collect()
    assert len({str(x.getPath()) for x in fs.listStatus(path)} - before) == 1
