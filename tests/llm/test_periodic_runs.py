import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from dalyworks.llm import periodic_runs as P


def plain_lyndon(s):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(k for k in range(1, len(s) - i + 1) if is_lyndon(s[i : i + k])) for i in range(len(s))]


def plain_runs(words, least):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                found.setdefault((i, size), q)  # the smallest period comes first
            i = j + 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=24))
def test_lyndon_array_in_both_orders(s):
    assert P.lyndon_array(s) == plain_lyndon(s)
    assert P.lyndon_array([-x for x in s]) == plain_lyndon([-x for x in s])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.sampled_from([2, 5, 12]))
def test_runs_match_every_period_tried(s, least):
    words = [b"w%d" % x for x in s]
    assert P.word_runs(words, least) == plain_runs(words, least)


@pytest.mark.parametrize("seed", range(6))
def test_runs_in_structured_texts(seed):
    draw = random.Random(seed)
    words = []
    for _ in range(12):
        piece = [b"%d" % draw.randrange(5) for _ in range(draw.randint(1, 30))]
        words += piece * draw.randint(1, 4) + piece[: draw.randrange(len(piece) + 1)]
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, b + a
    words += b + [b"x"] * 50
    assert P.word_runs(words) == plain_runs(words, 12)


def test_one_word_a_million_times_and_a_long_rise():
    assert P.word_runs([b"a"] * 1_000_000) == [(0, 1_000_000, 1)]
    rise = [b"%d" % i for i in range(30_000)]
    assert P.word_runs(rise) == [] and P.word_runs(rise + rise) == [(0, 60_000, 30_000)]
    assert P.runs_of(np.arange(30_000)) == set()


def plain_row(doc_id, text):
    words = _split(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *head, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _split(text):
    out = [""]
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def test_query_matches_the_plain_version(spark):
    edited = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = awkward() + [(i, prose(i, 20 + i)) for i in edited] + [(500, "u v w " * 30 + "x y " * 9), (501, "a b a b " * 8), (502, "one " * 11), (503, "one " * 12), (edited[0], ""), (edited[1], "w")]
    want = sorted((plain_row(*r[:2]) for r in rows), key=str)
    got = P.run_digests(documents(spark, rows, extra=True))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if "sha" not in c} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] > 0 for r in want) > 20 and P.run_digests(documents(spark, [])).collect() == []


def test_operator_keeps_other_columns(spark):
    df = documents(spark, [(1, "a b " * 10), (None, None)]).selectExpr("*", "'x' as runs", "'y' as id", "'z' as body")
    got = {r.doc_id: r for r in P.with_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 20, 2)] and got[1].collapsed == "a b" and got[1].id == "y" and got[1].body == "z"
    assert got[None].runs == [] and got[None].collapsed == "" and "text" not in got[1]
