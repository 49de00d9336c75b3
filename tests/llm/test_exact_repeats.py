import hashlib
import random

import pytest
from helpers import awkward, documents, prose

from dalyworks.llm import exact_repeats


def plain(rows, span):
    """The contract by counting every string of ``span`` bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in texts:
        for p in range(len(b) - span + 1):
            seen[b[p : p + span]] = seen.get(b[p : p + span], 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(span, n=60, seed=5):
    """Documents that share passages a little shorter, as long and longer than ``span``."""
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choices("abcdefgh \u00e9", k=k))
    shared = [text(draw.randint(span - span // 4, span + span // 2)) for _ in range(8)]
    core = text(span - 10)
    rows = []
    for i in range(n):
        parts = [text(draw.randint(0, 80))]
        for _ in range(draw.randint(0, 3)):
            s = draw.choice(shared)
            cut = draw.randint(0, 20)
            parts += [s[cut:] if draw.random() < 0.5 else s[: len(s) - cut], text(draw.randint(0, 60))]
        if i % 3 == 0:  # a common core with a few bytes more on either side, alike here and there
            parts += [draw.choice(["", "x", "yx", "zyx"]) * draw.randint(1, 4), core, draw.choice(["", "p", "pq", "pqr"]) * draw.randint(1, 4)]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("group", [20_000, 1])
def test_removal_matches_counting(spark, group):
    rows = passages(60) + [(100, "q" * 200), (101, "q" * 61), (102, "ab" * 90), (103, None)]
    found = exact_repeats.remove_repeats(documents(spark, rows, extra=True), span=60, window=24, group=group).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows, 60)


def test_production_lengths_and_awkward_rows(spark):
    rows = awkward() + [(60, prose(9, 200) + prose(1, 100)), (61, "\u00e9" * 200), (62, "\u00e9" * 199 + "e"), (63, prose(9, 200)[:399])]
    found = exact_repeats.remove_repeats(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows, 400)
    assert exact_repeats.remove_repeats(documents(spark, [])).collect() == []


def test_anchors_are_chosen_by_content():
    draw = random.Random(1)
    inner = bytes(draw.choices(b"abcd", k=500))
    one, two = bytes(draw.choices(b"ef", k=777)) + inner + b"gg" * 50, bytes(draw.choices(b"hi", k=40)) + inner
    a, b = exact_repeats.anchors(one), exact_repeats.anchors(two)
    for p in range(101):
        own = {x - p - 777 for x in a if 0 <= x - p - 777 < 128}
        assert own & {x - p - 40 for x in b if 0 <= x - p - 40 < 128}


def test_intervals_of_a_known_array():
    lcp = [0, 1, 3, 0, 0, 2]  # suffixes of "banana": a, ana, anana, banana, na, nana
    assert set(exact_repeats.intervals(lcp)) == {(3, 1, 2), (1, 0, 2), (2, 4, 5), (0, 0, 5)}


def test_scan_joins_left_and_right_of_the_same_partner():
    rights, lefts = [b"aaaa", b"aabb", b"zzzz"], [b"pppp", b"qqpp", b"pppp"]
    assert exact_repeats.scan_group(rights, lefts, 4) == [(4, 2), (2, 2), (4, 0)]
    assert exact_repeats.scan_group(rights, lefts, 5) == [None, None, None]
