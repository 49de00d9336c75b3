import random

import numpy as np
import xxhash
from helpers import awkward, documents, prose

from dalyworks.llm import near_copies
from dalyworks.llm.common import LOWER, components


def plain_print(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least member of each component of indices, by comparing every pair."""
    name = list(range(len(prints)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                name[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprint_is_the_defined_one():
    for text in [None, "", "One", "one two", "A b C d A b C", prose(4, 300), "x " * 5000]:
        assert near_copies.fingerprint(text) % 2**64 == plain_print(text)


def test_every_row_has_its_component(spark):
    rows = awkward()
    found = near_copies.near_copies(documents(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    by_print = {}
    for doc_id, text in rows:
        by_print.setdefault(plain_print(text), []).append(doc_id)
    prints = sorted(by_print)
    tops = plain_components(prints)
    least = {}
    for p, t in zip(prints, tops):
        ids = [i for q, u in zip(prints, tops) if u == t for i in by_print[q] if i is not None]
        least[p] = min(ids, default=None)
    for r in found:
        assert r.component_id == least[int(r.fingerprint, 16)]


def test_links_connect_what_all_pairs_connect(spark):
    draw = random.Random(3)
    prints = set()
    for _ in range(60):
        p = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):  # chains of close fingerprints
            prints.add(p)
            for _ in range(draw.randint(0, 3)):
                p ^= 1 << draw.randrange(64)
    prints |= {0, 1, 2**64 - 1, 2**63}
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    edges = near_copies.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=16)
    roots = {r.node: r.root for r in components(edges, "a", "b").collect()}
    tops = plain_components(prints)
    ours = [roots.get(s, s) for s in signed]
    assert len(set(zip(ours, tops))) == len(set(ours)) == len(set(tops))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_awkward_rows_and_columns(spark):
    found = near_copies.near_copies(documents(spark, awkward(), extra=True)).collect()
    assert len(found) == len(awkward())
    assert {r.component_id for r in found if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in found if r.doc_id in (5, 6)} == {5}


def test_empty_table(spark):
    empty = documents(spark, [])
    assert near_copies.near_copies(empty).collect() == []
