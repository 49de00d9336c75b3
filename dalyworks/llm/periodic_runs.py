"""Periodic runs of words: Lyndon arrays by suffix grouping, roots extended to maximal runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dalyworks.llm.common import fresh

#: Words a run has at least, besides two periods.
LEAST = 12
#: Rows, and bytes of their results, that are handed on together.
ROWS, BYTES = 2000, 8 << 20

RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the order of the symbols.

    Phase one of a suffix sorter that groups suffixes: groups begin as equal first symbols and
    are taken from the highest to the lowest. From each suffix of the group at hand the nearest
    suffix before it in a lower group is sought; one that is found k times, once for each of k
    copies of the group's context that follow its own, moves to a new group just above its old
    one, whose context is longer by these copies. When a group's turn comes its context is the
    longest Lyndon prefix of its suffixes.
    """
    n = len(symbols)
    found, owner = [0] * n, [0] * n
    names = {x: k for k, x in enumerate(sorted(set(symbols)))}
    members: list[list[int]] = [[] for _ in names]
    for i, x in enumerate(symbols):
        owner[i] = names[x]
        members[owner[i]].append(i)
    width = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))  # what moves is below the group at hand
    link = list(range(-1, n))  # link[i + 1]: i while its group is to come, else a place before it
    group = len(members) - 1
    while group >= 0:
        size = width[group]
        mine = [i for i in members[group] if owner[i] == group]
        for i in mine:
            found[i] = size
            link[i + 1] = i - 1
        copies: dict[int, int] = {}
        for i in mine:
            at = i
            while at and link[at] != at - 1:
                step = link[at] + 1
                link[at] = link[step]
                at = step
            if at:
                copies[at - 1] = copies.get(at - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for place, k in copies.items():
            moved.setdefault((owner[place], -k), []).append(place)
        for old, k in sorted(moved):
            new = len(members)
            for place in moved[old, k]:
                owner[place] = new
            members.append(moved[old, k])
            width.append(width[old] - k * size)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
        group = below[group]
    return found


def _reach(data: bytes, i: int, j: int, most: int) -> int:
    """Four-byte symbols that agree from places i and j on, ``most`` at most."""
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        if data[4 * (i + done) : 4 * (i + done + step)] != data[4 * (j + done) : 4 * (j + done + step)]:
            break
        done += step
        step *= 2
    else:
        return most
    while step > 1:
        half = step // 2
        if data[4 * (i + done) : 4 * (i + done + half)] == data[4 * (j + done) : 4 * (j + done + half)]:
            done, step = done + half, step - half
        else:
            step = half
    return done


def runs_of(symbols: np.ndarray, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of ``least`` symbols and two periods or more.

    Each run has a root that is the longest Lyndon word at its place in one of the two orders of
    the symbols. Every such word is extended both ways by the longest common extension of its
    place and the place one period on; words inside a stretch that is known are not tried again.
    """
    n = len(symbols)
    found: set[tuple[int, int, int]] = set()
    ahead = np.ascontiguousarray(symbols, "<u4")
    data, back = ahead.tobytes(), ahead[::-1].tobytes()
    for sign in (1, -1):
        period = np.array(lyndon_array((sign * symbols).tolist()), np.int64)
        place = np.arange(n)
        onward = place + period
        right = (onward < n) & (symbols == symbols[np.minimum(onward, n - 1)])
        left = (place > 0) & (symbols[place - 1] == symbols[onward - 1])
        known: dict[int, tuple[int, int]] = {}
        some = np.flatnonzero(left | right)
        for i, p in zip(some.tolist(), period[some].tolist(), strict=True):
            start, end = known.get(p, (n, n))
            if start <= i and i + p <= end:
                continue
            end = i + p + _reach(data, i, i + p, n - i - p)
            start = i - _reach(back, n - i - p, n - i, i)
            known[p] = (start, end)
            if end - start >= max(least, 2 * p):
                found.add((start, end - start, p))
    return found


def _stretches(symbols: np.ndarray, gram: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that can hold a run: those covered by recurring grams.

    A run of L words and period q has L - q equal words in a row q apart, at least ``gram`` of
    them where 2 * gram <= least; so each of its words lies in a gram that recurs, and so does
    each word that could prolong it. Grams are told apart by a sum: a clash only adds a stretch.
    """
    size = len(symbols) - gram + 1
    if size < 2:
        return
    name = np.zeros(size, np.uint64)
    for k in range(gram):
        name = name * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + size].astype(np.uint64)
    order = np.argsort(name)
    same = name[order[1:]] == name[order[:-1]]
    if not same.any():
        return
    edge = np.zeros(len(symbols) + 1, np.int64)
    twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    edge[twice] += 1
    edge[twice + gram] -= 1
    inside = np.cumsum(edge) > 0  # false at the end
    turns = np.flatnonzero(np.diff(inside, prepend=False))
    yield from zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)


def word_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs among ``words``, by start, then period."""
    if len(words) < max(least, 2):
        return []
    seen: dict[bytes, int] = {}
    symbols = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    gram = max(1, least // 2)
    found = []
    for a, b in _stretches(symbols, gram):
        if b - a >= least:
            found += [(a + s, size, p) for s, size, p in runs_of(symbols[a:b], least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, edit: Edit | None = None, runs: str = "runs", kept: str = "collapsed") -> DataFrame:
    """``docs`` without its text, with the periodic runs of the text's words and the text collapsed.

    Words are what stands between white space (space, tab to carriage return). ``runs`` is an
    array of (start, length, period) in word numbers by start, then period: stretches that repeat
    with this smallest period at least twice over ``least`` words or more and that no neighbour
    continues. ``kept`` has the words that no run holds after its first period, joined by spaces.
    Null and blank texts have no word: an empty array and an empty string. Rows are independent:
    ids may be null or repeat, and nothing is shuffled. ``edit`` may change the words first.
    Columns of ``docs`` that are named as ``runs`` or ``kept`` are replaced.
    """
    names = [c for c in docs.columns if c not in (text, runs, kept)]
    key, body = fresh([*names, runs, kept], "id"), fresh([*names, runs, kept], "body")
    source = docs.select(*names, F.col(doc_id).cast("long").alias(key), F.col(text).alias(body))
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(runs, T.ArrayType(RUN)), T.StructField(kept, T.StringType())])
    kind = pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(len(names)), batch.column(len(names) + 1)
            passed = batch.select(names)
            begin, held, found = 0, 0, ([], [])
            for i, (name, raw) in enumerate(zip(ids, texts, strict=True)):
                words = raw.as_buffer().to_pybytes().split() if raw.is_valid else []
                if edit:
                    words = edit(name.as_py(), words)
                mine = word_runs(words, least)
                found[0].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
                found[1].append(collapsed(words, mine))
                held += len(found[1][-1])
                if held > BYTES or len(found[0]) >= ROWS or i == batch.num_rows - 1:
                    made = [pa.array(found[0], kind), pa.array(found[1], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*passed.slice(begin, len(found[0])).columns, *made], [*names, runs, kept])
                    begin, held, found = i + 1, 0, ([], [])

    return source.mapInArrow(run, schema)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the checked query: in one document of ten, told by its id, the tail repeats."""
    mark = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if mark is None or mark % 10 or not words:
        return words
    g, n = mark // 10, len(words)
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    piece = words[first : first + period]
    return words[:first] + (piece * ((n - first) // period + 1))[: n - first]


def _longest(runs: Column) -> Column:
    """The run of greatest length, then of smallest start, then period."""
    return F.sort_array(F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"])))


def run_digests(docs: DataFrame, edit: Edit | None = repeat_tail) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    found = with_runs(docs.select("doc_id", "text"), edit=edit)
    best = F.try_element_at(_longest(F.col("runs")), F.lit(1))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    size, start, period = (F.col("best").getField(x) for x in ("col1", "start", "period"))
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), (-size).alias("length"), period.alias("period"),
        F.expr("1000 * -best.col1 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
