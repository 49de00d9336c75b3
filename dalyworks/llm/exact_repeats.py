"""Exact repeats over documents: a sparse suffix array, its common-prefix intervals, removal.

Every 400-byte string holds an anchor among its first ``WINDOW`` positions, chosen by content
alone, so equal strings have anchors at equal places. An anchor's ``core`` is the part of the
string that starts at the anchor and lies in all 400-byte strings that may have chosen it; its
context is what surrounds the core in those strings. Anchors whose core occurs once are dropped;
anchors whose whole context recurs are settled; the few others, at the borders of repeats, are
sorted as suffixes (the core's name first, then what follows), and their common-prefix intervals
are scanned for occurrences that also agree to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dalyworks.llm.common import staged

#: Length of the strings that count, and positions among which one is an anchor.
SPAN = 400
WINDOW = 128
#: Bytes whose hash decides between the positions.
GRAM = 16
#: Contexts of one core that one task scans; a core with more is settled by counted strings.
GROUP = 20_000
#: Buckets of the bit map that tells most untouched documents from the rest.
BUCKETS = 1 << 22


def _slide(values: np.ndarray, width: int, keep) -> np.ndarray:
    """``keep`` (minimum or maximum) over each ``width`` neighbours in a row."""
    done, span = values, 1
    while 2 * span <= width:
        done = keep(done[:-span], done[span:])
        span *= 2
    rest = width - span
    return keep(done[:-rest], done[rest:]) if rest else done


def anchors(text: bytes, span: int = SPAN, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Ascending positions; at least one in the first ``window`` places of any ``span`` bytes."""
    if len(text) < span:
        return np.empty(0, np.int64)
    h = (np.frombuffer(text, np.uint8).astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint32(0x85EBCA77) + (h[size:] ^ (h[size:] >> np.uint32(15)))
        size *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE3D)
    h = h[: len(text) - span + window]
    low = _slide(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint32)
    reach = _slide(np.concatenate((edge, low, edge)), window, np.maximum)
    return np.flatnonzero(h == reach[: len(h)])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(body).alias("mark"), body.cast("binary").alias("body")
    )


def _anchor_rows(span: int, window: int):
    core = span - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        held: list[tuple[np.ndarray, ...]] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["id", "mark", "pos", "core", "whole"])

        for batch in batches:
            for i, m, b in zip(*(batch.column(k) for k in range(3)), strict=True):
                text = b.as_py()
                found = anchors(text, span, window)
                n, places = len(found), found.tolist()
                if not n:
                    continue
                cores = np.fromiter((digest(text[a : a + core]) for a in places), np.uint64, n)
                wholes = np.fromiter((digest(text[max(0, a - window + 1) : a + span], min(a, window - 1)) for a in places), np.uint64, n)
                held.append((np.full(n, i.as_py(), np.int64), np.full(n, m.as_py(), np.int64), found, cores.view(np.int64), wholes.view(np.int64)))
                if len(held) >= 1000:
                    yield full()
                    held.clear()
        if held:
            yield full()

    return run


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit map, of a fixed size, of the buckets that (id, mark) of ``keys`` fall into."""
    bucket = F.pmod(F.xxhash64("id", "mark"), F.lit(BUCKETS)).cast("int").alias("bucket")
    found = np.zeros(BUCKETS, bool)
    found[keys.select(bucket).distinct().toPandas()["bucket"].to_numpy(np.int64)] = True
    return np.packbits(found)


def _touched(keyed: DataFrame, bits: np.ndarray, wanted: bool) -> DataFrame:
    """Rows of ``keyed`` whose bucket is set in ``bits``, or those whose bucket is not."""
    names = keyed.columns
    bucketed = keyed.withColumn("bucket", F.pmod(F.xxhash64("id", "mark"), F.lit(BUCKETS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            there = (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(there == wanted)).select(names)

    return bucketed.mapInArrow(run, keyed.schema)


def _context_rows(span: int, window: int):
    core = span - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["id", "mark", "pos", "core", "hot", "left", "right"])

        for batch in batches:
            for i, m, b, asked in zip(*(batch.column(k) for k in range(4)), strict=True):
                name, mark, text = i.as_py(), m.as_py(), b.as_py()
                for x in {(p["pos"], p["core"], p["hot"]) for p in asked.as_py()}:
                    a = x[0]
                    out.append((name, mark, *x, text[max(0, a - window + 1) : a], text[a + core : a + span]))
                if len(out) >= 10_000:
                    yield full()
                    out.clear()
        if out:
            yield full()

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a suffix array, by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes i-1 and i, with lcp[0] unused; deeper intervals
    come before those that enclose them.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def scan_group(rights: list[bytes], lefts: list[bytes], need: int) -> list[tuple[int, int] | None]:
    """For suffixes in ascending order: (left, right) reach of each one's repeats, or none.

    Two suffixes repeat a long enough string if they agree on r bytes to the right of the core
    and l to its left, with l + r >= need. In an interval of depth r the occurrences are taken
    in the order of what precedes them, read backwards; neighbours there have the longest
    common left extension, and where an extension ends the bytes before differ, or a document
    begins: the repeat is maximal to the left. All members of an interval are tested, not
    suffixes next to each other alone.
    """
    n = len(rights)
    back = [x[::-1] for x in lefts]
    if n == 2:
        reach = (_common(back[0], back[1]), _common(rights[0], rights[1]))
        return [reach if sum(reach) >= need else None] * 2
    order = sorted(range(n), key=back.__getitem__)
    rank = [0] * n
    for place, x in enumerate(order):
        rank[x] = place
    shared = np.array([0] + [_common(back[order[i - 1]], back[order[i]]) for i in range(1, n)])
    least = [shared]
    while 2 ** len(least) <= n:
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    ranks = np.array(rank)
    reach_left, reach_right = np.full(n, -1), np.full(n, -1)
    for depth, first, last in intervals([0] + [_common(rights[i - 1], rights[i]) for i in range(1, n)]):
        if first == last:
            continue
        members = np.arange(first, last + 1)
        members = members[np.argsort(ranks[members])]
        begin, end = ranks[members[:-1]] + 1, ranks[members[1:]]
        level = np.frexp(end - begin + 1)[1] - 1
        between = np.array([min(least[k][a], least[k][b - 2**k + 1]) for k, a, b in zip(level.tolist(), begin.tolist(), end.tolist(), strict=True)])
        longest = np.maximum(np.append(between, -1), np.insert(between, 0, -1))
        fits = longest + depth >= need
        some = members[fits]
        reach_left[some] = np.maximum(reach_left[some], longest[fits])
        reach_right[some] = np.maximum(reach_right[some], depth)
    return [(int(a), int(b)) if b >= 0 else None for a, b in zip(reach_left, reach_right, strict=True)]


def _scan(span: int, window: int):
    core = span - window + 1

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and held[-1][3] != row[3]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "mark", "s", "e"])

        for group in groups(batches):
            if len(group) > 1:
                found = scan_group([g[5] for g in group], [g[4] for g in group], window - 1)
                out += [(g[0], g[1], g[2] - x[0], g[2] + core + x[1]) for g, x in zip(group, found, strict=True) if x]
            if len(out) > 20_000:
                yield full()
                out = []
        if out:
            yield full()

    return run


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(id, mark, s, e): repeated strings by document, of ``span`` bytes or more; they may overlap.

    ``id`` is the doc_id (the least long where it is null) and ``mark`` a hash of the text; ``s``
    and ``e`` may reach over the text's ends by less than ``window``. Contexts are equal or not
    by 64-bit hashes until the borders, where bytes are compared. A core with more than
    ``group`` distinct contexts is not scanned in one task: each of its strings, named by what
    lies left and right of the core, is counted instead, which finds the same repeats.
    """
    keyed = _keyed(docs, doc_id, text)
    every = staged(keyed.mapInArrow(_anchor_rows(span, window), "id long, mark long, pos long, core long, whole long"), "anchors")
    cores = staged(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    some = staged(every.join(cores, "core"), "some")
    wholes = some.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "pos")).alias("one"), F.min("core").alias("core"))
    wholes = staged(wholes.where("n > 1").select("whole", "core", "one.*"), "wholes")
    names = wholes.select("whole")
    settled = some.join(names, "whole").select("id", "mark", (F.col("pos") - (window - 1)).alias("s"), (F.col("pos") + span).alias("e"))
    open_ = staged(some.join(names, "whole", "left_anti").select("id", "mark", "pos", "core"), "open")
    opened = staged(open_.select("core").distinct(), "opened")
    partners = wholes.join(opened, "core", "left_semi").select("id", "mark", "pos", "core")
    needed = staged(open_.unionByName(partners), "needed")
    large = staged(needed.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > group).select("core", F.lit(True).alias("hot")), "large")
    asked = needed.join(large, "core", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = staged(asked.groupBy("id", "mark").agg(F.collect_list(F.struct("pos", "core", "hot")).alias("asked")), "asked")
    bodies = _touched(keyed, _bits(asked), True).join(asked, ["id", "mark"]).select("id", "mark", "body", "asked")
    contexts = staged(bodies.mapInArrow(_context_rows(span, window), "id long, mark long, pos long, core long, hot boolean, left binary, right binary"), "contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = contexts.where("not hot").select("id", "mark", "pos", "core", "left", "right")
    scanned = suffixes.repartition(parts, "core").sortWithinPartitions("core", "right").mapInArrow(_scan(span, window), "id long, mark long, s long, e long")
    strings = contexts.where("hot").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    strings = strings.where((F.length("left") >= F.col("i")) & (F.length("right") >= window - 1 - F.col("i")))
    before = F.expr("substring(left, length(left) - i + 1, i)")
    after = F.expr(f"substring(right, 1, {window - 1} - i)")
    strings = strings.select("id", "mark", "pos", "i", F.xxhash64("core", "i", before, after).alias("name"))
    twice = staged(strings.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "twice")
    counted = strings.join(twice, "name").select("id", "mark", (F.col("pos") - F.col("i")).alias("s"), (F.col("pos") - F.col("i") + span).alias("e"))
    return settled.unionByName(scanned).unionByName(counted)


def _runs(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, inside a text of ``size`` bytes."""
    runs: list[list[int]] = []
    for s, e in sorted((max(0, x["s"]), min(size, x["e"])) for x in spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, b, spans in zip(*(batch.column(k) for k in range(3)), strict=True):
            text = b.as_py()
            runs = _runs(spans.as_py() or [], len(text))
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            name = i.as_py()
            out.append((None if name == -(2**63) else name, len(text), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
        if out:
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Bytes covered by a ``span``-byte string that also starts elsewhere go. Null texts are empty;
    texts shorter than ``span`` keep all their bytes; repeated rows are repeats of each other.
    Documents in no repeat, told by a bit map of fixed size, are finished where they are read;
    only the rest is joined to its spans.
    """
    found = repeated(docs, doc_id, text, span, window, group)
    spans = staged(found.groupBy("id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    keyed, bits = _keyed(docs, doc_id, text), _bits(spans)
    none = F.lit(None).cast("array<struct<s:bigint,e:bigint>>")
    apart = _touched(keyed, bits, False).select("id", "body", none.alias("spans")).mapInArrow(_cut, RESULT)
    joined = _touched(keyed, bits, True).join(spans, ["id", "mark"], "left").select("id", "body", "spans").mapInArrow(_cut, RESULT)
    return apart.unionByName(joined)
