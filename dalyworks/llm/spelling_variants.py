"""Spelling variants: words one edit apart by pivotal grams, and the commoner form each leads to."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dalyworks.llm.common import lower_ascii, scratch, staged

#: Runs of letters, code points of a word at least, and its occurrences at least.
LETTERS = r"[a-zÀ-ÿ]"
SHORTEST = 5
LEAST = 3
#: A form occurs at least so many times as often as the word that it explains.
TIMES = 2
#: Code points of a gram, and the edits that make words near.
GRAM = 2
EDITS = 1
#: Counters that order the grams, rare ones first; grams that share one are counted together.
COUNTERS = 1 << 13


def planted(doc_id: Column, word: Column) -> Column:
    """The word, or what the checked query makes of it: one in 97 loses a code point."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(mark, F.length(word)).cast("int")
    cut = F.concat(F.substring(word, 1, at), F.substring(word, at + 2, F.length(word)))
    return F.when(mark % 97 == 0, cut).otherwise(word)


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, edit=None) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lowered, of five letters and ``least`` occurrences or more.

    Null texts have none. ``edit`` makes a column of (doc_id, word) that takes the word's place.
    Occurrences are summed where they are read before they are shuffled.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))
    each = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("word"))
    if edit:
        each = each.select(edit(F.col("id"), F.col("word")).alias("word")).where(F.length("word") >= SHORTEST)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _counter(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % COUNTERS


def pivots(places: list[int], costs: list[int], count: int = EDITS + 1, gram: int = GRAM) -> list[int]:
    """``count`` of the places, ``gram`` or more apart, whose costs sum to the least.

    Dynamic programming from left to right: the best choice of k grams up to a place either
    leaves its gram out, or adds it to the best choice of k - 1 grams that end before it.
    """
    order = sorted(range(len(places)), key=places.__getitem__)
    best: list[list[tuple[int, list[int]] | None]] = [[(0, []) for _ in range(len(order) + 1)]]
    for k in range(1, count + 1):
        row: list[tuple[int, list[int]] | None] = [None]
        for t, x in enumerate(order):
            free = t
            while free and places[order[free - 1]] > places[x] - gram:
                free -= 1
            before = best[k - 1][free]
            taken = (before[0] + costs[x], [*before[1], places[x]]) if before else None
            row.append(min((c for c in (row[-1], taken) if c), default=None))
        best.append(row)
    return best[count][-1][1] if best[count][-1] else []


def signature(word: str, counts: np.ndarray | list[int]) -> list[tuple[int, bool]]:
    """(place, whether it is a pivot) of the grams in the word's prefix, by the order of grams.

    The prefix has the ``GRAM * EDITS + 1`` rarest grams and all others that equal the last of
    them. Two disjoint ones of the rarest are pivots. Words of two letters have no prefix.
    """
    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    cost = [counts[_counter(g)] for g in grams]
    order = sorted(range(len(grams)), key=lambda i: (cost[i], grams[i], i))
    first = order[: GRAM * EDITS + 1]
    if not first:
        return []
    last = (cost[first[-1]], grams[first[-1]])
    chosen = pivots(first, [cost[i] for i in first])
    return [(i, i in chosen) for i in order if (cost[i], grams[i]) <= last]


def _marked(words: DataFrame) -> DataFrame:
    """(word, n, size, place, pivot): one row per gram of each word's prefix."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substring("word", i, F.lit(GRAM)))
    seen = words.where(F.length("word") >= GRAM).select(F.explode(grams).alias("gram"))
    seen = seen.groupBy(F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(COUNTERS)).alias("counter")).count().toArrow()  # COUNTERS rows at most
    table = np.zeros(COUNTERS, np.int64)
    table[seen.column(0).to_numpy()] = seen.column(1).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.tolist()
        for batch in batches:
            rows = [(i, len(w), *x) for i, w in enumerate(batch.column(0).to_pylist()) for x in signature(w, counts)]
            if rows:
                at, size, place, pivot = zip(*rows, strict=True)
                kept = batch.take(pa.array(at))
                made = [pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(pivot)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], ["word", "n", "size", "place", "pivot"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, place int, pivot boolean")


def _keys(partner: Column) -> Column:
    """What a word with a gram at ``place`` shares with a near word of ``partner`` code points.

    An edit that leaves the gram whole lies to its right, and the gram stands at the same place
    in both, or to its left, and the gram is as far from the end in both; what lies on the
    edit's side is cut in two by the partner's length, and the edit is in one half: all else is
    equal. There is one key for each of the four halves, or none where the word has no such part.
    """
    size, place, word = F.col("size"), F.col("place"), F.col("word")
    rest = partner - place - GRAM
    near = F.floor((rest + 1) / 2).cast("int")
    head = place + GRAM
    there = place + partner - size
    close = F.floor((there + 1) / 2).cast("int")

    def key(kind: int, where: Column, a: Column, b: Column) -> Column:
        return F.xxhash64(F.lit(kind), partner, where, a, b)

    none, after = F.lit(""), F.substring(word, place + 1, size)
    beyond = F.when((rest >= 0) & (head + near <= size), key(0, place, F.substring(word, F.lit(1), head + near), none))
    tail = F.when(rest > near, F.substring(word, size - (rest - near) + 1, rest - near)).otherwise(none)
    inside = F.when(rest >= 0, key(1, place, F.substring(word, F.lit(1), head), tail))
    before = F.when((there >= 0) & (place >= close), key(2, there, F.substring(word, place - close + 1, size), none))
    touching = F.when(there >= 0, key(3, there, F.substring(word, F.lit(1), there - close), after))
    return F.filter(F.array(beyond, inside, before, touching), lambda x: x.isNotNull())


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of ``words`` (word, n; distinct) one edit apart, each once.

    Of two words the one whose prefix ends at the rarer gram has its pivots, where the edit does
    not touch them, among the other's prefix: so each word's pivots are looked up in an index of
    all prefixes, at places and lengths that one edit allows, and every pair found is verified.
    """
    marked = staged(_marked(words), "grams")
    index = marked.select(F.explode(_keys(F.col("size"))).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    asked = marked.where("pivot").withColumn("partner", F.explode(F.array(*[F.col("size") + d for d in range(-EDITS, EDITS + 1)])))
    asked = asked.select(F.explode(_keys(F.col("partner"))).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    met = asked.join(index, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", EDITS) == EDITS))
    first = F.col("a") < F.col("b")
    low, high = F.struct("a", "a_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"))
    ends = met.select(F.when(first, low).otherwise(high).alias("x"), F.when(first, high).otherwise(low).alias("y"))
    return ends.select(F.col("x.a").alias("a"), F.col("x.a_n").alias("a_n"), F.col("y.a").alias("b"), F.col("y.a_n").alias("b_n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, twice as far in each round.

    A form is at least ``TIMES`` as frequent as its word, so there is no circle and the number of
    rounds grows with the logarithm of the longest chain.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = staged(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words).

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near
    word of largest n (ties: the smallest by code point) if that is ``times`` its own n or more,
    else null; root follows forms to the last. Each word has fewer near words than one edit
    over the letters allows, so no group is large.
    """
    with scratch(words.sparkSession):
        words = staged(words.select("word", F.col("n").cast("long").alias("n")), "words")
        near = staged(near_pairs(words), "near")
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
        best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
        found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
        fits = F.col("form_n") >= times * F.col("n")
        found = found.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n"))
        found = staged(found, "forms")
        roots = _roots(found.where("form IS NOT NULL"))
        whole = found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return staged(whole.select("word", "form", "root", "n", "n_near", "form_n"), "variants", keep=True)


def variants(docs: DataFrame) -> DataFrame:
    """The checked query: the words of ``docs`` with planted losses, and their variants."""
    return group_variants(count_words(docs.select("doc_id", "text"), edit=planted))
