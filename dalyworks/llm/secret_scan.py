"""Secret scans in built-in functions: patterns, and entropy in windows of candidate strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dalyworks.llm.common import fresh

#: Patterns of the base kinds (fixed values), in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Characters of an assigned value at least.
VALUE = 8
#: Candidates for the entropy test: unbroken strings of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Width of a window, and the entropy in bits that a window must reach, by character class.
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Strings that no secret holds (lower case): samples, placeholders and alphabets.
ALLOWED = ("example", "placeholder", "changeme", "your_", "xxxx", "test", "abcdefgh", "012345", "lorem")


def _pieces(text: Column, pattern: str, matches: Column) -> Column:
    """For each of ``matches`` (all of ``pattern``): what splitting leaves before it, in characters, and itself."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))


def _spans(pieces: Column) -> Column:
    """(start, end, match) from pieces: their lengths add up to the places.

    The sums run in two steps, inside blocks of about the square root of the number of matches
    and over the blocks, so that a text of very many matches copies no long array each time.
    """
    wide = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def block(first: Column) -> Column:
        return F.aggregate(
            F.slice(pieces, first, wide),
            F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.length(x["match"])).alias("at"),
                F.concat(
                    acc["found"],
                    F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("match"))),
                ).alias("found"),
            ),
        )

    folded = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.size(pieces), wide), block),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["at"]).alias("at"),
            F.concat(
                acc["found"],
                F.transform(x["found"], lambda y: F.struct((acc["at"] + y["start"]).alias("start"), (acc["at"] + y["end"]).alias("end"), y["match"].alias("match"))),
            ).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(F.size(pieces) > 0, folded).otherwise(none)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters in a row.

    One fold over the characters: each turn adds one to the count of the character that enters
    and takes one from that of the character that leaves, and moves the sum of n*log2(n)
    accordingly; the entropy is log2(w) - sum/w once the window is full. The characters and those
    ``window`` places before them are laid side by side first, so that a turn costs the same
    anywhere in a long string.
    """
    weight = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(F.expr("cast(map() as map<int,int>)").alias("n"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    codes = F.transform(F.split(candidate, ""), F.ascii)
    steps = F.arrays_zip(codes.alias("enters"), F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.size(codes)).alias("leaves"))

    def turn(acc: Column, x: Column) -> Column:
        enters, leaves, i = x["enters"], x["leaves"], acc["i"] + 1
        had = F.coalesce(acc["n"][enters], F.lit(0))
        lost = F.coalesce(acc["n"][leaves], F.lit(0))
        changed = enters != leaves
        total = F.when(
            changed, acc["sum"] + weight(had + 1) - weight(had) + F.when(leaves >= 0, weight(lost - 1) - weight(lost)).otherwise(F.lit(0.0))
        ).otherwise(acc["sum"])
        kept = F.map_filter(acc["n"], lambda k, v: (k != enters) & (k != leaves))
        entered = F.when(changed, had + 1).otherwise(had)
        counts = F.map_concat(kept, F.create_map(enters, entered.cast("int")))
        counts = F.when(changed & (leaves >= 0) & (lost > 1), F.map_concat(counts, F.create_map(leaves, (lost - 1).cast("int")))).otherwise(counts)
        bits = F.log2(F.lit(float(window))) - total / window
        return F.struct(counts.alias("n"), i.alias("i"), total.alias("sum"), F.greatest(acc["best"], F.when(i >= window, bits).otherwise(F.lit(0.0))).alias("best"))

    return F.aggregate(steps, zero, turn, lambda acc: acc["best"])


def _suspicious(match: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a candidate has, apart from listed words, a part that mixes letters and digits and
    has a window whose entropy reaches the threshold of the part's character class.

    The allow list mutes the windows that touch a listed word, not the whole candidate: a key
    that an unbroken string holds beside such a word is still found.
    """
    parts = F.split(match, "(?i:" + "|".join(map(re.escape, allowed)) + ")", -1) if allowed else F.array(match)

    def tells(part: Column) -> Column:
        bits = F.when(part.rlike("^[0-9a-fA-F]+$"), F.lit(BITS["hex"])).when(part.rlike("^[A-Za-z0-9]+$"), F.lit(BITS["alnum"])).otherwise(F.lit(BITS["base64"]))
        return F.when((F.length(part) >= WINDOW) & part.rlike("[0-9]") & part.rlike("[A-Za-z]"), peak_entropy(part) >= bits).otherwise(F.lit(False))

    return F.exists(parts, tells)


def find_secrets(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` without its text, with ``found``: an array of (start, kind number, end).

    Kinds are numbered as in ``KINDS``; places are code points, ends exclusive. Base matches are
    leftmost and do not overlap within a kind; ``entropy`` adds every candidate string with a
    window of high entropy that the allow list does not suppress, also where a base match lies.
    Work grows with a string's length, and with the number of matches to the power 1.5.
    Null and empty texts have none. Nothing is shuffled and every row is judged by itself.
    """
    out = fresh(docs.columns, "found")
    keep = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    names = {n: fresh([*docs.columns, out], n) for n in ("m_assign", "m_value", "m_access", "m_hex", "m_candidate", "body")}
    cuts = {n: fresh([*docs.columns, out, *names.values()], f"{n}_cut") for n in ("m_assign", "m_access", "m_hex", "m_candidate")}
    has = body.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)")
    nothing = F.array().cast("array<string>")
    staged = docs.select(
        *keep,
        body.alias(names["body"]),
        F.when(has, _all(body, ASSIGN)).otherwise(nothing).alias(names["m_assign"]),
        F.when(has, _all(body, ASSIGN, 2)).otherwise(nothing).alias(names["m_value"]),
        F.when(F.contains(body, F.lit("AKIA")), _all(body, ACCESS)).otherwise(nothing).alias(names["m_access"]),
        _all(body, HEX).alias(names["m_hex"]),
        _all(body, CANDIDATE).alias(names["m_candidate"]),
    )
    patterns = {"m_assign": ASSIGN, "m_access": ACCESS, "m_hex": HEX, "m_candidate": CANDIDATE}
    empty = F.array().cast("array<struct<gap:int,match:string>>")
    staged = staged.select(
        *keep, names["m_value"],
        *[F.when(F.size(names[n]) > 0, _pieces(F.col(names["body"]), p, F.col(names[n]))).otherwise(empty).alias(cuts[n]) for n, p in patterns.items()],
    )
    assigned = F.zip_with(
        _spans(F.col(cuts["m_assign"])), F.col(names["m_value"]),
        lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("match")),
    )
    parts = [
        tagged(F.filter(assigned, lambda x: F.length(x["match"]) >= VALUE), 0),
        tagged(_spans(F.col(cuts["m_access"])), 1),
        tagged(_spans(F.col(cuts["m_hex"])), 2),
        tagged(F.filter(_spans(F.col(cuts["m_candidate"])), lambda x: _suspicious(x["match"], allowed)), 3),
    ]
    counts = [cuts[n] for n in patterns]
    parts = [F.when(F.size(n) > 0, p).otherwise(none) for n, p in zip(counts, parts, strict=True)]
    return staged.select(*keep, F.array_sort(F.concat(*parts)).alias(out))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text"))
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
