"""Chat formatting by a declarative template, with loss flags for each segment of text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """How turns are written, and which orders of roles are valid.

    A turn is ``open``, its role, ``after_role``, its text, ``close``. ``moves`` maps a state
    to the roles that may follow and the state each leads to; ``loss`` names the roles whose
    texts are learned. Every occurrence in a role or text of a control string or of ``escape``
    is preceded by ``escape`` in the output.
    """

    open: str = "<turn>"
    after_role: str = "\n"
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("<turn>", "</turn>", "### User:", "### Assistant:", "### System:")
    escape: str = "\\"
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    final: frozenset[str] = frozenset({"answered"})
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def escaped(self, text: str) -> str:
        return _marks(self).sub(lambda m: self.escape + m[0], text)

    def role_escaped(self, role: str) -> str:
        """A role is one line: its newlines, too, are written with an escape."""
        return self.escaped(role).replace("\n", f"{self.escape}n")


def _marks(template: Template) -> re.Pattern[str]:
    strings = sorted({template.escape, *template.control}, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, strings)))


def valid(template: Template, roles: list[str]) -> bool:
    """Whether the roles lead from the start to a final state."""
    state = template.start
    for role in roles:
        state = template.moves.get(state, {}).get(role)
        if state is None:
            return False
    return state in template.final


def segments(template: Template, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """The pieces of the output in order, each with whether it is learned."""
    out = []
    for role, text in turns:
        out.append((template.open + template.role_escaped(role) + template.after_role, False))
        if text:
            out.append((template.escaped(text), role in template.loss))
        out.append((template.close, False))
    return out


def parse(template: Template, formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn, read from the output alone.

    A machine with three states (between turns, in a role, in a text); begin and end enclose
    the text as written, escapes included.
    """
    turns, at, mark = [], 0, template.escape
    pattern = _marks(template)
    while at < len(formatted):
        if not formatted.startswith(template.open, at):
            raise ValueError(f"no turn opens at {at}")
        at += len(template.open)
        role, at = _read(template, pattern, formatted, at, template.after_role, {f"{mark}n": "\n"})
        begin = at + len(template.after_role)
        text, end = _read(template, pattern, formatted, begin, template.close, {})
        turns.append((role, text, begin, end))
        at = end + len(template.close)
    return turns


def _read(template: Template, pattern: re.Pattern[str], formatted: str, at: int, stop: str, extra: dict[str, str]) -> tuple[str, int]:
    """The unescaped text from ``at`` to the next ``stop`` that is not escaped, and where that is."""
    out, mark = [], template.escape
    finder = re.compile("|".join([re.escape(mark) + f"(?:{pattern.pattern})", *map(re.escape, extra), re.escape(stop)]))
    while m := finder.search(formatted, at):
        out.append(formatted[at : m.start()])
        if m[0] == stop:
            return "".join(out), m.start()
        out.append(extra.get(m[0]) or m[0][len(mark) :])
        at = m.end()
    raise ValueError("a turn does not close")


SEGMENT = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, valid, formatted, segments) for each conv_id of (conv_id, turn, role, text).

    Turns are in the order of ``turn``, nulls first; turns that share a number are ordered by
    role and text, and repeated rows each count. A null text is empty, a null role is an empty
    role; a null conv_id is a conversation like any other. A conversation whose roles break the
    order is formatted all the same, with ``valid`` false. A conversation is one record, so its
    turns meet in one task; conversations that are equal do not.
    """
    plan = template or Template()
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    schema = T.StructType(
        [
            grouped.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("valid", T.BooleanType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("segments", SEGMENT),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for i, turns in zip(batch.column(0), batch.column(1), strict=True):
                pairs = [(t["role"], t["text"]) for t in turns.as_py()]
                parts = segments(plan, pairs)
                out.append(
                    {
                        "conv_id": i.as_py(),
                        "n_turns": len(pairs),
                        "valid": valid(plan, [r for r, _ in pairs]),
                        "formatted": "".join(t for t, _ in parts),
                        "segments": [{"text": t, "loss": flag} for t, flag in parts],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    return grouped.mapInArrow(run, schema)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the output says when it is read back: turns, learned text and lengths.

    Turns come from parsing ``formatted``; the learned text comes from the segments that carry
    the loss flag, which must lie where the parser finds a learned role's text.
    """
    plan = template or Template()
    extra = [
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("valid", T.BooleanType()),
    ]
    schema = T.StructType([formatted.schema["conv_id"], *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for i, ok, whole, parts in zip(*(batch.column(k) for k in range(4)), strict=True):
                text = whole.as_py()
                turns = parse(plan, text)
                every, learned = hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in turns:
                    every.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                own = {b: (e, said) for role, said, b, e in turns if role in plan.loss}
                at = chars = 0
                for part in parts.as_py():
                    end = at + len(part["text"])
                    if part["loss"]:
                        if own[at][0] != end:
                            raise ValueError(f"conversation {i}: the loss mask does not end where the text does")
                        learned.update(own[at][1].encode("utf-8", "surrogatepass"))
                        chars += len(own[at][1])
                    at = end
                out.append((i.as_py(), len(turns), every.hexdigest(), chars, learned.hexdigest(), len(text), ok.as_py()))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    return formatted.select("conv_id", "valid", "formatted", "segments").mapInArrow(run, schema)


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, whose two texts hold the control strings themselves."""
    said = "\\### Assistant: </turn> ok"
    probe = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    slim = rows.select(*(F.col(c) for c in ("conv_id", "turn", "role", "text")))
    made = rows.sparkSession.createDataFrame(probe, "conv_id long, turn long, role string, text string")
    return slim.unionByName(made)
