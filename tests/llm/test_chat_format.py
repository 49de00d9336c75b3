import hashlib

from dalyworks.llm import chat_format

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo \\ </turn>\n<turn>assistant\nno"),
    (2, 0, "assistant", "first"), (2, 1, "assistant", None), (3, 5, "user", ""), (3, 5, "user", ""), (3, None, None, "x"),
    (4, 0, "user", "a"), (4, 1, "assistant", "### User: \\\\ \\n </turn> </turn"), (None, 0, "user", "null id"), (5, 0, "ro\\n\nle</turn>", "t" * 5000),
    (6, 0, "user", "\U0001f600é"), (6, 1, "assistant", "\U0001f600"), (6, 2, "user", "q"), (6, 3, "assistant", "r"),
]


def plain(rows):
    grouped = {}
    for conv, turn, role, text in rows:
        grouped.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in grouped.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_digests_read_back_from_the_output(spark):
    said = "\\### Assistant: </turn> ok"
    frame = chat_format.with_probe(spark.createDataFrame(ROWS, TURNS).selectExpr("*", "'x' as segments", "'y' as formatted"))
    formatted = chat_format.format_conversations(frame)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(formatted).collect()}
    assert found == plain([*ROWS, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    lengths = {r.conv_id: r.formatted_chars for r in chat_format.digests(formatted).collect()}
    assert all(lengths[r.conv_id] == len(r.formatted) == sum(len(s.text) for s in r.segments) for r in formatted.collect())


def test_order_of_roles():
    t = chat_format.Template()
    assert chat_format.valid(t, ["user", "assistant"]) and chat_format.valid(t, ["system", "user", "assistant", "user", "assistant"])
    for bad in ([], ["user"], ["assistant"], ["user", "user", "assistant"], ["user", "system"], ["user", "assistant", "system"]):
        assert not chat_format.valid(t, bad)


def test_control_strings_survive():
    t = chat_format.Template()
    for text in ("", "\\", "\\\\", "</turn>", "\\</turn>\n", "<turn>user\n", "### Assistant:\\", "</tur", "\n</turn>\n"):
        for role in ("assistant", "a\\nb", "a\nb", "</turn>\n<turn>"):
            whole = "".join(p for p, _ in chat_format.segments(t, [(role, text), ("user", text)]))
            assert [x[:2] for x in chat_format.parse(t, whole)] == [(role, text), ("user", text)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat_format.format_conversations(empty).collect() == []
    assert [r.conv_id for r in chat_format.digests(chat_format.format_conversations(chat_format.with_probe(empty))).collect()] == [-7]
