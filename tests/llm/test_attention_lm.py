import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from dalyworks.llm import attention_lm
from dalyworks.llm.common import LOWER


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    """Small tables need no long fit, but where a test is about what is learnt."""
    monkeypatch.setattr(attention_lm, "STEPS", 8)


def plain(rows):
    tokens = [[*(t or "").encode().translate(LOWER).split(), b" "] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        ((i, h, len(x), sum(w in counts for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for (i, _), x, h in zip(rows, tokens, held)),
        key=str,
    )


def test_base_scores_and_counts(spark):
    rows = awkward() + [(i, prose(i, 30)) for i in range(20, 60)]
    found = attention_lm.language_scores(documents(spark, rows, extra=True)).collect()
    tell = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)
    assert tell == plain(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    same = {round(r.score, 3) for r in found if r.doc_id in (2, 3, 4)}
    assert len(same) == 1


def test_context_makes_held_out_text_likelier_than_counts_do(spark, monkeypatch):
    """Two languages of the same size: the words before tell which one a text is in."""
    monkeypatch.setattr(attention_lm, "STEPS", 100)

    def text(i):
        draw = random.Random(i)
        words = [f"{'ab'[i % 2]}{k:03d}" for k in range(60)] if i % 2 else [f"{'xyz'[k % 3]}o{k}" for k in range(60)]
        return " ".join(draw.choices(words, k=150))

    found = [r for r in attention_lm.language_scores(documents(spark, [(i, text(i)) for i in range(200)])).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_probabilities_add_up_to_one():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 50, attention_lm.IDS + 1)
    events = attention_lm.Events.of(counts, 64)
    net = attention_lm.Attention(attention_lm.CONTEXT, (64, 8), 1)
    keys = draw.integers(0, attention_lm.SYMBOLS - 1, (1, attention_lm.CONTEXT))
    logp = [net.log10(keys, 1, np.array([[c]]))[0, 0] for c in range(64)]
    total = sum(10 ** (logp[events.place[i]] + events.within[i]) for i in range(attention_lm.IDS + 1))
    assert abs(total - 1) < 1e-5


def test_no_position_sees_what_follows():
    draw = np.random.default_rng(2)
    net = attention_lm.Attention(attention_lm.CONTEXT, (64, 8), 1)
    keys = draw.integers(0, 1000, (1, attention_lm.CONTEXT))
    other = keys.copy()
    other[0, -5:] = draw.integers(0, 1000, 5)
    a, b = (net.forward(k, attention_lm.SCORED)[0] for k in (keys, other))
    assert np.allclose(a[:-5], b[:-5]) and not np.allclose(a[-5:], b[-5:])


def test_gradient_lowers_the_loss():
    draw = np.random.default_rng(3)
    net = attention_lm.Attention(8, (64, 8), 1)
    keys = draw.integers(0, 20, (4000, 8))
    classes = (keys[:, 5] % 7)[:, None]  # told by a place two back
    before = net.log10(keys, 1, classes).mean()
    learner = attention_lm.Learner(net, 1, 256, 0.02)
    for turn in range(40):
        order = np.random.default_rng(turn).permutation(len(keys))
        learner.through(keys[order], classes[order])
    assert net.log10(keys, 1, classes).mean() > before + 0.8


def plain_layer(net, read, event, events):
    """Log10 probability of ``event`` after the symbols ``read``, one position at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    own = p["e"][read[-1]]
    score = np.array([own @ p["q"] @ (p["e"][x] @ p["k"]) * net.width**-0.5 + p["r"][len(read) - 1 - j] for j, x in enumerate(read)])
    a = np.exp(score - score.max())
    hidden = (a / a.sum()) @ np.array([p["e"][x] @ p["v"] for x in read]) + own
    logits = hidden @ p["u"] + p["c"]
    logp = logits - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    return logp[events.place[event]] / math.log(10) + events.within[event]


def plain_score(model, encode, words, counts):
    leads, total = [], 0.0
    for word in words:
        pieces = encode(" " + word.decode())
        leads.append(pieces[0])
        spelled = sum(
            plain_layer(model.inside, [model.later.symbol[x] for x in pieces[max(0, k - attention_lm.IN_WORD) : k]], e, model.later)
            for k, e in enumerate([*pieces[1:], attention_lm.STOP], 1)
        )
        begun, new = model.begun[pieces[0]], model.new[pieces[0]]
        share = new if begun else 1.0
        total += math.log10(share * 10**spelled + (1 - share) * counts.get(word, 0) / max(begun, 1))
    read = [attention_lm.START, *(model.lead.symbol[x] for x in leads)]
    for i, event in enumerate([*leads, attention_lm.STOP]):
        first = max(0, (i // attention_lm.SCORED - 1) * attention_lm.SCORED)
        total += plain_layer(model.across, read[first : i + 1], event, model.lead)
    return total


def test_scores_match_a_plain_forward_pass(spark, monkeypatch):
    kept = []
    train = attention_lm.train
    monkeypatch.setattr(attention_lm, "train", lambda *a, **b: kept.append(train(*a, **b)) or kept[-1])
    texts = {i: prose(i, 90 if i % 3 else 13) for i in range(20)} | {90: "", 91: "unknownword " * 40, 92: prose(5, 33)}
    found = attention_lm.language_scores(documents(spark, list(texts.items())), chunk_bytes=2000).collect()
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().translate(LOWER).split())
    encode = attention_lm.encoder(attention_lm.TOKENIZERS)
    for r in found:
        want = plain_score(kept[0], encode, texts[r.doc_id].encode().translate(LOWER).split(), counts)
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-3)


def test_chunk_borders_and_texts_longer_than_a_chunk(spark):
    rows = awkward() + [(i, prose(i, 40)) for i in range(20, 50)]
    assert max(len(t or "") for _, t in rows) > 3000
    for size in (700, 3000):
        found = attention_lm.language_scores(documents(spark, rows), chunk_bytes=size).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str) == plain(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_every_training_window_is_dealt_to_one_round(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "LEARNT", 1.0)
    docs = documents(spark, [(i, prose(i, 200)) for i in range(30)]).withColumn("held", attention_lm.held_out(F.col("doc_id")))
    row = attention_lm.chunks(docs.select("doc_id", "text", "held").coalesce(1)).first().asDict()
    events = attention_lm.Events.of(np.ones(attention_lm.IDS + 1), 64)
    nets = [attention_lm.Attention(attention_lm.CONTEXT, (64, 8), 1), attention_lm.Attention(attention_lm.IN_WORD, (64, 8), 1)]
    model = attention_lm.Model(events, events, *nets, None, None)
    rounds = [attention_lm._lessons(model, row, k, 3, 5)[0][0] for k in range(3)]
    starts, held = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["held"], np.uint8)
    assert held.any() and sum(map(len, rounds)) == sum(-(-n // attention_lm.SCORED) for n, h in zip(np.diff(starts), held) if not h)


def test_all_windows_and_later_subwords_of_training_documents_are_learnt(spark):
    docs = documents(spark, [(i, prose(i, 200)) for i in range(30)]).withColumn("held", attention_lm.held_out(F.col("doc_id")))
    row = attention_lm.chunks(docs.select("doc_id", "text", "held").coalesce(1)).first().asDict()
    events = attention_lm.Events.of(np.ones(attention_lm.IDS + 1), 64)
    model = attention_lm.Model(events, events, None, None, None, None)
    rounds = [attention_lm._lessons(model, row, k, 3, 5) for k in range(3)]
    starts, held = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["held"], np.uint8)
    assert sum(len(x[0][0]) for x in rounds) == sum(-(-n // attention_lm.SCORED) for n, h in zip(np.diff(starts), held) if not h)
    keys, later, word = model.word_windows(*attention_lm._pieces(row))
    want, found = Counter(), Counter()
    for k, e, w in zip(keys, later, word):
        want[(k.tobytes(), int(events.place[e]))] += int(np.frombuffer(row["counts"], np.int32)[w])
    for _, (keys, classes, weight) in rounds:
        for k, c, w in zip(keys, classes, weight):
            found[(k.tobytes(), int(c[0]))] += float(w)
    want = {k: v for k, v in want.items() if v}
    assert len(want) > 50 and want.keys() == found.keys() and all(math.isclose(found[k], v, rel_tol=1e-4) for k, v in want.items())


def test_later_subwords_that_read_and_predict_alike_are_one_row(spark):
    """Many words that begin alike give few rows, with the counts of all of them."""
    words = [f"{a}{b}{c}" for a in "qxz" for b in ("qq", "xx", "zz") for c in range(100, 900)]
    texts = [(i, " ".join(random.Random(i).choices(words, k=3000))) for i in range(8)]
    docs = documents(spark, texts).withColumn("held", attention_lm.held_out(F.col("doc_id")))
    row = attention_lm.chunks(docs.select("doc_id", "text", "held").coalesce(1)).first().asDict()
    events = attention_lm.Events.of(np.ones(attention_lm.IDS + 1), 64)
    model = attention_lm.Model(events, events, None, None, None, None)
    dealt = [x for k in range(3) for x in zip(*attention_lm._lessons(model, row, k, 3, 5)[1])]
    distinct = {(k.tobytes(), int(c[0])) for k, c, _ in dealt}
    counts = np.frombuffer(row["counts"], np.int32)
    _, _, word = model.word_windows(*attention_lm._pieces(row))
    assert len(dealt) <= 2 * len(distinct) < (counts[word] > 0).sum()
    assert math.isclose(sum(float(w) for *_, w in dealt), counts[word].sum(), rel_tol=1e-4)


def test_rows_scored_once_score_as_rows_scored_each():
    draw = np.random.default_rng(4)
    net = attention_lm.Attention(attention_lm.IN_WORD, (64, 8), 1)
    keys = draw.integers(0, 1000, (50, attention_lm.IN_WORD))
    row, classes = np.sort(draw.integers(0, 50, 400)), draw.integers(0, 64, 400)
    for size in (1, 200):  # with logits too large for plain exponentials too
        net.p["u"] *= np.float32(size)
        assert np.allclose(net.log10_at(keys, row, classes, 16), net.log10(keys[row], 1, classes[:, None])[:, 0], atol=1e-4, rtol=1e-4)
        assert np.isfinite(net.log10(keys[row], 1, classes[:, None])).all()


def test_empty_table_and_no_training_rows(spark):
    assert attention_lm.language_scores(documents(spark, [])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = attention_lm.language_scores(documents(spark, [(held, "a b")])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_words_spelled_together_are_spelled_as_each_alone():
    speller, draw = attention_lm.Speller(attention_lm.TOKENIZERS), random.Random(6)
    for letters in ("ab1's.é中", "ab\x85 　\x1c'中"):  # with other blanks inside words too
        for _ in range(60):
            words = ["".join(draw.choices(letters, k=draw.randint(1, 6))) for _ in range(draw.randint(0, 30))]
            pieces, sizes = speller.spell(words)
            alone = [speller.encode(" " + word) for word in words]
            assert pieces.tolist() == [x for ids in alone for x in ids] and sizes.tolist() == [len(ids) for ids in alone]


def test_a_word_of_many_chunks_is_learnt_and_scored_once(spark, monkeypatch):
    """The pages hold each distinct word of the corpus once, with its training count."""
    kept, train = [], attention_lm.train
    monkeypatch.setattr(attention_lm, "train", lambda cut, pages, *a, **b: kept.append((cut.count(), pages.collect())) or train(cut, pages, *a, **b))
    texts = {i: prose(i, 60) for i in range(40)}
    attention_lm.language_scores(documents(spark, list(texts.items())), chunk_bytes=700).collect()
    chunks, pages = kept[0]
    totals = np.concatenate([np.frombuffer(p["totals"], np.int64) for p in pages])
    want = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.encode().translate(LOWER).split(), b" "])
    words = {w for t in texts.values() for w in t.encode().translate(LOWER).split()} | {b" "}
    assert chunks > 5 and sorted(totals.tolist()) == sorted(want[w] for w in words)
