import numpy as np
from helpers import awkward, documents, prose

from dalyworks.llm import training_order


def test_permutation_is_one_to_one_and_keyed():
    for size in (1, 2, 3, 5, 16, 17, 1000):
        for key in (0, 1, 12345):
            slots = training_order.permute(np.arange(size), size, key)
            assert sorted(slots.tolist()) == list(range(size))
    a, b = (training_order.permute(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def test_every_text_comes_back_from_its_records(spark, tmp_path):
    rows = awkward() + [(50 + i, prose(i, 20 * i)) for i in range(12)]
    docs = documents(spark, rows, extra=True)
    records = training_order.ordered(docs, length=16, shard=8)
    found = records.collect()
    width = training_order.stride(16)
    assert sorted(r.slot for r in found) == list(range(len(found)))
    assert all(len(r.record) == width and r.shard == r.slot // 8 and r.shard_offset == r.slot % 8 * width for r in found)
    encode = training_order.encoder(training_order.TOKENIZERS)
    by_id = {}
    for r in sorted(found, key=lambda r: (str(r.doc_id), r.seq_no)):
        head = np.frombuffer(r.record[:16], training_order.HEAD)[0]
        assert head["seq_no"] == r.seq_no and head["n_tokens"] == r.n_tokens
        ids = np.frombuffer(r.record[16:], "<u2")
        assert (ids[r.n_tokens :] == training_order.END).all()
        if r.doc_id not in (None, 5):
            by_id.setdefault(r.doc_id, []).extend(ids[: r.n_tokens].tolist())
    for doc_id, text in rows:
        if doc_id not in (None, 5):
            assert by_id[doc_id] == [*encode(text or ""), training_order.END]
    path = str(tmp_path / "shards")
    training_order.write_shards(training_order.ordered(docs, length=16, shard=8), path, length=16, shard=8)
    read = training_order.read_from(spark, path, 0, length=16, shard=8).collect()
    whole = {r.slot: (r.doc_id, r.seq_no, np.frombuffer(r.record[16:], "<u2")[: r.n_tokens].tolist()) for r in found}
    assert {r.slot: (r.doc_id, r.seq_no, r.tokens) for r in read} == whole
    later = training_order.read_from(spark, path, 13, length=16, shard=8).collect()
    assert sorted(r.slot for r in later) == list(range(13, len(found)))


def test_empty_table(spark):
    assert training_order.ordered(documents(spark, [])).collect() == []
