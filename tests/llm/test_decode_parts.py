import numpy as np
import pyarrow as pa

from lexiweave.llm import bpe


def test_decode_works_on_parts_of_a_batch(monkeypatch):
    v = bpe.Vocabulary([b"a", b"bc", b""], np.zeros(256, np.int32), np.zeros(1, np.uint64), np.zeros(1, np.int32), 63)
    monkeypatch.setattr(bpe, "DECODED", 4, raising=False)
    ids = [[0, 1], [1, 1, 0], None, [], [0] * 9, [7, None], [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "token_ids"])
    out = list(bpe._decode(iter([batch, batch.slice(0, 0)]), v))
    assert len(out) > 3 and max(b.num_rows for b in out) < 5
    assert [x for b in out for x in b.column(1).to_pylist()] == ["abc", "bcbca", None, "", "a" * 9, "��", "bc"]
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(7))
