import pyarrow as pa

from filmcrate.llm import common


def test_memory_is_given_back_after_every_batch(monkeypatch):
    called = []
    monkeypatch.setattr(common, "tidy", lambda: called.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]) for n in (common.BATCH_ROWS * 2 + 1, 5)]
    out = list(common.by_batch(lambda b: iter([b]))(iter(batches)))
    assert [b.num_rows for b in out] == [common.BATCH_ROWS, common.BATCH_ROWS, 1, 5]
    assert len(called) == 5  # after each of four, and at the end
