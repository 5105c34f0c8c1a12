import pyarrow as pa

from tidemark.llm.batches import by_size


def test_slices_keep_rows_and_bounds():
    texts = ["a" * 5, None, "b" * 20, "", "c" * 3, "d" * 4, "é" * 3]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["k", "t"])
    got = list(by_size(iter([batch, batch.slice(0, 0), batch]), 1, 10))
    assert [r for b in got for r in b.column(1).to_pylist()] == texts * 2
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 10 for b in got)
    assert len(got) == 8
