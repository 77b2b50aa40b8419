"""Slices of record batches by the length of their texts."""

import pyarrow as pa

from alamatika.llm.batches import text_slices


def test_slices_are_bounded_and_whole():
    texts = ["aa", None, "b" * 10, "", "c", "é", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["k", "t"])
    got = [s.column(0).to_pylist() for s in text_slices([batch, batch.slice(0, 0)], 1, 4)]
    assert got == [[0, 1], [2], [3, 4, 5, 6]]
