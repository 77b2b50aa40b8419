"""Memory of Python tasks: batches cut by the length of their texts, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # bytes of text worked on at once (or one longer text)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Task) -> Task:
    """``run`` that leaves no freed memory behind: Python workers outlive their task and
    wait beside those of later stages.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            give_back()

    return task


def text_slices(
    parts: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of record batches whose texts in ``column`` have at most ``limit`` bytes
    together; a longer text is a slice of its own.
    """
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column(column)), 0)
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))])
        begin = 0
        while begin < part.num_rows:
            end = int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1
            end = min(part.num_rows, max(begin + 1, end))
            yield part.slice(begin, end - begin)
            begin = end
