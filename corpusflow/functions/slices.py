"""Arrow batches worked on in slices, so that a Python worker holds the objects of a few texts at a time."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
# Bytes of text after which freed memory goes back to the system.
_TRIM_BYTES = 16_000_000
_done = [0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(first, length)`` of stretches with about ``SLICE_BYTES`` of text each."""
    if len(texts) == 0:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("float64")))
    part = (ends // SLICE_BYTES).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(texts)]])
    for a, b in zip(starts[:-1], starts[1:]):
        yield int(a), int(b - a)
        _done[0] += int(ends[b - 1] - (ends[a - 1] if a else 0))
        if _done[0] >= _TRIM_BYTES:
            _done[0] = 0
            give_back()


def in_slices(texts: pa.Array, work: Callable[[pa.Array, int], pa.Array], kind: pa.DataType) -> pa.Array:
    """``work(slice, first row)`` of all slices as one array; a worker's output must be as long as its input."""
    return pa.chunked_array([work(texts.slice(first, n), first) for first, n in slices(texts)], kind).combine_chunks()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
