"""Arrow text columns as flat byte arrays: words, lines and hashes of many documents at once.

Texts are handled in slices of about ``SLICE`` bytes (at least one document each), so the arrays of a
task stay bounded however many rows a batch has.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusflow.llm.workers import between

SLICE = 2_000_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_C = [np.uint64(c) for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: anything but white space.
WORD = ~SPACES


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C[0]
    x = x ^ (x >> np.uint64(29))
    x = x * _C[1]
    return x ^ (x >> np.uint64(32))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several, order included."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mix(out * _C[2] + part.astype(np.uint64) + _C[3])
    return out


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}
between(_powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(n + n // 4 + 1, base, np.uint64)
        have[0] = 1
        np.cumprod(have, dtype=np.uint64, out=have)
        _powers[base] = have
    return have[:n]


class Texts:
    """The bytes of a run of documents; ``offsets[i]`` is where document i begins."""

    def __init__(self, column: pa.Array):
        data, self.offsets = flat(column)
        self.data, self.n = data, len(column)
        self._prefix = None

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each document has."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def spans(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each maximal run of flagged bytes inside a document."""
        first, last = flags.copy(), flags.copy()
        first[1:] &= ~flags[:-1]
        last[:-1] &= ~flags[1:]
        full = np.flatnonzero(np.diff(self.offsets))
        heads, tails = self.offsets[full], self.offsets[full + 1] - 1
        first[heads] = flags[heads]
        last[tails] = flags[tails]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, self.doc_of(starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of spans; equal bytes give equal hashes wherever they stand.

        ``data`` may be another form of the bytes (lower case), the same for every call.
        """
        if self._prefix is None:
            self._prefix = prefixes(self.data if data is None else data)
        return span_hashes(self._prefix, starts, ends)


def prefixes(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` works out the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = _power(_UNBASE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _C[3])


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of ``width`` bytes."""
    return mix((prefix[width:] - prefix[:-width]) * _power(_UNBASE, len(prefix) - width))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, content = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[offsets[0]:offsets[-1]] if content is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each."""
    _, offsets = flat(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, len(column))
        at = end


def in_slices(column: pa.Array, work, size: int = SLICE) -> pa.Array:
    """``work`` of each slice of a column, put together; no rows give what ``work`` gives for none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = [work(column.slice(a, b - a)) for a, b in slices(column, size)]
    return pa.concat_arrays(parts) if parts else work(column)


def struct(**columns) -> pa.StructArray:
    """A struct column from named columns."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, list(columns))
