"""What Python workers keep between tasks.

A worker serves one stage after the other. Tokenizers and automata are kept while one operator uses them;
when another begins, they go and freed memory is given back, so a worker never holds those of all operators.
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_caches: dict[str, Callable[[], None]] = {}
_shared: list[Callable[[], None]] = []
_now = [""]


def between(clear: Callable[[], None]) -> None:
    """``clear`` drops what operators share, which is made anew in the size that the next one needs."""
    _shared.append(clear)


def begin(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Said by an operator before it works in a process; ``clear`` drops what it keeps."""
    _caches[name] = clear
    if _now[0] != name:
        for drop in [*(drop for other, drop in _caches.items() if other != name), *_shared]:
            drop()
        _now[0] = name
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
