"""Memory of Python workers, which go on from task to task."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Free what the allocators only keep for later; without this a worker holds what its largest task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
