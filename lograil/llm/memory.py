"""Memory of the Python workers, which live on between tasks: what a task has freed goes back to the system.

Without it an idle worker holds the peak of its past tasks, beside the executor's heap.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_MMAP_THRESHOLD, _BYTES = -3, 1 << 20


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library where it is glibc, set to map arrays of a megabyte and more by themselves, so that freeing returns them."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        return None
    libc.mallopt(_MMAP_THRESHOLD, _BYTES)
    return libc


def release() -> None:
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, releasing memory at its end."""

    def wrapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _libc()
        try:
            yield from run(it)
        finally:
            release()

    return wrapped
