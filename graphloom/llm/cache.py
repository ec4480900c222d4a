"""Bounded memo of pure functions of short strings, for use with ``map(memo.__getitem__, ...)``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: list = [None, None]


def only(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept in this Python worker until another key is asked for.

    A worker serves one operator after another; what it holds for speed is
    that of the last one only, so memory does not add up over a pipeline.
    """
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


def tidied(run: Callable) -> Callable:
    """``run`` over a partition, giving freed memory back to the system at its end.

    The allocators of Arrow and libc keep what they freed, and an idle worker
    would hold it while others of its executor need it.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


class Memo(dict):
    """Two generations of at most ``limit`` entries each: hits cost one dict lookup.

    When the young generation is full it becomes the old one; entries of the old
    one are taken over as they are used. Memory stays bounded and results do not
    depend on what is remembered.
    """

    def __init__(self, function, limit: int = 200_000, max_key: int = 256):
        super().__init__()
        self.function, self.limit, self.max_key, self.old = function, limit, max_key, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.max_key:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
