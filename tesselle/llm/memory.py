"""A bounded memory of results for short strings, kept by Python workers while they run."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Results remembered in each of two generations, and the longest string that is remembered.
MOST, LONGEST = 100_000, 32


def release() -> None:
    """Give back to the system what a finished step has freed; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(kernel: Callable) -> Callable:
    """A kernel over batches that gives back at its end what it has freed, as its worker waits for the next task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


class Memory(dict):
    """Results of ``make`` by string, in two generations.

    When the young generation is full it becomes the old one; what is asked for again returns to
    the young one. So frequent strings stay, rare ones go, and no more than 2 * ``most`` strings of
    up to ``longest`` characters are held, which bounds the bytes too (about 25 MB for short results).
    """

    def __init__(self, most: int = MOST, longest: int = LONGEST):
        super().__init__()
        self.most, self.longest = most, longest
        self.old: dict[Any, Any] = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got
