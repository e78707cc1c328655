"""What a task holds, and what its Python worker keeps: workers live on for tasks of other operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

from retailmart.llm.words import text_buffers

CACHES: list = []  # lru_caches of operators, kept for their own further tasks only

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def parts(batches, text: int, most: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of the column ``text`` (a longer one by itself) and to ``rows``
    rows, so that what is made of a batch is small too."""
    for batch in batches:
        cuts, first = text_buffers(batch.column(text))[0], 0
        while first < batch.num_rows:
            after = int(np.searchsorted(cuts, cuts[first] + most, "right")) - 1
            after = min(max(after, first + 1), batch.num_rows, first + (rows or batch.num_rows))
            yield batch.slice(first, after - first)
            first = after


def give_back() -> None:
    """Freed memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(rows: Callable[..., Iterator[pa.RecordBatch]], keep=None) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``rows``, a function over batches for mapInArrow, that drops what tasks of other operators left
    in the worker, but for the cache ``keep``, and leaves no freed memory behind."""

    @wraps(rows)
    def run(*args, **named):
        for cache in CACHES:
            if cache is not keep:
                cache.cache_clear()
        give_back()
        yield from rows(*args, **named)
        give_back()

    return run
