"""What Python workers keep of an executor's memory."""

from __future__ import annotations

import contextlib
import ctypes
from functools import cache

import pyarrow as pa


@cache
def _trim():
    """malloc's function that returns free pages, where there is one."""
    with contextlib.suppress(OSError, TypeError, AttributeError):
        return ctypes.CDLL(None).malloc_trim
    return lambda _: 0


def give_back() -> None:
    """Returns to the system what Arrow and malloc hold free. Else each of an executor's workers keeps the most that any batch took, for as long as tasks reuse it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
