"""Unicode forms of Arrow strings, for Python workers, which import no more than this."""

from __future__ import annotations

import contextlib
import ctypes
import unicodedata
from collections.abc import Callable

import pyarrow as pa


def _each(s: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """``one`` of every text but ASCII ones, which stay; what the batch before left free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    return pa.array([x if x is None or x.isascii() else one(x) for x in s.to_pylist()], pa.string())


def nfkc(s: pa.Array) -> pa.Array:
    return _each(s, lambda x: unicodedata.normalize("NFKC", x))


def no_accents(s: pa.Array) -> pa.Array:
    return _each(s, lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))
