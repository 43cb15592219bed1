"""Words of whole Arrow text columns as numpy arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C17 | 3  # odd, and 3 modulo 4
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, U), np.ones(1, U)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                step = np.full(n, b, U)
                step[0] = 1
                _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of h."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        return lambda _: None


_TRIM = _trimmer()


def trim() -> None:
    """Give freed memory back to the machine. Spark keeps idle Python workers, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; a longer text is a run of its own.

    A null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at separators (a table over bytes) and at the ends of rows."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~apart[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edges[1:] - 1] = word[edges[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over random byte values, by one running sum over the bytes."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
