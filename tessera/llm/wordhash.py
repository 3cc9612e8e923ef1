"""Word and shingle hashing over whole Arrow batches, with numpy and without a loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z where asked.  Both rules work
on UTF-8 bytes as they do on code points, because every byte of a longer sequence is above 0x7F.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def gives_back(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches at whose end the worker returns free memory to the system.

    Spark keeps workers for the next task with Python, and meanwhile an executor's other tasks need the memory.
    """

    @wraps(work)
    def worked(*given: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*given)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return worked


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 20, n + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of a batch's rows with at most `limit` bytes, or one row that has more."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    i = used = 0
    for j, size in enumerate(sizes.tolist()):
        if used + size > limit and j > i:
            yield i, j
            i, used = j, 0
        used += size
    if i < len(sizes):
        yield i, len(sizes)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; a null has none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and each row's first word (n + 1 numbers)."""
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64 bits of each word, from a polynomial's prefix sums; fold: A-Z count as a-z."""
    power, inverse = powers(len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((_FOLDED if fold else _LETTER)[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each row the sorted distinct hashes of its runs of `width` words, and its number of words.

    A row with fewer words, but at least one, has its whole sequence as its only run; one without words has none.
    """
    raw, bounds = utf8(texts)
    starts, ends, first = words(raw, bounds)
    hashes = word_hashes(raw, starts, ends)
    runs = hashes
    for k in range(1, width):
        runs = mix(runs[: max(0, len(hashes) - k)] * U64(0xFF51AFD7ED558CCD) + hashes[k:]) if len(hashes) > k else runs[:0]
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= width:
            yield np.unique(runs[i : j - width + 1]), j - i
        elif j > i:
            whole = hashes[i : i + 1]
            for k in range(i + 1, j):
                whole = mix(whole * U64(0xFF51AFD7ED558CCD) + hashes[k : k + 1])
            yield whole + U64(j - i), j - i
        else:
            yield hashes[:0], 0
