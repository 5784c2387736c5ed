"""Vectorised words and hashes of Arrow string arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte; the second table has A-Z as a-z.
BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = FOLDED[97:123]
#: Odd, so that it has an inverse modulo 2**64.
BASE = int(_RNG.integers(1, 2**62)) * 4 + 1
INVERSE = pow(BASE, -1, 2**64)
STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """BASE**i or INVERSE**i modulo 2**64 for i < n."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), BASE if kind == "up" else INVERSE, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the number of words before each row (one more entry)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((FOLDED if folded else BYTES)[data] * powers("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers("down", len(data))[starts] + (ends - starts).astype(np.uint64) * STEPS[63])


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values; rows may be crossed, the caller masks those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * STEPS[0]
    for i in range(1, k):
        out += hashes[i : i + n] * STEPS[i]
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, A-Z folded; with fewer words the one of the whole
    sequence; none without words."""
    data, offsets = buffers(column)
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, folded=True)
    grams = gram_hashes(hashes, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield mix((hashes[a:b] * STEPS[: b - a]).sum(keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, np.uint64)


@functools.cache
def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns memory that this worker no longer uses to the system: it may wait a while for its next task, beside others."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most about so many bytes of the column each (a longer single row comes alone).  When they
    are used up, memory goes back."""
    for batch in batches:
        col = batch.column(column)
        if not len(col):
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(col)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: counts[i] consecutive values each."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * values.dtype.itemsize, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))]).cast(pa.binary())
