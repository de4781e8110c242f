"""Word hashing over UTF-8 bytes, whole Arrow batches at a time.

Texts are never decoded: every character outside ASCII consists of bytes from
0x80 on, so a byte table can tell word bytes from the rest.  Memory stays bounded
because a batch is walked in slices of some megabytes; one text larger than a
slice forms a slice of its own, and its hashes are still made window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_WINDOW = 1 << 18
_LONG_WORD = 1 << 14
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes in ``ranges`` (ends included)."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Digits, ASCII letters of either case, and all of a character outside ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: As ALNUM, without digits.
ALPHA = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but blanks: space, and 0x09 to 0x0D.
SOLID = ~byte_table((0x20, 0x20), (0x09, 0x0D))


def _powers(base: int) -> np.ndarray:
    out = np.full(_WINDOW + _LONG_WORD + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POWER:
        _POWER.extend([_powers(_BASE), _powers(_INVERSE)])
    return _POWER


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets, row = _offsets(column), 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, *_bytes(column.slice(row, end - row))
        row = end


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a slice; only where it has nulls is it copied."""
    if column.null_count:
        column = column.fill_null("")
    offsets, raw = _offsets(column), column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and how many words come before each text.

    The last has one entry more than there are texts.  No word spans two texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    before &= ~edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z taken as a-z."""
    out = np.empty(len(starts), dtype=np.uint64)
    power, inverse = _tables()
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _WINDOW)))
        base, stop = starts[first], min(ends[last - 1], starts[last - 1] + _LONG_WORD)
        sums = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum((LOWER[data[base:stop]].astype(np.uint64) + np.uint64(1)) * power[: stop - base], out=sums[1:])
        a, b = starts[first:last] - base, np.minimum(ends[first:last], stop) - base
        out[first:last] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        first = last
    for i in long:
        digest = hashlib.blake2b(LOWER[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return out


def _multiplier(j: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(b"gram%d" % j, digest_size=8).digest(), "little") | 1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, as many as fit."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _multiplier(j)
    return mix(out)


def same_text(position: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from ``position`` on lie in one text.  ``first``: words before each text."""
    text = np.searchsorted(first, position, side="right") - 1
    return position + k <= first[text + 1]
