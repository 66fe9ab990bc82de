"""Array views of text columns: bytes, word spans and 64-bit fingerprints, all vectorised over an Arrow batch.

The operators of this subpackage work inside ``mapInArrow`` tasks. A batch of texts is seen as one byte array with
document offsets; words, shingles and fixed-length windows are computed for the whole batch by numpy. Where equality
decides a result, ``distinct`` compares the contents; fingerprints alone only choose features and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multiplier of the polynomial fingerprint and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: ``[\x20\x09-\x0D]``: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(length + 1, BASE, np.uint64)
    down = np.full(length + 1, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Prefix:
    """Prefix sums of a polynomial over bytes or code points: the fingerprint of any span in constant time."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        value = _BYTE_VALUES[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1))
        np.cumsum(value * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Of each window of this length, by its start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_values(inside: np.ndarray) -> np.ndarray:
    """Of each byte: what it counts in ``run_prints``, with A-Z as a-z, and 0 for what is not inside a run."""
    return np.where(inside, _BYTE_VALUES[LOWER], np.uint64(0))


def run_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What ``Prefix`` of the lower-cased data gives for the runs, where these are all that ``values`` counts."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    value = np.take(values, data)
    value *= up[: len(data)]
    return mix(np.add.reduceat(value, start) * down[start] + (end - start).astype(np.uint64))


#: Spans of more bytes are hashed and compared one by one.
LONG = 512
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with zeros after the end."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def prints(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, mixed eight bytes at a time."""
    size, eight = end - start, eights(data)
    out = mix(size.astype(np.uint64) + np.uint64(seed * BASE & (1 << 64) - 1))
    rows, at, left = np.flatnonzero(size <= LONG), start, size
    at, left = at[rows], left[rows]
    while len(rows):
        out[rows] = mix(out[rows] * np.uint64(BASE) + (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def same_as(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span whose number is in ``other``."""
    size, eight = end - start, eights(data)
    out = size == size[other]
    rows = np.flatnonzero(out & (size <= LONG) & (other != np.arange(len(size))))
    at, by, left = start[rows], start[other[rows]], size[rows]
    while len(rows):
        out[rows[((eight[at] ^ eight[by]) & _LOW_BYTES[np.minimum(left, 8)]) != 0]] = False
        more = left > 8
        rows, at, by, left = rows[more], at[more] + 8, by[more] + 8, left[more] - 8
    for i in np.flatnonzero(out & (size > LONG) & (other != np.arange(len(size)))).tolist():
        out[i] = np.array_equal(data[start[i] : end[i]], data[start[other[i]] : end[other[i]]])
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of an array: one span of each content, and for every span the number of its content. Hashes group the
    spans and their bytes decide: what differs from its group's first span is told apart by its bytes alone."""
    wide = data.dtype.itemsize
    raw, a, b = data.view(np.uint8), start * wide, end * wide
    _, first, inverse = np.unique(prints(raw, a, b), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_as(raw, a, b, first[inverse])).tolist()
    found: dict[bytes, int] = {}
    for i in odd:
        inverse[i] = found.setdefault(raw[a[i] : b[i]].tobytes(), len(first) + len(found))
    more = {inverse[i]: i for i in reversed(odd)}
    return np.r_[first, np.array([more[k] for k in sorted(more)], first.dtype)], inverse


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about this many bytes, so that temporary arrays stay small; a longer row is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without separators, and the row that it is in; runs end with their row."""
    return runs(~separators[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, of a mask of what is inside a run."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][(offsets[:-1] < offsets[1:])]
    starts[first] = inside[first]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each row's distinct word shingles, sorted within the row, and the row of each.

    A-Z are lower-cased. A row with fewer words than ``size`` has its whole word sequence as its one shingle; a row
    without words has none.
    """
    low = LOWER[data]
    start, end, row = words(low, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = prints(low, start, end)
    return _distinct_runs(word, row, size, lambda value, later, i: mix(value * np.uint64(BASE) + later + np.uint64(i)))


def numbered_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, but with numbers that are equal only where the words are: words are told apart by their bytes,
    and longer runs by the numbers of their words."""
    low = LOWER[data]
    start, end, row = words(low, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, word = distinct(low, start, end)
    word = word.astype(np.uint64) + np.uint64(1)
    kinds = np.uint64(len(first) + 1)

    def step(value: np.ndarray, later: np.ndarray, i: int) -> np.ndarray:
        return later if not i else np.unique(value * kinds + later, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)

    return _distinct_runs(word, row, size, step)


def _distinct_runs(word: np.ndarray, row: np.ndarray, size: int, step) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row's runs of ``size`` words, sorted; a word beyond the row counts as 0."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    n = len(word)
    value, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(size):
        later = np.minimum(np.arange(n) + i, n - 1)
        same = (np.arange(n) + i < n) & (row[later] == row)
        whole &= same
        value = step(value, np.where(same, word[later], np.uint64(0)), i)
    keep = whole
    keep[first[count < size]] = True
    value, row = value[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], row[fresh]


def row_starts(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of rows 0 to rows in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(rows + 1))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)
