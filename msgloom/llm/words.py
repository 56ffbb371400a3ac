"""Words and word shingles of Arrow text batches, as NumPy arrays.

A word is a run of `[^\\x20\\x09-\\x0D]`, with A-Z in lower case. Words and shingles are
64-bit hashes; two different ones share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at a time, so that memory follows this and not the batch.
SLICE_BYTES = 4 << 20
_CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)  # a random number for each byte
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, _CHUNK), base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0][:n], _POWERS[1][:n]


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # n + 1 places in the arrays above for n texts
    text_starts: np.ndarray  # n + 1 places in data


def text_slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where their text passes `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and n + 1 places in them. NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if not len(texts) or data is None or places[-1] == places[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def words_of(texts: pa.Array) -> Words:
    """The words of all texts, in order."""
    data, text_starts = text_bytes(texts)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64), text_starts)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = text_starts[:-1][np.diff(text_starts) > 0]
    first[border] = inside[border]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[border[1:] - 1] = inside[border[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in chunks that end with a word
        begin = starts[at]
        to = max(at + 1, np.searchsorted(ends, begin + _CHUNK, "right"))
        size = ends[to - 1] - begin
        if size <= _CHUNK:
            power, inverse = _powers(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_LETTER[_LOWER[data[begin : begin + size]]] * power, out=sums[1:])
            s, e = starts[at:to] - begin, ends[at:to] - begin
            hashes[at:to] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _GOLD)
        at = to
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[i] : ends[i]]].tobytes())
    return Words(data, starts, ends, hashes, np.searchsorted(starts, text_starts), text_starts)


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of words, in order."""
    x = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        x = mixed(x * _GOLD + part)
    return x


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in order of place, and n + 1 offsets into them.

    A text with fewer words than `width` has its whole sequence as one; a text
    without words has none.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(out_offsets[-1], np.uint64)
    long = counts >= width
    if long.any():
        every = combined([hashes[k : len(hashes) - width + 1 + k] for k in range(width)])
        take = np.ones(len(hashes) + 1, np.int32)
        # Starts whose window would cross the end of their text are left out.
        for k in range(1, width):
            ends = offsets[1:][counts >= k] - k
            take[ends] = 0
        source = np.flatnonzero(take[: len(every)])
        target = np.repeat(long, made)
        out[target] = every[source]
    for i in np.flatnonzero((counts > 0) & ~long):
        own = hashes[offsets[i] : offsets[i + 1]]
        out[out_offsets[i]] = combined([own[k : k + 1] for k in range(len(own))])[0]
    return out, out_offsets


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = words_of(texts)
    every, places = shingles(words.hashes, words.offsets, width)
    return [np.unique(every[a:b]) for a, b in zip(places[:-1], places[1:])]
