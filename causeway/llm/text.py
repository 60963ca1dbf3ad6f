"""Whole-text scanning over Arrow string buffers: words and hashes as numpy arrays, never a Python loop over words.

A batch of texts is taken as one byte buffer plus row offsets. Every function here works on bytes of UTF-8, for which
the word classes used by the operators are exact (their separators are ASCII).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
BASE, STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed by xxh3: a polynomial modulo 2**64 has known collisions from about 1,000 terms on.
LONG_WORD = 64


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for lo, hi in separators:
        out[lo : hi + 1] = False
    return out


#: words [^\x20\x09-\x0D]+
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the base is odd. Grown tables are kept up to 2**21 entries."""
    at = _POWERS.get(base)
    if at is None or len(at[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            v = np.full(size, b, dtype=U)
            v[0] = 1
            both.append(np.cumprod(v, dtype=U))
        at = (both[0], both[1])
        if size <= 1 << 21:
            _POWERS[base] = at
    return at


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls: null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string())


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each, from 0."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(texts: pa.Array, size: int = 500_000):
    """(first row, end row) of runs of whole texts of about `size` bytes; a longer text stands alone."""
    _, offs = raw(texts)
    at, n = 0, len(texts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = end


def words(data: np.ndarray, offs: np.ndarray, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (n + 1 values)."""
    mask = word[data]
    first, last = mask.copy(), mask.copy()
    if len(data):
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        held = offs[1:] > offs[:-1]
        at = offs[:-1][held]
        first[at] = mask[at]
        at = offs[1:][held] - 1
        last[at] = mask[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = powers(int(BASE), len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    length = ends - starts
    h = mix(h ^ (length.astype(U) << U(56)))
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def windows(h: np.ndarray, k: int, base: int = int(STEP)) -> np.ndarray:
    """Hash of each k consecutive values; the last k - 1 entries are missing. Callers drop windows over two texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    power, inverse = powers(base, len(h) + 1)
    sums = np.empty(len(h) + 1, U)
    sums[0] = 0
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each group of the given sizes, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, .. of each run, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
