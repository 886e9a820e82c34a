"""Words of whole Arrow string columns as 64-bit hashes, in numpy.

A batch's character buffer is read in place: no Python string is made. A word's hash is a polynomial over its
bytes, mixed; A-Z count as a-z. Two different words share a hash with probability 2^-64 or so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = max(64, 2 * n)
        p = np.full(size, _ODD, np.uint64)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """A class of word bytes: every byte that is not a separator. Non-ASCII characters are word bytes."""

    def __init__(self, separators: list[int]):
        self.word = np.ones(256, bool)
        self.word[separators] = False
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = mix(lower.astype(np.uint64) + np.uint64(1009))
        self.value[~self.word] = 0

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of the texts data[offsets[i]:offsets[i+1]], and the offsets of each text's words."""
        hashes, _, _, at = self.located(data, offsets)
        return hashes, at

    def located(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first bytes, byte lengths, offsets of each text's words)."""
        inside = self.word[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        start[cuts] = inside[cuts]
        starts = np.flatnonzero(start)
        at = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, starts, at
        where = np.flatnonzero(inside)
        first = np.flatnonzero(start[where])
        lengths = np.diff(np.append(first, len(where)))
        pos = np.arange(len(where)) - np.repeat(first, lengths)
        value = self.value[data[where]] * _powers(int(lengths.max()) + 1)[pos]
        return mix(np.add.reduceat(value, first)), starts, lengths, at


#: Words [^\x20\x09-\x0D]+
BLANK_WORDS = Words([0x20, *range(0x09, 0x0E)])
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: ASCII letters and digits, and all non-ASCII characters
ALNUM_WORDS = Words([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; they cross text borders, which the caller leaves out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        total += words[j : j + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    return mix(total + np.uint64(k))


def gram_starts(at: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one text begin."""
    counts = np.maximum(np.diff(at) - k + 1, 0)
    return np.repeat(at[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def chunks(column: pa.Array | pa.ChunkedArray, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
