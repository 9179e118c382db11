"""Vectorised words and shingles of many texts at a time.

A word is a run of bytes other than blank and \\x09-\\x0D; A-Z count as a-z. Words and shingles
are known by 64-bit hashes. Work goes in slices of about ``SLICE`` bytes, so a worker needs some 20 MB for its arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
SLICE = 1 << 18

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD += 1
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_TURNS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            made = np.full(size, base, np.uint64)
            made[0] = 1
            _powers[k] = np.cumprod(made, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _slice_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a slice."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLD[data] * power, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of some bytes; slices end at white space."""
    if len(data) <= SLICE:
        return _slice_words(data)
    starts, hashes, low = [], [], 0
    while low < len(data):
        high, step = min(len(data), low + SLICE), SLICE
        while high < len(data):
            blanks = np.flatnonzero(~_IS_WORD[data[max(low, high - step) : high]])
            if len(blanks):
                high = max(low, high - step) + int(blanks[-1]) + 1
                break
            high, step = min(len(data), high + SLICE), SLICE
        a, h = _slice_words(data[low:high])
        starts.append(a + low)
        hashes.append(h)
        low = high
    return np.concatenate(starts), np.concatenate(hashes)


@lru_cache(1)
def _is_mark() -> np.ndarray:
    """Code points of punctuation, symbols, separators, controls and format characters."""
    category = map(unicodedata.category, map(chr, range(0x110000)))
    return np.fromiter((c[0] in "PSZ" or c in ("Cc", "Cf") for c in category), bool, 0x110000)


def unmarked(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with blanks for all that is neither letter, digit nor combining mark."""
    marks = _is_mark()
    out = np.where(marks[np.minimum(data, 128)] & (data < 128), np.uint8(32), data)
    for size, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + size <= len(data)]
        code = (data[at] & (0x7F >> size)).astype(np.int64)
        for k in range(1, size):
            code = code << 6 | (data[at + k] & 0x3F)
        at = at[marks[np.minimum(code, 0x10FFFF)]]
        for k in range(size):
            out[at + k] = 32
    return out


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words; of all words together if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _TURNS[k % 5] + np.uint64(k + 5 * width)
    return mix(total)


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows of a string column: (first row, end row, start of each row in the bytes, the bytes).

    Null rows are empty. A group has about a slice of bytes, or one longer row.
    """
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        yield low, high, offsets[low : high + 1] - offsets[low], content[offsets[low] : offsets[high]]
        low = high


def words_of(column: pa.Array, clean: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) of a string column, in order; ``clean`` may blank out bytes before."""
    for low, high, offsets, data in texts_of(column):
        data = clean(data) if clean else data
        if high - low == 1:
            yield low, word_hashes(data)[1]
            continue
        # a blank between rows, so that no word runs on
        spread = np.full(len(data) + high - low, 32, np.uint8)
        shift = np.repeat(np.arange(high - low), np.diff(offsets))
        spread[np.arange(len(data)) + shift] = data
        starts, hashes = word_hashes(spread)
        bounds = np.searchsorted(starts, offsets + np.arange(high - low + 1))
        for k in range(high - low):
            yield low + k, hashes[bounds[k] : bounds[k + 1]]
