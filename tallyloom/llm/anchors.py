"""Anchors: positions of a text chosen by its content, for finding repeated strings.

The anchor of a 100-byte window is its 40-byte string with the smallest hash (the first of equals). Equal windows
have their anchors at equal offsets, and neighbouring windows mostly share one, so a text has
about one anchor in 31 bytes. The *context* of an anchor is all bytes of the windows that share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from tallyloom.llm.words import SLICE, mix

WINDOW = 100
GRAM = 40
_BASE = 0xD1342543DE82EF95
_SPAN = WINDOW - GRAM + 1
_LOW = np.uint64((1 << 21) - 1)

_powers: list[np.ndarray] = []


class Rolling:
    """Hash of any substring of a piece of bytes in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if not _powers or len(_powers[0]) < n:
            size = max(n, SLICE + WINDOW + 1)
            made = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                power = np.full(size, base, np.uint64)
                power[0] = 1
                made.append(np.cumprod(power, dtype=np.uint64))
            _powers[:] = made
        self._back = _powers[1]
        self._sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:n]) * self._back[:n])


class Found(NamedTuple):
    """Anchors of a group of texts; all positions are in the group's bytes."""

    row: np.ndarray  # text, counted from the group's first
    anchor: np.ndarray
    low: np.ndarray  # first and last start of a window that has the anchor
    high: np.ndarray


def find(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Rolling, Found]]:
    """Anchors of texts laid end to end; a long text comes in pieces that overlap by a window.

    Yields (offset of the piece, its hashes, anchors with positions in the piece).
    """
    low = 0
    while True:
        high = min(len(data), low + SLICE)
        piece = data[low:high]
        if len(piece) >= WINDOW:
            rolling = Rolling(piece)
            yield low, rolling, _find(rolling, len(piece), bounds - low)
        if high == len(data):
            return
        low = high - WINDOW + 1


def _find(rolling: Rolling, size: int, bounds: np.ndarray) -> Found:
    grams = rolling.every(GRAM)
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, least = 1, keys
    while width * 2 <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _SPAN - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & _LOW).astype(np.int64)  # of the window that starts here
    starts = np.arange(len(anchor))
    row = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + WINDOW <= bounds[np.minimum(row + 1, len(bounds) - 1)]
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    kept = inside[first]
    first, last = first[kept], last[kept]
    return Found(row[first], anchor[first], first, last)
