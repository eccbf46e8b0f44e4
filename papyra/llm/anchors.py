"""Anchors: the places that stand for all windows of a text of a given width.

The anchor of a window is the leftmost of its ``gram``-byte substrings with the smallest hash. Equal
windows have equal anchors at equal offsets, so windows need only be compared within one anchor's hash.
Adjacent windows mostly share their anchor; a run of them is a segment.
"""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1:] = np.uint64(base)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


class Rolling:
    """Polynomial hashes of any substring of data, modulo 2 ** 64, with an odd base."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        self.inverse = powers(pow(base, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * powers(base, len(data)) + powers(base, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts data[starts[i]:ends[i]]: text, first window, last window, anchor (places in data), anchor hash, segment hash.

    A segment covers the bytes from its first window to the end of its last one. Texts shorter than a
    window have none.
    """
    n = len(data) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(data, BASE_A)
    grams = rolling.all(gram)
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~low) | (place & low), window - gram + 1)
    # windows that lie in one text
    own = np.zeros(n + 1, np.int32)
    fit = ends - starts >= window
    np.add.at(own, starts[fit], 1)
    np.add.at(own, ends[fit] - window + 1, -1)
    valid = np.cumsum(own[:-1]) > 0
    text = np.zeros(n, np.bool_)
    text[starts[fit]] = True  # a new text begins a new segment
    change = np.empty(n, np.bool_)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change |= text
    change[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    anchor = (least[first] & low).astype(np.int64)
    of = np.searchsorted(starts[fit], first, "right") - 1
    geometry = ((last - first) << 8 | (anchor - first)).astype(np.uint64)
    inner = mix(Rolling(data, BASE_B).of(first, last + window) + geometry * np.uint64(0x9E3779B97F4A7C15))
    return np.flatnonzero(fit)[of], first, last, anchor, grams[anchor], inner
