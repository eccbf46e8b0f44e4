"""Two-stage suffix sorting of a block of bytes, to a depth.

Suffixes smaller than their successors (type S) are sorted directly; the others (type L) are induced by
one scan of the buckets of first bytes from left to right: a suffix's predecessor, if of type L, goes to
the head of its bucket in the order in which the scan meets it. What the scan meets is taken in
stretches that are already complete, so each step moves an array and not one suffix.
"""

from __future__ import annotations

import numpy as np


def types(data: np.ndarray) -> np.ndarray:
    """True for type S; the last suffix is of type L, since nothing is smaller than its empty successor."""
    n = len(data)
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    differs = np.flatnonzero(step)
    nxt = np.searchsorted(differs, np.arange(n - 1))
    return np.append(np.append(step[differs], -1)[nxt] > 0, False)


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least."""
    s = np.frombuffer(data, np.uint8)
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = types(s)
    direct = np.flatnonzero(small).tolist()
    direct.sort(key=lambda i: data[i : i + depth])
    direct = np.array(direct, np.int64)

    total, own = np.bincount(s, minlength=256), np.bincount(s[direct], minlength=256)
    ends = np.cumsum(total)
    starts = ends - total
    out = np.full(n, -1, np.int64)
    at = np.cumsum(own) - own
    for c in np.flatnonzero(own).tolist():
        out[ends[c] - own[c] : ends[c]] = direct[at[c] : at[c] + own[c]]

    head = starts.copy()

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = s[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(first)], strict=True):
            c = first[a]
            out[head[c] : head[c] + b - a] = before[a:b]
            head[c] += b - a

    out[head[s[-1]]] = n - 1
    head[s[-1]] += 1
    for c in np.flatnonzero(total).tolist():
        done = starts[c]
        while done < head[c]:
            stretch = out[done : head[c]].copy()
            done = head[c]
            induce(stretch)
        induce(out[ends[c] - own[c] : ends[c]])
    return out


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in order, ``most`` at most; 0 for the first."""
    s = np.frombuffer(data + b"\0" * most, np.uint8)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(most):
        alive = alive[s[order[alive] + k] == s[order[alive - 1] + k]]
        if not len(alive):
            break
        out[alive] = k + 1
    left = len(data) - order
    out[1:] = np.minimum(out[1:], np.minimum(left[1:], left[:-1]))
    return out
