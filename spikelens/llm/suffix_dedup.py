"""Suffix-array dedup: longest previous factors over the suffixes at candidate windows.

In suffix order, the nearest neighbours with a smaller text position on either side hold a suffix's longest earlier
match (its longest previous factor); with positions reversed they hold the longest later match. Candidates and their
spreading over tasks come from ``repeats``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats

BYTES = repeats.Unit(size=1, window=200, k=64)


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value to the left, or -1. Whatever lies between a place and its pointer is
    larger, so pointers that still lead to a larger value may jump along that value's own pointer."""
    p = np.arange(len(x)) - 1
    todo = np.flatnonzero(p >= 0)
    while len(todo := todo[(p[todo] >= 0)]):
        todo = todo[x[p[todo]] > x[todo]]
        p[todo] = p[p[todo]]
    return p


def ranks(data: np.ndarray, cap: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all positions by their first 8, 16, 32, ... bytes, up to ``cap``; zero bytes follow the end."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : n + i]
    levels, length = [(8, np.unique(word, return_inverse=True)[1].astype(np.int64))], 8
    while 2 * length <= cap:
        r = levels[-1][1]
        after = np.full(n, -1, np.int64)
        after[: max(0, n - length)] = r[length:]
        levels.append((2 * length, np.unique(r * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)))
        length *= 2
    return levels


def common_prefix(data: np.ndarray, levels, i: np.ndarray, j: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix at ``i`` and ``j``, at most ``cap``, by descending through the levels."""
    n, t = len(data), np.zeros(len(i), np.int64)
    for length, r in reversed(levels):
        a, b = i + t, j + t
        ok = (a < n) & (b < n)
        t += length * (ok & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]))
    for _ in range(7):
        a, b = i + t, j + t
        ok = (a < n) & (b < n) & (t < cap)
        t += ok & (data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)])
    return np.minimum(t, cap)


def factors(data: np.ndarray, at: np.ndarray, order: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor, capped, of the suffixes at ``at``; ``order`` says which is earlier."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = ranks(data, cap)
    length, top = levels[-1]
    tail = np.minimum(at + cap - length, len(data) - 1)
    suffix = np.lexsort((order, top[tail], top[at]))
    x, place = order[suffix], at[suffix]
    n, out = len(x), []
    for values in (x, -x):
        best = np.zeros(n, np.int64)
        left = previous_smaller(values)
        right = n - 1 - previous_smaller(values[::-1])[::-1]
        for near, ok in ((left, left >= 0), (right, right < n)):
            k = np.flatnonzero(ok)
            best[k] = np.maximum(best[k], common_prefix(data, levels, place[k], place[near[k]], cap))
        back = np.empty(n, np.int64)
        back[suffix] = best
        out.append(back)
    return out[0], out[1]


def match(segs, bucket, order, unit, keep):
    """Flags of the windows of each segment that also start in another one (or, for "first", an earlier one)."""
    data = np.frombuffer(b"".join(segs), np.uint8)
    sizes = np.fromiter(map(len, segs), np.int64, len(segs))
    ends = np.cumsum(sizes)
    count = sizes - unit.window + 1
    owner = np.repeat(np.arange(len(segs)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (ends - sizes)[owner] + inner
    place = np.empty(len(at), np.int64)
    place[np.lexsort((inner, order[owner]))] = np.arange(len(at))
    before, after = factors(data, at, place, unit.window)
    hit = before >= unit.window
    if keep == "none":
        hit |= after >= unit.window
    return np.split(hit, np.cumsum(count)[:-1])


def dedup(docs: DataFrame, keep: str = "first", min_bytes: int = 200, **how) -> DataFrame:
    """Cut byte runs covered by repeated ``min_bytes``-byte strings; see ``repeats.remove`` for the columns added.

    Texts are compared as UTF-8 bytes; nulls are empty; matches do not cross documents. With ``keep="first"`` the
    first copy stays, with "none" every copy goes.
    """
    unit = repeats.Unit(1, min_bytes, max(1, min(64, min_bytes // 3)))
    return repeats.remove(docs, unit, match, keep, **how)
