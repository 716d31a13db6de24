"""Substring dedup: suffix automata of reference shards give matching statistics of documents streamed past them.

A shard holds the distinct candidate segments of one anchor (``repeats``); its size is bounded, and only documents that
hold the anchor are sent past it, so no automaton has to meet all documents. The automaton counts for every state in
how many places it ends, which tells a match with another place from a segment's match with itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats

WORDS = repeats.Unit(size=8, window=35, k=12)


class Automaton:
    """Suffix automaton of several sequences, with the number of end places and the lowest rank of each state."""

    def __init__(self):
        self.next, self.link, self.length, self.places, self.least = [{}], [-1], [0], [0], [1 << 62]

    def _state(self, length, step, link):
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        self.least.append(1 << 62)
        return len(self.next) - 1

    def add(self, sequence, rank: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            to = nxt[last].get(c)
            if to is not None and length[to] == length[last] + 1:
                last = to
            else:
                new = self._state(length[last] + 1, {}, 0) if to is None else None
                p = last
                if new is not None:
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = new
                        p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        target = q
                    else:
                        target = self._state(length[p] + 1, dict(nxt[q]), link[q])
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = target
                            p = link[p]
                        link[q] = target
                    if new is None:
                        new = target
                    else:
                        link[new] = target
                last = new
            self.places[last] += 1
            if rank < self.least[last]:
                self.least[last] = rank

    def close(self) -> None:
        """Hand counts and ranks of end places up the suffix links, longest states first."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            u = self.link[v]
            self.places[u] += self.places[v]
            self.least[u] = min(self.least[u], self.least[v])

    def statistics(self, sequence, accept) -> list[int]:
        """For every place of a sequence, the longest match ending there whose state ``accept``s."""
        v, n, out = 0, 0, []
        for c in sequence:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            v = self.next[v].get(c, 0)
            n = n + 1 if v else 0
            u, m = v, n
            while u and not accept(u):
                u = self.link[u]
                m = self.length[u]
            out.append(m if u else 0)
        return out


def match(segs, bucket, order, unit, keep):
    """Flags of the windows of each segment that also start in another one (or, for "first", an earlier one)."""
    out = [None] * len(segs)
    by = np.argsort(bucket, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        words = [np.frombuffer(segs[i], np.uint64).tolist() for i in group]
        shard = Automaton()
        for i, w in zip(group, words, strict=True):
            shard.add(w, int(order[i]))
        shard.close()
        places, least = shard.places, shard.least
        for i, w in zip(group, words, strict=True):
            rank = int(order[i])
            found = shard.statistics(w, (lambda u: places[u] > 1) if keep == "none" else (lambda u, r=rank: least[u] < r))
            out[i] = np.array(found[unit.window - 1 :]) >= unit.window
    return out


def dedup(docs: DataFrame, keep: str = "first", min_words: int = 35, **how) -> DataFrame:
    """Cut maximal word spans covered by repeated windows of ``min_words`` words; see ``repeats.remove``.

    Words are runs of bytes outside 0x09-0x0D and 0x20, unchanged; nulls have none; windows stay within a document.
    """
    return repeats.remove(docs, repeats.Unit(8, min_words, max(1, min(12, min_words // 3))), match, keep, **how)
