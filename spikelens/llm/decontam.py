"""Benchmark decontamination: rare seeds, then local alignment.

An alignment that reaches the threshold matches at least so many of an item's words that one of its rarest ones must be among
them: the seeds of an item of n words that needs m matches are its n - m + 1 rarest words, by their number in the corpus. So
no pair is lost, whatever the edits. Seeds found in a text lead to (text, item) pairs where they lie; an item held by a
third of all texts costs each of them its own alignment and no shuffle. Items are taken in blocks of bounded size, so what
tasks receive does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from .common import pieces, word_hashes, word_spans
from .licenses import GAP, LOWER

BLOCK_BYTES = 4 << 20  # items' text per pass over the corpus
MATCH, MISMATCH, SPACE = 2, -1, -1
THRESHOLD = 0.5
CELLS = 1 << 21  # (word, item) sums held at once
#: Shorter items match nothing; up to WHOLE words an item must stand whole, a longer one scores at least as much.
SHORTEST, WHOLE = 3, 4


def words_of(p):
    """Word hashes of pieces (runs of letters, digits and bytes above 0x7F, A-Z lower-cased), and each piece's first."""
    data = LOWER[p.data]
    a, b, first = word_spans(data, p.start, p.end, GAP)
    return word_hashes(data, a, b), first, a, b


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score, first and end word in ``text``.

    Row by row; a gap in the text's direction is the running maximum of score plus gap costs, so a row is one scan.
    """
    n = len(text)
    ramp = np.arange(n + 1) * -SPACE
    above, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        up = above + SPACE
        diagonal = above[:-1] + np.where(text == w, MATCH, MISMATCH)
        row, origin = up.copy(), begin.copy()
        better = diagonal > row[1:]
        row[1:][better] = diagonal[better]
        origin[1:][better] = begin[:-1][better]
        fresh = row <= 0
        row[fresh] = 0
        origin[fresh] = np.flatnonzero(fresh)
        shifted = row + ramp
        top = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == top, np.arange(n + 1), 0))
        spread = top - ramp
        moved = spread > row
        row[moved] = spread[moved]
        origin[moved] = origin[source[moved]]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), k)
        above, begin = row, origin
    return best


def _item_words(texts: list[str]) -> list[np.ndarray]:
    out: list = []
    for p in pieces(pa.array(texts, pa.string())):
        h, first, _, _ = words_of(p)
        out += [h[first[i] : first[i + 1]] for i in range(len(p.row))]
    return out


def needed(length: np.ndarray, threshold: float) -> np.ndarray:
    """Score that an item of so many words must reach."""
    return np.maximum(np.ceil(MATCH * length * threshold - 1e-9), MATCH * np.minimum(length, WHOLE)).astype(np.int64)


class Finder:
    """Items of one block with their seeds; finds (row, item id, score, first word, end word, seeds met) in a text column.

    ``counts`` says how often each word hash of the items stands in the corpus; without it all words are equally rare. An
    item is aligned only where enough of its words stand close together (``_reachable``), so what is passed over cannot reach
    the threshold.
    """

    def __init__(self, items: list[np.ndarray], ids: list, threshold: float, counts: dict[int, int] | None = None):
        self.ids = ids
        self.start = np.cumsum([0, *[len(h) for h in items]])
        self.words = np.concatenate([np.zeros(0, np.uint64), *items])
        self.known, self.number = np.unique(self.words, return_inverse=True)
        length = np.diff(self.start)
        self.need = needed(length, threshold)
        # gaps of an alignment that reaches the score, so how far it strays from the diagonal of any match in it
        self.margin = MATCH * length - self.need
        item = np.repeat(np.arange(len(length)), length)
        often = np.array([(counts or {}).get(int(w), 0) for w in self.known], np.int64)[self.number] if len(self.known) else item
        rare = np.lexsort((self.words, often, item))
        place = np.arange(len(rare)) - self.start[item[rare]]
        chosen = rare[(place <= length[item[rare]] - -(-self.need[item[rare]] // MATCH)) & (length[item[rare]] >= SHORTEST)]
        x, item, offset = self.words[chosen], item[chosen], chosen - self.start[item[chosen]]
        order = np.lexsort((offset, item, x))
        x, item, offset = x[order], item[order], offset[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (item[1:] != item[:-1]))[: len(x)])
        # a word that an item repeats is one entry, from its first to its last place
        self.item, self.low, self.high = item[first], offset[first], offset[np.append(first[1:], len(x)) - 1] if len(x) else offset
        self.seeds, begin = np.unique(x[first], return_index=True)
        self.begin = np.append(begin, len(first))

    def _reachable(self, numbers: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Per item the largest sum over neighbouring words of a text, MATCH for words of the item and a gap's cost for others.

        It bounds every alignment: each word of its stretch of text is a match or costs at least that much.
        """
        kinds, which = np.unique(numbers, return_inverse=True)
        size = self.start[items + 1] - self.start[items]
        source = np.repeat(self.start[items] - np.cumsum(size) + size, size) + np.arange(size.sum())
        word = self.number[source]
        at = np.minimum(np.searchsorted(kinds, word), len(kinds) - 1)
        own = kinds[at] == word
        worth = np.full((len(kinds), len(items)), SPACE, np.int32)
        worth[at[own], np.repeat(np.arange(len(items)), size)[own]] = MATCH
        out, step = [], max(1, CELLS // len(numbers))
        for lo in range(0, len(items), step):
            total = np.zeros((len(numbers) + 1, len(items[lo : lo + step])), np.int32)
            np.cumsum(worth[:, lo : lo + step][which], axis=0, out=total[1:])
            out.append((total - np.minimum.accumulate(total)).max(0))
        return np.concatenate(out)

    def find(self, column) -> Iterator[tuple[int, int, float, int, int, int]]:
        for p in pieces(column):
            h, first, _, _ = words_of(p)
            if not len(self.seeds) or not len(h):
                continue
            at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
            where = np.flatnonzero(self.seeds[at] == h)
            if not len(where):
                continue
            found = at[where]
            texts, cuts = np.unique(np.searchsorted(first, where, "right") - 1, return_index=True)
            for i, c, d in zip(texts.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
                lo, hi = int(first[i]), int(first[i + 1])
                for item, share, a, b, n in self._in_text(h[lo:hi], found[c:d], where[c:d] - lo):
                    yield int(p.row[i]), self.ids[item], share, a, b, n

    def _in_text(self, text: np.ndarray, found: np.ndarray, where: np.ndarray):
        n = self.begin[found + 1] - self.begin[found]
        entry = np.repeat(self.begin[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.item[entry], np.repeat(where, n)
        length = self.start[item + 1] - self.start[item]
        # where the item would lie, with room for edits
        begin = np.maximum(0, place - self.high[entry] - self.margin[item])
        end = np.minimum(len(text), place - self.low[entry] + length + self.margin[item])
        order = np.lexsort((begin, item))
        item, begin, end = item[order], begin[order], end[order]
        numbers = np.minimum(np.searchsorted(self.known, text), len(self.known) - 1)
        numbers = np.where(self.known[numbers] == text, numbers, -1)
        held, cuts = np.unique(item, return_index=True)
        ends, worth = np.append(cuts[1:], len(item)), self._reachable(numbers, held) >= self.need[held]
        for i, c, d in zip(held[worth].tolist(), cuts[worth].tolist(), ends[worth].tolist(), strict=True):
            own = self.number[self.start[i] : self.start[i + 1]]
            spans: list = []
            for a, b in zip(begin[c:d].tolist(), end[c:d].tolist(), strict=True):  # near ones together
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            best = (0, 0, 0)
            for a, b in spans:
                score, x0, x1 = align(self.words[self.start[i] : self.start[i + 1]], text[a:b])
                best = max(best, (score, a + x0, a + x1))
            if best[0] >= self.need[i]:
                yield i, best[0] / (MATCH * len(own)), best[1], best[2], d - c


def _leak_rows(finder: Finder, columns: tuple[str, ...]):
    def rows(batches):
        for batch in batches:
            out = [list(x) for x in zip(*finder.find(batch.column("text")), strict=True)] or [[] for _ in range(6)]
            at = pa.array(out[0], pa.int64())
            yield pa.record_batch([*[batch.column(c).take(at) for c in columns], pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()),
                                   *[pa.array(o, pa.int64()) for o in out[3:]]],
                                  names=[*columns, "item_id", "score", "first_word", "end_word", "n_seeds"])

    return rows


def _clean_rows(finder: Finder, text: str):
    def rows(batches):
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            ok[[r[0] for r in finder.find(batch.column(text))]] = False
            yield batch.filter(pa.array(ok))

    return rows


def blocks(benchmark: DataFrame, item: str, text: str, size: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """Items, read as a stream, in lists of about ``size`` bytes of text."""
    held, n = [], 0
    for r in benchmark.select(F.col(item).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).toLocalIterator():
        held.append(r)
        n += len(r["text"])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _word_counts(known: np.ndarray):
    """Per task: how often each of the ``known`` word hashes stands in the texts."""
    def rows(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for p in pieces(batch.column("text")):
                h = words_of(p)[0]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.record_batch([pa.array(np.arange(len(known), dtype=np.int32)), pa.array(total)], ["i", "n"])

    return rows


def finders(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, threshold: float) -> Iterator[Finder]:
    """One finder per block of items, with the words of the block counted in ``docs``."""
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    for block in blocks(benchmark, item, item_text):
        items = _item_words([r["text"] for r in block])
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
        counts = {}
        if len(known):
            found = own.mapInArrow(_word_counts(known), "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
            counts = {int(known[r.i]): r.n for r in found.collect()}  # words of one block
        yield Finder(items, [r["id"] for r in block], threshold, counts)


def leaks(docs: DataFrame, benchmark: DataFrame, doc: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id",
          item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(document, item) pairs whose best local alignment reaches ``threshold`` of the item's perfect score.

    Columns: ``doc``, item_id, score, first_word, end_word (the aligned span of the text's words) and n_seeds, the places
    of the text where one of the item's rarest words lies. Items of up to four words must stand whole, those of up to eight
    score like four whole words at least, so that a common phrase is no leak; items under three words and null or empty texts
    match nothing. Repeated rows match each by itself, empty tables give no rows. Two passes over the corpus per block of
    items, no shuffle of texts.
    """
    rows = docs.select(*doc, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumnRenamed("__text", "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    kinds += "item_id long, score double, first_word long, end_word long, n_seeds long"
    result = docs.sparkSession.createDataFrame([], kinds)
    for finder in finders(docs, text, benchmark, item, item_text, threshold):
        result = result.unionByName(rows.mapInArrow(_leak_rows(finder, doc), kinds))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, that hold no test item; see ``leaks``. No shuffle takes place."""
    out = docs
    for finder in finders(docs, text, benchmark, item, item_text, threshold):
        out = out.mapInArrow(_clean_rows(finder, text), docs.schema)
    return out
