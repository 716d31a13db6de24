"""Ranked lexical search with a document FP-tree.

Documents are reduced to the terms of the items, in falling document frequency, so that they share paths of a trie from
the root. Every subtree keeps the largest tf of each term and the smallest length norm m below it; both bound the score of
any document in the subtree from above. Each item walks the tree depth first, best bound first, and leaves out subtrees
whose bound cannot enter its best list (Han et al.'s prefix tree, searched by branch and bound).

The corpus is read once to reduce it; the reduced rows are stored. Frequencies come from partial counts merged by Spark.
Trees are built in tasks over bounded blocks of reduced rows, each task hands on its best rows per item, and a
two-stage top-k merges them. Items come in blocks of bounded wording; each block is one pass over the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spikelens.functions.dist import top_k

from .common import pieces, stored, word_hashes, word_spans

#: Words of items handled in one pass over the corpus; a longer item comes alone.
ITEM_WORDS = 200_000
#: Term entries of documents in one tree.
TREE_TERMS = 1 << 21
#: Documents scored together at the end of a branch, unless that needs more than ``CELLS`` bounds.
LEAF, CELLS = 64, 1 << 23

# Bytes that are part of a term (letters, digits, all beyond ASCII), and A-Z in small letters.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Vocabulary:
    """The terms of a block of items, found in byte arrays by hash and then compared byte for byte."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(words)
        self.data = np.frombuffer(b"".join(self.words), np.uint8)
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.cumsum(self.length) - self.length
        hashes = word_hashes(self.data, self.start, self.start + self.length)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.words)

    def find(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans of ``data`` are terms, and which terms they are."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = word_hashes(data, a, b)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        term = self.order[at]
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.length[term] == b - a))
        term = term[hit]
        size = self.length[term]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = data[np.repeat(a[hit], size) + step] == self.data[np.repeat(self.start[term], size) + step]
        equal = np.ones(len(hit), bool)
        equal[np.repeat(np.arange(len(hit)), size)[~same]] = False
        return hit[equal], term[equal]


def _reduced(vocabulary: Vocabulary):
    """Rows of (doc, all its terms, items' terms in it, their tf)."""
    terms = len(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column("text")):
                data = LOWER[part.data]
                a, b, first = word_spans(data, part.start, part.end, GAP)
                hit, term = vocabulary.find(data, a, b)
                row = np.searchsorted(first, hit, "right") - 1
                key, tf = np.unique(row * terms + term, return_counts=True)
                ends = np.searchsorted(key, np.arange(len(part.start) + 1) * terms).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, terms), tf)]
                doc = batch.column("doc").slice(part.row[0], len(part.row))
                yield pa.record_batch([doc, pa.array(np.diff(first)), *lists], ["doc", "n", "terms", "tf"])

    return rows


def _frequencies(terms: int):
    """Per task: documents that hold each term, documents with any term (``terms``), terms in all (``terms + 1``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            total[:terms] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
            n = batch.column("n").to_numpy()
            total[terms] += np.count_nonzero(n)
            total[terms + 1] += n.sum()
        yield pa.record_batch([pa.array(np.arange(terms + 2, dtype=np.int32)), pa.array(total)], ["term", "n"])

    return rows


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of the score before its weight; grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Trie over rows of term places; entries are leaves (runs of neighbouring rows) and inner nodes, the root last.

    ``order`` sorts the rows by path, then m, then ``turn`` (their rank by key). ``bound[e, t]`` is the most a term t can
    give any document under entry e.
    """

    def __init__(self, offsets: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray, turn: np.ndarray, terms: int):
        n = len(offsets) - 1
        self.terms, self.leaf = terms, max(LEAF, n * terms // CELLS)
        wide = place.astype(">u4").tobytes()
        order = sorted(range(n), key=lambda i: (wide[4 * offsets[i] : 4 * offsets[i + 1]], m[i], turn[i]))
        self.order = np.array(order, np.int64)
        size = np.diff(offsets)[self.order]
        self.at = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(offsets[self.order] - self.at[:-1], size) + np.arange(self.at[-1])
        self.place, self.tf = place[source], tf[source]
        self.m, self.turn, self.row = m[self.order], turn[self.order], np.repeat(np.arange(n), size)
        self.value = _part(self.tf, self.m[self.row])
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        inner = self._grow(0, n, 0)
        self._bounds(inner)

    def _symbols(self, lo: int, hi: int, depth: int) -> np.ndarray:
        at = self.at[lo:hi] + depth
        over = at >= self.at[lo + 1 : hi + 1]
        return np.where(over, -1, self.place[np.minimum(at, len(self.place) - 1)])

    def _grow(self, lo: int, hi: int, depth: int) -> list:
        """Nested lists of leaf numbers for rows lo to hi, which share their first ``depth`` terms."""
        stack, root = [(lo, hi, depth, None)], None
        while stack:
            lo, hi, depth, into = stack.pop()
            node: list = []
            if into is None:
                root = node
            else:
                into.append(node)
            while True:
                symbols = self._symbols(lo, hi, depth) if hi > lo else np.zeros(0, np.int64)
                if len(symbols) <= self.leaf or symbols[0] != symbols[-1] or symbols[0] < 0:
                    break
                depth += 1
            cuts = np.flatnonzero(np.diff(symbols)) + 1 if len(symbols) > self.leaf else []
            edges = [lo, *(int(lo + c) for c in cuts), hi]
            run = lo
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > self.leaf and symbols[a - lo] >= 0:
                    self._leaves(run, a, node)
                    stack.append((a, b, depth + 1, node))
                    run = b
                elif b - run > self.leaf:
                    self._leaves(run, a, node)
                    run = a
            self._leaves(run, hi, node)
        return root

    def _leaves(self, lo: int, hi: int, node: list) -> None:
        for a in range(lo, hi, self.leaf):
            node.append(len(self.spans))
            self.spans.append((a, min(hi, a + self.leaf)))

    def _bounds(self, root: list) -> None:
        leaves = len(self.spans)
        most = [np.zeros(self.terms, np.int32) for _ in range(leaves)]
        least_m, first = [], []
        for leaf, (lo, hi) in enumerate(self.spans):
            p, q = self.at[lo], self.at[hi]
            np.maximum.at(most[leaf], self.place[p:q], self.tf[p:q].astype(np.int32))
            least_m.append(int(self.m[lo:hi].min()))
            first.append(int(self.turn[lo:hi].min()))
        inner: list[list[int]] = []

        def close(children: list[int]) -> int:
            inner.append(children)
            most.append(np.maximum.reduce([most[c] for c in children]))
            least_m.append(min(least_m[c] for c in children))
            first.append(min(first[c] for c in children))
            return leaves + len(inner) - 1

        stack: list = [(root, iter(root), [])]
        while stack:  # children before their parents, however deep
            node, rest, done = stack[-1]
            for child in rest:
                if isinstance(child, list):
                    stack.append((child, iter(child), []))
                    break
                done.append(child)
            else:
                stack.pop()
                entry = close(done) if done else -1
                if stack:
                    stack[-1][2].append(entry)
        self.children = inner
        self.first = first
        self.bound = _part(np.array(most), np.array(least_m)[:, None]).astype(np.int32)

    def search(self, places: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (in ``order``) and scores of the k best documents with a score of at least ``floor``, above 0."""
        limits = self.bound[:, places].astype(np.int64) @ weights
        dense = np.zeros(self.terms, np.int64)
        dense[places] = weights
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, last = max(floor, 1), None  # score and turn of the k-th best
        leaves, stack = len(self.spans), [len(self.first) - 1]
        while stack:
            entry = stack.pop()
            limit = limits[entry]
            if limit < least or (last is not None and limit == least and self.first[entry] > last):
                continue
            if entry >= leaves:
                children = self.children[entry - leaves]
                stack.extend(sorted(children, key=lambda c: limits[c]))
                continue
            lo, hi = self.spans[entry]
            p, q = self.at[lo], self.at[hi]
            weight = dense[self.place[p:q]]
            hit = np.flatnonzero(weight)
            own = np.zeros(hi - lo, np.int64)
            np.add.at(own, self.row[p:q][hit] - lo, weight[hit] * self.value[p:q][hit])
            good = np.flatnonzero(own >= least)
            if not len(good):
                continue
            rows, scores = np.append(rows, good + lo), np.append(scores, own[good])
            if len(rows) > k:
                keep = np.lexsort((self.turn[rows], -scores))[:k]
                rows, scores = rows[keep], scores[keep]
            if len(rows) == k:
                worst = np.lexsort((self.turn[rows], -scores))[-1]
                least, last = int(scores[worst]), int(self.turn[rows[worst]])
        return rows, scores


def _best(held: pa.Table, k: int) -> pa.Table:
    """The k best rows of every item."""
    order = pc.sort_indices(held, [("item", "ascending"), ("score", "descending"), ("doc", "ascending")])
    held = held.take(order).combine_chunks()
    item = held["item"].to_numpy()
    return held.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def _searched(items: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, documents: int, words: int, k: int):
    terms = len(rank)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of about ``TREE_TERMS`` term entries."""
        held, size = [], 0
        for batch in batches:
            entries = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(entries, entries[lo] + TREE_TERMS - size, "right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(entries[hi] - entries[lo])
                lo = hi
                if size >= TREE_TERMS or lo < len(batch):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, held = [0] * len(items), None
        for table in trees(batches):
            table = table.filter(pc.greater(pc.list_value_length(table["terms"]), 0)).combine_chunks()
            if not len(table):
                continue
            lists = table["terms"].chunk(0)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            place, tf = rank[lists.flatten().to_numpy()], table["tf"].chunk(0).flatten().to_numpy()
            order = np.lexsort((place, np.repeat(np.arange(len(table)), np.diff(offsets))))
            turn = np.empty(len(table), np.int64)
            turn[pc.sort_indices(table["doc"], sort_keys=[("", "ascending")]).to_numpy()] = np.arange(len(table))
            m = 100 - 75 + (75 * documents * table["n"].to_numpy()) // words
            tree = Tree(offsets, place[order], tf[order], m, turn, terms)
            found = [tree.search(places, weights, k, least) for (places, weights), least in zip(items, floor, strict=True)]
            item = np.repeat(np.arange(len(items), dtype=np.int32), [len(r) for r, _ in found])
            new = pa.table({"item": item, "score": np.concatenate([s for _, s in found] or [np.zeros(0, np.int64)]),
                            "doc": table["doc"].take(tree.order[np.concatenate([r for r, _ in found] or [np.zeros(0, np.int64)])])})
            held = _best(new if held is None else pa.concat_tables([held, new]), k)
            item, score = held["item"].to_numpy(), held["score"].to_numpy()
            full = np.flatnonzero(np.bincount(item, minlength=len(items)) == k)
            for i, least in zip(full, score[np.searchsorted(item, full, "right") - 1], strict=True):
                floor[i] = int(least)
        if held is not None:
            yield from held.to_batches()

    return rows


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their terms in order."""
    for batch in batches:
        for part in pieces(batch.column("text")):
            data = LOWER[part.data]
            a, b, first = word_spans(data, part.start, part.end, GAP)
            words = pa.array([data[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())
            yield pa.record_batch([batch.column("item").slice(part.row[0], len(part.row)),
                                   pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), words)], ["item", "words"])


def _item_blocks(items: DataFrame) -> Iterator[list]:
    block, words = [], 0
    for row in items.toLocalIterator():
        if block and words + len(row.words) > ITEM_WORDS:
            yield block
            block, words = [], 0
        block.append((row.item, Counter(map(bytes, row.words))))
        words += len(row.words)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item key, ``rank`` from 1, document key, ``score``.

    Terms are runs of letters, digits and non-ASCII characters, with A-Z in small letters. With N documents that have a
    term, df of them holding a term, L terms in all and n in a document: a term weighs floor(1000 ln((2N+2)/(2df+1))), a
    document's m is 25 + 75nN div L, and its score sums weight * (10^9 tf div (1000 tf + 8m)) over the item's terms,
    repeats included. Only scores above 0 count; equal scores go by ascending document key, nulls last. Null or empty texts
    have no terms: such documents count nowhere and such items find nothing. Every row is a document or an item of its
    own, also with a null or repeated key. Empty tables give no rows; other columns are not used.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))
    worded = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text")).mapInArrow(
        _worded, f"item {items.schema[item].dataType.simpleString()}, words array<binary>")
    key = docs.schema[doc].dataType.simpleString()
    out = None
    for block in _item_blocks(worded):
        vocabulary = Vocabulary(list(set().union(*(words for _, words in block))))
        reduced = stored(own.mapInArrow(_reduced(vocabulary), f"doc {key}, n long, terms array<int>, tf array<int>"))
        total = {r.term: r.n for r in reduced.select("n", "terms").mapInArrow(
            _frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        df = np.array([total.get(t, 0) for t in range(len(vocabulary))], np.int64)
        documents, words = total.get(len(vocabulary), 0), total.get(len(vocabulary) + 1, 0)
        if not words:
            continue
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in df]
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        number = {w: i for i, w in enumerate(vocabulary.words)}
        queries = []
        for _, counts in block:
            terms = [number[w] for w in counts]
            queries.append((rank[np.array(terms, np.int64)], np.array(
                [n * weight[t] for t, n in zip(terms, counts.values(), strict=True)], np.int64)))
        found = reduced.mapInArrow(_searched(queries, rank, documents, words, k), f"item int, score long, doc {key}")
        names = spark.createDataFrame(
            [(i, name) for i, (name, _) in enumerate(block)], f"item int, name {items.schema[item].dataType.simpleString()}")
        best = top_k(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc")], k).join(F.broadcast(names), "item")
        best = best.select(F.col("name").alias(item), F.col("rank"), F.col("doc").alias(doc), "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], f"item {items.schema[item].dataType.simpleString()}, rank int, doc {key}, score long")
        out = out.withColumnsRenamed({"item": item, "doc": doc})
    return out
