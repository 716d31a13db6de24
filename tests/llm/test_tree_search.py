"""Ranked search: the tree against scoring every document, and the whole query on awkward tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spikelens.llm import tree_search
from spikelens.llm.tree_search import Tree, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item place, doc key, score) of the best k by score, then key, nulls last."""
    texts = [(d, Counter(words(t))) for d, t in docs]
    filled = [c for _, c in texts if c]
    n_docs, n_words = len(filled), sum(sum(c.values()) for c in filled)
    df = Counter(w for c in filled for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for w, f in df.items()}
    out = []
    for i, text in items:
        found = []
        for d, c in texts:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // n_words if n else 0
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    pick = lambda: vocabulary[min(59, int(rnd.expovariate(0.08)))]
    docs = [(i, " ".join(pick() for _ in range(rnd.randrange(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)] + [(2000 + i, docs[i][1].upper() + "!") for i in range(40)]
    docs += [(None, docs[7][1]), (None, "t1"), (5, docs[9][1]), (5, docs[9][1]), (3000, None), (3001, ""), (3002, " .,-"),
             (3003, " ".join(pick() for _ in range(30_000))), (3004, "Ünï t3 日本 x-y"), (3005, "only other words")]
    rnd.shuffle(docs)
    items = [(i, " ".join(pick() for _ in range(rnd.randrange(1, 12)))) for i in range(25)]
    items += [(100, "t1 t1 t1 t2"), (101, None), (102, ""), (103, "nowhere"), (104, "ünï 日本"), (105, docs[3][1] or "t4"), (106, "Ünï T3")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_search_equals_scoring_everything(spark, k):
    docs, items = corpus(k)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = search(frame, spark.createDataFrame(items, "item_id long, text string"), k=k).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(brute(docs, items, k), key=lambda r: r[:2])


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(4, 60)
    monkeypatch.setattr(tree_search, "ITEM_WORDS", 40)
    got = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(brute(docs, items, 5), key=lambda r: r[:2])


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_bounds_hold_and_branches_are_left_out(monkeypatch, leaf):
    monkeypatch.setattr(tree_search, "LEAF", leaf)
    rnd, terms, rows = random.Random(leaf), 30, []
    for _ in range(400):
        rows.append(sorted(rnd.sample(range(terms), rnd.randrange(1, 8))))
    rows += [[0, 1, 2]] * 200
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tf = np.array([rnd.randrange(1, 9) for r in rows for _ in r], np.int32)
    m, turn = np.array([rnd.randrange(25, 400) for _ in rows]), np.array(rnd.sample(range(len(rows)), len(rows)))
    tree = Tree(offsets, np.concatenate(rows), tf, m, turn, terms)
    assert sorted(tree.order) == list(range(len(rows)))
    seen = 0
    for lo, hi in tree.spans:
        seen += hi - lo
        assert hi - lo <= leaf
    assert seen == len(rows)
    share = 10**9 * tf.astype(np.int64) // (1000 * tf + 8 * np.repeat(m, np.diff(offsets)))
    for _ in range(20):
        places = np.array(rnd.sample(range(terms), 4))
        weights = np.array([rnd.randrange(0, 9000) for _ in places])
        dense = np.zeros(terms, np.int64)
        dense[places] = weights
        score = [int((dense[np.concatenate(rows)[a:b]] * share[a:b]).sum()) for a, b in zip(offsets[:-1], offsets[1:])]
        limits = tree.bound[:, places].astype(np.int64) @ weights
        assert all(limits[e] >= max(score[i] for i in tree.order[lo:hi]) for e, (lo, hi) in enumerate(tree.spans))
        assert limits[-1] >= max(score)
        found, scores = tree.search(places, weights, 10, 0)
        want = sorted((-s, turn[i]) for i, s in enumerate(score) if s > 0)[:10]
        assert sorted((-s, turn[tree.order[r]]) for r, s in zip(found, scores)) == want


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([("d", "a b", 1, 2, 3)], "name string, item_id string, doc long, score long, rank long")
    items = spark.createDataFrame([("q", "B", 1)], "item_id string, text string, item long")
    got = search(docs, items, doc="name", text="item_id")
    assert got.columns == ["item_id", "rank", "name", "score"] and [tuple(r)[:3] for r in got.collect()] == [("q", 1, "d")]
    assert search(docs.limit(0), items, doc="name", text="item_id").collect() == []
    none = search(docs, items.limit(0), doc="name", text="item_id")
    assert none.collect() == [] and none.columns == got.columns
