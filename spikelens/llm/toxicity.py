"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so words of toxic documents are labelled first: a word is toxic where one of its features (the
word, its beginnings, its endings) is much more frequent in toxic documents than in others and nearly the strongest such
evidence of its document. The field learns feature and transition weights from these words by gradient steps on its
likelihood. Forward-backward gives every word's marginal; a document's highest marginal and expected number of toxic words
give its score through a logistic fit, and runs of likely toxic words its offending offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bounds of the sample the model is fitted on: labelled rows, and characters of a sampled text.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 10_000
CACHED_WORDS = 500_000
_TOKEN = re.compile(r"[^\W\d_]+")
_LANES = 64


def features(word: str) -> list[str]:
    w = word.lower()
    return [w, *{f"^{w[:k]}" for k in range(3, 7) if len(w) >= k}, *{f"{w[-k:]}$" for k in range(3, 5) if len(w) >= k}]


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """P(toxic) of every word of several texts laid end to end, and P(state before, state) summed where both are of one text.

    ``score`` is what each word adds for the toxic state, ``first`` marks the first word of a text. A first word's matrix
    forgets the state before, so one pass serves all texts. The chain is cut into blocks; matrix products run over all
    blocks at once, and only the blocks themselves are walked one by one.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e = np.exp(np.clip(score, -30, 30))
    blocks = -(-n // _LANES)
    m = np.zeros((2, 2, blocks * _LANES))
    m[0, 0, n:] = m[1, 1, n:] = 1
    w, s = np.exp(trans), np.exp(start)
    for i in range(2):
        m[i, 0, :n] = np.where(first, s[0], w[i, 0])
        m[i, 1, :n] = np.where(first, s[1], w[i, 1]) * e
    m = np.ascontiguousarray(m.reshape(2, 2, blocks, _LANES).transpose(0, 1, 3, 2))
    whole = m[:, :, 0].copy()
    for t in range(1, _LANES):
        step = m[:, :, t]
        whole = np.stack([whole[:, 0] * step[0, j] + whole[:, 1] * step[1, j] for j in (0, 1)], 1)
        whole /= whole.sum((0, 1))
    ahead, back = np.empty((2, blocks)), np.empty((2, blocks))
    (a, b), (c, d) = whole.tolist()
    f0, f1 = 0.5, 0.5
    for k in range(blocks):
        ahead[:, k] = f0, f1
        f0, f1 = f0 * a[k] + f1 * c[k], f0 * b[k] + f1 * d[k]
        z = f0 + f1
        f0, f1 = f0 / z, f1 / z
    f0, f1 = 0.5, 0.5
    for k in range(blocks - 1, -1, -1):
        back[:, k] = f0, f1
        f0, f1 = a[k] * f0 + b[k] * f1, c[k] * f0 + d[k] * f1
        z = f0 + f1
        f0, f1 = f0 / z, f1 / z
    alpha = np.empty((2, _LANES, blocks))
    before = ahead
    for t in range(_LANES):
        now = np.stack([before[0] * m[0, j, t] + before[1] * m[1, j, t] for j in (0, 1)])
        now /= now.sum(0)
        alpha[:, t] = before = now
    out, pairs = np.empty((_LANES, blocks)), np.zeros((2, 2))
    beta = back
    inner = np.zeros(blocks * _LANES, bool)
    inner[:n] = ~first
    inner = inner.reshape(blocks, _LANES).T
    for t in range(_LANES - 1, -1, -1):
        p = alpha[:, t] * beta
        out[t] = p[1] / p.sum(0)
        prev = alpha[:, t - 1] if t else ahead
        joint = np.stack([[prev[i] * m[i, j, t] * beta[j] for j in (0, 1)] for i in (0, 1)])
        pairs += (joint / joint.sum((0, 1)))[:, :, inner[t]].sum(2)
        beta = np.stack([m[i, 0, t] * beta[0] + m[i, 1, t] * beta[1] for i in (0, 1)])
        beta /= beta.sum(0)
    return out.T.ravel()[:n], pairs


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    logit: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        x = self.cache.get(w)
        if x is None:
            x = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
            if len(self.cache) < CACHED_WORDS:
                self.cache[w] = x
        return x

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of some texts, and the place of each text's first word (plus the total)."""
        lists = [_TOKEN.findall(t) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        get = self.cache.get
        score = np.array([y if (y := get(w)) is not None else self.word(w) for ws in lists for w in ws], float)
        first = np.zeros(len(score), bool)
        first[at[:-1][at[:-1] < at[1:]]] = True
        return marginals(score, first, self.trans, self.start)[0], at

    def summary(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text: log odds of the highest marginal, and log of 1 + expected toxic words beyond noise."""
        n = len(at) - 1
        high, total = np.full(n, 1e-6), np.zeros(n)
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            high[full] = np.clip(np.maximum.reduceat(p, at[:-1][full]), 1e-6, 1 - 1e-6)
            total[full] = np.add.reduceat(np.where(p > 0.05, p, 0.0), at[:-1][full])
        return np.stack([np.ones(n), np.log(high / (1 - high)), np.log1p(total)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.logit), -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, steps: int = 40) -> Model:
    """A model from documents and their 0/1 labels; without both classes, one that calls nothing toxic."""
    model = Model()
    if not len(toxic) or toxic.min() == toxic.max():
        return model
    same: dict[str, str] = {}  # one object per different word
    lists = [[same.setdefault(w, w) for w in _TOKEN.findall(t)] for t in texts]
    counts = [Counter(), Counter()]
    sizes = [0, 0]
    seen = set()
    for t, ws, y in zip(texts, lists, toxic.tolist(), strict=True):
        if t not in seen:  # copies would make any of their words look telling
            seen.add(t)
            sizes[y] += 1
            counts[y].update({f for w in set(ws) for f in features(w)})
    prior = (sizes[1] + 1) / (sum(sizes) + 2)
    strong = {}
    for f, a in counts[1].items():
        share = (a + prior) / (a + counts[0][f] + 1)
        if a >= 3 and share >= 0.8:
            strong[f] = a * np.log(share / prior)
    evidence: dict[str, float] = {}

    def weigh(w: str) -> float:
        if w not in evidence:
            evidence[w] = max((strong.get(f, 0.0) for f in features(w)), default=0.0)
        return evidence[w]

    # all toxic documents of the sample and as many others, in their order
    others = np.flatnonzero(toxic == 0)
    chosen = np.sort(np.concatenate([np.flatnonzero(toxic == 1), others[: max(200, 2 * int(toxic.sum()))]]))
    types: dict[str, int] = {}
    ids, labels, first = [], [], []
    for i in chosen.tolist():
        ws = lists[i]
        if not ws:
            continue
        marks = [0] * len(ws)
        if toxic[i]:
            own = [weigh(w) for w in ws]
            top = max(own)
            marks = [int(x > 0 and x >= 0.3 * top) for x in own]
        ids += [types.setdefault(w, len(types)) for w in ws]
        labels += marks
        first += [True, *[False] * (len(ws) - 1)]
    x, y, head = np.array(ids), np.array(labels, float), np.array(first)
    names: dict[str, int] = {}
    owner, feat = [], []
    for w, i in types.items():
        for f in features(w):
            if counts[0][f] + counts[1][f] >= 3:
                owner.append(i)
                feat.append(names.setdefault(f, len(names)))
    owner, feat = np.array(owner, np.int64), np.array(feat, np.int64)
    weight, bias = np.zeros(len(names)), np.log(max(y.mean(), 1e-6))
    square, bias_square, trans_square = np.full(len(names), 1e-4), 1e-4, np.full((2, 2), 1e-4)
    inner = ~head
    yi = y.astype(int)
    told = np.zeros((2, 2))
    np.add.at(told, (yi[:-1][inner[1:]], yi[1:][inner[1:]]), 1)
    n = max(1.0, y.sum())
    for _ in range(steps):
        score = bias + np.bincount(owner, weight[feat], len(types))
        p, pairs = marginals(score[x], head, model.trans, model.start)
        by_type = np.bincount(x, y - p, len(types)) / n
        g = np.bincount(feat, by_type[owner], len(names)) - 1e-5 * weight
        square += g * g
        weight += 0.4 * g / np.sqrt(square)
        gb = by_type.sum()
        bias_square += gb * gb
        bias += 0.2 * gb / np.sqrt(bias_square)
        gt = (told - pairs) / n - 1e-3 * model.trans
        trans_square += gt * gt
        model.trans = model.trans + 0.1 * gt / np.sqrt(trans_square)
    model.weights = {f: float(weight[i]) for f, i in names.items() if abs(weight[i]) > 1e-3}
    model.bias = float(bias)
    s = np.concatenate([model.summary(*model.words(texts[i : i + 200])) for i in range(0, len(texts), 200)])
    b = np.zeros(3)
    for _ in range(25):  # Newton steps of a lightly penalised logistic fit
        q = 1 / (1 + np.exp(-np.clip(s @ b, -30, 30)))
        h = (s * (q * (1 - q))[:, None]).T @ s + 1e-2 * np.eye(3)
        b = b + np.linalg.solve(h, s.T @ (toxic - q) - 1e-2 * b)
    model.logit = tuple(b.tolist())
    model.cache = {}
    return model


def sample(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS,
           chars: int = SAMPLE_CHARS):
    """Texts and labels the model may learn from: rows whose crc32 of the id leaves a remainder of 1 to 4 by 5."""
    learn = labels.select(F.col(doc).alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc is not null and toxic in (0, 1)")
    learn = learn.where(F.crc32(F.col("doc").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc"), "toxic").limit(rows)
    found = (docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.char_length("text") <= chars)
             .join(F.broadcast(learn), "doc").orderBy("doc", "text").limit(rows).select("text", "toxic").toPandas())
    return found["text"].tolist(), found["toxic"].to_numpy(np.int64)


def _score_rows(model: Model, columns: tuple[str, ...], with_spans: bool, name: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            done, scores, spans = 0, np.zeros(len(texts)), [[] for _ in texts]
            while done < len(texts):
                size, end = 0, done
                while end < len(texts) and (end == done or size + len(texts[end]) <= 1 << 21):
                    size, end = size + len(texts[end]), end + 1
                p, at = model.words(texts[done:end])
                scores[done:end] = model.scores(model.summary(p, at))
                if with_spans:
                    for i in np.unique(np.searchsorted(at, np.flatnonzero(p >= 0.5), "right") - 1).tolist():
                        last = None
                        for x, q in zip(_TOKEN.finditer(texts[done + i]), p[at[i] : at[i + 1]] >= 0.5, strict=True):
                            if q and last is not None:
                                spans[done + i][-1]["end"] = x.end()
                            elif q:
                                spans[done + i].append({"start": x.start(), "end": x.end()})
                            last = x if q else None
                done = end
            kept = [batch.column(c) for c in columns]
            more = [pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] if with_spans else []
            yield pa.record_batch([*kept, pa.array(scores), *more],
                                  names=[*columns, f"{name}_score", *([f"{name}_spans"] if with_spans else [])])

    return rows


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None, with_spans: bool = True,
          name: str = "toxic") -> DataFrame:
    """Columns ``keep`` (all when not given) plus ``name``_score (0 to 1) and ``name``_spans (character offsets), one row
    per row. Columns that have these names already are replaced.

    Nulls are empty texts; a text without words gets the score of no evidence. No shuffle takes place.
    """
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in (f"{name}_score", f"{name}_spans"))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    spans = f", `{name}_spans` array<struct<start: int, end: int>>" if with_spans else ""
    return rows.mapInArrow(_score_rows(model, keep, with_spans, name), f"{schema}`{name}_score` double{spans}")
