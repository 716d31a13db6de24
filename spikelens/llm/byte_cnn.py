"""Quality scores from a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. Bytes become learned vectors, beside a channel that says whether
the bytes before stood a few places earlier too. Learned filters slide over each chunk and are max-pooled; the mean
and the maximum of a document's chunks go through a small hidden layer to one probability. Filters, byte vectors and layers
are trained together by gradient descent (Adam) on a bounded sample of labelled rows, in one task; scoring runs in tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces

CHUNK, STEP = 512, 448
#: Labelled rows in the sample, and chunks drawn of each (all, if fewer).
ROWS, DRAWN = 3000, 6
#: Batches of the fit, whatever the size of the sample.
STEPS = 1000
VECTOR, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 24, 16
PAD = 256
#: A byte counts as repeated where it ends RUN equal bytes at one of these distances.
RUN, NEAREST, FARTHEST = 6, 3, 40
SLAB = 256


@dataclass
class Network:
    vectors: np.ndarray  # (257, VECTOR)
    filters: np.ndarray  # (WIDTH * (VECTOR + 1), FILTERS)
    filter_bias: np.ndarray
    hidden: np.ndarray  # (2 * FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def _new(rng: np.random.Generator) -> Network:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    depth = WIDTH * (VECTOR + 1)
    net = Network(normal(PAD + 1, VECTOR, scale=0.5), normal(depth, FILTERS, scale=depth**-0.5), normal(FILTERS, scale=0.01),
                  normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), normal(HIDDEN, scale=0.01),
                  normal(HIDDEN, scale=HIDDEN**-0.5), normal(1, scale=0.01))
    net.vectors[PAD] = 0
    return net


def chunk_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of each text (one for an empty one) and their starts: all bytes lie in a chunk, neighbours overlap."""
    number = 1 + np.maximum(0, -(-(size - CHUNK) // STEP))
    return number, (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * STEP


def _laid(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks as rows of byte values, ``PAD`` beyond the end of the text."""
    at = start[:, None] + np.arange(CHUNK)
    rows = np.full(at.shape, PAD, np.int16)
    inside = at < end[:, None]
    rows[inside] = data[at[inside]]
    return rows


def _repeated(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(rows.shape, bool)
    real = rows != PAD
    for lag in range(NEAREST, FARTHEST + 1):
        same = (rows[:, lag:] == rows[:, :-lag]) & real[:, lag:]
        two = same[:, 1:] & same[:, :-1]
        four = two[:, 2:] & two[:, :-2]
        out[:, lag + RUN - 1 :] |= four[:, : four.shape[1] - 2] & two[:, 4:]
    return out


def _patches(net: Network, rows: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH * (VECTOR + 1)) of what every filter sees."""
    n = len(rows)
    seen = np.empty((n, CHUNK, VECTOR + 1), np.float32)
    seen[:, :, :VECTOR] = net.vectors[rows]
    seen[:, :, VECTOR] = _repeated(rows)
    flat = seen.reshape(n, CHUNK * (VECTOR + 1))
    windows = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * (VECTOR + 1), axis=1)
    return np.ascontiguousarray(windows[:, :: STRIDE * (VECTOR + 1)])


def _pooled(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Max-pooled filter outputs of every chunk, the places of the maxima, and the patches."""
    patches = _patches(net, rows)
    n, places, depth = patches.shape
    got = (patches.reshape(-1, depth) @ net.filters).reshape(n, places, FILTERS)
    best = got.argmax(1)
    top = np.take_along_axis(got, best[:, None], 1)[:, 0] + net.filter_bias
    return np.maximum(top, 0), best, patches


def _combined(net: Network, pooled: np.ndarray, number: np.ndarray):
    """Mean and maximum of each document's chunks, hidden layer, probability."""
    first = np.cumsum(number) - number
    mean = np.add.reduceat(pooled, first, axis=0) / number[:, None].astype(np.float32)
    most = np.maximum.reduceat(pooled, first, axis=0)
    features = np.concatenate([mean, most], 1)
    hidden = np.tanh(features @ net.hidden + net.hidden_bias)
    logit = (hidden @ net.out + net.out_bias[0]).astype(np.float64)
    return features, hidden, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def probabilities(net: Network, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One probability per text ``data[start:end]``."""
    if not len(start):
        return np.zeros(0)
    number, offset = chunk_starts(end - start)
    begin, stop = np.repeat(start, number) + offset, np.repeat(end, number)
    pooled = [_pooled(net, _laid(data, begin[i : i + SLAB], stop[i : i + SLAB]))[0] for i in range(0, len(begin), SLAB)]
    return _combined(net, np.concatenate(pooled), number)[2]


def gradients(net: Network, rows: np.ndarray, number: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over documents (``number`` rows of ``rows`` each), and its gradient by every array of ``net``."""
    pooled, best, patches = _pooled(net, rows)
    features, hidden, p = _combined(net, pooled, number)
    loss = float(-np.mean(np.log(np.where(label == 1, p, 1 - p) + 1e-12)))
    d_logit = ((p - label) / len(label)).astype(np.float32)
    d_hidden = d_logit[:, None] * net.out * (1 - hidden**2)
    d_features = d_hidden @ net.hidden.T
    doc = np.repeat(np.arange(len(number)), number)
    d_pooled = (d_features[:, :FILTERS] / number[:, None].astype(np.float32))[doc]
    # a document's maximum passes its gradient to the first chunk that reaches it
    reach = pooled == features[doc, FILTERS:]
    before = np.cumsum(reach, axis=0)
    base = np.concatenate([np.zeros((1, FILTERS), before.dtype), before])[np.cumsum(number) - number]
    d_pooled += np.where(reach & (before - base[doc] == 1), d_features[doc, FILTERS:], 0)
    d_pooled *= pooled > 0
    chosen = np.take_along_axis(patches, best[:, :, None], 1)  # (chunks, FILTERS, depth)
    d_filters = np.einsum("cfd,cf->df", chosen, d_pooled)
    back = (d_pooled[:, :, None] * net.filters.T[None]).reshape(len(rows), FILTERS, WIDTH, VECTOR + 1)[..., :VECTOR]
    byte = np.take_along_axis(rows, (best[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(len(rows), -1), 1)
    d_vectors = np.zeros_like(net.vectors)
    np.add.at(d_vectors, byte.ravel(), back.reshape(-1, VECTOR))
    d_vectors[PAD] = 0
    return loss, [d_vectors, d_filters, d_pooled.sum(0), features.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_logit,
                  np.array([d_logit.sum()], np.float32)]


def train(rows: np.ndarray, number: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 0.004,
          seed: int = 7) -> Network:
    """Adam over ``steps`` batches of shuffled documents, at a rate that falls to nothing."""
    rng = np.random.default_rng(seed)
    net, first = _new(rng), np.cumsum(number) - number
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(number))
        mine, order = order[:batch], order[batch:]
        take = np.concatenate([np.arange(first[i], first[i] + number[i]) for i in mine])
        _, slopes = gradients(net, rows[take], number[mine], label[mine])
        for array, slope, (m, v) in zip(net.arrays(), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope**2 - v)
            array -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The network of the whole sample, which is bounded."""
    sample = pa.Table.from_batches(batches, pa.schema([("y", pa.int32()), ("turn", pa.int64()), ("chunks", pa.binary())]))
    sample = sample.sort_by([("turn", "ascending"), ("y", "ascending")])
    chunks = [np.frombuffer(c, "<i2").reshape(-1, CHUNK) for c in sample["chunks"].to_pylist()]
    if chunks:
        net = train(np.concatenate(chunks), np.array([len(c) for c in chunks]), sample["y"].to_numpy())
        held = io.BytesIO()
        np.savez(held, *net.arrays())
        yield pa.record_batch([pa.array([held.getvalue()], pa.binary())], ["net"])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``DRAWN`` chunks of each text, spread over its whole length, end to end."""
    for batch in batches:
        out: list[bytes] = []
        for part in pieces(batch.column("text")):
            for a, b in zip(part.start, part.end, strict=True):
                _, offset = chunk_starts(np.array([b - a]))
                offset = offset[np.unique(np.linspace(0, len(offset) - 1, DRAWN).round().astype(int))]
                rows = _laid(part.data, a + offset, np.full(len(offset), b))
                out.append(rows.astype("<i2").tobytes())
        yield pa.record_batch([batch.column("y"), batch.column("turn"), pa.array(out, pa.binary())], ["y", "turn", "chunks"])


def fold(doc: str, folds: int = 4) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc: str = "doc_id", text: str = "text",
        held: int = 2, rows: int = ROWS) -> Network:
    """A network learnt from at most ``rows`` labelled rows of ``docs`` whose fold is not ``held``.

    The sample is the labelled keys with the smallest hash, so it is the same in every run; of a text longer than ``DRAWN``
    chunks, chunks spread over all of it are learnt from. A key labelled twice counts as 1 if any label is 1; null labels
    and keys are left out; null texts count as empty. Without any label the network is untrained.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & (fold(doc) != held)).groupBy(
        F.col(doc).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(rows)
    own = docs.select(F.col(doc).alias("key"), F.col(text).cast("binary").alias("text")).join(F.broadcast(known), "key")
    drawn = own.select("y", F.xxhash64(F.col("key").cast("string"), "text").alias("turn"), "text").mapInArrow(
        _draw, "y int, turn long, chunks binary")
    sample = drawn.orderBy("turn", "y", "chunks").limit(rows)
    got = sample.coalesce(1).mapInArrow(_trained, "net binary").collect()
    if not got:
        return _new(np.random.default_rng(7))
    with np.load(io.BytesIO(got[0].net)) as arrays:
        return Network(*arrays.values())


def score(docs: DataFrame, net: Network, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` of every row: the probability of label 1. Null texts count as empty, which have a score too; every
    row is scored by itself, also with a null or repeated key; an empty table gives no rows; other columns are not used."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [probabilities(net, p.data, p.start, p.end) for p in pieces(batch.column("text"))]
            yield pa.record_batch([batch.column("doc"), pa.array(np.concatenate(got or [np.zeros(0)]))], ["doc", "score"])

    key = docs.schema[doc].dataType.simpleString()
    out = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text")).mapInArrow(rows, f"doc {key}, score double")
    return out.withColumnRenamed("doc", doc)
