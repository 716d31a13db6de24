"""Byte network: chunks, filters against a plain loop, gradients against differences, held-out accuracy, awkward tables."""

import numpy as np
from pyspark.sql import functions as F

from spikelens.llm import byte_cnn
from spikelens.llm.byte_cnn import CHUNK, FILTERS, PAD, STEP, STRIDE, VECTOR, WIDTH, fit, fold, probabilities, score

TEXTS = [b"", b"a", b"Some plain words. " * 3, b"cira cira cira cira cira", bytes(range(256)) * 9, "ñandú é ".encode() * 200, b"x" * 20_000]


def laid(texts):
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    return np.frombuffer(b"".join(texts), np.uint8), end - size, end


def network(seed=3):
    return byte_cnn._new(np.random.default_rng(seed))


def test_chunks_cover_every_byte_and_overlap():
    for n in [0, 1, CHUNK - 1, CHUNK, CHUNK + 1, CHUNK + STEP, CHUNK + STEP + 1, 100_000]:
        number, start = byte_cnn.chunk_starts(np.array([n]))
        assert number[0] == len(start) and start[0] == 0 and start[-1] + CHUNK >= n
        assert all(b - a == STEP < CHUNK for a, b in zip(start, start[1:]))
        assert n == 0 or start[-1] < n


def plain(net, text):
    """The probability of one text, place by place."""
    pooled = []
    for at in range(0, max(1, len(text) - CHUNK + STEP), STEP):
        chunk = [*text[at : at + CHUNK]] + [PAD] * CHUNK
        chunk = chunk[:CHUNK]
        real = len(text[at : at + CHUNK])
        repeated = [any(i - lag - 5 >= 0 and i < real and chunk[i - 5 : i + 1] == chunk[i - 5 - lag : i + 1 - lag]
                        for lag in range(3, 41)) for i in range(CHUNK)]
        seen = np.array([[*net.vectors[c], r] for c, r in zip(chunk, repeated)])
        outs = [seen[i : i + WIDTH].ravel() @ net.filters + net.filter_bias for i in range(0, CHUNK - WIDTH + 1, STRIDE)]
        pooled.append(np.maximum(np.max(outs, axis=0), 0))
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(np.tanh(features @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0])))


def test_probabilities_equal_a_plain_loop():
    net = network()
    assert np.allclose(probabilities(net, *laid(TEXTS)), [plain(net, t) for t in TEXTS], atol=1e-5)
    assert len(probabilities(net, *laid([]))) == 0


def test_gradients_equal_differences():
    net, texts = network(5), [t[:900] for t in TEXTS[:6]]
    for i, a in enumerate(net.arrays()):
        setattr(net, list(vars(net))[i], a.astype(np.float64))
    data, start, end = laid(texts)
    number, offset = byte_cnn.chunk_starts(end - start)
    rows = byte_cnn._laid(data, np.repeat(start, number) + offset, np.repeat(end, number))
    label = np.array([0, 1, 1, 0, 0, 1])
    _, slopes = byte_cnn.gradients(net, rows, number, label)
    rng = np.random.default_rng(1)
    for array, slope in zip(net.arrays(), slopes):
        for at in rng.choice(array.size, min(12, array.size), replace=False):
            place, step = np.unravel_index(at, array.shape), 1e-4
            if array is net.vectors and place[0] == PAD:
                continue
            kept = array[place]
            losses = []
            for value in (kept + step, kept - step):
                array[place] = value
                losses.append(byte_cnn.gradients(net, rows, number, label)[0])
            array[place] = kept
            assert abs((losses[0] - losses[1]) / (2 * step) - slope[place]) < 2e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score(docs, fit(docs, labels)).join(labels, "doc_id").where(fold("doc_id") == 2).toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.score >= 0.7).mean() >= 0.97 and (bad.score < 0.7).mean() >= 0.8
    # rows of the held-out fold teach nothing
    changed = labels.withColumn("quality", F.when(fold("doc_id") == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = score(docs, fit(docs, changed)).toPandas()
    assert np.allclose(again.set_index("doc_id").score.loc[got.doc_id].to_numpy(), got.score.to_numpy(), atol=1e-6)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (1, None, 2), (None, "", 3), (2, "w " * 60_000, 4), (3, "ok", 5), (3, "ok", 6)], "doc_id long, text string, score int")
    net = network()
    got = sorted(((r.doc_id or 0), r.score) for r in score(docs, net).collect())
    assert [d for d, _ in got] == [0, 1, 1, 2, 3, 3] and all(0 <= s <= 1 for _, s in got)
    assert np.allclose([s for _, s in got[:3]], got[0][1], atol=1e-6) and np.isclose(got[4][1], got[5][1], atol=1e-6)
    assert score(docs.limit(0), net).collect() == []
    none = fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert len(none.arrays()) == 7
