import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, events
from spikelens.functions.dist import settle
from spikelens.operators import evidence as V, keywords as K
from spikelens.sources import world_events as W


def docs(spark, texts):
    return spark.createDataFrame([(t, 1) for t in texts], "text string, n int").groupBy("text").agg(F.sum("n").alias("n"))


def test_tokens(one):
    words = one(K.tokens(F.lit("The U.S. Army, AT Ohio's border -- a Protest!")))
    assert words == ["army", "ohio", "border", "protest"]
    assert one(K.tokens(F.lit(""))) == []
    assert one(K.tokens(F.lit("Texas protest"), F.lit("USA"))) == ["protest"]
    assert one(K.tokens(F.lit("Texas protest"), F.lit("Iran"))) == ["texas", "protest"]
    assert one(K.ngrams(F.array(F.lit("x"), F.lit("y"), F.lit("z")))) == ["x", "y", "z", "x y", "y z"]
    assert one(K.ngrams(K.tokens(F.lit("army of protest")))) == ["army", "protest", "army protest"]


def brute(texts, max_features=800):
    bags = [Counter(t) for t in texts]
    df = Counter(k for b in bags for k in b)
    tf = Counter()
    for b in bags:
        tf.update(b)
    vocab = sorted((t for t in df if df[t] >= 2), key=lambda t: (-tf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    total = Counter()
    for b in bags:
        w = {t: (1 + math.log(n)) * idf[t] for t, n in b.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            total[t] += v / norm
    return idf, {t: v / len(texts) for t, v in total.items()}


def grams(text):
    words = text.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_tfidf_against_brute_force(spark):
    texts = ["alpha beta beta gamma", "alpha beta", "beta delta delta", "alpha beta", "", "gamma delta epsilon", "zeta"]
    d = docs(spark, texts)
    for limit in (800, 3):
        vocabulary = settle(K.fit_tfidf(d, max_features=limit))
        idf, mean = brute([grams(t) for t in texts], limit)
        assert {r.term: pytest.approx(r.idf) for r in vocabulary.collect()} == idf
        got = {r.keyword: r.score for r in K.top_keywords(d, vocabulary, top_n=100).collect()}
        assert got == {t: pytest.approx(v, abs=6e-6) for t, v in mean.items()}


def test_document_vectors_have_unit_length(spark):
    d = W.table(spark, SF, "documents").select("doc_id", "text", F.lit(1).alias("n"))
    weights = K.doc_weights(d, settle(K.fit_tfidf(d, ["doc_id"])), ["doc_id"])
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert norms and all(r.s == pytest.approx(1.0) for r in norms)


def test_repeated_texts_count_as_often_as_they_occur(spark):
    rows = [dict(event_id=i, actor1="Police", actor2="Crowd" if i % 3 else "Senate", location="Ohio") for i in range(30)]
    ev = events(spark, rows)
    vocabulary = K.event_vocabulary(ev)
    police = vocabulary.where("term = 'police'").first()
    assert (police.df, police.total_tf) == (30, 30)
    assert K.event_texts(ev).count() == 2


def slow_chunks(text, size=500, overlap=80):
    text = " ".join(text.split())
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            cut = text.rfind(". ", start + size - 120, stop)
            stop = cut + 2 if cut >= 0 else stop
        if len(text[start:stop].strip()) >= 80:
            out.append(text[start:stop].strip())
        start = stop - overlap if stop - overlap > start else start + max(1, size - overlap)
    return out


@pytest.mark.parametrize("text", ["", "x" * 79, "x" * 80, "x" * 500, "x" * 501, "y" * 390 + ". " + "z" * 400,
                                  "y" * 300 + ". " + "z" * 400, "a b  c\n" * 300, "w. " * 700])
def test_chunks(spark, text):
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    got = V.chunk(df).orderBy("chunk_idx").collect()
    assert [r.text for r in got] == slow_chunks(text)
    assert [r.chunk_idx for r in got] == list(range(len(got)))


@pytest.mark.parametrize("size, overlap", [(500, 0), (500, 1), (300, 200), (200, 150), (120, 119)])
def test_chunks_of_other_sizes(spark, size, overlap):
    texts = ["word. " * 90 + "x" * 700 + ". end " * 60, "y" * 1000, "é😀. " * 300, "short. " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {}
    for r in V.chunk(df, size=size, overlap=overlap).orderBy("id", "chunk_idx").collect():
        got.setdefault(r.id, []).append(r.text)
    assert [got.get(i, []) for i in range(len(texts))] == [slow_chunks(t, size, overlap) for t in texts]


def test_chunks_of_a_long_text(spark):
    text = "A sentence of some length, number nine. " * 100_000  # 4 MB: far too long for cuts that copy a list
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    assert [r.text for r in V.chunk(df).orderBy("chunk_idx").collect()] == slow_chunks(text)


def test_page_text():
    long = "This paragraph is certainly longer than forty characters."
    assert V.page_text(f"<p>{long}</p><nav><p>{long}</p></nav><p>short</p>") == long
    assert V.page_text(f"<script>var a='<p>{long}</p>'</script><p>A &amp; B <b>{long}</b><br>end</p>") == f"A & B {long} end"
    assert V.page_text(f"<p>{long}<p>{long}") == f"{long} {long} {long}"  # the open one holds the next
    assert V.page_text("") == "" and V.page_text(None) == ""


def test_jvm_reader_ends_paragraphs_as_html_does(spark):
    long = "This paragraph is certainly longer than forty characters."
    pages = [
        (f"<p>{long}</p><nav><p>{long}</p></nav><p>short</p>", long),
        (f"<script>var a='<p>{long}</p>'</script><P class=x>A &amp; B <b>{long}</b><br>end</P>", f"A & B {long} end"),
        (f"<p>{long}<p>{long}", f"{long} {long}"),
        (f"<p>{long}<div>not this, which is also long enough to be a paragraph</div><pre>nor {long}</pre>", long),
        (f"<p>{long} open to the end", f"{long} open to the end"),
        (f"<!-- <p>{long}</p> --><p>&#65;&#x2014;&#38;lt; &#55296; &#12 &quot;{long}&quot;", f'A—&lt; � &#12 "{long}"'),
        ("", ""), (None, "")]
    df = spark.createDataFrame([(i, "u", html) for i, (html, _) in enumerate(pages)], "page_id bigint, url string, html string")
    assert [r.text for r in V.read_pages(df).orderBy("page_id").collect()] == [text for _, text in pages]


def test_only_wanted_pages_are_read(spark):
    html = f"<p>{'w' * 200}</p>"
    df = spark.createDataFrame([(2, "a", html), (1, "a", f"<p>{'v' * 200}</p>"), (3, "b", html), (4, None, html)],
                               "page_id bigint, url string, html string")
    wanted = settle(df.where("url = 'a'").select(V.url_key(F.col("url")).alias("url_key")).distinct())
    seen = []

    def read(pages):
        seen.append([r.page_id for r in pages.collect()])
        return V.read_pages(pages)

    assert [r.text for r in V.page_store(df, wanted, read).collect()] == ["v" * 200]
    assert seen == [[1]]


def test_context_block_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, i, "d.com", "u", 0.5, "t" * n) for i, n in ((1, 100), (2, 5000), (3, 10))]
    df = spark.createDataFrame(rows, "k int, rank int, domain string, source_url string, score double, text string")
    out = V.context_block(df, ["k"]).first()
    assert out.n_passages == 1 and out.context.startswith("[Source: d.com | Relevance: 0.50]\n\"ttt")


def vectors(spark, n, seed=1, name="vec_id"):
    m = np.random.default_rng(seed).normal(size=(n, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], f"{name} bigint, embedding array<double>")


@pytest.mark.parametrize("blocks", [False, True])
def test_search_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(V, "MAX_QUERIES", 3)
        monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    m, df = vectors(spark, 210)
    q, qdf = vectors(spark, 7, seed=2, name="query_id")
    q[0] = m[5]
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(7)], "query_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in V.search(df, qdf, 4).collect()}
    sims = np.round(q @ m.T, 6)
    for i in range(7):
        best = sorted(range(210), key=lambda j: (-sims[i, j], j))[:4]
        assert [got[(i, k + 1)][0] for k in range(4)] == best
    assert got[(0, 1)] == (5, 1.0) and len(got) == 28


def test_search_asks_for_more_than_there_is(spark):
    _, df = vectors(spark, 3)
    _, q = vectors(spark, 2, name="query_id")
    assert V.search(df, q, 10).count() == 6


def test_urls_of_a_spike(spark):
    rows = [dict(event_id=1, source_url="http://a.com/1", quad_class=1, num_mentions=99), dict(event_id=2, source_url="http://b.com/2", num_mentions=1),
            dict(event_id=3, source_url="http://a.com/1", quad_class=4, num_mentions=5), dict(event_id=4, source_url="http://www.wsj.com/z"),
            dict(event_id=5, source_url=None), dict(event_id=6, source_url="http://c.com/3", quad_class=2, num_mentions=7)]
    ev = events(spark, rows)
    bursts = ev.select("day", "country").distinct().withColumn("is_burst", F.lit(True))
    got = [r.source_url for r in V.spike_urls(ev, bursts, 3).orderBy("rank").collect()]
    assert got == ["http://a.com/1", "http://b.com/2", "http://c.com/3"]


def test_word_vectors_follow_their_definition(spark):
    texts = ["alpha beta beta gamma", "beta", "", None, "the of and", "delta Alpha 9 x", "beta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    model = V.fit_embedder(docs, dim=16)
    kept = [[w for w in (t or "").lower().split() if w in ("alpha", "beta", "gamma", "delta")] for t in texts]
    df = np.zeros(16)
    for words in kept:
        df[[p for p in {V.word_place(w, 16)[0] for w in words}]] += 1
    assert model == pytest.approx(np.log(8 / (df + 1)))
    for row in V.embed(docs, model).collect():
        want = np.zeros(16)
        for w in kept[row.doc_id]:
            at, sign = V.word_place(w, 16)
            want[at] += sign * model[at]
        norm = np.sqrt((want**2).sum())
        assert row.embedding == pytest.approx(want / norm if norm else want, abs=1e-6)
    at, sign = V.word_place("beta", 1024)
    digest = hashlib.md5(b"beta").hexdigest()
    assert (at, sign) == (int(digest[:8], 16) % 1024, 1.0 if digest[8] < "8" else -1.0)


def test_python_holds_a_bounded_part_of_a_batch():
    import pyarrow as pa

    lists = pa.array([["a", "b"]] * 5 + [[]] + [["a"] * 250_000] + [["c"] * 90_000] * 4)
    parts = list(V._slices(lists))
    assert sum(len(p) for p in parts) == len(lists) and pa.concat_arrays(parts).equals(lists)
    assert all(len(p.flatten()) <= V.SLICE_WORDS or len(p) == 1 for p in parts) and len(parts) == 4
    at, sign, owner = V._word_places(lists.slice(0, 6), 16, {})
    assert list(zip(at, sign)) == [V.word_place(w, 16) for w in ["a", "b"] * 5] and list(owner) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_documents_are_dealt_out_once_and_terms_sorted_natively(spark):
    docs = spark.sql("select id as doc_id, 'en' as lang, 1 as n, 'Red fox, red\\t\\u00a0FOX 7 dog-house' as text from range(40)")
    vocabulary = spark.sql("select 'fox' as term, 1e0 as idf")
    weights = K.doc_weights(K.spread(docs, "doc_id"), vocabulary, ["lang", "doc_id"])
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "sort_array(" in plan and "array_sort(" not in plan
    got = {(r.term, r.tf) for r in K.term_counts(docs.where("doc_id = 0"), ["doc_id"]).collect()}
    assert got == {("red", 2), ("fox", 2), ("dog", 1), ("house", 1), ("red fox", 2), ("fox red", 1), ("fox dog", 1), ("dog house", 1)}
