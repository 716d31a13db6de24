"""Text evidence: from stored pages to passages, vectors and search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import attach, packed, pin, settle, top_k
from .bursts import burst_days
from .keywords import tokens

KEYS = ["day", "country"]
MAX_QUERIES = 2_000        # queries sent to every task
BLOCK_ROWS = 4_000         # rows per block when there are more
DIM = 1024                 # entries of a text vector
KNOWN_WORDS = 200_000      # words whose entry a batch remembers
SLICE_WORDS = 200_000      # words of an Arrow batch that Python holds at a time
SLICE_ROWS = 1_000         # vectors of an Arrow batch that Python holds at a time


# --- sources of a spike ------------------------------------------------------

def spike_urls(events: DataFrame, bursts: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` distinct source URLs of every spike: conflict first, then most mentioned.

    Each URL keeps its best event (a grouped minimum), so hot days shrink before ranking.
    """
    on_spike = attach(
        events.where(F.col("source_url").isNotNull()), burst_days(bursts), KEYS, "left_semi", spread=["event_id"])
    conflict = F.coalesce(F.col("quad_class") >= 3, F.lit(False)).cast("int")
    # conflict first: mentions are far below 10**12
    best = F.min(packed(F.coalesce(-F.col("num_mentions"), F.lit(1)) - conflict * F.lit(10**12), F.col("event_id")))
    urls = on_spike.groupBy(*KEYS, "source_url").agg(best.alias("b")).where(~X.is_blocked(F.col("source_url")))
    return top_k(urls, KEYS, [F.col("b")], n).select(*KEYS, "rank", "source_url")


def url_key(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 16)


def page_store(pages: DataFrame, keys: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Text per wanted ``url_key`` of ``keys``; the lowest page id when a URL was stored twice.

    Pages are cut down to the wanted ones by key alone, and only these are parsed by ``read``.
    """
    keyed = pages.withColumn("url_key", url_key(F.col("url")))
    held = attach(keyed.select("url_key", "page_id"), keys, ["url_key"], "left_semi", spread=["page_id"])
    first = settle(held.groupBy("url_key").agg(F.min("page_id").alias("page_id")))
    wanted = attach(keyed, first, ["url_key", "page_id"], "left_semi", spread=["page_id"])
    return read(wanted.select("page_id", "url", "html")).select(
        url_key(F.col("url")).alias("url_key"), clean_article(F.col("text")).alias("text"))


def spike_articles(urls: DataFrame, pages: DataFrame, attempts: int = C.MAX_ARTICLES,
                   read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Texts of the first ``attempts`` URLs of each spike that are long enough."""
    tried = settle(urls.where(F.col("rank") <= attempts).withColumn("url_key", url_key(F.col("source_url"))))
    store = page_store(pages, settle(tried.select("url_key").distinct()), read or read_pages)
    return (
        tried.join(store, "url_key").where(F.length("text") >= C.MIN_ARTICLE_CHARS)
        .select(*KEYS, "rank", "source_url", X.article_domain(F.col("source_url")).alias("domain"), "text")
    )


# --- text of a page ----------------------------------------------------------

class _Paragraphs(HTMLParser):
    """Collects the text of every <p>, nested ones into their parents as well."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list | None]] = []
        self.hidden = 0
        self.found: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.hidden += tag in C.DROPPED_TAGS
        bucket = None
        if tag == "p" and not self.hidden:
            bucket = []
            self.found.append(bucket)
        self.open.append((tag, bucket))

    def handle_endtag(self, tag):
        if not any(name == tag for name, _ in self.open):
            return
        while self.open:
            name, _ = self.open.pop()
            self.hidden -= name in C.DROPPED_TAGS
            if name == tag:
                break

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.hidden:
            for _, bucket in self.open:
                if bucket is not None:
                    bucket.append(piece)


def page_text(html: str) -> str:
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    texts = (" ".join(parts) for parts in parser.found)
    return " ".join(t for t in texts if len(t) > C.MIN_PARAGRAPH_CHARS)


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each page by a tolerant parser (Arrow batches, one small helper per row)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": pdf["html"].map(page_text)})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string")


def paragraphs_native(html: Column) -> Column:
    """Texts of paragraphs longer than the minimum, by regular expressions inside the JVM.

    As in HTML, a paragraph ends at its end tag, at the next paragraph or at any block element, so an open one is kept
    and none is listed twice. Character references are decoded after tags are gone.
    """
    for tag in C.DROPPED_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    html = F.translate(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), "\x01", " ")
    parts = F.split(F.regexp_replace(html, r"(?i)<p(?:\s[^>]*)?/?>", "\x01"), "\x01")
    ends = rf"(?is)</?(?:{'|'.join(C.BLOCK_TAGS)})(?:\s[^>]*)?/?>.*\z"
    inside = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.regexp_replace(p, ends, ""))
    plain = F.transform(inside, lambda p: F.trim(F.regexp_replace(unescaped(F.regexp_replace(p, r"<[^>]*>", " ")), r"\s+", " ")))
    return F.coalesce(F.array_join(F.filter(plain, lambda p: F.length(p) > C.MIN_PARAGRAPH_CHARS), " "), F.lit(""))


def unescaped(text: Column) -> Column:
    """Numeric and common named character references as characters; numbers of no character become U+FFFD."""

    def one(rest: Column) -> Column:
        number = F.lower(F.regexp_extract(rest, r"(?i)^(x[0-9a-f]{1,6}|[0-9]{1,7});", 1))
        code = F.when(F.startswith(number, F.lit("x")), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        # an ampersand waits for the named ones, so that it begins none of them
        char = F.when(code == 38, F.lit("&amp;")).when(
            valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
        return F.when(number == "", F.concat(F.lit("&#"), rest)).otherwise(
            F.concat(char, F.substr(rest, F.length(number) + 2)))

    parts = F.split(text, "&#")
    text = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    for name, char in (*C.CHARACTER_REFERENCES, ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def read_pages(pages: DataFrame) -> DataFrame:
    """Main text of each page by the JVM reader."""
    return pages.select("page_id", "url", paragraphs_native(F.col("html")).alias("text"))


def clean_article(text: Column, max_chars: int | None = None) -> Column:
    """Single spaces, printable ASCII only. Whole texts unless ``max_chars`` is given."""
    one_line = F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), r" {2,}", " ")
    plain = F.trim(F.regexp_replace(one_line, r"[^\x20-\x7E]", " "))
    return plain if max_chars is None else F.substring(plain, 1, max_chars)


# --- passages ----------------------------------------------------------------

def _piece_pattern(size: int, overlap: int, lookback: int) -> str:
    """Pattern whose matches step from piece to piece; group 1 is the piece, seen ahead of the step.

    A greedy count finds the last ". " near the end of a piece, and the step beside it counts alike, so it ends
    ``overlap`` before the same place. Cases in this order: more text and a sentence end, more text, the rest.
    """
    more, low, stride = f"(?=.{{{size + 1}}})", max(0, size - lookback), max(1, size - overlap)
    steps, far = [], max(low + 2, overlap + 1)  # the shortest piece that is longer than its overlap
    if far <= size and overlap >= 2:
        steps.append(more + rf".{{{far - overlap},{size - overlap}}}(?=.{{{overlap - 2}}}\. )")
    elif far <= size:
        steps.append(more + rf".{{{far - 2},{size - 2}}}" + (r"\.(?= )" if overlap else r"\. "))
    if low + 2 <= min(overlap, size):
        steps.append(more + rf"(?=.{{{low},{min(overlap, size) - 2}}}\. ).{{{stride}}}")
    steps += [f"{more}.{{{stride}}}", rf".{{1,{size}}}(?=.{{{overlap}}}\z)", f".{{1,{stride}}}"]
    pieces = ([rf"{more}.{{{low},{size - 2}}}\. "] if low + 2 <= size else []) + [f".{{1,{size}}}"]
    return f"(?s)(?=({'|'.join(pieces)}))(?:{'|'.join(steps)})"


def chunk(docs: DataFrame, text: str = "text", size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping pieces of each text as ``(chunk_idx, text)`` rows with all other columns repeated.

    A piece ends after the last ". " near its end when there is one. Each cut depends on the one before; one pass of a
    pattern makes them all, so a text costs time and memory by its length, however long it is.
    """
    others = [c for c in docs.columns if c != text]
    flat = pin(docs.select(*others, F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")).alias("_flat")))
    pattern = F.lit(_piece_pattern(size, overlap, C.CHUNK_LOOKBACK))
    pieces = F.transform(F.regexp_extract_all("_flat", pattern, F.lit(1)), lambda p: F.trim(p))
    pieces = F.filter(pieces, lambda p: F.length(p) >= C.MIN_CHUNK_CHARS)
    return flat.select(*others, F.inline(F.transform(pieces, lambda p, i: F.struct(i.alias("chunk_idx"), p.alias(text)))))


def fixed_chunks(docs: DataFrame, text: str = "text", size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Like :func:`chunk` with a fixed stride, without looking for sentence ends; inside the JVM.

    The flattened text is a column of its own, so it is made once and not once per piece.
    """
    others = [c for c in docs.columns if c != text]
    flat = docs.withColumn("_flat", F.trim(F.regexp_replace(text, r"\s+", " "))).drop(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length("_flat") - 1, F.lit(0)), F.lit(size - overlap))
    pieces = F.transform(starts, lambda s, i: F.struct(
        i.alias("chunk_idx"), F.trim(F.substring("_flat", s + 1, F.lit(size))).alias(text)))
    return flat.select(*others, F.inline(pieces)).where(F.length(text) >= C.MIN_CHUNK_CHARS)


# --- vectors -----------------------------------------------------------------

def word_place(word: str, dim: int) -> tuple[int, float]:
    """Entry and sign of a word, from the digits of its md5: the same on every engine."""
    digest = md5(word.encode(), usedforsecurity=False).digest()
    return int.from_bytes(digest[:4], "big") % dim, 1.0 if digest[4] < 128 else -1.0


def _placed(words, dim: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Entries and signs of a list of words; ``known`` remembers them, up to a bound."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    out = []
    for w in words:
        place = known.get(w)
        if place is None:
            place = known[w] = word_place(w, dim)
        out.append(place)
    places = np.array(out, float).reshape(-1, 2)
    return places[:, 0].astype(int), places[:, 1]


def _slices(lists: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows with at most ``SLICE_WORDS`` words; a longer row stands alone."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
        yield lists.slice(start, stop - start)
        start = stop


def _word_places(lists: pa.Array, dim: int, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, sign and row of every word; Python sees the different words of the rows only."""
    coded = lists.flatten().dictionary_encode()
    at, sign = _placed(coded.dictionary.to_pylist(), dim, known)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return at[codes], sign[codes], owner


def fit_embedder(docs: DataFrame, text: str = "text", dim: int = DIM) -> np.ndarray:
    """Weight of each vector entry: ln((N + 1) / (df + 1)) over documents that have a word there.

    Documents are counted where they lie; what is merged are ``dim`` counts per task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, known = np.zeros(dim, np.int64), 0, {}
        for batch in batches:
            n += batch.num_rows
            for words in _slices(batch.column(0)):
                at, _, owner = _word_places(words, dim, known)
                df += np.bincount(np.unique(owner * dim + at) % dim, minlength=dim)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array(np.append(n, df))], ["i", "n"])

    rows = docs.select(tokens(F.coalesce(text, F.lit(""))).alias("_words")).mapInArrow(count, "i int, n bigint")
    total = np.zeros(dim + 1, np.int64)
    for r in rows.groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r.i + 1] = r.n
    return np.log((total[0] + 1.0) / (total[1:] + 1.0))


def embed(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``embedding``: signed counts of hashed words, weighted, as a unit vector (zeros for no words)."""
    def vectors(column: pa.Array) -> pa.Array:
        known: dict = {}
        out = [np.zeros(0, np.float32)]
        for words in _slices(column):
            at, sign, owner = _word_places(words, len(model), known)
            ends = np.searchsorted(owner, np.arange(1, len(words)))
            for own_at, own_sign in zip(np.split(at, ends), np.split(sign, ends), strict=True):
                v = np.bincount(own_at, weights=own_sign, minlength=len(model)) * model
                norm = np.sqrt((v * v).sum())
                out.append((v / norm if norm else v).astype(np.float32))
        offsets = np.arange(len(column) + 1, dtype=np.int32) * len(model)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))

    made = F.arrow_udf(vectors, ArrayType(FloatType()))
    return docs.withColumn("embedding", made(tokens(F.coalesce(text, F.lit("")))))


def embed_with(docs: DataFrame, make_predict, text: str = "text", batch_size: int = 64) -> DataFrame:
    """Hook for a real encoder: ``make_predict()`` returns a function from texts to vectors."""
    from pyspark.ml.functions import predict_batch_udf

    encoder = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return docs.withColumn("embedding", encoder(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Unit vector in the mean direction of each group, as ``(query_id, embedding)``."""
    means = (
        vectors.select(group, F.posexplode("embedding").alias("i", "v")).groupBy(group, "i")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])  # one entry per dimension
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x * x))
    return means.groupBy(group).agg(listed.alias("e")).select(
        F.col(group).cast("bigint").alias("query_id"), F.transform("e", lambda x: x / norm).alias("embedding"))


def _leaders(ids, row, k: int):
    """Ids and scores of the best ``k`` of one query; equal scores by id."""
    at = np.arange(len(row))
    if len(row) > k:
        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
    at = at[np.lexsort((ids[at], -row[at]))[:k]]
    return ids[at], row[at]


def _block_leaders(ids, vectors, queries, k: int) -> list:
    return [_leaders(ids, row, k) for row in np.round(queries @ vectors.T, 6)]


def _ranked_frame(query_ids, best: list) -> pd.DataFrame:
    sizes = [len(ids) for ids, _ in best]
    return pd.DataFrame({"query_id": np.repeat(query_ids, sizes), "vec_id": np.concatenate([ids for ids, _ in best]),
                         "score": np.concatenate([scores for _, scores in best])})


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top ``k`` of ``vectors (vec_id, embedding)`` for each of
    ``queries (query_id, embedding)``, both bigint ids and unit vectors.

    A counted, small query set goes to every task, where each Arrow batch becomes one
    matrix product; a partition keeps a running best ``k`` per query and puts it out once.
    More queries are cut into blocks that meet the vector blocks in a cogroup, each of
    bounded size.
    """
    schema = "query_id bigint, vec_id bigint, score double"
    n_queries = queries.count()
    if n_queries <= MAX_QUERIES:
        held = queries.select("query_id", "embedding").toPandas()
        query_ids = held["query_id"].to_numpy()
        matrix = np.array(held["embedding"].tolist(), dtype="float64").reshape(len(held), -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for part in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
                if len(query_ids):
                    block = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                    block = block.astype("float64").reshape(part.num_rows, -1)
                    new = _block_leaders(part.column("vec_id").to_numpy(zero_copy_only=False), block, matrix, k)
                    best = new if best is None else [
                        _leaders(np.append(a, c), np.append(b, d), k) for (a, b), (c, d) in zip(best, new)]
            if best is not None:
                yield pa.RecordBatch.from_pandas(_ranked_frame(query_ids, best), preserve_index=False)

        partial = vectors.select("vec_id", "embedding").mapInArrow(run, schema)
    else:
        partial = _block_search(vectors, queries, n_queries, k, schema)
    return top_k(partial, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def _block_search(vectors, queries, n_queries, k, schema) -> DataFrame:
    vb = max(1, -(-vectors.count() // BLOCK_ROWS))
    qb = max(1, -(-n_queries // BLOCK_ROWS))

    def blocks(df, id_col, own, n_own, other, n_other):
        return df.select(
            id_col, "embedding", F.pmod(F.xxhash64(id_col), F.lit(n_own)).alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        stack = lambda s: np.array(s.tolist(), dtype="float64")
        best = _block_leaders(v["vec_id"].to_numpy(), stack(v["embedding"]), stack(q["embedding"]), k)
        return _ranked_frame(q["query_id"].to_numpy(), best)

    left = blocks(vectors, "vec_id", "_v", vb, "_q", qb).groupBy("_v", "_q")
    right = blocks(queries, "query_id", "_q", qb, "_v", vb).groupBy("_v", "_q")
    return left.cogroup(right).applyInPandas(run, schema)


def search_within(vectors: DataFrame, queries: DataFrame, keys, k: int = C.EVIDENCE_TOP_K, ids=("chunk_idx",)) -> DataFrame:
    """Top ``k`` among the passages that share ``keys`` with the query (one query per key).

    Only the passages of a query's own key are compared, so nothing is crossed.
    """
    q = queries.select(*keys, F.col("embedding").alias("_q"))
    scored = vectors.join(q, list(keys)).withColumn("score", X.np_round(cosine(F.col("embedding"), F.col("_q")), 6))
    return top_k(scored.drop("embedding", "_q"), list(keys), [F.desc("score"), *[F.col(i) for i in ids]], k)


def context_block(passages: DataFrame, keys, max_chars: int = C.CONTEXT_CHARS) -> DataFrame:
    """Passages of each key in rank order as one text, up to the first that does not fit."""
    keys = list(keys)
    domain = F.when(F.coalesce("domain", F.lit("")) != "", F.col("domain")).otherwise(F.substring("source_url", 1, 40))
    entry = F.concat(F.lit("[Source: "), domain, F.lit(" | Relevance: "), X.fixed(F.col("score"), 2), F.lit(']\n"'),
                     X.strip(F.col("text")), F.lit('"\n'))
    running = F.sum(F.length("entry")).over(Window.partitionBy(*keys).orderBy("rank"))
    fits = passages.withColumn("entry", entry).withColumn("used", running).where(F.col("used") <= max_chars)
    # bounded: entries that fit into max_chars
    return fits.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda s: s["entry"]), "\n")
        .alias("context"),
        F.count(F.lit(1)).alias("n_passages"))


def one_per_domain(passages: DataFrame, keys) -> DataFrame:
    """The best passage of each domain, in rank order."""
    w = Window.partitionBy(*keys, "domain").orderBy("rank")
    out = Window.partitionBy(*keys).orderBy("rank")
    return (
        passages.where(F.coalesce("source_url", F.lit("")) != "").withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") == 1).drop("_n").withColumn("position", F.row_number().over(out))
    )


def spike_queries(bursts: DataFrame) -> DataFrame:
    """One search text per spike."""
    return burst_days(bursts).withColumn(
        "text", F.concat_ws(" ", F.lit("geopolitical events"), "country", F.date_format("day", "yyyy-MM-dd")))


def passage_arrays(passages: DataFrame, keys=KEYS) -> DataFrame:
    """Per key the passages (at most top-k) as one array in rank order."""
    item = F.struct("rank", "domain", "source_url", "score", "text")
    listed = F.array_sort(F.collect_list(item))
    return passages.groupBy(*keys).agg(
        F.transform(listed, lambda s: F.struct(s["domain"].alias("domain"), s["source_url"].alias("source_url"),
                                               s["score"].cast("double").alias("score"), s["text"].alias("text")))
        .alias("passages"))


def leading_domains(passages: DataFrame, keys=KEYS, n: int = 3) -> DataFrame:
    """Distinct domains of the first four passages, best first."""
    best = passages.where((F.col("rank") <= 4) & (F.col("domain") != "")).groupBy(*keys, "domain").agg(
        F.min("rank").alias("r"))
    return best.groupBy(*keys).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", "domain"))), lambda s: s["domain"]), 1, n)
        .alias("domains"))
