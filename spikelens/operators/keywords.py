"""TF-IDF keywords.

Documents are (group columns, ``text``, ``n``): a text and how many documents carry
it. Event texts are put together from few distinct parts, so equal texts are counted
first and everything after that works on distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import attach, settle
from .bursts import burst_days, mark_bursts


def tokens(text: Column, country: Column | None = None) -> Column:
    """Lower-case words of two or more ASCII letters that are not stopwords."""
    words = F.split(F.lower(text), r"[^a-z]+")

    def keep(word: Column) -> Column:
        ok = (F.length(word) > 1) & ~word.isin(*C.STOPWORDS)
        if country is not None:
            for name, extra in C.COUNTRY_STOPWORDS.items():
                ok = ok & ~(F.coalesce(country == name, F.lit(False)) & word.isin(*extra))
        return ok

    return F.filter(words, keep)


def clean_text(text: Column, country: Column | None = None) -> Column:
    return F.array_join(tokens(text, country), " ")


def ngrams(words: Column) -> Column:
    """Single words and pairs of neighbours (after stopword removal)."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def event_texts(events: DataFrame, *groups: str) -> DataFrame:
    """Distinct event texts per group with their counts."""
    return events.groupBy(*groups, F.col("text_for_tfidf").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def spread(docs: DataFrame, *keys: str) -> DataFrame:
    """Whole documents dealt out by their keys: cutting them into terms costs far more than reading them, and a stored
    table has only as many tasks as row groups. Sums per document then need no further shuffle."""
    return docs.repartition(*keys)


def term_counts(docs: DataFrame, keys, country: Column | None = None, pairs: bool = True) -> DataFrame:
    """Occurrences of each term in each document. ``keys`` identify a document.

    Counted inside the row: the terms are sorted and cut where one differs from the one before, so no row of a document
    meets another and nothing is shuffled. Each step is a column made once, by a generator that no projection merges
    with the next; the keys stand outside of it, so documents already hashed on them stay so. ``sort_array`` compares
    texts natively, ``array_sort`` would call a lambda for every two terms.
    """
    rest = [*keys, "n", "n_words"]
    words = docs.select(*keys, "n", F.inline(F.array(F.struct(tokens(F.col("text"), country).alias("_words")))))
    words = words.withColumn("n_words", F.size("_words"))
    terms = ngrams(F.col("_words")) if pairs else F.col("_words")
    words = words.select(*rest, F.inline(F.array(F.struct(F.sort_array(terms).alias("_terms")))))
    first = F.transform("_terms", lambda t, i: F.when((i == 0) | (t != F.get("_terms", i - 1)), i))
    words = words.select(*rest, "_terms", F.inline(F.array(F.struct(F.array_compact(first).alias("_first")))))
    runs = F.transform("_first", lambda at, i: F.struct(
        F.get("_terms", at).alias("term"),
        (F.coalesce(F.get("_first", i + 1), F.size("_terms")) - at).cast("bigint").alias("tf")))
    return words.select(*rest, F.inline(runs))


def fit_tfidf(
    docs: DataFrame,
    keys=("text",),
    max_features: int = C.TFIDF_MAX_FEATURES,
    min_df: int = C.TFIDF_MIN_DF,
) -> DataFrame:
    """Vocabulary ``(term, df, total_tf, idf)``: the most frequent terms found in
    at least ``min_df`` documents, the first by name on ties."""
    counts = term_counts(docs, keys)
    n_docs = docs.agg(F.sum("n")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.sum("n").alias("df"), F.sum(F.col("n") * F.col("tf")).alias("total_tf"))
        .where(F.col("df") >= min_df)
        .orderBy(F.desc("total_tf"), "term")
        .limit(max_features)
        .withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    )


def fit_relative(docs: DataFrame, keys=("text",), max_features: int = 500, min_df: int = 2) -> DataFrame:
    """Vocabulary of single words for :func:`relative_keywords`, the most widespread first."""
    counts = term_counts(docs, keys, pairs=False)
    n_docs = docs.agg(F.sum("n")).scalar()
    return (
        counts.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
        .orderBy(F.desc("df"), "term").limit(max_features)
        .withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    )


def doc_weights(docs: DataFrame, vocabulary: DataFrame, keys=("text",), country: Column | None = None) -> DataFrame:
    """Unit-length weights ``(keys, n, term, weight)`` with damped term counts.

    The vocabulary is limited to ``max_features`` rows, hence the broadcast.
    """
    counts = term_counts(docs, keys, country)
    raw = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn(
        "w", (1.0 + F.log("tf")) * F.col("idf"))
    per_doc = raw.groupBy(*keys, "n").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("terms"))
    return per_doc.select(*keys, "n", "norm", F.explode("terms").alias("t")).select(
        *keys, "n", F.col("t.term").alias("term"), (F.col("t.w") / F.col("norm")).alias("weight"))


def _ranked(sums: DataFrame, docs: DataFrame, groups, top_n: int) -> DataFrame:
    sizes = docs.groupBy(*groups).agg(F.sum("n").alias("n_docs"))
    if groups:
        joined = sums.join(sizes, list(groups))
    else:
        joined = sums.withColumn("n_docs", sizes.scalar())
    score = F.col("total") / F.col("n_docs")
    w = Window.partitionBy(*groups).orderBy(F.desc(X.np_round(F.col("mean"), 10)), "term")
    return (
        joined.withColumn("mean", score)
        .withColumn("rank", F.row_number().over(w))
        .where((F.col("rank") <= top_n) & (F.col("mean") > 0))
        .select(*groups, "rank", F.col("term").alias("keyword"), X.np_round(F.col("mean"), 5).alias("score"))
    )


def top_keywords(
    docs: DataFrame, vocabulary: DataFrame, groups=(), top_n: int = 15, keys=("text",), country: Column | None = None
) -> DataFrame:
    """Best terms of each group by mean weight; every document counts, empty ones too.

    Scores are ranked at ten decimals and ties go to the first term by name.
    """
    weights = doc_weights(docs, vocabulary, [*groups, *keys], country)
    sums = weights.groupBy(*groups, "term").agg(F.sum(F.col("n") * F.col("weight")).alias("total"))
    return _ranked(sums, docs, groups, top_n)


def relative_keywords(docs: DataFrame, vocabulary: DataFrame, groups=(), top_n: int = 15, keys=("text",)) -> DataFrame:
    """Variant without damping or unit length: share of the document's words times idf."""
    counts = term_counts(docs, [*groups, *keys], pairs=False)
    sums = (
        counts.join(F.broadcast(vocabulary.select("term", "idf")), "term")
        .groupBy(*groups, "term")
        .agg(F.sum(F.col("n") * F.col("tf") / F.col("n_words") * F.col("idf")).alias("total"))
    )
    return _ranked(sums, docs, groups, top_n)


def event_vocabulary(events: DataFrame, **options) -> DataFrame:
    """Fitted vocabulary of all event texts, computed once."""
    return settle(fit_tfidf(event_texts(events), **options))


def by_country(events: DataFrame, vocabulary: DataFrame, top_n: int = 15) -> DataFrame:
    docs = event_texts(events.where(F.col("country").isNotNull()), "country")
    return top_keywords(docs, vocabulary, ["country"], top_n, country=F.col("country"))


def normal_vs_burst(events: DataFrame, bursts: DataFrame, vocabulary: DataFrame, top_n: int = 15) -> DataFrame:
    """Keywords per country on spike days and on other days."""
    marked = mark_bursts(events.where(F.col("country").isNotNull()), bursts)
    docs = event_texts(marked, "country", "on_burst")
    return top_keywords(docs, vocabulary, ["country", "on_burst"], top_n, country=F.col("country"))


def on_bursts(events: DataFrame, bursts: DataFrame, vocabulary: DataFrame, top_n: int = 15) -> DataFrame:
    """Keywords per country over its spike days."""
    docs = event_texts(_burst_events(events, bursts), "country")
    return top_keywords(docs, vocabulary, ["country"], top_n, country=F.col("country"))


def per_spike(events: DataFrame, bursts: DataFrame, vocabulary: DataFrame, top_n: int = 10) -> DataFrame:
    """Keywords of every single spike."""
    docs = event_texts(_burst_events(events, bursts), "day", "country")
    return top_keywords(docs, vocabulary, ["day", "country"], top_n, country=F.col("country"))


def _burst_events(events: DataFrame, bursts: DataFrame) -> DataFrame:
    return attach(events, burst_days(bursts), ["day", "country"], "left_semi", spread=["event_id"])


def term_deltas(compared: DataFrame) -> DataFrame:
    """Spike score minus normal score of every listed term, a missing score as zero."""
    side = lambda flag, name: compared.where(F.col("on_burst") == flag).select(
        "country", F.col("keyword").alias("term"), F.col("score").alias(name))
    zero = F.lit(0.0)
    both = side(True, "burst_score").join(side(False, "normal_score"), ["country", "term"], "full_outer")
    delta = F.coalesce("burst_score", zero) - F.coalesce("normal_score", zero)
    return both.select(
        "country", "term", F.coalesce("burst_score", zero).alias("burst_score"),
        F.coalesce("normal_score", zero).alias("normal_score"),
        X.np_round(delta, 5).alias("delta"),
    ).withColumn("direction", F.when(F.col("delta") > 0, "Higher during spikes").otherwise("Lower during spikes"))


def balanced(deltas: DataFrame, each: int = 8) -> DataFrame:
    """The lowest and the highest ``each`` deltas of a country that has more than twice as many."""
    up = Window.partitionBy("country").orderBy("delta", "term")
    all_rows = Window.partitionBy("country")
    return (
        deltas.withColumn("position", F.row_number().over(up))
        .withColumn("_n", F.count(F.lit(1)).over(all_rows))
        .where((F.col("_n") <= 2 * each) | (F.col("position") <= each) | (F.col("position") > F.col("_n") - each))
        .drop("_n")
    )


def shift_insights(view: DataFrame, overall: DataFrame) -> DataFrame:
    """One sentence per country on the terms that stand out during its spikes."""
    raised = (
        view.groupBy("country")
        .agg(F.array_sort(F.collect_list(F.when(F.col("delta") > 0, F.struct((-F.col("delta")).alias("d"), "term"))))
             .alias("r"))
        .select("country", F.transform("r", lambda s: s["term"]).alias("raised"))
    )
    leading = overall.where(F.col("rank") <= 3).groupBy("country").agg(F.collect_list("keyword").alias("leading"))
    both = raised.join(leading, "country", "left").withColumn(
        "leading", F.coalesce("leading", F.array().cast("array<string>")))
    fresh = F.filter(F.slice("raised", 1, 3), lambda t: ~F.array_contains(F.col("leading"), t))
    name = F.concat(F.lit("**"), F.col("country"), F.lit("**"))
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    text = (
        F.when(F.size("fresh") > 0, F.concat(
            F.lit("During spike periods, "), name, F.lit(" coverage shifts toward "), bold(F.get("fresh", F.lit(0))),
            F.when(F.size("fresh") > 1, F.concat(F.lit(" and "), bold(F.get("fresh", F.lit(1))))).otherwise(""),
            F.lit(" — terms not prominent in day-to-day activity, suggesting heightened geopolitical or "
                  "crisis-related coverage.")))
        .when(F.size("raised") > 0, F.concat(
            F.lit("Spike periods in "), name, F.lit(" reinforce existing patterns — "),
            bold(F.get("raised", F.lit(0))),
            F.lit(" remains the dominant theme across both normal and elevated activity days.")))
        .otherwise(F.concat(F.lit("Insufficient spike data for "), name,
                            F.lit(" to identify meaningful pattern shifts.")))
    )
    return both.withColumn("fresh", fresh).select("country", text.alias("insight"))
