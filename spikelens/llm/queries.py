"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_array_dedup(spark, sf_dir):
    """Bytes covered by 200-byte strings that start anywhere else, cut out of every document."""
    from .suffix_dedup import dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, keep="none").select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@query
def op2_substring_dedup(spark, sf_dir):
    """Words covered by windows of 35 words that start anywhere else, cut out of every document."""
    from .substring_dedup import dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, keep="none").select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", "kept_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), limit=4096, end=1)


@query
def op4_license_scan(spark, sf_dir):
    """License phrases and templates in every document."""
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))




@query
def op6_consistent_hash_ring(spark, sf_dir):
    """All documents on 8 shards, counts at most one apart."""
    from .ring import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), shards=8)


@query
def op7_one_permutation_minhash(spark, sf_dir):
    """Fingerprints of all documents and of their edited forms."""
    from .fingerprints import edited

    return edited(table(spark, sf_dir, "documents"))


@query
def op8_circulant_minhash(spark, sf_dir):
    """Near-duplicate components of all documents on 2-word shingles."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query
def op9_toxicity_crf(spark, sf_dir):
    """Toxicity scores of all documents, learnt from the labels of four fifths of the labelled ones."""
    from .toxicity import fit, sample, score

    docs = table(spark, sf_dir, "documents")
    model = fit(*sample(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model, keep=("doc_id",)).select(
        "doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


@query
def op10_benchmark_decontamination(spark, sf_dir):
    """Documents that hold test items, whole or edited, with the aligned words and the score."""
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_url_association_rules(spark, sf_dir):
    """Verdicts on all pages' urls by rules, and by mined association rules where none fits."""
    from .url_rules import judge

    return judge(table(spark, sf_dir, "pages"))


@query
def op12_token_alignment(spark, sf_dir):
    """Tokens of two tokenizers aligned in every document, with how common its linked pairs are."""
    import public_tokenizers

    from .token_align import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_tree_search(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    from .tree_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE["op11_tree_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    b AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_words FROM d WHERE len(words) > 0),
    t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
        FROM t, total GROUP BY term),
    scored AS (SELECT b.q, b.item_id, t.r, d.doc_id, sum(w.weight * ((1000000000 * t.tf) //
            (1000 * t.tf + 8 * (100 - 75 + (75 * len(d.words) * total.n_docs) // total.n_words))))::BIGINT AS score
        FROM b JOIN t ON b.term = t.term JOIN w ON w.term = t.term JOIN d ON d.r = t.r, total
        GROUP BY b.q, b.item_id, t.r, d.doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_byte_cnn(spark, sf_dir):
    """Quality scores of all documents, learnt from the labels of three quarters of the labelled ones."""
    from .byte_cnn import fit, fold, score

    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select(
        "doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
