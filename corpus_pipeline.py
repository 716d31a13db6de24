"""Text preparation as one job: toxic documents out, near copies out, repeated passages cut, benchmark leaks out, packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``. Nulls and empty texts pass the first four
stages and are packed as one end token each; an empty table gives no rows; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spikelens.llm import decontam, near_dedup, packing, substring_dedup, toxicity
from spikelens.llm.common import file_count, stored, table
from spikelens.llm.queries import tokenizer_path


def few_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` in as many parts as suit the number of documents: each part becomes a file of the stage."""
    return out.coalesce(file_count(docs.count(), docs.sparkSession))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a field learnt from the labelled ones among them."""
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, with_spans=False, name="__toxic")
    return few_files(scored.where(F.col("__toxic_score") < 0.5).select(*docs.columns), docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return few_files(near_dedup.survivors(docs).select(*docs.columns), docs)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows of 35 words that start anywhere else are cut out; n_chars follows the text."""
    cut = substring_dedup.dedup(docs, keep="none", with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return few_files(out.select(*docs.columns), docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, neither whole nor edited."""
    return few_files(decontam.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with the sequences that hold them."""
    return few_files(packing.pack(docs, tokenizer_path(), limit=4096, end=1), docs)


STAGES = [
    ("toxicity", toxic_out), ("near_dedup", near_copies_out), ("substring_dedup", passages_out),
    ("decontamination", leaks_out), ("packing", packed),
]

#: Trained models and tokenizers have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
