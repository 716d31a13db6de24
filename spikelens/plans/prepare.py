"""The batch job: raw exports to events, spikes, keywords, lead-lag, model, evaluation, templates.

    spark-submit -m spikelens.plans.prepare RAW_FOLDER OUTPUT_FOLDER [LABEL_FILE]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import config as C
from ..functions.dist import settle
from ..operators import bursts as B, chains as CH, clean, evaluate as E, keywords as K, leadlag as L, model as M, silver
from ..session import build
from ..sources import raw_files, tables

REPORT = (
    "rows_raw bigint, invalid_dates_dropped bigint, rows_beyond_cutoff bigint, rows_outside_countries bigint, "
    "null_quad_dropped bigint, rows_outside_window bigint, rows_final bigint, date_min date, date_max date, "
    "countries map<string, bigint>, dominant_year int, duplicates_removed bigint"
)


def prepare(spark: SparkSession, raw_folder: str, out: str, label_path: str | None = None) -> dict[str, str]:
    """Run every stage, each reading the stored result of the one before. Returns the paths written."""
    paths = {name: f"{out}/{name}" for name in (
        "events", "bursts", "burst_rules", "vocabulary", "cross_country", "chain_model", "cleaning_report",
        "evaluation", "template", "silver")}

    raw = raw_files.read_folder(spark, raw_folder, with_position=True)
    watch = Observation("cleaning")
    tables.save_events(clean.clean_events(raw, watch=watch), paths["events"])
    events = tables.load_events(spark, paths["events"])
    tables.save_report(clean.observed_report(watch, events), paths["cleaning_report"])
    rules = tables.run_parameters(spark)
    tables.save_table(rules, paths["burst_rules"])
    tables.save_table(B.detect_bursts(events), paths["bursts"])
    bursts = tables.load_bursts(spark, paths["bursts"])

    tables.save_table(K.fit_tfidf(K.event_texts(events)), paths["vocabulary"])
    tables.save_report(L.pair_report(L.burst_series(bursts)), paths["cross_country"])

    if label_path:
        burst_labels, chain_labels = tables.read_labels(spark, label_path)
    else:
        made = silver.silver_labels(events, bursts)
        tables.write_labels(made.bursts, made.chains, paths["silver"])
        burst_labels, chain_labels = made.bursts, made.chains
        tables.write_labels(silver.burst_template(bursts), silver.chain_template(events), paths["template"])

    report = spark.read.schema(REPORT).json(paths["cleaning_report"])
    summary = evaluation(events, bursts, report, burst_labels, chain_labels)
    tables.save_report(summary, paths["evaluation"])

    anchors, relevant = label_tables(events, chain_labels)
    pairs = settle(M.training_pairs(events, anchors, relevant))
    if pairs.limit(M.MIN_PAIRS).count() >= M.MIN_PAIRS and pairs.select("label").distinct().count() == 2:
        model, _ = M.train(pairs)
        M.save_model(model, paths["chain_model"])
    else:
        del paths["chain_model"]
    return paths


def label_tables(events: DataFrame, chain_labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchor attributes and (anchor_id, item) rows of chain labels that list relevant ids."""
    anchors = CH.anchor_rows(events, chain_labels.select(F.col("anchor_event_id").alias("anchor_id")))
    relevant = settle(chain_labels.select(
        F.col("anchor_event_id").alias("anchor_id"), F.explode("relevant_event_ids").alias("item")).distinct())
    return anchors, relevant


def evaluation(
    events: DataFrame, bursts: DataFrame, report: DataFrame, burst_labels: DataFrame, chain_labels: DataFrame
) -> DataFrame:
    """All evaluation sections as ``(section, metric, value)`` rows."""
    anchors, relevant = label_tables(events, chain_labels)
    judged = anchors.join(relevant.select("anchor_id").distinct(), "anchor_id", "left_semi")
    chain = settle(CH.find_chains(events, anchors))
    patterns = CH.chain_patterns(chain, anchors, chain_labels.select(F.col("anchor_event_id").alias("anchor_id")))
    pattern_pairs = patterns.join(
        chain_labels.where(F.coalesce("expected_pattern", F.lit("")) != "").select(
            F.col("anchor_event_id").alias("anchor_id"), F.col("expected_pattern").alias("expected")), "anchor_id",
    ).select("expected", F.col("pattern").alias("predicted"))
    metrics = E.ranking_metrics(E.chain_retrieved(chain), relevant, judged)
    sample = CH.anchor_rows(events, silver.sample_ids(events))
    sample_chain = CH.with_details(settle(CH.find_chains(events, sample)), events, sample)
    sections = [
        E.long_rows(B.sanity(bursts), "burst_sanity"),
        E.long_rows(clean.data_quality(report, events), "data_quality"),
        E.long_rows(E.outcome_scores(E.label_outcomes(bursts.where("is_burst"), burst_labels)), "burst_labels"),
        E.long_rows(E.versus_percentile(bursts, burst_labels), "burst_vs_baseline"),
        E.long_rows(E.mean_metrics(metrics), "chain_labels"),
        E.long_rows(E.pattern_scores(pattern_pairs), "patterns"),
        E.long_rows(E.lift_over_random(sample_chain, sample, E.random_ranks(events, sample, one_hash=True)), "baseline_comparison"),
        ablation_rows(events, judged, relevant),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def ablation_rows(events: DataFrame, anchors: DataFrame, relevant: DataFrame) -> DataFrame:
    scores = E.ablation_scores(E.ablation_ranks(events, anchors), relevant, anchors).drop("delta_vs_full")
    chance = E.random_baseline(E.random_ranks(events, anchors), relevant, anchors)
    table = E.delta_to_full(scores.unionByName(chance))
    return table.select(F.lit("ablation").alias("section"), F.col("config").alias("metric"),
                        F.to_json(F.struct("mean_ndcg_5", "std_ndcg_5", "n_queries", "delta_vs_full")).alias("value"))


if __name__ == "__main__":
    prepare(build("prepare"), *sys.argv[1:4])
