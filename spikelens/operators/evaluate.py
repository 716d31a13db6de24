"""Evaluation of spikes, chains and patterns against labels and baselines.

Retrieved lists come as ``(query keys, item, rank)``, labels as ``(query keys, item)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import settle, top_many
from .aggregate import hash_order
from .chains import PAIR_COLUMNS, candidate_pairs, with_features

# Hash digits that order the candidates of one random trial where trials share a hash.
TRIAL_DIGITS = 6


def ranking_metrics(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, keys=("anchor_id",)) -> DataFrame:
    """P@3, P@5, R@5, nDCG@5, reciprocal rank and average precision per query.

    Precision divides by the items returned, average precision by all relevant items.
    ``queries`` lists every query, so that an empty result still gets its zeros.
    """
    keys = list(keys)
    labels = relevant.select(*[k for k in keys if k in relevant.columns], F.col("item"), F.lit(1.0).alias("rel"))
    label_keys = [k for k in keys if k in relevant.columns]
    joined = retrieved.join(labels, [*label_keys, "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    so_far = F.sum("rel").over(Window.partitionBy(*keys).orderBy("rank"))
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    per_query = joined.withColumn("hits", so_far).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("retrieved_count"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel"))).alias(f"h{k}") for k in (3, 5)],
        F.sum(F.when(F.col("rank") <= 5, gain)).alias("dcg"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank"))).alias("ap"),
    )
    n_labels = labels.groupBy(*label_keys).agg(F.count(F.lit(1)).alias("relevant_count"))
    df = queries.select(*keys).join(per_query, keys, "left").join(n_labels, label_keys).withColumn(
        "retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
    zero, n = F.lit(0.0), F.col("retrieved_count")
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("relevant_count"), F.lit(5)).cast("int")),
        zero, lambda acc, i: acc + 1.0 / F.log2(i + 1.0))

    def precision(k: int):
        return X.np_round(F.when(n > 0, F.col(f"h{k}") / F.least(n, F.lit(k))).otherwise(zero), 4)

    return df.select(
        *keys, "retrieved_count", "relevant_count",
        precision(3).alias("precision_at_3"),
        precision(5).alias("precision_at_5"),
        X.np_round(F.coalesce(F.col("h5") / F.col("relevant_count"), zero), 4).alias("recall_at_5"),
        X.np_round(F.coalesce(F.col("dcg") / ideal, zero), 4).alias("ndcg_at_5"),
        X.np_round(F.coalesce(1.0 / F.col("first_hit"), zero), 4).alias("mrr"),
        X.np_round(F.coalesce(F.col("ap") / F.col("relevant_count"), zero), 4).alias("ap"),
    )


def mean4(column: str):
    """Mean of values that have four decimals, at four decimals; summed as whole numbers, so exact."""
    return F.rint(F.avg(F.rint(F.col(column) * 1e4))) / 1e4


def mean_metrics(metrics: DataFrame) -> DataFrame:
    names = {"precision_at_3": "mean_precision_at_3", "precision_at_5": "mean_precision_at_5",
             "recall_at_5": "mean_recall_at_5", "ndcg_at_5": "mean_ndcg_at_5", "mrr": "mean_mrr", "ap": "mean_map"}
    return metrics.agg(
        *[mean4(c).alias(n) for c, n in names.items()], F.count(F.lit(1)).alias("num_queries"))


def chain_retrieved(chain: DataFrame) -> DataFrame:
    """Chain rows as a result list: before then after, each in date order."""
    order = Window.partitionBy("anchor_id").orderBy(F.when(F.col("side") == "before", 0).otherwise(1), "position")
    return chain.select("anchor_id", F.col("event_id").alias("item"), F.row_number().over(order).alias("rank"))


# --- spikes ----------------------------------------------------------------

def label_outcomes(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """Every spike label with its outcome; ``detected`` holds the found (day, country)."""
    found = detected.select("day", "country").distinct().withColumn("found", F.lit(True))
    real, hit = F.col("is_real_burst"), F.col("found")
    return (
        labels.withColumn("is_real_burst", F.coalesce("is_real_burst", F.lit(True)))
        .join(found, ["day", "country"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
        .withColumn("result", F.when(real & hit, "true_positive").when(real, "false_negative")
                    .when(hit, "false_positive").otherwise("true_negative"))
        .drop("found")
    )


def outcome_scores(outcomes: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("result") == r)
    one = F.lit(1)
    counted = outcomes.agg(
        n("true_positive").alias("true_positives"), n("false_positive").alias("false_positives"),
        n("false_negative").alias("false_negatives"), n("true_negative").alias("true_negatives"),
        F.count(one).alias("total_labels"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    p, r = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    return counted.select("*", X.np_round(p, 3).alias("precision"), X.np_round(r, 3).alias("recall"),
                          X.np_round(f1, 3).alias("f1"))


def above_percentile(bursts: DataFrame, q: float = 0.95) -> DataFrame:
    """Country-days above the exact percentile of the daily counts (one number per country-day)."""
    threshold = bursts.agg(F.percentile("event_count", q)).scalar()
    return bursts.where(F.col("event_count") > threshold).select("day", "country")


def versus_percentile(bursts: DataFrame, labels: DataFrame) -> DataFrame:
    ours = outcome_scores(label_outcomes(bursts.where("is_burst"), labels))
    base = settle(outcome_scores(label_outcomes(above_percentile(bursts), labels)).select(
        *[F.col(c).alias(f"baseline_{c}") for c in ("precision", "recall", "f1")]))
    # both are single rows
    both = ours.select("precision", "recall", "f1").withColumns(
        {c: base.select(c).scalar() for c in base.columns})
    return both.withColumn("f1_improvement", X.np_round(F.col("f1") - F.col("baseline_f1"), 3))


# --- chains ----------------------------------------------------------------

def shares_actor():
    """Row's event names one of the anchor's known actors."""
    hit = F.lit(False)
    for a in ("a_actor1", "a_actor2"):
        known = ~F.col(a).isin("Unknown", "")
        hit = hit | F.coalesce(known & ((F.col("actor1") == F.col(a)) | (F.col("actor2") == F.col(a))), F.lit(False))
    return hit


def chain_quality(chain: DataFrame, anchors: DataFrame, patterns: DataFrame) -> DataFrame:
    """Size, actor and country overlap, mean score and pattern of each chain."""
    joined = chain.join(anchors.select("anchor_id", "a_actor1", "a_actor2", "a_country"), "anchor_id")
    same = F.coalesce(F.col("country") == F.col("a_country"), F.lit(False))
    per_anchor = joined.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("chain_size"),
        X.np_round(F.avg(shares_actor().cast("int")), 3).alias("actor_overlap"),
        X.np_round(F.avg(same.cast("int")), 3).alias("country_overlap"),
        (F.rint(F.avg(F.rint(F.col("chain_score") * 1e4)) / 10) / 1e3).alias("avg_chain_score"))
    df = patterns.select("anchor_id", "pattern").join(per_anchor, "anchor_id", "left")
    return df.na.fill(0, ["chain_size"]).na.fill(0.0, ["actor_overlap", "country_overlap", "avg_chain_score"])


def pattern_scores(pairs: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and per-class F1 from ``(expected, predicted)`` rows."""
    one = F.lit(1)
    cells = pairs.groupBy("expected", "predicted").agg(F.count(one).alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    hits = cells.where(F.col("expected") == F.col("predicted")).select(F.col("expected").alias("label"),
                                                                       F.col("n").alias("tp"))
    per = (
        side("expected").join(side("predicted"), "label", "full_outer").join(hits, "label", "left")
        .na.fill(0, ["n_expected", "n_predicted", "tp"])
    )
    tp = F.col("tp")
    p, r = tp / F.greatest("n_predicted", one), tp / F.greatest("n_expected", one)
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    return per.withColumn("f1", f1).agg(
        X.np_round(F.sum("tp") / F.sum("n_expected"), 3).alias("accuracy"),
        X.np_round(F.avg("f1"), 3).alias("macro_f1"),
        F.sum("n_expected").alias("n_evaluated"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", X.np_round(F.col("f1"), 3))))).alias(
            "per_class_f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of expected against predicted patterns, one column per predicted pattern."""
    patterns = ["De-escalation", "Escalation", "Isolated", "Mixed", "Persistence", "Unknown"]
    return pairs.groupBy("expected").pivot("predicted", patterns).agg(F.count(F.lit(1))).na.fill(0)


def ablation_weights() -> dict[str, dict[str, float]]:
    configs = {
        name: {f: (0.0 if f in removed else w) for f, w in C.CHAIN_WEIGHTS.items()}
        for name, removed in C.ABLATION_GROUPS.items()
    }
    configs["recency_only"] = {f: (1.0 if f == "temporal_decay" else 0.0) for f in C.FEATURES}
    return configs


def ablation_ranks(events: DataFrame, anchors: DataFrame, window_days: int = 7, top_n: int = 5) -> DataFrame:
    """Best ``2 * top_n`` candidates of all countries per anchor and weight set, without a copy of the pairs per set."""
    pairs = with_features(candidate_pairs(events, anchors, window_days, "any", PAIR_COLUMNS))
    cols = {f: F.col(f) for f in C.FEATURES}
    # ten decimals keep the order apart from summation noise
    scores = {name: X.np_round(X.dot(cols, w), 10) for name, w in ablation_weights().items()}
    return top_many(pairs, ["anchor_id"], "event_id", scores, 2 * top_n, "config", at_once=4).withColumnRenamed("event_id", "item")


def ablation_scores(ranks: DataFrame, relevant: DataFrame, anchors: DataFrame) -> DataFrame:
    """Mean and deviation of nDCG@5 per weight set and its difference to the full model."""
    names = F.explode(F.array(*[F.lit(n) for n in ablation_weights()])).alias("config")
    queries = anchors.select("anchor_id", names)
    m = ranking_metrics(ranks, relevant, queries, ["anchor_id", "config"])
    return delta_to_full(m.groupBy("config").agg(
        mean4("ndcg_at_5").alias("mean_ndcg_5"),
        X.np_round(F.stddev_pop("ndcg_at_5"), 4).alias("std_ndcg_5"),
        F.count(F.lit(1)).alias("n_queries")))


def delta_to_full(scores: DataFrame) -> DataFrame:
    full = F.max(F.when(F.col("config") == "full_model", F.col("mean_ndcg_5"))).over(Window.partitionBy(F.lit(1)))
    return scores.withColumn("delta_vs_full", X.np_round(F.col("mean_ndcg_5") - full, 4))


def random_ranks(
    events: DataFrame, anchors: DataFrame, window_days: int = 7, top_n: int = 5, trials: int = 5, one_hash: bool = False
) -> DataFrame:
    """Random ``2 * top_n`` candidates of all countries per anchor and trial, repeatable.

    Every trial orders the pairs by a whole hash of its own; with ``one_hash`` by digits of its own of one hash per pair.
    """
    keep = ("country", "actor1", "actor2", "a_country", "a_actor1", "a_actor2")
    pairs = candidate_pairs(events, anchors, window_days, "any", ("event_id", "event_date", "day", "country", "actor1", "actor2"))
    draws = {t: hash_order("anchor_id", "event_id", seed=f"42:{t}") for t in range(1, trials + 1)}
    if one_hash:
        pairs = pairs.withColumn("_digits", hash_order("anchor_id", "event_id"))
        draws = {t: F.substring("_digits", 1 + TRIAL_DIGITS * (t - 1), TRIAL_DIGITS) for t in draws}
    ranks = top_many(pairs, ["anchor_id"], "event_id", draws, 2 * top_n, "trial", keep, down=False)
    return ranks.withColumnRenamed("event_id", "item").drop("score")


def random_baseline(ranks: DataFrame, relevant: DataFrame, anchors: DataFrame, trials: int = 5) -> DataFrame:
    """Mean nDCG@5 over the trials per anchor, then over the anchors."""
    queries = anchors.select("anchor_id", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    slim = ranks.select("anchor_id", "trial", "item", "rank")
    m = ranking_metrics(slim, relevant, queries, ["anchor_id", "trial"])
    per_anchor = m.groupBy("anchor_id").agg(F.sum(F.rint(F.col("ndcg_at_5") * 1e4)).alias("ndcg"))
    return per_anchor.agg(
        F.lit("random_baseline").alias("config"),
        (F.rint(F.avg("ndcg") / trials) / 1e4).alias("mean_ndcg_5"),
        X.np_round(F.stddev_pop("ndcg") / trials / 1e4, 4).alias("std_ndcg_5"),
        F.count(F.lit(1)).alias("n_queries"))


def lift_over_random(chain: DataFrame, anchors: DataFrame, ranks: DataFrame) -> DataFrame:
    """Actor and country overlap of scored chains against random candidates."""
    joined = chain.join(anchors.select("anchor_id", "a_actor1", "a_actor2", "a_country"), "anchor_id")

    def overlap(df, keys):
        same = F.coalesce(F.col("country") == F.col("a_country"), F.lit(False))
        per = df.groupBy(*keys).agg(F.avg(shares_actor().cast("int")).alias("actor"),
                                    F.avg(same.cast("int")).alias("country"))
        return per.agg(F.avg("actor").alias("actor"), F.avg("country").alias("country"), F.count(F.lit(1)).alias("n"))

    scored, rand = overlap(joined, ["anchor_id"]), settle(overlap(ranks, ["anchor_id", "trial"]))
    both = scored.select(F.col("actor").alias("s_actor"), F.col("country").alias("s_country"),
                         F.col("n").alias("n_scored")).withColumns(
        {f"r_{c}": rand.select(c).scalar() for c in ("actor", "country", "n")})
    r3 = lambda c: X.np_round(c, 3)
    return both.select(
        r3(F.col("s_actor")).alias("scored_actor_overlap"), r3(F.col("s_country")).alias("scored_country_overlap"),
        r3(F.col("r_actor")).alias("random_actor_overlap"), r3(F.col("r_country")).alias("random_country_overlap"),
        r3(F.col("s_actor") - F.col("r_actor")).alias("actor_overlap_lift"),
        r3(F.col("s_country") - F.col("r_country")).alias("country_overlap_lift"),
        "n_scored", F.col("r_n").alias("n_random_trials"))


def long_rows(df: DataFrame, section: str) -> DataFrame:
    """One-row table as ``(section, metric, value)`` rows with text values."""
    def text(c):
        kind = dict(df.dtypes)[c]
        return F.to_json(c) if kind.startswith(("map", "array", "struct")) else F.col(c).cast("string")

    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), text(c).alias("value")) for c in df.columns]))
    return df.select(F.lit(section).alias("section"), rows.alias("r")).select("section", "r.metric", "r.value")
