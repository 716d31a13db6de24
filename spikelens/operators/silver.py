"""Labels made by rule ("silver") and templates for hand labelling.

The relevant ids come from the same heuristic that ranks chains, so scores against
them say how stable the ranking is, not how good.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import settle, top_k
from .aggregate import hash_order
from .bursts import day_anchors, top_per_country
from .chains import anchor_rows, chain_patterns, find_chains

class Silver(NamedTuple):
    bursts: DataFrame   # one row per labelled spike
    chains: DataFrame   # one row per anchor with its relevant ids
    anchors: DataFrame  # anchor attributes
    relevant: DataFrame  # (anchor_id, item)


def silver_labels(events: DataFrame, bursts: DataFrame) -> Silver:
    top = settle(top_per_country(bursts))
    owners = settle(day_anchors(events, top))
    anchors = anchor_rows(events, owners)
    chain = settle(find_chains(events, anchors, 7, C.SILVER_TOP_N))
    patterns = chain_patterns(chain, anchors).select("anchor_id", "pattern")
    good = F.least(F.col("chain_score") / C.CHAIN_MAX_SCORE, F.lit(1.0)) >= C.RELEVANCE_THRESHOLD
    relevant = settle(chain.where(good).select("anchor_id", F.col("event_id").alias("item"), "side", "position"))
    order = F.struct(F.when(F.col("side") == "before", 0).otherwise(1).alias("s"), "position", "item")
    # at most 2 * top_n ids per anchor
    ids = relevant.groupBy("anchor_id").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda r: r["item"]).alias("relevant_event_ids"))
    count, z = F.col("event_count"), F.col("z_score")
    burst_labels = top.select(
        "day", "country", "event_count", "z_score",
        ((z >= 2.0) & (count >= C.SILVER_MIN_COUNT)).alias("is_real_burst"),
        F.concat(F.lit("Auto-labeled: z="), X.fixed(z, 2), F.lit(", count="), count.cast("string")).alias("description"))
    chain_labels = (
        owners.join(top.select("day", "country", "z_score"), ["day", "country"])
        .join(anchors, "anchor_id").join(patterns, "anchor_id").join(ids, "anchor_id", "left")
        .withColumn("relevant_event_ids", F.coalesce("relevant_event_ids", F.array().cast("array<bigint>")))
        .select(
            F.col("anchor_id").alias("anchor_event_id"), F.col("day").cast("string").alias("date"), "country",
            F.concat("a_actor1", F.lit(" → "), "a_actor2").alias("actors"), F.col("a_quad_label").alias("event_type"),
            "relevant_event_ids", F.col("pattern").alias("expected_pattern"),
            F.concat(F.lit("Auto-labeled via heuristic chain scorer. z="), X.fixed(z, 2), F.lit(", "),
                     F.size("relevant_event_ids").cast("string"), F.lit(" relevant events found.")).alias("description"))
    )
    return Silver(burst_labels, chain_labels, anchors, relevant.select("anchor_id", "item"))


def burst_template(bursts: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` country-days with the highest z, to be judged by hand."""
    return (
        bursts.orderBy(F.desc("z_score"), "day", "country").limit(n)
        .select(F.col("day").cast("string").alias("day"), "country", "event_count",
                X.np_round(F.col("z_score"), 2).alias("z_score"), F.lit(True).alias("is_real_burst"),
                F.lit("TODO: describe what happened").alias("description"))
    )


def chain_template(events: DataFrame, n: int = 25) -> DataFrame:
    """Strong events spread over the countries, to be given relevant ids by hand.

    From the ``3 * n`` strongest, a seeded sample of ``n // 3 + 1`` per country,
    countries by name, ``n`` in all.
    """
    pool = top_k(events, [], [F.col("event_strength").desc_nulls_last(), F.col("event_id")], 3 * n).drop("rank")
    w = Window.partitionBy("country").orderBy(hash_order("event_id"), "event_id")
    return (
        pool.where(F.col("country").isNotNull()).withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= n // 3 + 1).orderBy("country", "_r").limit(n)
        .select(F.col("event_id").alias("anchor_event_id"), F.col("event_date").cast("string").alias("date"), "country",
                F.concat("actor1", F.lit(" → "), "actor2").alias("actors"), F.col("quad_label").alias("event_type"),
                F.array().cast("array<bigint>").alias("relevant_event_ids"), F.lit("").alias("expected_pattern"),
                F.lit("TODO: describe the expected chain").alias("description"))
    )


def sample_per_country(events: DataFrame, n: int) -> DataFrame:
    """Seeded sample of ``n`` events per country."""
    return top_k(events.withColumn("_h", hash_order("event_id")), ["country"], [F.col("_h"), F.col("event_id")], n).drop(
        "_h")


def sample_ids(events: DataFrame, n: int = 15) -> DataFrame:
    """Seeded sample of ``n`` event ids over all events, as anchors."""
    ids = events.where(F.col("event_id").isNotNull()).select("event_id").withColumn("_h", hash_order("event_id"))
    return top_k(ids, [], [F.col("_h"), F.col("event_id")], n).select(F.col("event_id").alias("anchor_id"))
