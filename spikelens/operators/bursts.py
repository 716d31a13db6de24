"""Spike days: a country's count against its own lagged rolling baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import attach, packed, packed_minor, settle
from .aggregate import daily_counts


def dense_days(daily: DataFrame) -> DataFrame:
    """Every day of the whole span for every country, missing counts as zero."""
    lo, hi = daily.agg(F.min("day")).scalar(), daily.agg(F.max("day")).scalar()
    grid = daily.select("country").distinct().select("country", F.explode(F.sequence(lo, hi)).alias("day"))
    return grid.join(daily, ["day", "country"], "left").select(
        "day", "country", F.coalesce("event_count", F.lit(0)).alias("event_count"))


def score_days(
    dense: DataFrame,
    window: int = C.ROLLING_WINDOW,
    z_threshold: float = C.Z_THRESHOLD,
    min_events: int = C.MIN_EVENTS,
) -> DataFrame:
    """Baseline, z-score and flag. The frame is the previous ``window`` days only;
    z uses the rounded baseline. The table has one row per country and day, so a
    window over a country holds days, not events."""
    before = Window.partitionBy("country").orderBy("day").rowsBetween(-window, -1)
    count, mean, std = F.col("event_count"), F.col("rolling_mean"), F.col("rolling_std")
    return (
        dense.withColumns({
            "rolling_mean": X.np_round(F.coalesce(F.avg(count).over(before), F.lit(0.0)), 2),
            "rolling_std": X.np_round(F.coalesce(F.stddev_samp(count).over(before), F.lit(0.0)), 2),
        })
        .withColumn("z_score", F.when(std > 0, X.np_round((count - mean) / std, 3)).otherwise(0.0))
        .withColumn("is_burst", (F.col("z_score") > z_threshold) & (count >= min_events))
    )


def detect_bursts(events: DataFrame, window: int = C.ROLLING_WINDOW, z_threshold: float = C.Z_THRESHOLD,
                  min_events: int = C.MIN_EVENTS) -> DataFrame:
    """Dense (day, country) table with baseline, z-score and spike flag.

    The daily counts are settled first, so the events are read once although the
    calendar, the country list and the counts all come from them.
    """
    return score_days(dense_days(settle(daily_counts(events))), window, z_threshold, min_events)


def burst_table(events: DataFrame, **rules) -> DataFrame:
    """:func:`detect_bursts`, computed once. One row per country and day."""
    return settle(detect_bursts(events, **rules))


def burst_days(bursts: DataFrame, *columns: str) -> DataFrame:
    return bursts.where("is_burst").select("day", "country", *columns)


def summary(bursts: DataFrame) -> DataFrame:
    return burst_days(bursts, "event_count", "rolling_mean", "z_score").orderBy(F.desc("z_score"), "day", "country")


def events_on_bursts(events: DataFrame, bursts: DataFrame) -> DataFrame:
    """Events that happened on a spike day of their country."""
    return attach(events, burst_days(bursts), ["day", "country"], "left_semi", spread=["event_id"])


def mark_bursts(events: DataFrame, bursts: DataFrame) -> DataFrame:
    """Every event with ``on_burst``."""
    flagged = burst_days(bursts).withColumn("on_burst", F.lit(True))
    return attach(events, flagged, ["day", "country"], "left", spread=["event_id"]).withColumn(
        "on_burst", F.coalesce("on_burst", F.lit(False)))


def band(bursts: DataFrame) -> DataFrame:
    """Expected range: mean plus/minus two deviations, not below zero."""
    mean, std = F.col("rolling_mean"), F.col("rolling_std")
    return bursts.select("day", "country", "event_count", "rolling_mean",
                         (mean + 2 * std).alias("upper"), F.greatest(mean - 2 * std, F.lit(0.0)).alias("lower"))


def run_lengths(bursts: DataFrame) -> DataFrame:
    """Length of the run of spike days around each country-day.

    The day itself counts as one even when it is not a spike, so a quiet day
    between two runs joins them.
    """
    by_day = Window.partitionBy("country").orderBy("day")
    spikes = bursts.where("is_burst").withColumn(
        "island", F.date_sub("day", F.row_number().over(by_day)))
    runs = spikes.select("day", "country", F.count(F.lit(1)).over(Window.partitionBy("country", "island")).alias("run"))
    dense = bursts.select("day", "country", "is_burst").join(runs, ["day", "country"], "left").withColumn(
        "run", F.coalesce("run", F.lit(0)))
    beside = 1 + F.coalesce(F.lag("run").over(by_day), F.lit(0)) + F.coalesce(F.lead("run").over(by_day), F.lit(0))
    return dense.select("day", "country", "is_burst",
                        F.when(F.col("is_burst"), F.col("run")).otherwise(beside).alias("consecutive_days"))


def top_per_country(bursts: DataFrame, n: int = C.ANCHORS_PER_COUNTRY) -> DataFrame:
    w = Window.partitionBy("country").orderBy(F.desc("z_score"), "day")
    return (
        bursts.where("is_burst").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    )


def shared_days(bursts: DataFrame) -> DataFrame:
    """Days on which two or more countries spike."""
    return (
        burst_days(bursts, "z_score").groupBy("day")
        .agg(F.count(F.lit(1)).alias("n_countries"),
             F.array_join(F.sort_array(F.collect_list("country")), ", ").alias("countries"))
        .where(F.col("n_countries") >= 2)
    )


def shared_day_rows(bursts: DataFrame) -> DataFrame:
    """The spike rows of those days with the number of countries."""
    days = shared_days(bursts).select("day", "n_countries")
    return burst_days(bursts, "z_score", "event_count").join(days, "day").orderBy("day", "country")


def sanity(bursts: DataFrame) -> DataFrame:
    spikes = F.col("is_burst")
    n = F.count_if(spikes)
    per_country = (
        bursts.where("is_burst").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("country", "n")))))
    )
    return bursts.agg(
        F.count(F.lit(1)).alias("total_country_days"),
        F.countDistinct("day").alias("calendar_days"),
        n.alias("burst_country_days"),
        X.np_round(n / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("burst_ratio"),
        F.coalesce(X.np_round(F.avg(F.when(spikes, F.col("z_score"))), 3), F.lit(0.0)).alias("mean_z_on_burst"),
        X.np_round(F.max("z_score"), 3).alias("max_z_score"),
    ).withColumn("bursts_per_country", per_country.scalar())


def page_figures(bursts: DataFrame) -> DataFrame:
    """Spike days, days analysed, strongest finite z, mean count on spike days."""
    finite = F.when(~F.col("z_score").isin(float("inf"), float("-inf")), F.col("z_score"))
    return bursts.agg(
        F.count_if("is_burst").alias("spike_days"),
        F.countDistinct("day").alias("days_analysed"),
        F.max(finite).alias("strongest"),
        F.coalesce(F.avg(F.when(F.col("is_burst"), F.col("event_count"))), F.lit(0.0)).alias("mean_events_on_spike"),
    )


def day_anchors(events: DataFrame, days: DataFrame) -> DataFrame:
    """Most mentioned event of each given (day, country); the lowest id on ties.

    A grouped minimum of one packed number, combined before the shuffle, instead of sorting whole days.
    """
    day_events = attach(events, days.select("day", "country"), ["day", "country"], "inner", spread=["event_id"])
    first = packed(F.coalesce(-F.col("num_mentions"), F.lit(1)), F.col("event_id"))
    return day_events.groupBy("day", "country").agg(F.min(first).alias("b")).select(
        "day", "country", packed_minor(F.col("b")).alias("anchor_id"))
