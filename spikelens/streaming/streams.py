"""Structured Streaming forms of ingest, counting and spike detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..sources.raw_files import FILE_GLOB, parse_lines

WATERMARK = "1 day"


def read_landed(spark: SparkSession, folder: str, country_codes=None, max_files: int | None = None) -> DataFrame:
    """Export files as they land, each read once (the checkpoint remembers them)."""
    reader = spark.readStream.option("pathGlobFilter", FILE_GLOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = parse_lines(reader.text(folder).select("value", F.col("_metadata.file_name").alias("file_name")))
    return rows.where(F.col("ActionGeo_CountryCode").isin(*sorted(country_codes))) if country_codes else rows


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything there is into a Parquet table and stop."""
    return (
        df.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def unique_events(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Drop repeats of an event id that arrive within the watermark of the first."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Events per closed day and country; ``events`` has ``ts`` (timestamp) and ``country``."""
    counted = events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "country").agg(
        F.count(F.lit(1)).alias("event_count"))
    return counted.select(F.col("window.start").cast("date").alias("day"), "country", "event_count")


def sliding_tone(events: DataFrame, watermark: str = WATERMARK, days: int = 7) -> DataFrame:
    """Mean tone per country over the ``days`` days before ``until`` (exclusive), one window per day."""
    tone = events.withWatermark("ts", watermark).groupBy(F.window("ts", f"{days} days", "1 day"), "country").agg(
        F.avg("avg_tone").alias("mean_tone"), F.count("avg_tone").alias("n"))
    return tone.select(F.col("window.start").cast("date").alias("since"), F.col("window.end").cast("date").alias("until"),
                       "country", "mean_tone", "n")


def spike_stream(
    counts: DataFrame,
    window: int = C.ROLLING_WINDOW,
    z_threshold: float = C.Z_THRESHOLD,
    min_events: int = C.MIN_EVENTS,
    start_day: str | None = None,
) -> DataFrame:
    """Baseline, z-score and flag for the closed days of :func:`daily_counts`' table.

    The state of a country is its last day and its last ``window`` counts. Days with
    no row are filled with zero once a later day arrives. ``start_day`` begins every
    country at the same day; otherwise at its first one.

    ``status`` is "closed" for these rows. No count vanishes: one of a day before ``start_day`` comes out as "early", one
    of a day that was closed before as "late", both with null baselines and without a part in later ones. Counts of one day
    that come in one batch are added up. :func:`closed_days` and :func:`outside_days` tell them apart.
    """
    schema = ("day date, country string, event_count bigint, rolling_mean double, rolling_std double, "
              "z_score double, is_burst boolean, status string")
    epoch = pd.Timestamp("1970-01-01")
    first = None if start_day is None else (pd.Timestamp(start_day) - epoch).days - 1

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, recent = state.get if state.exists else (first, [])
        recent = list(recent)
        new = pd.concat(list(batches))
        number = (pd.to_datetime(new["day"]) - epoch).dt.days
        counts_by_day = new.groupby(number)["event_count"].sum().sort_index()
        rows = []
        for day, count in counts_by_day.items():
            if last is not None and day <= last:
                rows.append(((epoch + pd.Timedelta(days=int(day))).date(), key[0], int(count), None, None, None, None,
                             "early" if first is not None and day <= first else "late"))
                continue
            gap = [] if last is None else [(d, 0) for d in range(last + 1, day)]
            for d, n in [*gap, (int(day), int(count))]:
                mean = float(np.round(np.mean(recent), 2)) if recent else 0.0
                std = float(np.round(np.std(recent, ddof=1), 2)) if len(recent) > 1 else 0.0
                z = float(np.round((n - mean) / std, 3)) if std > 0 else 0.0
                rows.append(((epoch + pd.Timedelta(days=d)).date(), key[0], n, mean, std, z,
                             bool(z > z_threshold and n >= min_events), "closed"))
                recent = [*recent, n][-window:]
                last = d
        state.update((last, recent))
        out = pd.DataFrame(rows, columns=["day", "country", "event_count", "rolling_mean", "rolling_std", "z_score",
                                          "is_burst", "status"])
        yield out.astype({"rolling_mean": "float64", "rolling_std": "float64", "z_score": "float64", "is_burst": "boolean"})

    return counts.groupBy("country").applyInPandasWithState(
        step, schema, "last int, recent array<bigint>", "append", GroupStateTimeout.NoTimeout)


def closed_days(days: DataFrame) -> DataFrame:
    """The days of :func:`spike_stream` that have a baseline, in the form of the batch result."""
    return days.where(F.col("status") == "closed").drop("status")


def outside_days(days: DataFrame) -> DataFrame:
    """Counts that came for a day already closed or before the start: ``(day, country, event_count, status)``."""
    return days.where(F.col("status") != "closed").select("day", "country", "event_count", "status")
