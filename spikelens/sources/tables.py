"""Stored tables, reports, parameters and label files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions.dist import settle
from ..schemas import LABELS


def save_table(df: DataFrame, path: str, partition_by=None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_events(df: DataFrame, path: str) -> None:
    """Events by month, clustered so that country/day filters skip row groups."""
    clustered = df.repartitionByRange("month_label", "country", "day", "event_id")
    save_table(clustered.sortWithinPartitions("month_label", "country", "day"), path, ["month_label"])


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_events(spark: SparkSession, path: str, cutoff: str = C.CUTOFF_DATE) -> DataFrame:
    """Stored events up to the cutoff. The month bound prunes whole partitions."""
    last = F.lit(cutoff).cast("date")
    events = load_table(spark, path)
    if "month_label" in events.columns:
        events = events.where(F.col("month_label") <= F.date_format(last, "yyyy-MM"))
    return events.where((F.col("event_date") <= last) & (F.col("day") <= last))


def load_bursts(spark: SparkSession, path: str, cutoff: str = C.CUTOFF_DATE) -> DataFrame:
    return load_table(spark, path).where(F.col("day") <= F.lit(cutoff).cast("date"))


def save_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON; structs, arrays, maps and dates serialise natively."""
    df.write.mode("overwrite").json(path)


def run_parameters(
    spark: SparkSession,
    window: int = C.ROLLING_WINDOW,
    z_threshold: float = C.Z_THRESHOLD,
    min_events: int = C.MIN_EVENTS,
) -> DataFrame:
    """One-row table of the spike rules, stored beside the output."""
    return spark.range(1).select(
        F.lit(window).alias("rolling_window"),
        F.lit(float(z_threshold)).alias("z_threshold"),
        F.lit(min_events).alias("min_events"),
    )


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A label file as (burst labels, chain labels)."""
    doc = spark.read.schema(LABELS).option("multiLine", True).json(path)
    bursts = (
        doc.select(F.explode("burst_ground_truth").alias("l"))
        .select("l.*")
        .withColumn("day", F.col("day").cast("date"))
        .withColumn("is_real_burst", F.coalesce("is_real_burst", F.lit(True)))
    )
    chains = doc.select(F.explode("chain_ground_truth").alias("l")).select("l.*")
    return bursts, chains


def write_labels(bursts: DataFrame, chains: DataFrame, path: str) -> None:
    """Label tables as two JSON-lines folders under ``path``."""
    save_report(bursts, f"{path}/bursts")
    save_report(chains, f"{path}/chains")


def write_label_file(bursts: DataFrame, chains: DataFrame, path: str) -> None:
    """Both label tables as one document. Labels are few: some spikes per country."""
    rows = lambda df: df.agg(F.collect_list(F.struct(*df.columns))).scalar()
    save_report(
        bursts.sparkSession.range(1).select(
            rows(bursts.withColumn("day", F.col("day").cast("string"))).alias("burst_ground_truth"),
            rows(chains).alias("chain_ground_truth")),
        path)


def missing_keys(wanted: DataFrame, stored: DataFrame, keys=("country", "day")) -> DataFrame:
    """Keys asked for that a keyed store does not hold yet."""
    return wanted.select(*keys).distinct().join(stored.select(*keys).distinct(), list(keys), "left_anti")


def refresh_keyed(df: DataFrame, path: str, keys=("country", "day")) -> None:
    """Write only the partitions present in ``df``, replacing those and leaving others."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def build_absent(
    wanted: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], keys=("country", "day")
) -> DataFrame:
    """Rows of the wanted keys from a keyed store, after building those keys that it does not hold.

    ``build`` gets the absent keys, settled, and returns their rows with the key columns; it is not called when there are
    none, but for a store that holds nothing yet, which learns its columns that way. Rows are written by key first and the keys are noted afterwards, so a run that dies in between is made up for by
    the next one, and a key without rows is not built again. Keys that are null are left out.
    """
    keys = list(keys)
    spark, rows_at, keys_at = wanted.sparkSession, f"{path}/rows", f"{path}/keys"
    asked = wanted.select(*keys).dropna().distinct()
    asked.limit(0).write.mode("ignore").parquet(keys_at)
    held = spark.read.schema(asked.schema).parquet(keys_at)
    absent = settle(missing_keys(asked, held, keys))
    if not absent.isEmpty() or held.isEmpty():
        rows = build(absent)
        rows.limit(0).drop(*keys).write.mode("ignore").parquet(f"{path}/form")
        refresh_keyed(rows, rows_at, keys)
        absent.write.mode("append").parquet(keys_at)
    form = spark.read.parquet(f"{path}/form").schema
    for field in asked.schema.fields:
        form = form.add(field)
    return spark.read.schema(form).parquet(rows_at).join(settle(asked), keys, "left_semi")
