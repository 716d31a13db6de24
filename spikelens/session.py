"""Session settings this library expects; a cluster sets master and sizes itself."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text and vector steps are heavy for their size: let small shuffles keep all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # explained plans name all partitions and filters that a scan keeps, not their first 100 characters
    "spark.sql.maxMetadataStringLength": "2000",
}


def build(app: str = "spikelens", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
