"""Streaming forms, run over the given tables until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens import config as C
from spikelens.sources import raw_files
from spikelens.sources import world_events as W
from spikelens.schemas import KEPT_COLUMNS, RAW_COLUMNS
from spikelens.streaming import streams as ST

from .cleaning import events, null_tokens, scratch, slim
from .registry import query
from .sql import with_ctes


def land_exports(spark, sf, folder: str) -> None:
    raw = W.raw_view(spark, sf)
    have = set(raw.columns)
    wide = raw.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS])
    wide.write.mode("append").option("sep", "\t").option("quote", "\u0000").option("extension", "CSV").option(
        "emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


@query("str1_incremental_ingest", with_ctes(
    f"select {null_tokens(KEPT_COLUMNS)} from raw where ActionGeo_CountryCode in ('IN', 'IR', 'US')", "raw"))
def _(spark, sf):
    """Landed export files, the stream started twice: every row arrives once."""
    base = scratch(spark)
    land_exports(spark, sf, f"{base}/landed")
    for _ in range(2):
        ST.run_available(ST.read_landed(spark, f"{base}/landed", C.COUNTRY_NAMES), f"{base}/table",
                         f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table").drop("file_name")


def event_stream(spark, sf, base: str, repeats: bool = False):
    """Events landed as files and read as a stream, followed by one event far past the end."""
    ts = W.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ev = slim(spark, sf).select("event_id", "country", "avg_tone").join(ts, "event_id")
    if repeats:
        later = ev.where("event_id % 10 = 0").withColumn("ts", F.col("ts") + F.expr("interval 2 hours"))
        ev = ev.unionByName(later)
    end = ts.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit("end").alias("country"),
        F.lit(None).cast("double").alias("avg_tone"), "ts")
    ev.unionByName(end).write.parquet(f"{base}/landed")
    schema = "event_id bigint, country string, avg_tone double, ts timestamp"
    return spark.readStream.schema(schema).parquet(f"{base}/landed")


def finish(spark, df, base, name="table"):
    ST.run_available(df, f"{base}/{name}", f"{base}/checkpoint-{name}").awaitTermination()
    return spark.read.parquet(f"{base}/{name}")


@query("str2_streaming_dedup", "select event_id from events")
def _(spark, sf):
    """A tenth of the events arrive a second time two hours later."""
    base = scratch(spark)
    unique = ST.unique_events(event_stream(spark, sf, base, repeats=True), "2 days")
    return finish(spark, unique, base).where("event_id >= 0").select("event_id")


@query("str3_streaming_daily_counts", with_ctes("select day, country, event_count from daily", "daily"), dates="day")
def _(spark, sf):
    base = scratch(spark)
    return finish(spark, ST.daily_counts(event_stream(spark, sf, base)), base)


@query("str4_streaming_spikes", with_ctes("select * from bursts", "bursts"), dates="day")
def _(spark, sf):
    """A second stream over the table of closed days."""
    base = scratch(spark)
    finish(spark, ST.daily_counts(event_stream(spark, sf, base)), base, "counts")
    first = spark.read.parquet(f"{base}/counts").agg(F.min("day").cast("string")).first()[0]
    counts = spark.readStream.schema("day date, country string, event_count bigint").parquet(f"{base}/counts")
    return ST.closed_days(finish(spark, ST.spike_stream(counts, start_day=first), base, "spikes"))


@query("str4_late_and_early_days", with_ctes("""select day, country, event_count, case when day < lo + 5 then 'early' else 'late' end
    as status from daily, (select min(day) as lo from daily) where day < lo + 5 or date_diff('day', date '1970-01-01', day) % 3 = 0""",
    "daily"), dates="day")
def _(spark, sf):
    """Counts of every third day come a second time, after their day was closed; the first five days lie before the start."""
    base = scratch(spark)
    counts = finish(spark, ST.daily_counts(event_stream(spark, sf, base)), base, "counts")
    start = counts.agg(F.date_add(F.min("day"), 5).alias("day")).first().day
    third = F.date_diff("day", F.lit("1970-01-01").cast("date")) % 3 == 0
    for i, part in enumerate((counts, counts.where(third & (F.col("day") >= F.lit(start))))):
        part.write.mode("append").parquet(f"{base}/given")
        given = spark.readStream.schema("day date, country string, event_count bigint").parquet(f"{base}/given")
        days = finish(spark, ST.spike_stream(given, start_day=str(start)), base, "spikes")
    return ST.outside_days(days)


@query("str5_sliding_tone", with_ctes("""select until - 7 as since, until, country, avg(avg_tone) as mean_tone, count(avg_tone) as n
    from (select cast(unnest(generate_series(min(day) + 1, max(day) + 7, interval 1 day)) as date) as until from ev) u
    join ev on day >= until - 7 and day < until group by 1, 2, 3""", "ev"), floats="mean_tone", dates="since until")
def _(spark, sf):
    base = scratch(spark)
    return finish(spark, ST.sliding_tone(event_stream(spark, sf, base)), base)
