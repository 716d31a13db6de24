"""The batch job and the streams, on the given tables."""

import datetime as dt

from pyspark.sql import functions as F

from catalog.streams import land_exports
from conftest import SF
from spikelens.operators import clean, model as M
from spikelens.plans.prepare import REPORT, prepare
from spikelens.sources import raw_files, tables
from spikelens.streaming import streams as ST


def test_batch_job(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    land_exports(spark, SF, raw)
    paths = prepare(spark, raw, out)
    rows = raw_files.read_folder(spark, raw, with_position=True)
    observed = spark.read.schema(REPORT).json(paths["cleaning_report"]).first().asDict()
    assert observed == clean.cleaning_report(rows).first().asDict()
    events = tables.load_events(spark, paths["events"])
    assert events.count() == observed["rows_final"] == events.select("event_id").distinct().count()
    bursts = tables.load_bursts(spark, paths["bursts"])
    assert bursts.count() == 3 * bursts.select("day").distinct().count()
    summary = spark.read.json(paths["evaluation"])
    assert {"burst_sanity", "data_quality", "ablation"} <= {r.section for r in summary.select("section").distinct().collect()}
    if "chain_model" in paths:
        assert M.load_model(spark, paths["chain_model"]).count() == 17
    assert spark.read.parquet(paths["vocabulary"]).count() > 0


def stream(spark, tmp_path, rows, step):
    src = str(tmp_path / "src")
    schema = "event_id bigint, country string, avg_tone double, ts timestamp"
    for i, batch in enumerate(rows):
        data = [(e, c, t, dt.datetime(2024, 1, d, h)) for e, c, t, d, h in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema(schema).parquet(src)
        ST.run_available(step(df), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_repeats_within_the_watermark(spark, tmp_path):
    out = stream(spark, tmp_path, [[(1, "A", 0.0, 1, 1), (1, "A", 0.0, 1, 3)], [(1, "A", 0.0, 1, 20), (2, "A", 0.0, 2, 1)]],
                 lambda df: ST.unique_events(df))
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_late_rows(spark, tmp_path):
    batches = [[(1, "A", 0.0, 1, 1), (2, "A", 0.0, 3, 1)],
               [(3, "A", 0.0, 2, 5), (9, "A", 0.0, 1, 5)],  # day 2 is open, day 1 was closed
               [(4, "A", 0.0, 20, 1)]]
    out = stream(spark, tmp_path, batches, ST.daily_counts)
    assert {r.day.day: r.event_count for r in out.collect()} == {1: 1, 2: 1, 3: 1}


def test_spike_stream_fills_silent_days(spark, tmp_path):
    src = str(tmp_path / "counts")
    schema = "day date, country string, event_count bigint"
    d = lambda n: dt.date(2024, 1, n)
    for batch in ([(d(1), "A", 4), (d(2), "A", 6)], [(d(5), "A", 9), (d(5), "B", 7)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        df = ST.spike_stream(spark.readStream.schema(schema).parquet(src), start_day="2024-01-01")
        ST.run_available(df, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.country, r.day.day): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[("A", i)].event_count for i in range(1, 6)] == [4, 6, 0, 0, 9]
    assert [got[("B", i)].event_count for i in range(1, 6)] == [0, 0, 0, 0, 7]
    last = got[("A", 5)]
    assert (last.rolling_mean, last.rolling_std, last.z_score, last.is_burst) == (2.5, 3.0, 2.167, True)
    assert got[("B", 5)].z_score == 0.0


def test_late_and_early_days_come_out(spark, tmp_path):
    src, schema = str(tmp_path / "counts"), "day date, country string, event_count bigint"
    d = lambda n: dt.date(2024, 1, n)
    given = [[(d(1), "A", 4), (d(3), "A", 6), (d(4), "A", 5)], [(d(3), "A", 2), (d(2), "A", 7), (d(6), "A", 1), (d(1), "B", 9)]]
    for batch in given:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        df = ST.spike_stream(spark.readStream.schema(schema).parquet(src), start_day="2024-01-03")
        ST.run_available(df, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    days = spark.read.parquet(str(tmp_path / "out"))
    outside = sorted((r.country, r.day.day, r.event_count, r.status) for r in ST.outside_days(days).collect())
    assert outside == [("A", 1, 4, "early"), ("A", 2, 7, "early"), ("A", 3, 2, "late"), ("B", 1, 9, "early")]
    closed = {(r.country, r.day.day): r.event_count for r in ST.closed_days(days).collect()}
    assert closed == {("A", 3): 6, ("A", 4): 5, ("A", 5): 0, ("A", 6): 1}
    assert days.agg(F.sum("event_count")).first()[0] == sum(n for batch in given for *_, n in batch)


def test_files_are_ingested_once(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    land_exports(spark, SF, folder)
    for _ in range(2):
        ST.run_available(ST.read_landed(spark, folder), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == raw_files.read_folder(spark, folder).count()
