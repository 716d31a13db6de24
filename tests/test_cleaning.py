import pytest
from pyspark.sql import functions as F

from spikelens.operators import clean
from spikelens.schemas import KEPT_COLUMNS, RAW_COLUMNS
from spikelens.sources import raw_files, tables


def line(**fields):
    base = dict(GLOBALEVENTID="1", SQLDATE="20260110", Actor1Name="USA", Actor2Name="IRAN", EventRootCode="4", QuadClass="3",
                GoldsteinScale="-2", NumMentions="5", NumSources="2", NumArticles="1", AvgTone="-1.5",
                ActionGeo_CountryCode="US", ActionGeo_FullName="Ohio", SOURCEURL="https://www.a.com/x")
    row = {**base, **fields}
    return "\t".join(row.get(c) or "" for c in RAW_COLUMNS)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "20260110.export.CSV").write_text("\n".join([
        line(), line(GLOBALEVENTID="2", Actor1Name='5" GUN'), "short\t20260110", line(GLOBALEVENTID="3") + "\textra", "",
        line(GLOBALEVENTID="4", ActionGeo_CountryCode="FR"),
    ]) + "\n")
    (tmp_path / "20260111.export.csv").write_text(line(Actor1Name="LATER") + "\n")
    (tmp_path / ".hidden.csv").write_text(line(GLOBALEVENTID="9") + "\n")
    (tmp_path / "notes.txt").write_text(line(GLOBALEVENTID="8") + "\n")
    (tmp_path / "empty.CSV").write_text("")
    return str(tmp_path)


def test_folder(spark, folder):
    rows = raw_files.read_folder(spark, folder)
    assert rows.columns == KEPT_COLUMNS
    ids = sorted(r[0] for r in rows.select("GLOBALEVENTID").collect())
    assert ids == ["1", "1", "2", "4", "short"]  # long line skipped, short one padded
    assert rows.count() == 5
    assert rows.where("GLOBALEVENTID = '2'").first().Actor1Name == '5" GUN'
    assert rows.where("GLOBALEVENTID = 'short'").first().SOURCEURL is None
    assert raw_files.read_folder(spark, folder, {"US"}).count() == 3
    assert raw_files.read_export(spark, f"{folder}/20260111.export.csv").count() == 1


def test_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        raw_files.read_folder(spark, str(tmp_path))


def test_first_file_wins(spark, folder):
    raw = raw_files.read_folder(spark, folder, with_position=True)
    events = {r.event_id: r for r in clean.clean_events(raw).collect()}
    assert set(events) == {1, 2}
    first = events[1]
    assert (first.actor1, first.country, first.event_type, first.root_label) == ("Usa", "USA", "Conflict", "Consult")
    assert first.event_label == "1 | 2026-01-10 | Usa → Iran | Verbal Conflict"
    assert first.text_for_tfidf == "Usa Iran Ohio Verbal Conflict Consult"
    assert first.source_domain == "a.com"


def raw_rows(spark, rows):
    base = {c: None for c in KEPT_COLUMNS} | dict(SQLDATE="20260110", QuadClass="1", ActionGeo_CountryCode="US")
    data = [tuple({**base, "GLOBALEVENTID": str(i), **r}[c] for c in KEPT_COLUMNS) + ("f", i) for i, r in enumerate(rows)]
    schema = ", ".join(f"{c} string" for c in KEPT_COLUMNS) + ", file_name string, line_no bigint"
    return spark.createDataFrame(data, schema)


def test_drop_reasons_and_report(spark):
    raw = raw_rows(spark, [
        {}, {}, {"SQLDATE": "20260132"}, {"SQLDATE": "20260327"}, {"ActionGeo_CountryCode": "FR"},
        {"ActionGeo_CountryCode": None}, {"QuadClass": "x"}, {"SQLDATE": "20251115"}, {"SQLDATE": "20251201"},
        {"GLOBALEVENTID": "0"}, {"SQLDATE": "2026-1-1"}])
    reasons = [r[0] for r in clean.tag_stages(raw).orderBy("line_no").select("drop_reason").collect()]
    assert reasons == [None, None, "invalid_date", "beyond_cutoff", "outside_countries", "outside_countries", "null_quad",
                       "outside_window", None, None, "invalid_date"]
    report = clean.cleaning_report(raw).first()
    assert report.rows_raw == 11 and report.rows_final == 3 and report.duplicates_removed == 1
    assert report.dominant_year == 2026 and report.countries == {"USA": 3}
    assert report.rows_raw == (report.invalid_dates_dropped + report.rows_beyond_cutoff + report.rows_outside_countries
                               + report.null_quad_dropped + report.rows_outside_window + report.duplicates_removed
                               + report.rows_final)


def test_modal_year_tie_takes_the_earlier(spark):
    raw = raw_rows(spark, [{"SQLDATE": "20250110"}, {"SQLDATE": "20260110"}])
    assert clean.modal_year(clean.cast_columns(raw)).first()[0] == 2025


def test_parsing_is_not_repeated_by_filters(spark, folder):
    plan = clean.tag_stages(raw_files.read_folder(spark, folder, with_position=True)).where(
        "drop_reason is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1


def test_month_partitions_are_pruned(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    tables.save_events(clean.clean_events(raw_files.read_folder(spark, folder, with_position=True)), out)
    df = tables.load_events(spark, out, "2026-01-10").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_label" in plan and "LessThanOrEqual(event_date" in plan
    assert df.count() == 2


def test_keyed_store(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("USA", "2024-01-01", 1), ("USA", "2024-01-02", 2)], "country string, day string, v int")
    tables.refresh_keyed(df, path)
    tables.refresh_keyed(df.where("v = 2").withColumn("v", F.lit(20)), path)
    stored = spark.read.schema("v int, country string, day string").parquet(path)
    assert sorted(r.v for r in stored.collect()) == [1, 20]
    wanted = df.union(spark.createDataFrame([("Iran", "2024-01-01", 3)], df.schema))
    assert [r.country for r in tables.missing_keys(wanted, stored).collect()] == ["Iran"]


def test_a_store_builds_only_absent_keys(spark, tmp_path):
    calls = []

    def build(absent):
        calls.append(sorted(r.k for r in absent.collect()))
        return absent.where("k <> 3").selectExpr("k", "explode(array(k, 10 * k)) as v", "concat('t', k) as t")

    def ask(*ks):
        wanted = spark.createDataFrame([(k,) for k in ks], "k bigint")
        return sorted((r.k, r.v, r.t) for r in tables.build_absent(wanted, str(tmp_path / "store"), build, ["k"]).collect())

    assert ask() == [] and calls.pop() == []  # a new store
    assert ask(1, None, 1) == [(1, 1, "t1"), (1, 10, "t1")]
    assert ask(1, 2, 3) == [(1, 1, "t1"), (1, 10, "t1"), (2, 2, "t2"), (2, 20, "t2")]
    assert ask(3, 2) == [(2, 2, "t2"), (2, 20, "t2")]
    assert calls == [[1], [2, 3]]  # 3 has no rows and is not built again
    assert ask() == [] and len(calls) == 2
