"""Reading, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spikelens import config as C
from spikelens.functions import exprs as X
from spikelens.functions.dist import settle, shared_dir
from spikelens.operators import aggregate as A, bursts as B, chains as CH, clean, keywords as K, silver as S
from spikelens.schemas import KEPT_COLUMNS, NULL_TOKENS, RAW_COLUMNS
from spikelens.sources import raw_files, tables
from spikelens.sources import world_events as W

from .registry import query
from .sql import (add, article_domain, blocked, case_map, clean_actor, domain, fixed, in_list, match_strength, quote, rnd,
                  root_label, strength, tone_label, week, with_ctes)


def events(spark, sf, **kw):
    return clean.enrich(W.events_view(spark, sf, **kw))


def slim(spark, sf):
    """Events without the place and URL dimensions."""
    return events(spark, sf, place=False, url=False)


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/spikelens-{uuid.uuid4().hex}"


# --- files -------------------------------------------------------------------

def as_lines(raw):
    """Raw rows as export lines with all 58 fields."""
    have = set(raw.columns)
    fields = [F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("") for c in RAW_COLUMNS]
    return raw.select(F.concat_ws("\t", *fields).alias("value"), "file_name")


def null_tokens(columns) -> str:
    tokens = in_list(NULL_TOKENS)
    return ", ".join(f"case when {c} not in {tokens} then {c} end as {c}" for c in columns)


@query("src1_parse_export_lines", with_ctes(f"select {null_tokens(KEPT_COLUMNS)}, file_name from raw", "raw"))
def _(spark, sf):
    return raw_files.parse_lines(as_lines(W.raw_view(spark, sf)))


_COUNTRY = "('IN', 'IR', 'US')"


@query("src2_read_export_folder",
       with_ctes(f"select {null_tokens(KEPT_COLUMNS)} from raw where ActionGeo_CountryCode in {_COUNTRY}", "raw"))
def _(spark, sf):
    """Written as export files, then read back with the country filter."""
    folder = scratch(spark)
    raw = W.raw_view(spark, sf)
    have = set(raw.columns)
    wide = raw.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS])
    wide.write.option("sep", "\t").option("quote", "\u0000").option("extension", "CSV").option(
        "emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return raw_files.read_folder(spark, folder, C.COUNTRY_NAMES)


@query("src3_missing_days", """select d.day from (select cast(unnest(generate_series(date '1992-01-01', date '1998-12-31',
    interval 1 day)) as date) as day) d where d.day not in (select cast(o_orderdate as date) from orders)""", dates="day")
def _(spark, sf):
    seen = W.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return raw_files.missing_days(spark, seen, "1992-01-01", "1998-12-31")


_LANDED = "select distinct country || '-' || cast(day as varchar) || '.CSV' as file_name from ev"


@query("src4_new_files", with_ctes(f"{_LANDED} except {_LANDED} where quad_class = 2 and avg_tone < -10", "ev"))
def _(spark, sf):
    ev = slim(spark, sf)
    name = F.concat("country", F.lit("-"), F.col("day").cast("string"), F.lit(".CSV")).alias("file_name")
    return raw_files.new_files(ev.select(name).distinct(), ev.where("quad_class = 2 and avg_tone < -10").select(name))


@query("src5_save_events_by_month",
       with_ctes("select month_label, country, count(*) as n, sum(event_id)::bigint as ids from ev group by 1, 2", "ev"))
def _(spark, sf):
    path = scratch(spark)
    tables.save_events(slim(spark, sf), path)
    return tables.load_table(spark, path).groupBy("month_label", "country").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("src6_load_table", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf):
    return tables.load_table(spark, f"{sf}/customer.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src7_load_events_cutoff",
       with_ctes("select event_id, day, country from ev where day <= date '2024-01-20'", "ev"), dates="day")
def _(spark, sf):
    path = scratch(spark)
    tables.save_events(slim(spark, sf), path)
    return tables.load_events(spark, path, "2024-01-20").select("event_id", "day", "country")


@query("src8_load_bursts_cutoff", with_ctes("select * from bursts where day <= date '2024-01-20'", "bursts"), dates="day")
def _(spark, sf):
    path = scratch(spark)
    tables.save_table(B.detect_bursts(slim(spark, sf)), path)
    return tables.load_bursts(spark, path, "2024-01-20")


_REPORT_COUNTS = ("rows_raw", "invalid_dates_dropped", "rows_beyond_cutoff", "rows_outside_countries",
                  "null_quad_dropped", "rows_outside_window", "duplicates_removed", "rows_final")


def cleaning_ctes() -> None:
    add("typed", ["raw"], """select *, case when length(SQLDATE) = 8 then try_strptime(SQLDATE, '%Y%m%d')::date end
        as event_date, try_cast(QuadClass as double)::int as quad, try_cast(GLOBALEVENTID as double)::bigint as id
        from raw""")
    add("early", ["typed"], f"""select *, case when event_date is null then 'invalid_date'
        when event_date > date '{C.CUTOFF_DATE}' then 'beyond_cutoff'
        when coalesce(ActionGeo_CountryCode not in {_COUNTRY}, true) then 'outside_countries'
        when quad is null then 'null_quad' end as early from typed""")
    add("modal", ["early"], """select y from (select year(event_date) as y, count(*) as n from early where early is null
        group by 1) order by n desc, y limit 1""")
    add("tagged", ["early", "modal"], """select early.* exclude (early), coalesce(early, case when not (
        (month(event_date) = 12 and year(event_date) in ((select y from modal) - 1, (select y from modal)))
        or (month(event_date) in (1, 2, 3) and year(event_date) in ((select y from modal), (select y from modal) + 1)))
        then 'outside_window' end) as drop_reason from early""")
    add("unique_rows", ["tagged"], """select * from tagged where drop_reason is null
        qualify row_number() over (partition by id order by file_name, line_no) = 1""")
    add("cleaned", ["unique_rows"], f"""select *, {case_map('ActionGeo_CountryCode', C.COUNTRY_NAMES)} as country
        from unique_rows""")


cleaning_ctes()

_REPORT = """select (select count(*) from tagged) as rows_raw,
  (select count(*) from tagged where drop_reason = 'invalid_date') as invalid_dates_dropped,
  (select count(*) from tagged where drop_reason = 'beyond_cutoff') as rows_beyond_cutoff,
  (select count(*) from tagged where drop_reason = 'outside_countries') as rows_outside_countries,
  (select count(*) from tagged where drop_reason = 'null_quad') as null_quad_dropped,
  (select count(*) from tagged where drop_reason = 'outside_window') as rows_outside_window,
  (select count(*) from tagged where drop_reason is null) - (select count(*) from cleaned) as duplicates_removed,
  (select count(*) from cleaned) as rows_final, (select y::int from modal) as dominant_year,
  (select min(event_date) from cleaned) as date_min, (select max(event_date) from cleaned) as date_max,
  (select string_agg(country || '=' || n, ', ' order by country) from (select country, count(*) as n from cleaned
   group by 1)) as countries"""


def flat_report(report):
    pairs = F.transform(F.map_entries("countries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.withColumn("countries", F.array_join(F.array_sort(pairs), ", "))


@query("agg14_cleaning_report", with_ctes(_REPORT, "tagged", "cleaned"), dates="date_min date_max")
def _(spark, sf):
    return flat_report(clean.cleaning_report(W.raw_view(spark, sf)))


@query("agg15_data_quality", with_ctes(f"""select rows_raw, rows_final, invalid_dates_dropped, duplicates_removed,
    rows_outside_countries, rows_outside_window, cast(date_min as varchar) || ' → ' || cast(date_max as varchar) as date_range,
    countries, (select count(distinct event_date) from cleaned) as unique_days,
    (select {rnd("avg(case when Actor1Name is null or Actor2Name is null then 1e0 else 0e0 end) * 100", 1)} from cleaned)
      as missing_actor_pct from ({_REPORT})""", "tagged", "cleaned"))
def _(spark, sf):
    raw = W.raw_view(spark, sf)
    return flat_report(clean.data_quality(clean.cleaning_report(raw), clean.clean_events(raw)))


@query("src9_json_report", with_ctes(
    "select country, count(*) as spikes, max(z_score) as max_z, min(day) as first_day from spikes group by 1", "spikes"),
    dates="first_day")
def _(spark, sf):
    path = scratch(spark)
    report = B.burst_table(slim(spark, sf)).where("is_burst").groupBy("country").agg(
        F.count(F.lit(1)).alias("spikes"), F.max("z_score").alias("max_z"), F.min("day").alias("first_day"))
    tables.save_report(report, path)
    return spark.read.schema("country string, spikes bigint, max_z double, first_day date").json(path)


@query("src10_stored_rules", with_ctes(
    """select day, country, event_count, z_score, z_score > 1.5e0 and event_count >= 10 as is_burst from scored""",
    "scored"), dates="day")
def _(spark, sf):
    """Spike rules written, read back and applied."""
    path = scratch(spark)
    tables.save_table(tables.run_parameters(spark, 7, 1.5, 10), path)
    r = tables.load_table(spark, path).first()
    return B.detect_bursts(slim(spark, sf), r.rolling_window, r.z_threshold, r.min_events).select(
        "day", "country", "event_count", "z_score", "is_burst")


# --- projections ---------------------------------------------------------------

@query("prj1_keep_columns", with_ctes(f"select {', '.join(KEPT_COLUMNS)} from raw", "raw"))
def _(spark, sf):
    return W.raw_view(spark, sf).select(*KEPT_COLUMNS)


@query("prj2_parse_dates", with_ctes("select line_no, event_date from typed", "typed"), dates="event_date")
def _(spark, sf):
    return clean.cast_columns(W.raw_view(spark, sf)).select("line_no", "event_date")


_DBL = "GoldsteinScale AvgTone ActionGeo_Lat ActionGeo_Long"
_LNG = "GLOBALEVENTID NumMentions NumSources NumArticles"


@query("prj3_coerce_numbers", with_ctes("select line_no, " + ", ".join(
    [f"try_cast({c} as double) as {c}" for c in _DBL.split()]
    + [f"try_cast({c} as double)::bigint as {c}" for c in _LNG.split()]) + ", quad as QuadClass from typed", "typed"))
def _(spark, sf):
    return clean.cast_columns(W.raw_view(spark, sf)).select("line_no", "QuadClass", *_DBL.split(), *_LNG.split())


@query("prj4_clean_actors", with_ctes(
    f"select line_no, {clean_actor('Actor1Name')} as actor1, {clean_actor('Actor2Name')} as actor2 from raw", "raw"))
def _(spark, sf):
    return W.raw_view(spark, sf).select("line_no", X.clean_actor(F.col("Actor1Name")).alias("actor1"),
                                        X.clean_actor(F.col("Actor2Name")).alias("actor2"))


@query("prj5_missing_actor_flag", with_ctes(
    "select line_no, Actor1Name is null or Actor2Name is null as has_missing_actor from raw", "raw"))
def _(spark, sf):
    return W.raw_view(spark, sf).select(
        "line_no", (F.col("Actor1Name").isNull() | F.col("Actor2Name").isNull()).alias("has_missing_actor"))


def simple(name, columns, dates="", floats=""):
    """A query over derived event columns and its SQL."""
    names = columns.split()
    needs_all = any(c in ("location", "text_for_tfidf", "source_url", "source_domain") for c in names)

    @query(name, with_ctes(f"select event_id, {', '.join(names)} from ev", "ev"), dates=dates, floats=floats)
    def _(spark, sf):
        return (events if needs_all else slim)(spark, sf).select("event_id", *names)


simple("prj6_date_parts", "day year month month_label week_label", dates="day")
simple("prj8_class_labels", "quad_label event_type")
simple("prj9_family_label", "root_label")
simple("prj10_actor_pair", "actor_pair")
simple("prj11_event_label", "event_label")
simple("prj12_event_strength", "event_strength")
simple("prj13_text_field", "text_for_tfidf")
simple("prj14_source_domain", "source_domain")


@query("prj7_country_names", with_ctes(
    f"select line_no, {case_map('ActionGeo_CountryCode', C.COUNTRY_NAMES)} as country from raw", "raw"))
def _(spark, sf):
    return W.raw_view(spark, sf).select(
        "line_no", X.lookup(C.COUNTRY_NAMES, F.col("ActionGeo_CountryCode")).alias("country"))


@query("prj15_country_pair", with_ctes(
    "select line_no, coalesce(Actor1CountryCode, 'UNK') || ' → ' || coalesce(Actor2CountryCode, 'UNK') as country_pair from raw",
    "raw"))
def _(spark, sf):
    unk = F.lit("UNK")
    return W.raw_view(spark, sf).select("line_no", F.concat(
        F.coalesce("Actor1CountryCode", unk), F.lit(" → "), F.coalesce("Actor2CountryCode", unk)).alias("country_pair"))


@query("prj16_tone_label", with_ctes(f"select event_id, {tone_label('avg_tone')} as tone from ev", "ev"))
def _(spark, sf):
    return slim(spark, sf).select("event_id", X.tone_label(F.col("avg_tone")).alias("tone"))


@query("prj17_tone_with_value", with_ctes(
    f"select event_id, {tone_label('avg_tone')} || ' (' || {fixed('avg_tone', 1)} || ')' as tone from ev", "ev"))
def _(spark, sf):
    return slim(spark, sf).select("event_id", X.tone_with_value(F.col("avg_tone")).alias("tone"))


@query("prj18_goldstein_label", with_ctes("""select event_id, case when goldstein is null then 'Unknown'
    when goldstein <= -7 then 'Extreme Conflict' when goldstein <= -3 then 'High Conflict'
    when goldstein < 0 then 'Low Conflict' when goldstein = 0 then 'Neutral' when goldstein <= 3 then 'Low Cooperation'
    when goldstein <= 7 then 'High Cooperation' else 'Extreme Cooperation' end as intensity from ev""", "ev"))
def _(spark, sf):
    return slim(spark, sf).select("event_id", X.goldstein_label(F.col("goldstein")).alias("intensity"))


@query("prj20_spike_severity", with_ctes(
    "select day, country, case when z_score >= 3 then 'High' else 'Moderate' end as severity from spikes", "spikes"),
    dates="day")
def _(spark, sf):
    return B.burst_table(slim(spark, sf)).where("is_burst").select(
        "day", "country", X.severity(F.col("z_score")).alias("severity"))


@query("prj21_display_names", with_ctes(
    """select event_id, cast(event_date as varchar) as "Date", country as "Country", actor1 as "Actor 1",
    quad_label as "Event Class", avg_tone as "Tone", location as "Location", source_domain as "Source" from ev""", "ev"))
def _(spark, sf):
    df = events(spark, sf).select("event_id", F.col("event_date").cast("string").alias("event_date"), "country", "actor1",
                                  "quad_label", "avg_tone", "location", "source_domain")
    return clean.with_display_names(df)


@query("prj23_picker_labels", with_ctes(
    """select event_id, strftime(event_date, '%b %d') || '  ·  ' || (case when actor1 <> 'Unknown' then actor1 else '—' end)
    || ' → ' || (case when actor2 <> 'Unknown' then actor2 else '—' end) || '  ·  ' || coalesce(quad_label, '') as label
    from ev""", "ev"))
def _(spark, sf):
    return slim(spark, sf).select("event_id", A.picker_label().alias("label"))


# --- filters -------------------------------------------------------------------

@query("flt1_countries", with_ctes(f"select line_no from raw where ActionGeo_CountryCode in {_COUNTRY}", "raw"))
def _(spark, sf):
    return W.raw_view(spark, sf).where(F.col("ActionGeo_CountryCode").isin(*C.COUNTRY_NAMES)).select("line_no")


@query("flt2_cutoff", with_ctes(f"select line_no, event_date from typed where event_date <= date '{C.CUTOFF_DATE}'", "typed"),
       dates="event_date")
def _(spark, sf):
    return clean.cast_columns(W.raw_view(spark, sf)).where(
        F.col("event_date") <= F.lit(C.CUTOFF_DATE).cast("date")).select("line_no", "event_date")


@query("flt3_required_fields", with_ctes(
    "select line_no from typed where event_date is not null and quad is not null", "typed"))
def _(spark, sf):
    return clean.cast_columns(W.raw_view(spark, sf)).na.drop(subset=["event_date", "QuadClass"]).select("line_no")


@query("flt4_season", with_ctes("select line_no, drop_reason from tagged", "tagged"))
def _(spark, sf):
    return clean.tag_stages(W.raw_view(spark, sf)).select("line_no", "drop_reason")


@query("flt5_country_and_type", with_ctes(
    "select event_id from ev where country in ('India', 'Iran') and event_type in ('Conflict')", "ev"))
def _(spark, sf):
    return A.apply_filters(slim(spark, sf), ["India", "Iran"], ["Conflict"]).select("event_id")


@query("flt6_search", with_ctes("""select event_id, 'text' as kind from ev where contains(lower(actor1), 'actor 7')
    or contains(lower(actor2), 'actor 7') or contains(lower(location), 'actor 7')
    union all select event_id, 'id' from ev where event_id = 42 union all select event_id, 'none' from ev""", "ev"))
def _(spark, sf):
    """A text that occurs, an id that exists and a text that does not occur (all rows)."""
    ev = events(spark, sf, url=False)
    hits = [A.search(ev, q).select("event_id", F.lit(k).alias("kind"))
            for q, k in ((" Actor 7", "text"), ("42", "id"), ("no such place", "none"))]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@query("flt7_near_day", with_ctes("""select event_id, 'in' as kind from ev where event_date between date '2024-01-08' and
    date '2024-01-22' union all select event_id, 'out' from ev""", "ev"))
def _(spark, sf):
    ev = slim(spark, sf)
    return A.near_day(ev, "2024-01-15").select("event_id", F.lit("in").alias("kind")).unionByName(
        A.near_day(ev, "2030-01-15").select("event_id", F.lit("out").alias("kind")))


@query("flt8_prefer_day_then_id", with_ctes(
    "select event_id from ev where day = date '2024-01-05' and (event_id = (select min(event_id) from ev where day = date "
    "'2024-01-05'))", "ev"))
def _(spark, sf):
    from spikelens.functions.dist import prefer

    ev = slim(spark, sf)
    first = ev.where("day = date '2024-01-05'").agg(F.min("event_id")).scalar()
    on_day = prefer(ev, F.col("day") == F.lit("2024-01-05").cast("date"))
    return prefer(on_day, F.col("event_id") == first).select("event_id")


@query("flt9_with_coordinates", with_ctes(
    "select event_id, lat, long from ev where lat is not null and long is not null", "ev"))
def _(spark, sf):
    return slim(spark, sf).na.drop(subset=["lat", "long"]).select("event_id", "lat", "long")


_SWAP = (("example.com", "news.bloomberg.com"), ("example.net", "wsj.com"))


@query("flt10_blocked_domains", f"""select page_id, url, {article_domain('url')} as domain from (select page_id,
    replace(replace(url, 'example.com', 'news.bloomberg.com'), 'example.net', 'wsj.com') as url from pages)
    where not {blocked('url')}""")
def _(spark, sf):
    """Page URLs with some hosts exchanged for blocked ones."""
    url = F.col("url")
    for old, new in _SWAP:
        url = F.replace(url, F.lit(old), F.lit(new))
    pages = W.table(spark, sf, "pages").select("page_id", url.alias("url"))
    return pages.where(~X.is_blocked(F.col("url"))).select("page_id", "url", X.article_domain(F.col("url")).alias("domain"))


@query("top5_first_per_event", with_ctes("select id as event_id, line_no, file_name from unique_rows", "unique_rows"))
def _(spark, sf):
    kept = clean.tag_stages(W.raw_view(spark, sf)).where("drop_reason is null").select(
        "GLOBALEVENTID", "line_no", "file_name")
    return clean.first_per_event(kept).select(F.col("GLOBALEVENTID").alias("event_id"), "line_no", "file_name")


@query("agg19_modal_year", with_ctes("select y::int as dominant_year from modal", "modal"))
def _(spark, sf):
    return clean.modal_year(clean.tag_stages(W.raw_view(spark, sf)).where(
        "drop_reason is null or drop_reason = 'outside_window'"))


@query("clean_events_end_to_end", with_ctes(f"""select id as event_id, event_date, country,
    {clean_actor('Actor1Name')} as actor1, {clean_actor('Actor2Name')} as actor2, {root_label('EventRootCode')} as root_label,
    {strength("try_cast(NumMentions as double)", "try_cast(NumSources as double)", "try_cast(AvgTone as double)",
              "try_cast(GoldsteinScale as double)")} as event_strength,
    {week('event_date')} as week_label, {domain('SOURCEURL')} as source_domain from cleaned""", "cleaned"),
       dates="event_date")
def _(spark, sf):
    return clean.clean_events(W.raw_view(spark, sf)).select(
        "event_id", "event_date", "country", "actor1", "actor2", "root_label", "event_strength", "week_label",
        "source_domain")
