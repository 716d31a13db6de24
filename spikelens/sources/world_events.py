"""The given star-schema tables presented as coded world events.

``EXPR`` holds one expression per column, over ``events`` joined to ``nation`` and
``pages``, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dist import pin

EXPR = {
    "event_id": "e.event_id",
    "event_date": "cast(e.ts as date)",
    "day": "cast(e.ts as date)",
    "country": "case e.user_id % 3 when 0 then 'USA' when 1 then 'India' else 'Iran' end",
    "quad_class": "case e.event_type when 'signup' then 1 when 'view' then 1 when 'purchase' then 2 "
                  "when 'click' then 3 else 4 end",
    "root_code": "lpad(cast(e.k % 20 + 1 as string), 2, '0')",
    "goldstein": "(e.k - 50) / 5.0e0",
    "avg_tone": "(50 - e.value) / 10.0e0",
    "num_mentions": "cast(floor(e.value) as bigint)",
    "num_sources": "e.k % 7",
    "actor1": "case when e.user_id % 10 = 0 then 'Unknown' "
              "else concat('Actor ', cast(e.user_id % 40 as string)) end",
    "actor2": "concat('Actor ', cast(e.event_id % 40 as string))",
    "has_missing_actor": "e.user_id % 10 = 0",
    "actor1_cc": "concat('C', cast(e.user_id % 12 as string))",
    "actor2_cc": "concat('C', cast(e.event_id % 12 as string))",
    "lat": "case when e.k % 10 = 0 then null else (e.user_id % 25) * 3.0e0 - 36 end",
    "long": "case when e.k % 10 = 0 then null else e.k * 3.0e0 - 150 end",
}
PLACE = {"location": "n.n_name"}
URL = {"source_url": "p.url"}

# The same events as an all-string export with the faults such files have.
RAW_EXPR = {
    "GLOBALEVENTID": "cast(e.event_id - case when e.event_id % 50 = 49 then 1 else 0 end as string)",
    "SQLDATE": "case e.k when 13 then '20240132' when 14 then '20270115' when 15 then '20240615' "
               "else replace(cast(cast(e.ts as date) as string), '-', '') end",
    "Actor1Code": "concat('A', cast(e.user_id % 40 as string))",
    "Actor1Name": "case e.user_id % 10 when 0 then null when 1 then '  ' when 2 then 'nan' "
                  "when 3 then 'AL-QAEDA' when 4 then 'O''NEIL' when 5 then 'U.S. ARMY' "
                  "else concat(' ACTOR ', cast(e.user_id % 40 as string)) end",
    "Actor1CountryCode": "case when e.user_id % 12 = 11 then null "
                         "else concat('C', cast(e.user_id % 12 as string)) end",
    "Actor2Code": "concat('A', cast(e.event_id % 40 as string))",
    "Actor2Name": "case e.event_id % 9 when 0 then null when 1 then 'None' when 2 then 'na' "
                  "else concat('actor ', cast(e.event_id % 40 as string)) end",
    "Actor2CountryCode": "concat('C', cast(e.event_id % 12 as string))",
    "Actor1Type1Code": "e.event_type",
    "EventCode": "cast(e.k % 20 + 1 as string)",
    "EventBaseCode": "cast(e.k % 20 + 1 as string)",
    "EventRootCode": "cast(e.k % 20 + 1 as string)",
    "QuadClass": "case when e.k = 16 then null when e.k = 17 then 'x' else case e.event_type when 'signup' then '1' "
                 "when 'view' then '1' when 'purchase' then '2' when 'click' then '3' else '4' end end",
    "GoldsteinScale": "case when e.k = 19 then 'bad' else cast((e.k - 50) / 5.0e0 as string) end",
    "NumMentions": "case when e.k = 20 then null else cast(cast(floor(e.value) as bigint) as string) end",
    "NumSources": "cast(e.k % 7 as string)",
    "NumArticles": "cast(e.k % 5 as string)",
    "AvgTone": "case when e.k = 18 then null else cast(cast((50 - e.value) / 10.0e0 as decimal(12, 3)) as string) end",
    "ActionGeo_Type": "cast(e.k % 5 as string)",
    "ActionGeo_FullName": "case when e.k = 21 then null else n.n_name end",
    "ActionGeo_CountryCode": "case when e.user_id % 7 = 6 then 'UK' when e.user_id % 3 = 0 then 'US' "
                             "when e.user_id % 3 = 1 then 'IN' else 'IR' end",
    "ActionGeo_Lat": "case when e.k % 10 = 0 then null else cast((e.user_id % 25) * 3 - 36 as string) end",
    "ActionGeo_Long": "case when e.k % 10 = 0 then null else cast(e.k * 3 - 150 as string) end",
    "SOURCEURL": "p.url",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, place: bool, url: bool) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    df = table(spark, sf_dir, "events").withColumn("k", k).alias("e")
    if place:
        nation = table(spark, sf_dir, "nation").alias("n")
        df = df.join(nation, F.expr("n.n_nationkey = e.user_id % 25"))
    if url:
        pages = table(spark, sf_dir, "pages").select("page_id", "url")
        # every page is some event's source; every thirteenth event has none
        n = max(1, pages.count())
        df = df.join(pages.alias("p"), F.expr(f"e.event_id % 13 <> 12 and p.page_id = e.event_id % {n}"), "left")
    return df


def events_view(spark: SparkSession, sf_dir: str, place: bool = True, url: bool = True) -> DataFrame:
    """Cleaned events; leave out ``place``/``url`` to save their dimension joins."""
    exprs = {**EXPR, **(PLACE if place else {}), **(URL if url else {})}
    return _joined(spark, sf_dir, place, url).selectExpr(*[f"{e} as {c}" for c, e in exprs.items()])


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept export columns as strings, with ``file_name`` (one per day) and ``line_no``."""
    exprs = {
        **RAW_EXPR,
        "file_name": "concat(replace(cast(cast(e.ts as date) as string), '-', ''), '.export.CSV')",
        "line_no": "e.event_id",
    }
    return pin(_joined(spark, sf_dir, True, True).selectExpr(*[f"{e} as {c}" for c, e in exprs.items()]))
