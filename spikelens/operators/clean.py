"""Cleaning and derived columns: raw strings to the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import pin, settle
from ..schemas import CLEAN_NAMES, KEPT_COLUMNS, NUMERIC_COLUMNS

LONGS = ("GLOBALEVENTID", "NumMentions", "NumSources", "NumArticles")


def cast_columns(raw: DataFrame) -> DataFrame:
    """Add ``event_date`` and turn the numeric columns into numbers; bad text becomes null."""
    typed = {}
    for c in NUMERIC_COLUMNS:
        number = F.col(c).try_cast("double")
        kind = "bigint" if c in LONGS else "int" if c == "QuadClass" else None
        typed[c] = number.cast(kind) if kind else number
    date = F.try_to_timestamp("SQLDATE", F.lit("yyyyMMdd")).cast("date")
    return raw.withColumns({**typed, "event_date": F.when(F.length("SQLDATE") == 8, date)})


def season_filter(dominant_year):
    """December of the modal year or the one before; Jan-Mar of the modal year or the one after."""
    year, month = F.year("event_date"), F.month("event_date")
    december = (month == 12) & year.isin(dominant_year - 1, dominant_year)
    spring = month.isin(1, 2, 3) & year.isin(dominant_year, dominant_year + 1)
    return december | spring


def modal_year(df: DataFrame) -> DataFrame:
    """One row: the most frequent year, the earliest on ties."""
    return (
        df.groupBy(F.year("event_date").alias("dominant_year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max_by("dominant_year", F.struct("n", -F.col("dominant_year"))).alias("dominant_year"))
    )


def counters():
    """Row counters of a cleaning run, over :func:`tag_stages` rows."""
    dropped = lambda reason: F.count_if(F.col("drop_reason") == reason)
    return (
        F.count(F.lit(1)).alias("rows_raw"),
        dropped("invalid_date").alias("invalid_dates_dropped"),
        dropped("beyond_cutoff").alias("rows_beyond_cutoff"),
        dropped("outside_countries").alias("rows_outside_countries"),
        dropped("null_quad").alias("null_quad_dropped"),
        dropped("outside_window").alias("rows_outside_window"),
        F.count_if(F.col("drop_reason").isNull()).alias("rows_kept"),
    )


def tag_stages(raw: DataFrame, cutoff: str = C.CUTOFF_DATE, country_codes=None) -> DataFrame:
    """Typed rows with ``drop_reason``: the first cleaning rule each row fails, else null.

    One pass gives both the kept rows and every counter of the cleaning report.
    Duplicates are not decided here; see :func:`first_per_event`.
    """
    codes = sorted(country_codes or C.COUNTRY_NAMES)
    typed = pin(cast_columns(raw))
    early = (
        F.when(F.col("event_date").isNull(), "invalid_date")
        .when(F.col("event_date") > F.lit(cutoff).cast("date"), "beyond_cutoff")
        .when(~F.coalesce(F.col("ActionGeo_CountryCode").isin(*codes), F.lit(False)), "outside_countries")
        .when(F.col("QuadClass").isNull(), "null_quad")
    )
    tagged = typed.withColumn("_early", early)
    year = settle(modal_year(tagged.where(F.col("_early").isNull()))).scalar()
    # (a when-chain with no match is null, so kept rows carry no reason)
    late = F.when(~season_filter(year), "outside_window")
    return tagged.withColumn("drop_reason", F.coalesce("_early", late)).drop("_early")


def first_per_event(df: DataFrame, id_col: str = "GLOBALEVENTID", order=("file_name", "line_no")) -> DataFrame:
    """One row per id, the earliest in file order.

    A grouped minimum leaves one row per id and partition before the shuffle. Rows
    are wide, so Spark sorts them by id for it on both sides.
    """
    others = [c for c in df.columns if c != id_col]
    kept = F.min_by(F.struct(*others), F.struct(*order)).alias("row")
    return df.groupBy(id_col).agg(kept).select(id_col, "row.*")


def enrich(events: DataFrame) -> DataFrame:
    """All derived columns of the events table that its own columns allow."""
    have = set(events.columns)
    new = {
        "year": F.year("event_date"),
        "month": F.month("event_date"),
        "month_label": F.date_format("event_date", "yyyy-MM"),
        "week_label": X.week_label(F.col("event_date")),
        "quad_label": X.quad_label(F.col("quad_class")),
        "event_type": X.event_type(F.col("quad_class")),
        "root_label": X.root_label(F.col("root_code")),
        "actor_pair": F.concat("actor1", F.lit(" → "), "actor2"),
        "event_strength": X.event_strength(
            F.col("num_mentions"), F.col("num_sources"), F.col("avg_tone"), F.col("goldstein")),
        "country_pair": F.concat(
            F.coalesce("actor1_cc", F.lit("UNK")), F.lit(" → "), F.coalesce("actor2_cc", F.lit("UNK"))),
    }
    df = events.withColumns(new)
    more = {
        "event_label": F.concat_ws(
            " | ", F.col("event_id").cast("string"), F.date_format("event_date", "yyyy-MM-dd"),
            F.col("actor_pair"), F.coalesce("quad_label", F.lit("Unknown"))),
    }
    if "location" in have:
        more["text_for_tfidf"] = text_field()
    if "source_url" in have:
        more["source_domain"] = X.source_domain(F.col("source_url"))
    return df.withColumns(more)


def text_field():
    """Actors, place, class and family in one text; missing parts leave their separator."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("actor1", "actor2", "location", "quad_label", "root_label")]
    return X.strip(F.concat_ws(" ", *parts))


def to_events(rows: DataFrame) -> DataFrame:
    """Typed, deduplicated export rows to the full events table."""
    base = rows.select(
        *[F.col(raw).alias(clean) for raw, clean in CLEAN_NAMES.items()],
        "event_date",
        F.col("event_date").alias("day"),
        X.lookup(C.COUNTRY_NAMES, F.col("ActionGeo_CountryCode")).alias("country"),
        X.clean_actor(F.col("Actor1Name")).alias("actor1"),
        X.clean_actor(F.col("Actor2Name")).alias("actor2"),
        (F.col("Actor1Name").isNull() | F.col("Actor2Name").isNull()).alias("has_missing_actor"),
        *[F.col(c) for c in KEPT_COLUMNS if c not in CLEAN_NAMES],
    )
    return enrich(base)


def clean_events(
    raw: DataFrame, cutoff: str = C.CUTOFF_DATE, order=("file_name", "line_no"), watch: Observation | None = None
) -> DataFrame:
    """Raw export rows to the events table.

    With ``watch``, the run that writes the table also gathers the counters of the
    cleaning report, see :func:`observed_report`; no further pass over the raw data.
    """
    tagged = tag_stages(raw, cutoff)
    if watch is not None:
        tagged = tagged.observe(watch, *counters())
    kept = tagged.where(F.col("drop_reason").isNull()).drop("drop_reason")
    return to_events(first_per_event(kept, order=order))


def _final_figures(events: DataFrame, year) -> DataFrame:
    """One row on the finished table: rows, dates, rows per country, modal year."""
    per_country = events.groupBy("country").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    return settle(per_country.agg(
        F.sum("n").alias("rows_final"),
        F.min("lo").alias("date_min"),
        F.max("hi").alias("date_max"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("country", "n")))).alias("countries"),
    ).withColumn("dominant_year", year))


def _report(counted: DataFrame, final: DataFrame) -> DataFrame:
    """Both are single rows."""
    return counted.select(
        "*", *[final.select(c).scalar().alias(c) for c in final.columns],
    ).withColumn("duplicates_removed", F.col("rows_kept") - F.col("rows_final")).drop("rows_kept")


def observed_report(watch: Observation, events: DataFrame) -> DataFrame:
    """Report of a finished write of :func:`clean_events`; ``events`` is the stored table."""
    found = watch.get
    counted = events.sparkSession.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in found.items()])
    year = modal_year(events.select("event_date")).scalar()
    return _report(counted, _final_figures(events, year))


def cleaning_report(raw: DataFrame, cutoff: str = C.CUTOFF_DATE) -> DataFrame:
    """One row of counters for a cleaning run, plus the rows kept per country."""
    tagged = tag_stages(raw, cutoff).select("GLOBALEVENTID", "event_date", "ActionGeo_CountryCode", "drop_reason",
                                            "file_name", "line_no")
    kept = tagged.where(F.col("drop_reason").isNull()).drop("drop_reason")
    unique = first_per_event(kept).select(
        "event_date", X.lookup(C.COUNTRY_NAMES, F.col("ActionGeo_CountryCode")).alias("country"))
    year = modal_year(tagged.where(F.coalesce(F.col("drop_reason") == "outside_window", F.lit(True)))).scalar()
    return _report(tagged.agg(*counters()), _final_figures(unique, year))


def data_quality(report: DataFrame, events: DataFrame) -> DataFrame:
    """Cleaning report with distinct days and the share of events missing an actor."""
    extra = settle(events.agg(
        F.countDistinct("day").alias("unique_days"),
        X.np_round(F.avg(F.col("has_missing_actor").cast("int")) * 100, 1).alias("missing_actor_pct"),
    ))
    return report.select(
        "rows_raw", "rows_final", "invalid_dates_dropped", "duplicates_removed", "rows_outside_countries",
        "rows_outside_window",
        F.concat(F.col("date_min").cast("string"), F.lit(" → "), F.col("date_max").cast("string")).alias("date_range"),
        "countries",
        extra.select("unique_days").scalar().alias("unique_days"),
        extra.select("missing_actor_pct").scalar().alias("missing_actor_pct"),
    )


def with_display_names(df: DataFrame) -> DataFrame:
    """Rename known columns for display, others stay."""
    return df.withColumnsRenamed({k: v for k, v in C.DISPLAY_NAMES.items() if k in df.columns})
