"""Country and period summaries, half-period comparisons, display selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import prefer, settle, top_k


def _is(kind: str):
    return F.col("event_type") == kind


def _share(kind: str):
    """Share of rows of a kind; rows without a type count in the denominator."""
    return F.avg(F.coalesce(_is(kind), F.lit(False)).cast("int"))


def _summary_columns():
    return (
        F.count("event_id").alias("total_events"),
        F.count_if(_is("Conflict")).alias("conflict_events"),
        F.count_if(_is("Cooperation")).alias("cooperation_events"),
        F.avg("avg_tone").alias("avg_tone"),
        F.avg("goldstein").alias("avg_goldstein"),
    )


def by_period(events: DataFrame, period: str = "month_label") -> DataFrame:
    """Totals, means and conflict/cooperation ratios per period and country."""
    grouped = (
        events.where(F.col(period).isNotNull() & F.col("country").isNotNull())
        .groupBy(F.col(period).alias("period"), "country")
        .agg(*_summary_columns(), F.coalesce(F.sum("num_mentions"), F.lit(0)).alias("total_mentions"))
    )

    def ratio(column: str):
        return X.np_round(F.col(column) / F.greatest("total_events", F.lit(1)), 4)

    return grouped.withColumns({
        "conflict_ratio": ratio("conflict_events"),
        "cooperation_ratio": ratio("cooperation_events"),
    }).orderBy("period", "country")


def by_country(events: DataFrame) -> DataFrame:
    return events.where(F.col("country").isNotNull()).groupBy("country").agg(*_summary_columns())


def daily_counts(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("day").isNotNull() & F.col("country").isNotNull())
        .groupBy("day", "country")
        .agg(F.count("event_id").alias("event_count"))
    )


def by_class(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("country").isNotNull() & F.col("quad_label").isNotNull())
        .groupBy("country", "quad_label")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def conflict_shares(events: DataFrame) -> DataFrame:
    """Cooperation share and negated conflict share in percent, for a diverging view."""
    return events.where(F.col("country").isNotNull()).groupBy("country").agg(
        (_share("Cooperation") * 100).alias("cooperation"),
        (-_share("Conflict") * 100).alias("conflict"),
    )


def conflict_outliers(events: DataFrame, margin: float = 0.1) -> DataFrame:
    """Countries whose conflict share exceeds the overall share by more than ``margin``."""
    per_country = events.where(F.col("country").isNotNull()).groupBy("country").agg(
        F.count_if(_is("Conflict")).alias("conflict_events"), F.count(F.lit(1)).alias("total_events"))
    overall = events.agg(_share("Conflict")).scalar()
    return (
        per_country.select(
            "country",
            (F.col("conflict_events") / F.col("total_events")).alias("conflict_share"),
            overall.alias("overall_share"),
        )
        .where(F.col("conflict_share") > F.col("overall_share") + margin)
    )


def headline(events: DataFrame, bursts: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.avg("avg_tone").alias("avg_tone"),
        (_share("Conflict") * 100).alias("conflict_pct"),
    ).withColumn("spike_days", bursts.agg(F.count_if("is_burst")).scalar())


def middle_day(events: DataFrame):
    """Last day of the first half: min + half of the span, halves of a day dropped."""
    lo, hi = F.min("event_date"), F.max("event_date")
    return events.agg(F.date_add(lo, F.floor(F.date_diff(hi, lo) / 2).cast("int"))).scalar()


def with_half(events: DataFrame) -> DataFrame:
    return events.withColumn("in_first", F.col("event_date") <= middle_day(events))


def halves_overall(events: DataFrame) -> DataFrame:
    """Tone, conflict share and volume of the two halves of the time span."""
    first, second = F.col("in_first"), ~F.col("in_first")
    conflict = F.coalesce(_is("Conflict"), F.lit(False)).cast("int")
    out = with_half(events).agg(
        F.count_if(first).alias("first_events"),
        F.count_if(second).alias("second_events"),
        F.avg(F.when(first, F.col("avg_tone"))).alias("first_tone"),
        F.avg(F.when(second, F.col("avg_tone"))).alias("second_tone"),
        (F.avg(F.when(first, conflict)) * 100).alias("first_conflict"),
        (F.avg(F.when(second, conflict)) * 100).alias("second_conflict"),
    )
    zero = F.lit(0.0)
    out = out.withColumns({c: F.coalesce(c, zero) for c in out.columns if c.endswith(("tone", "conflict"))})
    change = (F.col("second_events") - F.col("first_events")) / F.greatest("first_events", F.lit(1)) * 100
    tone = F.col("second_tone") - F.col("first_tone")
    return out.withColumns({
        "tone_delta": tone,
        "conflict_delta": F.col("second_conflict") - F.col("first_conflict"),
        "pct_change": change,
        "direction": F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable"),
        "tone_shift": F.when(tone < -0.3, "more negative").when(tone > 0.3, "more positive").otherwise("stable"),
    })


def halves_by_country(events: DataFrame) -> DataFrame:
    """Change of event volume between the halves, per country.

    ``pct_change`` divides by at least one event; ``trend_pct`` is null where the
    first half has none.
    """
    n1, n2 = F.col("first_events"), F.col("second_events")
    pct = (n2 - n1) / F.greatest(n1, F.lit(1)) * 100
    return (
        with_half(events.where(F.col("country").isNotNull()))
        .groupBy("country")
        .agg(F.count_if("in_first").alias("first_events"), F.count_if(~F.col("in_first")).alias("second_events"))
        .withColumns({
            "pct_change": pct,
            "trend_pct": F.when(n1 > 0, pct),
            "arrow": F.when(pct > 0, "▲").otherwise("▼"),
            "band": F.when(pct > 10, "up").when(pct < -10, "down").otherwise("flat"),
        })
    )


def insights(events: DataFrame, bursts: DataFrame) -> DataFrame:
    """Notable facts as numbered sentences; a stable-activity sentence when there are none."""
    stats = (
        halves_by_country(events)
        .withColumn("total", F.col("first_events") + F.col("second_events"))
        .join(bursts.groupBy("country").agg(F.count_if("is_burst").alias("spikes")), "country", "left")
        .withColumn("spikes", F.coalesce("spikes", F.lit(0)))
    )
    by_name = F.struct("country", "pct_change", "total", "spikes")

    def best(measure):
        # max_by keeps one of several equal maxima; the inverted name makes it the first by name
        return F.min_by(by_name, F.struct(-measure, F.col("country")))

    top = stats.agg(
        best(F.abs("pct_change")).alias("shift"),
        best(F.col("total")).alias("busy"),
        best(F.col("spikes")).alias("spiky"),
        F.count(F.lit(1)).alias("n_countries"),
    )
    whole = settle(halves_overall(events))
    overall = settle(events.agg(F.avg("avg_tone").alias("tone"), F.count(F.lit(1)).alias("n")))
    one = top.withColumns({
        c: whole.select(c).scalar()
        for c in ("first_tone", "second_tone", "tone_delta", "first_conflict", "second_conflict", "conflict_delta")
    }).withColumns({"mean_tone": overall.select("tone").scalar(), "n_events": overall.select("n").scalar()})
    pct = F.col("shift.pct_change")
    td, cd = F.col("tone_delta"), F.col("conflict_delta")
    sentences = [
        F.when(F.abs(pct) > 10, F.concat(
            F.lit("**"), F.col("shift.country"), F.lit("** saw the largest shift — events "),
            F.when(pct > 0, "increased").otherwise("decreased"), F.lit(" by "), X.fixed(F.abs(pct), 0),
            F.lit("% in the second half of the window."))),
        F.when(F.col("busy.country").isNotNull(), F.concat(
            F.lit("**"), F.col("busy.country"), F.lit("** accounts for the most total events ("),
            X.grouped(F.col("busy.total")), F.lit(")."))),
        F.when(F.col("spiky.spikes") > 0, F.concat(
            F.lit("**"), F.col("spiky.country"), F.lit("** recorded the most spike days ("),
            F.col("spiky.spikes").cast("string"), F.lit(")."))),
        F.when(F.abs(cd) > 5, F.concat(
            F.lit("Conflict share is "), F.when(cd > 0, "rising").otherwise("falling"), F.lit(" overall ("),
            X.fixed(F.col("first_conflict"), 0), F.lit("% → "), X.fixed(F.col("second_conflict"), 0), F.lit("%)."))),
        F.when(F.abs(td) > 0.5, F.concat(
            F.lit("Overall tone has shifted "), F.when(td < 0, "more negative").otherwise("more positive"),
            F.lit(" ("), X.fixed(F.col("first_tone"), 1), F.lit(" → "), X.fixed(F.col("second_tone"), 1),
            F.lit(")."))),
    ]
    stable = F.concat(
        F.lit("Activity is stable across "), F.col("n_countries").cast("string"), F.lit(" countries ("),
        X.grouped(F.col("n_events")), F.lit(" events). Tone is "), F.lower(X.tone_label(F.col("mean_tone"))), F.lit("."))
    numbered = F.array(*[F.struct(F.lit(i + 1).alias("insight_no"), s.alias("text")) for i, s in enumerate(sentences)])
    present = F.filter(numbered, lambda s: s["text"].isNotNull())
    fallback = F.array(F.struct(F.lit(0).alias("insight_no"), stable.alias("text")))
    return one.select(F.explode(F.when(F.size(present) > 0, present).otherwise(fallback)).alias("s")).select("s.*")


def tone_histogram(events: DataFrame, bins: int = 50) -> DataFrame:
    """Counts per country in ``bins`` equal bins between the smallest and largest tone."""
    bounds = settle(events.agg(F.min("avg_tone").alias("lo"), F.max("avg_tone").alias("hi")))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    position = F.when(F.col("hi") > F.col("lo"), (F.col("avg_tone") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return (
        events.where(F.col("avg_tone").isNotNull() & F.col("country").isNotNull())
        .select("country", "avg_tone", lo.alias("lo"), hi.alias("hi"))
        .withColumn("bin", F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(bins - 1)).cast("int"))
        .groupBy("country", "bin")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def busiest_places(events: DataFrame, n: int = 5) -> DataFrame:
    places = (
        events.where(F.col("location").isNotNull() & F.col("country").isNotNull())
        .groupBy("location", "country")
        .agg(F.count("event_id").alias("events"), X.np_round(F.avg("avg_tone"), 1).alias("tone"))
    )
    return places.orderBy(F.desc("events"), "location", "country").limit(n)


def top_families(events: DataFrame, n: int = 10) -> DataFrame:
    counts = (
        events.where(F.col("country").isNotNull() & F.col("root_label").isNotNull())
        .groupBy("country", "root_label")
        .agg(F.count(F.lit(1)).alias("events"))
    )
    w = Window.partitionBy("country").orderBy(F.desc("events"), "root_label")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def strongest(events: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` strongest events, newest first."""
    order = [F.col("event_strength").desc_nulls_last(), F.col("event_id")]
    return top_k(events, [], order, n).drop("rank").orderBy(F.desc("event_date"), *order)


def hash_order(*columns: str, seed: str = "42"):
    """Repeatable pseudo-random order of rows, the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def smallest(df: DataFrame, n: int, hashed: str) -> DataFrame:
    """The ``n`` rows with the smallest hex hash, for ``n`` beyond a ranking window.

    Counting the leading digits first tells which of them can hold the ``n`` smallest;
    only those rows (``n`` and at most one 65536th of the table) are then sorted.
    """
    digits = F.substring(hashed, 1, 4)
    counts = df.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("c"))  # at most 65536 rows
    running = counts.withColumn("upto", F.sum("c").over(Window.orderBy("d")))
    last = running.where(F.col("upto") >= n).agg(F.coalesce(F.min("d"), F.lit("~"))).scalar()
    return df.where(digits <= last).orderBy(hashed, "event_id").limit(n)


def map_points(events: DataFrame, n: int = C.MAX_MAP_POINTS) -> DataFrame:
    """Rows with both coordinates; a seeded sample of exactly ``n`` when there are more."""
    placed = events.na.drop(subset=["lat", "long"])
    return smallest(placed.withColumn("_h", hash_order("event_id")), n, "_h").drop("_h")


def apply_filters(events: DataFrame, countries, kinds=None) -> DataFrame:
    out = events.where(F.col("country").isin(*countries))
    return out.where(F.col("event_type").isin(*kinds)) if kinds else out


def search(events: DataFrame, text: str) -> DataFrame:
    """Whole number: that event id; other text: part of an actor or place. No hit: everything."""
    query = text.strip().lower()
    try:
        hit = F.col("event_id") == int(text.strip())
    except ValueError:
        hit = F.lit(False)
        for c in ("actor1", "actor2", "location"):
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(query), F.lit(False))
    return prefer(events, hit)


def near_day(events: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Events within ``days`` of a day, or all of them when there are none."""
    d = F.lit(day).cast("date")
    return prefer(events, F.col("event_date").between(F.date_sub(d, days), F.date_add(d, days)))


def picker_label():
    """`Mon DD  ·  A → B  ·  class`, an unknown actor shown as a dash."""
    actor = lambda c: F.when(F.col(c) != "Unknown", F.col(c)).otherwise("—")
    return F.concat(
        F.date_format("event_date", "MMM dd"), F.lit("  ·  "), actor("actor1"), F.lit(" → "), actor("actor2"),
        F.lit("  ·  "), F.coalesce("quad_label", F.lit("")))


def country_sheet(events: DataFrame, bursts: DataFrame, keywords: DataFrame, n_keywords: int = 5) -> DataFrame:
    """Events, tone, conflict share, burst days and leading keywords per country."""
    base = events.where(F.col("country").isNotNull()).groupBy("country").agg(
        F.count("event_id").alias("event_count"),
        F.avg("avg_tone").alias("avg_tone"),
        (_share("Conflict") * 100).alias("conflict_pct"),
    )
    spikes = bursts.groupBy("country").agg(F.count_if("is_burst").alias("burst_days"))
    words = (
        keywords.where(F.col("rank") <= n_keywords)
        .groupBy("country")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))),
                                      lambda s: s["keyword"]), ", ").alias("top_keywords"))
    )
    return (
        base.join(spikes, "country", "left").join(words, "country", "left")
        .withColumns({
            "burst_days": F.coalesce("burst_days", F.lit(0)),
            "top_keywords": F.coalesce("top_keywords", F.lit("N/A")),
        })
    )
