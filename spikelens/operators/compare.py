"""Facts of every spike and its comparison with earlier spikes of the same country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import settle
from .bursts import run_lengths


def day_facts(events: DataFrame) -> DataFrame:
    """One row per country and day with all counts and sums the reports need: one scan."""
    quad = F.col("quad_class")
    return settle(
        events.where(F.col("country").isNotNull()).groupBy("day", "country").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("avg_tone").alias("tone_sum"),
            F.count("avg_tone").alias("tone_n"),
            F.min("avg_tone").alias("tone_min"),
            F.max("avg_tone").alias("tone_max"),
            *[F.count_if(quad == q).alias(f"q{q}") for q in C.QUAD_LABELS],
        )
    )


def _by_day(low: int, high: int):
    number = F.date_diff(F.col("day"), F.lit("1970-01-01").cast("date"))
    return Window.partitionBy("country").orderBy(number).rangeBetween(low, high)


def top_quad():
    """Most frequent class label of a day, the first by name on ties."""
    names = sorted(C.QUAD_LABELS.values())
    entries = [F.struct(F.col(f"q{q}").alias("n"), F.lit(-names.index(label)).alias("o"), F.lit(label).alias("label"))
               for q, label in C.QUAD_LABELS.items()]
    best = F.array_max(F.array(*entries))
    return F.when(best["n"] > 0, best["label"]).otherwise("Unknown")


def trailing_tone(facts: DataFrame, days: int = 7) -> DataFrame:
    """Mean tone of the day and of the ``days`` calendar days before it."""
    before = _by_day(-days, -1)
    total, n = F.sum("tone_sum").over(before), F.sum("tone_n").over(before)
    return facts.select(
        "day", "country",
        F.when(F.col("tone_n") > 0, F.col("tone_sum") / F.col("tone_n")).alias("day_tone"),
        F.when(n > 0, total / n).alias("base_tone"),
    )


def tone_paths(facts: DataFrame, days: int = 3) -> DataFrame:
    """Daily mean tones from ``days`` before to ``days`` after each day, in order."""
    around = _by_day(-days, days)
    tone = F.when(F.col("tone_n") > 0, X.np_round(F.col("tone_sum") / F.col("tone_n"), 2))
    item = F.when(tone.isNotNull(), F.struct("day", tone.alias("tone")))
    listed = F.sort_array(F.collect_list(item).over(around))
    return facts.select("day", "country", F.transform(listed, lambda s: s["tone"]).alias("tone_trajectory"))


def spike_info(facts: DataFrame, bursts: DataFrame) -> DataFrame:
    """Count, baseline, z and tone shift of every spike; 0 shift when a side is unknown."""
    tone = trailing_tone(facts)
    delta = X.np_round(F.col("day_tone") - F.col("base_tone"), 2)
    return (
        bursts.where("is_burst").join(tone, ["day", "country"], "left")
        .select("day", "country", "event_count", F.col("rolling_mean").alias("baseline"), "z_score",
                F.coalesce(delta, F.lit(0.0)).alias("tone_delta"))
    )


def spike_stats(facts: DataFrame, bursts: DataFrame) -> DataFrame:
    """Full statistics of every spike."""
    keys = ["day", "country"]
    conflict = 100.0 * (F.col("q3") + F.col("q4")) / F.col("n")
    today = facts.select(
        *keys,
        F.when(F.col("tone_n") > 0, F.col("tone_sum") / F.col("tone_n")).alias("avg_tone"),
        conflict.alias("conflict_pct"), (100.0 - conflict).alias("coop_pct"), top_quad().alias("top_quad"))
    return (
        bursts.where("is_burst").select(*keys, "event_count", "z_score", F.col("rolling_mean").alias("baseline"))
        .join(today, keys, "left")
        .join(tone_paths(facts), keys, "left")
        .join(run_lengths(bursts).select(*keys, F.col("consecutive_days")), keys)
        .withColumns({
            "conflict_pct": F.coalesce("conflict_pct", F.lit(0.0)),
            "coop_pct": F.coalesce("coop_pct", F.lit(0.0)),
            "top_quad": F.coalesce("top_quad", F.lit("Unknown")),
            "tone_trajectory": F.coalesce("tone_trajectory", F.array().cast("array<double>")),
        })
    )


def earlier_spikes(spikes: DataFrame, n: int = 5) -> DataFrame:
    """For every spike its ``n`` latest predecessors in the same country.

    ``spikes`` has one row per spike; every column comes back as ``h_*``. A frame of
    ``n`` rows replaces a self join.
    """
    before = Window.partitionBy("country").orderBy("day").rowsBetween(-n, -1)
    others = [c for c in spikes.columns if c != "country"]
    past = F.collect_list(F.struct(*[F.col(c).alias(f"h_{c}") for c in others])).over(before)
    return (
        spikes.withColumn("_past", F.reverse(past))
        .select(*spikes.columns, F.posexplode("_past").alias("_i", "_h"))
        .select(*spikes.columns, (F.col("_i") + 1).alias("recency"), "_h.*")
    )


def direction():
    """Second half of the tone path against the first (half a point either way)."""
    arr = F.col("tone_trajectory")
    cut = F.floor(F.size(arr) / 2).cast("int")
    first = X.array_mean(F.slice(arr, F.lit(1), cut))
    second = X.array_mean(F.slice(arr, cut + 1, F.size(arr)))
    return (
        F.when(F.size(arr) < 3, "Insufficient data")
        .when(second < first - 0.5, "Escalating")
        .when(second > first + 0.5, "De-escalating")
        .otherwise("Stable")
    )


def compare_spikes(stats: DataFrame, n: int = 5) -> DataFrame:
    """Every spike against the mean of its predecessors; nulls and 'Unknown' without any."""
    one = F.lit(1.0)
    means = earlier_spikes(stats.drop("tone_trajectory", "top_quad", "coop_pct", "baseline"), n).groupBy(
        "country", "day").agg(
        F.count(F.lit(1)).alias("n_historical"),
        F.avg("h_event_count").alias("m_count"), F.avg("h_z_score").alias("m_z"), F.avg("h_avg_tone").alias("m_tone"),
        F.avg("h_conflict_pct").alias("m_conflict"), F.avg("h_consecutive_days").alias("m_days"))
    joined = stats.join(means, ["country", "day"], "left")
    has = F.col("n_historical").isNotNull()
    return joined.select(
        "day", "country",
        has.alias("has_history"),
        F.coalesce("n_historical", F.lit(0)).alias("n_historical"),
        X.np_round(F.col("event_count") / F.greatest("m_count", one), 2).alias("count_ratio_any"),
        X.np_round(F.col("z_score") / F.greatest("m_z", F.lit(0.01)), 2).alias("z_ratio_any"),
        X.np_round(F.col("avg_tone") - F.col("m_tone"), 2).alias("tone_diff"),
        X.np_round(F.col("conflict_pct") - F.col("m_conflict"), 1).alias("conflict_pct_diff"),
        X.np_round(F.col("consecutive_days") / F.greatest("m_days", one), 2).alias("duration_ratio_any"),
        F.when(has, direction()).otherwise("Unknown").alias("escalation_direction"),
        X.np_round(F.col("m_count"), 0).alias("avg_historical_count"),
        X.np_round(F.col("m_z"), 2).alias("avg_historical_z"),
        X.np_round(F.col("m_tone"), 2).alias("avg_historical_tone"),
    ).withColumns({  # greatest() skips nulls, so a ratio without history must be blanked
        c: F.when(F.col("has_history"), F.col(f"{c}_any")) for c in ("count_ratio", "z_ratio", "duration_ratio")
    }).drop("count_ratio_any", "z_ratio_any", "duration_ratio_any")


def versus_each(stats: DataFrame, n: int = 5) -> DataFrame:
    """Every spike against each of its predecessors."""
    slim = stats.select("country", "day", "event_count", "z_score", "avg_tone", "conflict_pct")
    return earlier_spikes(slim, n).select(
        "country", "day", "recency", F.col("h_day").alias("past_day"),
        X.np_round(F.col("event_count") / F.greatest("h_event_count", F.lit(1)), 2).alias("count_ratio"),
        X.np_round(F.col("z_score") - F.col("h_z_score"), 2).alias("z_diff"),
        X.np_round(F.col("avg_tone") - F.col("h_avg_tone"), 2).alias("tone_diff"),
        X.np_round(F.col("conflict_pct") - F.col("h_conflict_pct"), 1).alias("conflict_diff"),
    )


def comparison_table(stats: DataFrame, n: int = 5) -> DataFrame:
    """Display rows per spike: the spike itself (row 0, starred), then its predecessors."""
    slim = stats.select("country", "day", "event_count", "z_score", "avg_tone", "conflict_pct", "consecutive_days")
    own = ("day", "event_count", "z_score", "avg_tone", "conflict_pct", "consecutive_days")

    def rows(df, prefix, row_no, mark):
        c = {name: F.col(prefix + name) for name in own}
        return df.select(
            "country", F.col("day").alias("spike_day"), row_no.alias("row_no"),
            F.concat(F.date_format(c["day"], "yyyy-MM-dd"), F.lit(mark)).alias("date"),
            c["event_count"].alias("events"), X.np_round(c["z_score"], 2).alias("z"),
            X.np_round(c["avg_tone"], 2).alias("avg_tone"), X.np_round(c["conflict_pct"], 1).alias("conflict_pct"),
            c["consecutive_days"].alias("burst_days"))

    return rows(slim, "", F.lit(0), " ★").unionByName(rows(earlier_spikes(slim, n), "h_", F.col("recency"), ""))


def comparison_text(comparison: DataFrame) -> DataFrame:
    """Up to five sentences per spike, chosen by thresholds."""
    ratio, z, tone = F.col("count_ratio"), F.col("z_ratio"), F.col("tone_diff")
    conflict, n = F.col("conflict_pct_diff"), F.col("n_historical")
    mean, mean_z = X.grouped(F.col("avg_historical_count")), X.fixed(F.col("avg_historical_z"), 1)
    country = F.col("country")
    t = F.lit
    size = (
        F.when(ratio >= 1.5, F.concat(
            t("This spike is "), X.fixed(ratio, 1), t("× larger than the average of the previous "), n.cast("string"),
            t(" burst"), F.when(n == 1, "").otherwise("s"), t(" (historical mean: "), mean,
            t(" events), making it notably atypical.")))
        .when(ratio <= 0.7, F.concat(
            t("This spike is smaller than average, with event counts "), X.fixed((1 - ratio) * 100, 0),
            t("% below the historical mean of "), mean, t(" events.")))
        .otherwise(F.concat(
            t("Event volume is broadly consistent with historical spikes for "), country, t(", at "),
            X.fixed(ratio, 1), t("× the average of "), mean, t(" events.")))
    )
    intensity = (
        F.when(z >= 1.5, F.concat(
            t("The statistical intensity (z-score ratio: "), X.fixed(z, 1),
            t("×) significantly exceeds the historical average of "), mean_z,
            t("σ, indicating this is among the most statistically extreme events in the dataset.")))
        .when(z <= 0.7, F.concat(
            t("Despite the absolute event volume, the z-score ("), X.fixed(z, 1),
            t("×) is lower than historical averages ("), mean_z,
            t("σ), suggesting the baseline has also elevated.")))
    )
    mood = (
        F.when(tone < -1.5, F.concat(
            t("Tone is "), X.fixed(F.abs(tone), 1),
            t(" points more negative than the historical average for burst periods, suggesting an unusually "
              "adversarial or hostile environment compared to past spikes.")))
        .when(tone > 1.5, F.concat(
            t("Tone is "), X.fixed(tone, 1),
            t(" points more positive than historical burst averages, indicating a more cooperative character "
              "than previous spikes.")))
        .otherwise(F.concat(
            t("Tone (Δ"), X.signed(tone, 1),
            t(" vs. historical average) is broadly consistent with previous burst periods for this country.")))
    )
    mix = F.when(F.abs(conflict) >= 10, F.concat(
        t("The share of conflict-type events is "), X.fixed(F.abs(conflict), 0), t(" percentage points "),
        F.when(conflict > 0, "higher").otherwise("lower"),
        t(" than the historical average for burst days, which is analytically significant.")))
    path = F.when(F.col("escalation_direction").isin("Escalating", "De-escalating"), F.concat(
        t("The tone trajectory over the burst window shows a "), F.lower("escalation_direction"),
        t(" pattern, distinguishing this event from a simple one-day shock.")))
    none = F.concat(
        t("No historical burst data is available for "), country,
        t(", so a comparative assessment cannot be made. This appears to be the first detected spike in the "
          "current dataset."))
    text = F.when(F.col("has_history"), F.concat_ws(" ", size, intensity, mood, mix, path)).otherwise(none)
    return comparison.select("day", "country", text.alias("narrative"))
