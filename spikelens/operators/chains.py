"""Event chains: for many anchors at once, the best related events before and after.

The anchor side is the small one. It is widened to one row per day of its window,
which turns the date band into an equality, and is then broadcast when its counted
size allows, so the events are scanned where they lie and only the best rows per
anchor leave each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import among, attach, pin, settle, top_k_bounded

ANCHOR_COLUMNS = (
    "event_date", "country", "root_code", "root_label", "quad_class", "quad_label", "location", "actor1", "actor2",
    "actor1_cc", "actor2_cc", "avg_tone", "goldstein", "event_strength", "num_mentions",
)
RESULT_COLUMNS = (
    "event_id", "event_date", "actor1", "actor2", "country", "root_code", "root_label", "quad_label", "event_type",
    "avg_tone", "goldstein", "location", "source_url", "event_label", "event_strength", "quad_class",
)
# What the features and the narrow rows read of an event.
PAIR_COLUMNS = (
    "event_id", "event_date", "day", "country", "root_code", "quad_class", "location", "actor1", "actor2", "actor1_cc",
    "actor2_cc", "avg_tone", "goldstein", "event_strength", "num_mentions",
)
MAX_ANCHOR_DAYS = 100_000


def near_days(events: DataFrame, days: DataFrame, column: str, reach: int = 0) -> DataFrame:
    """Events within ``reach`` days of some day of a settled table, and maybe others of the same months.

    The span of days and the months, at most as many as there are months of events, become plain filters: stored months
    outside are not read, nor row groups outside the span.
    """
    around = F.sequence(F.date_sub(column, reach), F.date_add(column, reach))
    months = F.array_sort(F.collect_set("m"))
    span = days.select(column, F.explode(F.transform(around, lambda d: F.date_format(d, "yyyy-MM"))).alias("m")).agg(
        F.date_sub(F.min(column), reach).alias("lo"), F.date_add(F.max(column), reach).alias("hi"), months.alias("m")).first()
    if span.lo is None:
        return events.where(F.lit(False))
    if "month_label" in events.columns:
        events = events.where(F.col("month_label").isin(*span.m))
    return events.where(F.col("event_date").between(F.lit(span.lo), F.lit(span.hi)))


def anchor_rows(events: DataFrame, anchor_ids: DataFrame) -> DataFrame:
    """Attributes of the anchors, prefixed ``a_``; ids without a dated event drop out.

    When ``anchor_ids`` also says the ``event_date`` of each anchor, only the months of these dates are read; an id with
    a wrong date then counts as not found.
    """
    dated = ["event_date"] if "event_date" in anchor_ids.columns else []
    ids = settle(anchor_ids.select(F.col("anchor_id").alias("event_id"), *dated).distinct())
    if dated:
        events = near_days(events, ids, "event_date")
    found = attach(among(events, ids, "event_id"), ids, ["event_id", *dated], "left_semi", spread=["event_id"])
    return settle(
        found.where(F.col("event_date").isNotNull()).select(
            F.col("event_id").alias("anchor_id"),
            *[F.col(c).alias(f"a_{c}") for c in ANCHOR_COLUMNS if c in events.columns],
        )
    )


def candidate_pairs(
    events: DataFrame, anchors: DataFrame, window_days: int = 7, scope: str = "same", columns: Sequence[str] = ()
) -> DataFrame:
    """Anchor attributes beside every candidate event of the window.

    ``scope``: "same" country, "other" countries, or "any". ``columns`` of the events are made once per event; without,
    a column that is an expression may be computed again for every anchor that the event meets.
    """
    events = near_days(events, anchors, "a_event_date", window_days)
    if columns:
        events = pin(events, *[c for c in columns if c in events.columns])
    reach = F.sequence(F.date_sub("a_event_date", window_days), F.date_add("a_event_date", window_days))
    wide = anchors.withColumn("day", F.explode(reach))
    if scope == "same":
        keys, extra = ["country", "day"], None
        wide = wide.withColumn("country", F.col("a_country"))
    else:
        keys = ["day"]
        extra = F.col("country") != F.col("a_country") if scope == "other" else None
    pairs = attach(events, wide, keys, "inner", spread=["event_id"], max_rows=MAX_ANCHOR_DAYS)
    pairs = pairs.where(F.col("event_id") != F.col("anchor_id"))
    return pairs.where(extra) if extra is not None else pairs


def features() -> dict[str, Column]:
    """The 16 pair features over a row that holds ``a_*`` and candidate columns."""

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)).cast("double")

    def mentions(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(1)).cast("double"), F.lit(1.0))

    def shares(anchor_names, own_names, blanks) -> Column:
        hit = F.lit(False)
        for a in anchor_names:
            for c in own_names:
                same = (F.col(a) == F.col(c)) & ~F.col(a).isin(*blanks)
                hit = hit | F.coalesce(same, F.lit(False))
        return hit.cast("double")

    days = F.date_diff(F.col("event_date"), F.col("a_event_date"))
    same_country = flag(F.col("country") == F.col("a_country"))
    actor = shares(("a_actor1", "a_actor2"), ("actor1", "actor2"), ("Unknown", ""))
    return {
        "same_country": same_country,
        "same_event_root": F.col("root_code").eqNullSafe(F.col("a_root_code")).cast("double"),
        "same_quad_class": flag(F.col("quad_class") == F.col("a_quad_class")),
        "same_location": flag((F.col("location") == F.col("a_location")) & (F.col("a_location") != "")),
        "actor_exact_match": actor,
        "actor_country_match": shares(("a_actor1_cc", "a_actor2_cc"), ("actor1_cc", "actor2_cc"), ("UNK", "")),
        "actor_country_interact": actor * same_country,
        "tone_distance": F.least(F.abs(zero("avg_tone") - zero("a_avg_tone")) / 20.0, F.lit(1.0)),
        "goldstein_distance": F.least(F.abs(zero("goldstein") - zero("a_goldstein")) / 20.0, F.lit(1.0)),
        "temporal_decay": F.exp(-F.abs(days) / F.lit(C.TEMPORAL_TAU)),
        "is_precursor": (days < 0).cast("double"),
        "is_followup": (days > 0).cast("double"),
        "candidate_strength": F.least(zero("event_strength") / 10.0, F.lit(1.0)),
        "anchor_strength": F.least(zero("a_event_strength") / 10.0, F.lit(1.0)),
        "mention_ratio": F.least(mentions("num_mentions") / mentions("a_num_mentions"), F.lit(5.0)) / 5.0,
        "cross_country": ((same_country == 0) & (actor > 0)).cast("double"),
    }


def with_features(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(features())


def heuristic(weights: dict[str, float] = C.CHAIN_WEIGHTS) -> Callable[[], Column]:
    """Score of a row that already has the feature columns."""
    return lambda: X.np_round(X.dot({f: F.col(f) for f in C.FEATURES}, weights), 4)


def reason_codes() -> Column:
    """Comma-separated codes of the features that speak for a pair."""
    codes = [F.when(F.col(f) > 0, code) for f, code in C.REASON_CODES]
    codes.append(F.when(F.col("candidate_strength") > 0.5, "importance"))
    return F.array_join(F.array(*codes), ", ")  # nulls are skipped


def scored_pairs(events, anchors, window_days=7, scope="same", score=None) -> DataFrame:
    pairs = with_features(candidate_pairs(events, anchors, window_days, scope, PAIR_COLUMNS))
    return pairs.withColumn("chain_score", (score or heuristic())())


# What every chain row carries through the ranking: fixed-width columns only.
NARROW = ("event_id", "event_date", "goldstein", "quad_class")


def find_chains(
    events: DataFrame,
    anchors: DataFrame,
    window_days: int = 7,
    top_n: int = 5,
    scope: str = "same",
    score: Callable[[], Column] | None = None,
) -> DataFrame:
    """Chain rows of every anchor: ``side`` before/after, ``position`` in date order.

    Rows of the anchor's own day are shared out: up to half of the best ``top_n``
    of them fill free places before, the rest free places after. ``anchors`` comes
    from :func:`anchor_rows`. Equal scores are ordered by event id.

    Candidates are ranked as narrow rows; :func:`with_details` fetches the remaining
    columns for the few that made it.
    """
    side_of = F.signum(F.date_diff(F.col("event_date"), F.col("a_event_date"))).cast("int")
    ranked = top_k_bounded(
        scored_pairs(events, anchors, window_days, scope, score).select(
            "anchor_id", *NARROW, "chain_score", side_of.alias("pool")),
        ["anchor_id", "pool"], {"chain_score": True, "event_id": False}, top_n, "event_id",
    )
    everyone = Window.partitionBy("anchor_id")  # at most 3 * top_n rows per anchor from here on

    def size(pool: int) -> Column:
        return F.count(F.when(F.col("pool") == pool, 1)).over(everyone)

    half = F.greatest(F.floor(F.col("n_same") / 2), F.lit(1))
    to_before = F.least(F.lit(top_n) - F.col("n_before"), half)
    to_after = F.least(F.lit(top_n) - F.col("n_after"), F.col("n_same") - half)
    side = (
        F.when((F.col("pool") < 0) | ((F.col("pool") == 0) & (F.col("rank") <= to_before)), "before")
        .when((F.col("pool") > 0) | (F.col("rank") > F.col("n_same") - F.greatest(to_after, F.lit(0))), "after")
    )
    placed = (
        ranked.withColumns({"n_before": size(-1), "n_same": size(0), "n_after": size(1)})
        .withColumn("side", side)
        .where(F.col("side").isNotNull())
    )
    in_side = Window.partitionBy("anchor_id", "side").orderBy("event_date", F.desc("chain_score"), "event_id")
    return placed.withColumn("position", F.row_number().over(in_side)).drop(
        "pool", "rank", "n_before", "n_same", "n_after")


def with_details(chain: DataFrame, events: DataFrame, anchors: DataFrame, keep=RESULT_COLUMNS) -> DataFrame:
    """Settled chain rows with event columns, the 16 features and the reason codes."""
    wanted = chain.select(F.col("event_id"), "event_date", "anchor_id", "chain_score", "side", "position")
    events = among(near_days(events, wanted, "event_date"), wanted, "event_id")
    rows = attach(events, wanted, ["event_id", "event_date"], "inner", spread=["event_id"])
    pairs = attach(rows, anchors, ["anchor_id"], "inner", spread=["event_id"])
    kept = [c for c in keep if c in events.columns]
    return with_features(pairs).select(
        "anchor_id", "side", "position", "chain_score", *kept, reason_codes().alias("score_reasons"), *C.FEATURES)


def chain_strength(chain: DataFrame) -> DataFrame:
    """Strength labels against the chain's own maximum and against the fixed maximum."""
    best = F.max("chain_score").over(Window.partitionBy("anchor_id"))
    return chain.withColumns({
        "max_score": best,
        "strength": X.match_strength(F.col("chain_score"), best),
        "strength_fixed": X.match_strength(F.col("chain_score"), F.lit(C.CHAIN_MAX_SCORE)),
    })


def chain_summary(chain: DataFrame) -> DataFrame:
    return chain.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("linked"),
        F.avg("chain_score").alias("mean_score"),
        F.max("chain_score").alias("max_score"),
    )


def trajectories(chain: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per anchor: the ordered goldstein values, the classes and the number of events.

    Groups hold at most 2 * top_n + 1 rows, so collecting them is bounded.
    """
    order = {"before": 0, "anchor": 1, "after": 2}
    rows = chain.select("anchor_id", "event_date", "side", "position", "goldstein", "quad_class").unionByName(
        anchors.select("anchor_id", F.col("a_event_date").alias("event_date"), F.lit("anchor").alias("side"),
                       F.lit(1).alias("position"), F.col("a_goldstein").alias("goldstein"),
                       F.col("a_quad_class").alias("quad_class")))
    item = F.struct("event_date", X.lookup(order, F.col("side")).alias("part"), "position", "goldstein", "quad_class")
    items = rows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    values = F.filter(F.transform("items", lambda r: r["goldstein"]), lambda g: g.isNotNull())
    quads = F.filter(F.transform("items", lambda r: r["quad_class"]), lambda q: q.isNotNull())
    return items.select("anchor_id", F.size("items").alias("n_events"),
                        values.alias("goldstein_trajectory"), quads.alias("quads"))


def kendall(df: DataFrame, values: str = "goldstein_trajectory") -> DataFrame:
    """Add ``tau`` and ``p_value`` of an array against its own order (tau-b, normal p)."""

    def pair_sum(measure) -> Column:
        arr = F.col(values)
        inner = lambda x, i: F.aggregate(
            F.slice(arr, i + 2, F.size(arr)), F.lit(0.0), lambda acc, y: acc + measure(y - x))
        return F.aggregate(F.transform(arr, inner), F.lit(0.0), lambda acc, v: acc + v)

    n = F.size(values).cast("double")
    pairs = n * (n - 1) / 2
    s, ties = F.col("_s"), F.col("_ties")
    denom = F.sqrt(pairs * (pairs - ties))
    ok = (n >= 2) & (denom > 0)
    z = F.abs(s) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0)
    return (
        df.withColumn("_s", pair_sum(F.signum))
        .withColumn("_ties", pair_sum(lambda d: (d == 0).cast("double")))
        .withColumns({
            "tau": F.when(ok, s / denom).otherwise(0.0),
            "p_value": F.when(ok, 2.0 * X.norm_sf(z)).otherwise(1.0),
        })
        .drop("_s", "_ties")
    )


def classify(traj: DataFrame) -> DataFrame:
    """Trend of each trajectory; a falling goldstein is an escalation."""
    arr, quads = F.col("goldstein_trajectory"), F.col("quads")
    tau, p = F.col("tau"), F.col("p_value")
    mean = X.array_mean(arr)
    spread = F.sqrt(X.array_mean(F.transform(arr, lambda v: (v - mean) * (v - mean))))
    conflict = F.size(F.filter(quads, lambda q: q.isin(3, 4))) / F.size(quads)
    short = (
        F.when(F.size(quads) == 0, "Isolated")
        .when((conflict > 0.7) | (conflict < 0.3), "Persistence")
        .otherwise("Mixed")
    )
    alone, few = F.col("n_events") < 2, F.size(arr) < 3
    strong = (p < 0.10) & (F.abs(tau) > 0.3)
    wide = (p >= 0.10) & (spread > 4.0)
    pattern = (
        F.when(alone, "Isolated")
        .when(few, short)
        .when(strong & (tau < -0.3), "Escalation")
        .when(strong, "De-escalation")
        .when(wide, "Mixed")
        .when(p >= 0.10, "Persistence")
        .otherwise("Mixed")
    )
    confidence = (
        F.when(alone | few, "Low")
        .when(strong & (p < 0.05), "High")
        .when(strong | wide, "Moderate")
        .otherwise("Low")
    )
    plain = alone | few
    return kendall(traj).select(
        "anchor_id", "n_events", "goldstein_trajectory",
        pattern.alias("pattern"),
        confidence.alias("confidence"),
        F.when(plain, 0.0).otherwise(X.np_round(tau, 3)).alias("tau"),
        F.when(plain, 1.0).otherwise(X.np_round(p, 4)).alias("p_value"),
    )


def chain_patterns(chain: DataFrame, anchors: DataFrame, anchor_ids: DataFrame | None = None) -> DataFrame:
    """One pattern row per anchor; ids without an event give 'Unknown'."""
    patterns = classify(trajectories(chain, anchors))
    if anchor_ids is None:
        return patterns
    return anchor_ids.select("anchor_id").distinct().join(patterns, "anchor_id", "left").withColumns({
        "n_events": F.coalesce("n_events", F.lit(0)),
        "pattern": F.coalesce("pattern", F.lit("Unknown")),
        "confidence": F.coalesce("confidence", F.lit("Low")),
        "tau": F.coalesce("tau", F.lit(0.0)),
        "p_value": F.coalesce("p_value", F.lit(1.0)),
        "goldstein_trajectory": F.coalesce("goldstein_trajectory", F.array().cast("array<double>")),
    })


def end_means(arr: Column) -> tuple[Column, Column]:
    """Mean of the first two and of the last two values."""
    return X.array_mean(F.slice(arr, 1, 2)), X.array_mean(F.slice(arr, F.lit(-2), F.lit(2)))


def narratives(patterns: DataFrame, anchors: DataFrame) -> DataFrame:
    """A short text per anchor on its links, its trend and the change of intensity."""
    tau, p = X.fixed(F.col("tau"), 2), X.fixed(F.col("p_value"), 3)
    start, end = end_means(F.col("goldstein_trajectory"))
    a1, a2 = F.col("a_actor1"), F.col("a_actor2")
    actors = (
        F.when((a1 != "Unknown") & (a2 != "Unknown"), F.concat(a1, F.lit(" and "), a2))
        .when(a1 != "Unknown", a1)
        .otherwise("unidentified actors")
    )
    stats = F.concat(F.lit("τ="), tau, F.lit(", p="), p)
    trend = lambda word: F.concat(
        F.lit(f"The chain shows {word} pattern (Kendall "), stats, F.lit(", "), F.lower("confidence"),
        F.lit(" confidence) — "))
    linked = F.col("n_events") - 1
    lead = F.concat(
        F.lit("This "), F.lower(F.coalesce("a_quad_label", F.lit("event"))), F.lit(" event"),
        F.when(F.coalesce("a_root_label", F.lit("")) != "", F.concat(F.lit(" ("), F.lower("a_root_label"), F.lit(")")))
        .otherwise(""),
        F.lit(" involving "), actors,
        F.when(F.coalesce("a_country", F.lit("")) != "", F.concat(F.lit(" in "), F.col("a_country"))).otherwise(""),
        F.lit(" is connected to "), linked.cast("string"), F.lit(" related events."))
    shape = (
        F.when(F.col("pattern") == "Escalation", F.concat(
            trend("an escalation"), F.lit("conflict intensity increases over the sequence.")))
        .when(F.col("pattern") == "De-escalation", F.concat(
            trend("a de-escalation"), F.lit("tensions ease over the sequence.")))
        .when(F.col("pattern") == "Persistence", F.concat(
            F.lit("No significant directional trend detected — the event type persists with consistent intensity ("),
            stats, F.lit(").")))
        .when(F.col("pattern") == "Mixed", F.concat(
            F.lit("The chain shows high variability with no clear direction ("), stats,
            F.lit("). Events alternate between conflict and cooperation.")))
    )
    span = F.concat(F.lit(" (Goldstein: "), X.fixed(start, 1), F.lit(" → "), X.fixed(end, 1), F.lit(")."))
    enough = F.size("goldstein_trajectory") >= 3
    change = (
        F.when(enough & (end < start - 2), F.concat(F.lit("Conflict intensity increased"), span))
        .when(enough & (end > start + 2), F.concat(F.lit("Tensions eased over time"), span))
    )
    alone = F.lit("This event appears isolated — no strongly related events found nearby.")
    text = F.when(linked <= 0, alone).otherwise(F.concat_ws(" ", lead, shape, change))
    return patterns.join(anchors, "anchor_id").select("anchor_id", "pattern", text.alias("narrative"))


def _actor_keys(names: Sequence[str], codes: Sequence[str]) -> Column:
    """Different actors and actor country codes of a row that can link it to another one."""
    def keys(kind: str, columns: Sequence[str], blanks: Sequence[str]) -> list[Column]:
        return [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*blanks), F.concat(F.lit(kind), F.col(c))) for c in columns]

    return F.array_distinct(F.array_compact(F.array(
        *keys("a:", names, ("Unknown", "")), *keys("c:", codes, ("UNK", "")))))


def linked_pairs(events: DataFrame, anchors: DataFrame, window_days: int = 5) -> DataFrame:
    """Anchor attributes beside every event of the window in another country that shares an actor or an actor's code.

    Both sides are indexed by (day, actor or code), at most four entries a row and day, and meet in an equi-join; a pair
    that shares several keys counts under the first of the event's keys that the anchor has too, so it comes out once.
    """
    anchor_keys = _actor_keys(("a_actor1", "a_actor2"), ("a_actor1_cc", "a_actor2_cc"))
    reach = F.sequence(F.date_sub("a_event_date", window_days), F.date_add("a_event_date", window_days))
    index = anchors.withColumn("_theirs", anchor_keys).withColumn("day", F.explode(reach)).withColumn("_key", F.explode("_theirs"))
    own = events.withColumn("_keys", _actor_keys(("actor1", "actor2"), ("actor1_cc", "actor2_cc")))
    met = attach(own.withColumn("_key", F.explode("_keys")), index, ["day", "_key"], spread=["event_id"], max_rows=MAX_ANCHOR_DAYS)
    first = F.get(F.array_intersect("_keys", "_theirs"), F.lit(0))
    return met.where((F.col("country") != F.col("a_country")) & (F.col("event_id") != F.col("anchor_id"))
                     & (F.col("_key") == first)).drop("_key", "_keys", "_theirs")


def cross_country_links(events: DataFrame, anchors: DataFrame, window_days: int = 5, top_n: int = 5) -> DataFrame:
    """Best events in other countries that share an actor or an actor's country code.

    Only linked pairs are scored; they are ranked as narrow rows, and the other columns are fetched for the best.
    """
    pairs = with_features(linked_pairs(events.select(*PAIR_COLUMNS), anchors, window_days))
    scored = pairs.select("anchor_id", "event_id", heuristic(C.CROSS_COUNTRY_WEIGHTS)().alias("chain_score"))
    best = settle(top_k_bounded(scored, ["anchor_id"], {"chain_score": True, "event_id": False}, top_n, "event_id"))
    rows = attach(among(events, best, "event_id"), best, ["event_id"], spread=["event_id"])
    full = with_features(attach(rows, anchors, ["anchor_id"], spread=["event_id"]))
    kept = [c for c in RESULT_COLUMNS if c in events.columns]
    return full.select("anchor_id", *kept, "chain_score", reason_codes().alias("score_reasons"), "rank")


def countries_involved(links: DataFrame) -> DataFrame:
    return links.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("countries"))
