"""Aggregations, spikes and display selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens.functions import exprs as X
from spikelens.operators import aggregate as A, bursts as B, keywords as K, silver as S
from spikelens.sources import tables
from spikelens.sources import world_events as W

from .cleaning import events, scratch, slim
from .registry import query
from .sql import add, fixed, grouped, rnd, tone_label, with_ctes


def bursts(spark, sf):
    return B.burst_table(slim(spark, sf))


# --- AGG -----------------------------------------------------------------------

_SUMMARY = """count(event_id) as total_events, count(*) filter (event_type = 'Conflict') as conflict_events,
    count(*) filter (event_type = 'Cooperation') as cooperation_events, avg(avg_tone) as avg_tone,
    avg(goldstein) as avg_goldstein"""


def _rollup(label: str, column: str, dates: str = ""):
    sql = with_ctes(f"""select *, {rnd('conflict_events / total_events::double', 4)} as conflict_ratio,
        {rnd('cooperation_events / total_events::double', 4)} as cooperation_ratio from (select {column} as period, country,
        {_SUMMARY}, sum(num_mentions)::bigint as total_mentions from ev group by 1, 2)""", "ev")

    @query(f"agg1_by_{label}", sql, floats="avg_tone avg_goldstein", dates=dates)
    def _(spark, sf):
        return A.by_period(slim(spark, sf), column)


_rollup("day", "day", "period")
_rollup("week", "week_label")
_rollup("month", "month_label")


@query("agg2_country_summary", with_ctes(f"select country, {_SUMMARY} from ev group by 1", "ev"),
       floats="avg_tone avg_goldstein")
def _(spark, sf):
    return A.by_country(slim(spark, sf))


@query("agg3_daily_counts", with_ctes("select * from daily", "daily"), dates="day")
def _(spark, sf):
    return A.daily_counts(slim(spark, sf))


@query("agg4_by_class", with_ctes("select country, quad_label, count(*) as events from ev group by 1, 2", "ev"))
def _(spark, sf):
    return A.by_class(slim(spark, sf))


@query("agg5_by_class_on_spikes", with_ctes(
    "select country, quad_label, count(*) as events from ev join spikes using (day, country) group by 1, 2", "ev", "spikes"))
def _(spark, sf):
    ev = slim(spark, sf)
    return A.by_class(B.events_on_bursts(ev, B.burst_table(ev)))


@query("agg6_conflict_shares", with_ctes("""select country, avg((event_type = 'Cooperation')::int) * 100 as cooperation,
    -avg((event_type = 'Conflict')::int) * 100 as conflict from ev group by 1""", "ev"), floats="cooperation conflict")
def _(spark, sf):
    return A.conflict_shares(slim(spark, sf))


@query("agg7_conflict_outliers", with_ctes("""select country_pair as country, avg((event_type = 'Conflict')::int) as
    conflict_share, (select avg((event_type = 'Conflict')::int) from ev) as overall_share from ev group by 1
    having conflict_share > overall_share + 0.1e0""", "ev"), floats="conflict_share overall_share")
def _(spark, sf):
    """Over pairs of actor countries, of which some do stand out."""
    return A.conflict_outliers(slim(spark, sf).withColumn("country", F.col("country_pair")))


@query("agg8_headline", with_ctes("""select count(*) as total_events, avg(avg_tone) as avg_tone,
    avg((event_type = 'Conflict')::int) * 100 as conflict_pct, (select count(*) from spikes) as spike_days from ev""",
                                  "ev", "spikes"), floats="avg_tone conflict_pct")
def _(spark, sf):
    ev = slim(spark, sf)
    return A.headline(ev, B.burst_table(ev))


add("mid", ["ev"], "select min(event_date) + cast(floor((max(event_date) - min(event_date)) / 2) as int) as day from ev")
add("halved", ["ev", "mid"], "select *, event_date <= (select day from mid) as in_first from ev")
add("halves", ["halved"], """select count(*) filter (in_first) as first_events, count(*) filter (not in_first) as second_events,
    avg(avg_tone) filter (in_first) as first_tone, avg(avg_tone) filter (not in_first) as second_tone,
    avg((event_type = 'Conflict')::int) filter (in_first) * 100 as first_conflict,
    avg((event_type = 'Conflict')::int) filter (not in_first) * 100 as second_conflict from halved""")
add("halves2", ["halves"], """select *, second_tone - first_tone as tone_delta,
    second_conflict - first_conflict as conflict_delta,
    (second_events - first_events) / greatest(first_events, 1)::double * 100 as pct_change from halves""")


@query("agg9_half_periods", with_ctes("""select *, case when pct_change > 5 then 'increasing' when pct_change < -5
    then 'decreasing' else 'stable' end as direction, case when tone_delta < -0.3e0 then 'more negative'
    when tone_delta > 0.3e0 then 'more positive' else 'stable' end as tone_shift from halves2""", "halves2"),
       floats="first_tone second_tone first_conflict second_conflict tone_delta conflict_delta pct_change")
def _(spark, sf):
    return A.halves_overall(slim(spark, sf))


add("country_halves", ["halved"], """select *, (second_events - first_events) / greatest(first_events, 1)::double * 100
    as pct_change from (select country, count(*) filter (in_first) as first_events,
    count(*) filter (not in_first) as second_events from halved group by 1)""")


@query("agg10_half_periods_by_country", with_ctes("""select *, case when first_events > 0 then pct_change end as trend_pct,
    case when pct_change > 0 then '▲' else '▼' end as arrow,
    case when pct_change > 10 then 'up' when pct_change < -10 then 'down' else 'flat' end as band from country_halves""",
                                                  "country_halves"), floats="pct_change trend_pct")
def _(spark, sf):
    return A.halves_by_country(slim(spark, sf))


@query("agg11_insights", with_ctes(f"""
    select 1 as insight_no, '**' || country || '** saw the largest shift — events ' || case when pct_change > 0
      then 'increased' else 'decreased' end || ' by ' || {fixed('abs(pct_change)', 0)} || '% in the second half of the window.'
      as text from (select * from cs order by abs(pct_change) desc, country limit 1) where abs(pct_change) > 10
    union all select 2, '**' || country || '** accounts for the most total events (' || {grouped('total')} || ').'
      from (select * from cs order by total desc, country limit 1)
    union all select 3, '**' || country || '** recorded the most spike days (' || n_spikes || ').'
      from (select * from cs order by n_spikes desc, country limit 1) where n_spikes > 0
    union all select 4, 'Conflict share is ' || case when conflict_delta > 0 then 'rising' else 'falling' end || ' overall ('
      || {fixed('first_conflict', 0)} || '% → ' || {fixed('second_conflict', 0)} || '%).' from halves2
      where abs(conflict_delta) > 5
    union all select 5, 'Overall tone has shifted ' || case when tone_delta < 0 then 'more negative' else 'more positive' end
      || ' (' || {fixed('first_tone', 1)} || ' → ' || {fixed('second_tone', 1)} || ').' from halves2
      where abs(tone_delta) > 0.5e0""", "halves2",
    cs=(("country_halves", "bursts"), """select c.*, first_events + second_events as total, (select count(*) from bursts b
        where b.country = c.country and is_burst) as n_spikes from country_halves c""")))
def _(spark, sf):
    ev = slim(spark, sf)
    return A.insights(ev, B.burst_table(ev))


@query("agg12_tone_histogram", with_ctes("""select country, least(floor((avg_tone - lo) / (hi - lo) * 50), 49)::int as bin,
    count(*) as events from ev, (select min(avg_tone) as lo, max(avg_tone) as hi from ev) group by 1, 2""", "ev"))
def _(spark, sf):
    return A.tone_histogram(slim(spark, sf))


@query("agg13_busiest_places", with_ctes(f"""select location, country, count(event_id) as events, {rnd('avg(avg_tone)', 1)}
    as tone from ev where location is not null group by 1, 2 order by events desc, location, country limit 5""", "ev"))
def _(spark, sf):
    return A.busiest_places(events(spark, sf, url=False))


@query("agg16_burst_sanity", with_ctes(f"""select count(*) as total_country_days, count(distinct day) as calendar_days,
    count(*) filter (is_burst) as burst_country_days,
    {rnd('count(*) filter (is_burst) / greatest(count(*), 1)::double', 4)} as burst_ratio,
    coalesce({rnd('avg(z_score) filter (is_burst)', 3)}, 0e0) as mean_z_on_burst, {rnd('max(z_score)', 3)} as max_z_score,
    (select string_agg(country || '=' || n, ', ' order by country) from (select country, count(*) as n from spikes group by 1))
      as bursts_per_country from bursts""", "bursts", "spikes"))
def _(spark, sf):
    pairs = F.transform(F.map_entries("bursts_per_country"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return B.sanity(bursts(spark, sf)).withColumn("bursts_per_country", F.array_join(F.array_sort(pairs), ", "))


@query("agg17_spike_page_figures", with_ctes("""select count(*) filter (is_burst) as spike_days,
    count(distinct day) as days_analysed, max(z_score) filter (not isinf(z_score)) as strongest,
    coalesce(avg(event_count) filter (is_burst), 0e0) as mean_events_on_spike from bursts""", "bursts"),
       floats="mean_events_on_spike")
def _(spark, sf):
    return B.page_figures(bursts(spark, sf))


# --- JN / WIN --------------------------------------------------------------------

@query("jn1_day_country_grid", with_ctes("select * from grid", "grid"), dates="day")
def _(spark, sf):
    from spikelens.functions.dist import settle

    return B.dense_days(settle(A.daily_counts(slim(spark, sf))))


@query("jn2_events_on_spikes", with_ctes("select event_id, day, country from ev semi join spikes using (day, country)",
                                         "ev", "spikes"), dates="day")
def _(spark, sf):
    ev = slim(spark, sf)
    return B.events_on_bursts(ev, B.burst_table(ev)).select("event_id", "day", "country")


@query("jn3_mark_spike_events", with_ctes("""select event_id, coalesce(is_burst, false) as on_burst from ev left join spikes
    using (day, country)""", "ev", "spikes"))
def _(spark, sf):
    ev = slim(spark, sf)
    return B.mark_bursts(ev, B.burst_table(ev)).select("event_id", "on_burst")


def sensitive(spark, sf):
    """Spikes at a lower threshold, so that countries share days."""
    return B.burst_table(slim(spark, sf), z_threshold=1.0)


add("spikes1", ["scored"], "select *, true as is_burst from scored where z_score > 1.0e0 and event_count >= 5")
add("bursts1", ["scored"], "select *, z_score > 1.0e0 and event_count >= 5 as is_burst from scored")


@query("win1_lagged_mean", with_ctes("select day, country, event_count, rolling_mean from baseline", "baseline"), dates="day")
def _(spark, sf):
    return bursts(spark, sf).select("day", "country", "event_count", "rolling_mean")


@query("win2_lagged_deviation", with_ctes("select day, country, event_count, rolling_std from baseline", "baseline"),
       dates="day")
def _(spark, sf):
    return bursts(spark, sf).select("day", "country", "event_count", "rolling_std")


@query("win3_detect_bursts", with_ctes("select * from bursts", "bursts"), dates="day")
def _(spark, sf):
    return B.detect_bursts(slim(spark, sf))


add("orders_daily", [], """select cast(o_orderdate as date) as day, r_name as country, count(*) as event_count from orders
    join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
    group by 1, 2""")


def orders_as_events(spark, sf):
    """Orders as events of their customer's region."""
    t = lambda n: W.table(spark, sf, n)
    return (
        t("orders").join(t("customer"), F.expr("c_custkey = o_custkey"))
        .join(t("nation"), F.expr("n_nationkey = c_nationkey")).join(t("region"), F.expr("r_regionkey = n_regionkey"))
        .select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("day"),
                F.col("r_name").alias("country"))
    )


_LONG = {
    "ogrid": (("orders_daily",), """select d.day, c.country, coalesce(x.event_count, 0) as event_count
        from (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from orders_daily) d
        cross join (select distinct country from orders_daily) c
        left join orders_daily x on x.day = d.day and x.country = c.country"""),
    "obase": (("ogrid",), f"""select *, {rnd('coalesce(avg(event_count) over w, 0e0)', 2)} as rolling_mean,
        {rnd('coalesce(stddev_samp(event_count) over w, 0e0)', 2)} as rolling_std from ogrid
        window w as (partition by country order by day rows between 7 preceding and 1 preceding)"""),
    "oscored": (("obase",), f"""select *, case when rolling_std > 0
        then {rnd('(event_count - rolling_mean) / rolling_std', 3)} else 0e0 end as z_score from obase"""),
}
for _name, (_needs, _text) in _LONG.items():
    add(_name, _needs, _text)


@query("win3_detect_bursts_long", with_ctes("select *, z_score > 2.0e0 and event_count >= 3 as is_burst from oscored",
                                            "oscored"), dates="day")
def _(spark, sf):
    """The same on years of orders per region."""
    return B.detect_bursts(orders_as_events(spark, sf), min_events=3)


@query("win4_confidence_band", with_ctes("""select day, country, event_count, rolling_mean,
    rolling_mean + 2 * rolling_std as upper, greatest(rolling_mean - 2 * rolling_std, 0e0) as lower from bursts""", "bursts"),
       floats="upper lower", dates="day")
def _(spark, sf):
    return B.band(bursts(spark, sf))


add("runs", ["bursts1"], """select day, country, count(*) over (partition by country, island) as run from (select day, country,
    day - cast(row_number() over (partition by country order by day) as int) as island from bursts1 where is_burst)""")


@query("win5_run_lengths", with_ctes("""select day, country, is_burst, case when is_burst then run else 1
    + coalesce(lag(run) over w, 0) + coalesce(lead(run) over w, 0) end as consecutive_days from (select b.day, b.country,
    b.is_burst, coalesce(r.run, 0) as run from bursts1 b left join runs r on r.day = b.day and r.country = b.country)
    window w as (partition by country order by day)""", "bursts1", "runs"), dates="day")
def _(spark, sf):
    return B.run_lengths(sensitive(spark, sf))


add("top8", ["spikes"], """select * from (select *, row_number() over (partition by country order by z_score desc, day) as rank
    from spikes) where rank <= 8""")


@query("win6_top_spikes_per_country", with_ctes("select day, country, event_count, z_score, rank::int as rank from top8", "top8"),
       dates="day")
def _(spark, sf):
    return B.top_per_country(bursts(spark, sf)).select("day", "country", "event_count", "z_score", "rank")


add("owners", ["ev", "top8"], """select day, country, event_id as anchor_id from ev semi join top8 using (day, country)
    qualify row_number() over (partition by day, country order by num_mentions desc nulls last, event_id) = 1""")


@query("win7_spike_anchors", with_ctes("select * from owners", "owners"), dates="day")
def _(spark, sf):
    from spikelens.functions.dist import settle

    ev = slim(spark, sf)
    return B.day_anchors(ev, settle(B.top_per_country(B.burst_table(ev))))


add("ospikes", ["oscored"], "select * from oscored where z_score > 2.0e0 and event_count >= 3")


def order_bursts(spark, sf):
    return B.burst_table(orders_as_events(spark, sf), min_events=3)


@query("win11_shared_days", with_ctes("""select day, count(*) as n_countries, string_agg(country, ', ' order by country) as
    countries from ospikes group by 1 having count(*) >= 2""", "ospikes"), dates="day")
def _(spark, sf):
    return B.shared_days(order_bursts(spark, sf))


@query("jn4_shared_day_rows", with_ctes("""select day, country, z_score, event_count, n_countries from ospikes join (select day,
    count(*) as n_countries from ospikes group by 1 having count(*) >= 2) using (day)""", "ospikes"), dates="day")
def _(spark, sf):
    return B.shared_day_rows(order_bursts(spark, sf))


# --- TOP -------------------------------------------------------------------------

@query("top1_burst_list", with_ctes("select day, country, event_count, rolling_mean, z_score from spikes", "spikes"), dates="day")
def _(spark, sf):
    return B.summary(bursts(spark, sf))


@query("top2_families_per_country", with_ctes("""select country, root_label, events, rank::int as rank from (select *,
    row_number() over (partition by country order by events desc, root_label) as rank from (select country, root_label,
    count(*) as events from ev where root_label is not null group by 1, 2)) where rank <= 10""", "ev"))
def _(spark, sf):
    return A.top_families(slim(spark, sf))


add("strong100", ["ev"], "select * from ev order by event_strength desc nulls last, event_id limit 100")


@query("top3_strongest", with_ctes("select event_id, event_date, event_strength from strong100", "strong100"), dates="event_date")
def _(spark, sf):
    return A.strongest(slim(spark, sf)).select("event_id", "event_date", "event_strength")


@query("top4_map_points", with_ctes("""select event_id, lat, long from ev where lat is not null and long is not null
    order by md5('42:' || event_id), event_id limit 15000""", "ev"))
def _(spark, sf):
    return A.map_points(slim(spark, sf)).select("event_id", "lat", "long")


@query("top8_sample_per_country", with_ctes("""select country, event_id, rank::int as rank from (select country, event_id,
    row_number() over (partition by country order by md5('42:' || event_id), event_id) as rank from ev) where rank <= 15""",
                                            "ev"))
def _(spark, sf):
    return S.sample_per_country(slim(spark, sf), 15).select("country", "event_id", "rank")


@query("top9_stratified_strong", with_ctes("""select event_id as anchor_event_id, cast(event_date as varchar) as date, country,
    actor1 || ' → ' || actor2 as actors, quad_label as event_type, expected_pattern, description from (select *,
    '' as expected_pattern, 'TODO: describe the expected chain' as description, row_number() over (partition by country
    order by md5('42:' || event_id), event_id) as r from (select * from ev order by event_strength desc nulls last, event_id
    limit 75)) where r <= 9 order by country, r limit 25""", "ev"))
def _(spark, sf):
    return S.chain_template(slim(spark, sf)).drop("relevant_event_ids")


@query("set5_common_days", """select cast(o_orderdate as date) as day from orders join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey where n_regionkey = 0 intersect select cast(o_orderdate as date) from orders
    join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where n_regionkey = 2""", dates="day")
def _(spark, sf):
    """Days on which both of two regions have orders."""
    regions = W.table(spark, sf, "region")
    name = lambda k: regions.where(F.col("r_regionkey") == k).select("r_name").scalar()
    days = orders_as_events(spark, sf)
    one = lambda k: days.where(F.col("country") == name(k)).select("day")
    return one(0).intersect(one(2))


@query("src13_missing_index_keys", with_ctes("select country, cast(day as varchar) as day from spikes1 where z_score < 1.5e0",
                                             "spikes1"))
def _(spark, sf):
    """A keyed store written in two runs, asked for keys it does not hold."""
    path = scratch(spark)
    found = sensitive(spark, sf).where("is_burst").select("country", F.col("day").cast("string").alias("day"), "z_score")
    tables.refresh_keyed(found.where("z_score >= 2.0"), path)
    tables.refresh_keyed(found.where("z_score >= 1.5 and z_score < 2.0"), path)
    stored = spark.read.schema("z_score double, country string, day string").parquet(path)
    return tables.missing_keys(found, stored)
