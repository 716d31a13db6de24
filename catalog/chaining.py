"""Event chains, links between countries, lead-lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens import config as C
from spikelens.functions import exprs as X
from spikelens.functions.dist import settle
from spikelens.operators import aggregate as A, bursts as B, chains as CH, leadlag as L
from spikelens.sources import world_events as W

from .activity import orders_as_events
from .chain_sql import REASONS, chain_ctes, norm_sf, pair_ctes, pattern_ctes, score
from .cleaning import events, slim
from .registry import query
from .sql import CTES, add, case_map, fixed, in_list, match_strength, rnd, with_ctes

# The chain page offers the 100 strongest events as anchors.
add("anchors100", ["strong100"], "select event_id as anchor_id from strong100")
for _ctes in (chain_ctes("c", "anchors100"), pattern_ctes("c")):
    for _name, (_needs, _text) in _ctes.items():
        add(_name, _needs, _text)
for _p, _scope, _w in (("o", "other", 5), ("x", "any", 7)):
    for _name, (_needs, _text) in pair_ctes(_p, "anchors100", _scope, _w).items():
        add(_name, _needs, _text)

SCORED = ("anchor_id", "event_id", "side", "position", "chain_score", "score_reasons")


def strong_anchors(ev):
    return CH.anchor_rows(ev, A.strongest(ev).select(F.col("event_id").alias("anchor_id"), "event_date"))


def placed(spark, sf):
    """Events with their place, without URLs."""
    return events(spark, sf, url=False)


def strong_chains(spark, sf):
    ev = placed(spark, sf)
    anchors = strong_anchors(ev)
    return settle(CH.find_chains(ev, anchors)), anchors


def detailed_chains(spark, sf, url=False):
    ev = events(spark, sf, url=url)
    anchors = strong_anchors(ev)
    return CH.with_details(settle(CH.find_chains(ev, anchors)), ev, anchors)


def pair_counts(pairs):
    before = F.count_if(F.col("event_date") < F.col("a_event_date"))
    after = F.count_if(F.col("event_date") > F.col("a_event_date"))
    return pairs.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("candidates"), before.alias("n_before"), after.alias("n_after"))


def _pairs_query(name, cte, scope, window):
    @query(name, with_ctes(f"""select anchor_id, count(*) as candidates, count(*) filter (event_date < a_event_date) as n_before,
        count(*) filter (event_date > a_event_date) as n_after from {cte} group by 1""", cte))
    def _(spark, sf):
        """Candidates of each anchor; the pairs themselves stay in the tasks."""
        ev = slim(spark, sf)
        return pair_counts(CH.candidate_pairs(ev, strong_anchors(ev), window, scope))


_pairs_query("jn5_candidates_same_country", "c_hits", "same", 7)
_pairs_query("jn6_candidates_other_countries", "o_hits", "other", 5)
@query("jn6_linked_candidates", with_ctes("""select anchor_id, count(*) as candidates, count(*) filter (event_date < a_event_date)
    as n_before, count(*) filter (event_date > a_event_date) as n_after from o_hits where actor_hit or code_hit group by 1""", "o_hits"))
def _(spark, sf):
    """Candidates in other countries that share an actor or a code, by the index of both."""
    ev = events(spark, sf, url=False)
    return pair_counts(CH.linked_pairs(ev, strong_anchors(ev)))


_pairs_query("jn7_candidates_any_country", "x_hits", "any", 7)


@query("set6_actor_overlap", with_ctes("""select anchor_id, count(*) filter (actor_hit) as same_actor,
    count(*) filter (code_hit) as same_code from x_hits group by 1""", "x_hits"))
def _(spark, sf):
    ev = slim(spark, sf).withColumn("location", F.lit(""))
    pairs = CH.with_features(CH.candidate_pairs(ev, strong_anchors(ev), 7, "any"))
    return pairs.groupBy("anchor_id").agg(F.count_if(F.col("actor_exact_match") > 0).alias("same_actor"),
                                          F.count_if(F.col("actor_country_match") > 0).alias("same_code"))


@query("chn1_pair_features", with_ctes(f"select anchor_id, event_id, {', '.join(C.FEATURES)} from c_chain", "c_chain"),
       floats=" ".join(C.FEATURES))
def _(spark, sf):
    """The feature vectors of all chain rows."""
    return detailed_chains(spark, sf).select("anchor_id", "event_id", *C.FEATURES)


@query("chn2_heuristic_scores", with_ctes(
    "select anchor_id, pool, count(*) as n, max(chain_score) as best, sum(chain_score) as total from c_scored group by 1, 2",
    "c_scored"), floats="total", places=4)
def _(spark, sf):
    """Scores of all candidates, summarised per anchor and side."""
    ev = placed(spark, sf)
    day = F.col("event_date")
    pool = F.when(day < F.col("a_event_date"), "before").when(day > F.col("a_event_date"), "after").otherwise("same")
    return CH.scored_pairs(ev, strong_anchors(ev)).groupBy("anchor_id", pool.alias("pool")).agg(
        F.count(F.lit(1)).alias("n"), F.max("chain_score").alias("best"), F.sum("chain_score").alias("total"))


@query("chn4_event_chains", with_ctes(f"select {', '.join(SCORED)} from c_chain", "c_chain"))
def _(spark, sf):
    return detailed_chains(spark, sf).select(*SCORED)


@query("set2_sides_with_same_day", with_ctes(
    "select anchor_id, side, count(*) as n, count(*) filter (pool = 'same') as same_day from c_chain group by 1, 2", "c_chain"))
def _(spark, sf):
    chain, anchors = strong_chains(spark, sf)
    own_day = F.col("event_date") == F.col("a_event_date")
    return chain.join(anchors.select("anchor_id", "a_event_date"), "anchor_id").groupBy("anchor_id", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own_day).alias("same_day"))


_RESULT = [c for c in CH.RESULT_COLUMNS if c != "event_date"]


@query("prj24_result_columns", with_ctes(f"""select anchor_id, cast(event_date as varchar) as event_date, chain_score,
    score_reasons, {', '.join(_RESULT)} from c_chain""", "c_chain"))
def _(spark, sf):
    return detailed_chains(spark, sf, url=True).select(
        "anchor_id", F.col("event_date").cast("string").alias("event_date"), "chain_score", "score_reasons", *_RESULT)


@query("prj19_match_strength", with_ctes(f"""select anchor_id, event_id, max_score,
    {match_strength('chain_score', 'max_score')} as strength, {match_strength('chain_score', '18e0')} as strength_fixed
    from (select *, max(chain_score) over (partition by anchor_id) as max_score from c_chain)""", "c_chain"))
def _(spark, sf):
    chain, _ = strong_chains(spark, sf)
    return CH.chain_strength(chain).select("anchor_id", "event_id", "max_score", "strength", "strength_fixed")


@query("prj22_readable_reasons", with_ctes(f"""select anchor_id, event_id, array_to_string(list_transform(
    list_filter(list_transform(string_split(score_reasons, ','), lambda k: trim(k)), lambda k: k <> ''),
    lambda k: coalesce({case_map('k', C.REASON_LABELS)}, k)), '; ') as reasons from c_chain""", "c_chain"))
def _(spark, sf):
    return detailed_chains(spark, sf).select("anchor_id", "event_id",
                        F.array_join(X.readable_reasons(F.col("score_reasons")), "; ").alias("reasons"))


@query("chn5_reason_codes", with_ctes("select score_reasons, count(*) as n from c_scored group by 1", "c_scored"))
def _(spark, sf):
    """How often each combination of codes occurs among all candidates."""
    ev = placed(spark, sf)
    return CH.scored_pairs(ev, strong_anchors(ev)).groupBy(CH.reason_codes().alias("score_reasons")).agg(
        F.count(F.lit(1)).alias("n"))


def flat_trajectory(df):
    text = F.transform("goldstein_trajectory", lambda g: X.fixed(g, 1))
    return df.withColumn("traj", F.array_join(text, ",")).drop("goldstein_trajectory")


@query("chn6_kendall", with_ctes("select anchor_id, n, tau, p from c_t", "c_t"), floats="tau p")
def _(spark, sf):
    chain, anchors = strong_chains(spark, sf)
    return CH.kendall(CH.trajectories(chain, anchors)).select(
        "anchor_id", F.size("goldstein_trajectory").cast("bigint").alias("n"), "tau", F.col("p_value").alias("p"))


@query("chn7_patterns", with_ctes("select anchor_id, n_events::int as n_events, traj, pattern, confidence, tau, p_value from "
                                  "c_pattern", "c_pattern"))
def _(spark, sf):
    chain, anchors = strong_chains(spark, sf)
    return flat_trajectory(CH.chain_patterns(chain, anchors))


_GS, _GE = "list_avg(list_slice(gs, 1, 2))", "list_avg(list_slice(gs, -2, -1))"
_STATS = f"'τ=' || {fixed('tau', 2)} || ', p=' || {fixed('p_value', 3)}"
_SPAN = f"' (Goldstein: ' || {fixed(_GS, 1)} || ' → ' || {fixed(_GE, 1)} || ').'"
_KT = f"pattern (Kendall ' || {_STATS} || ', ' || lower(confidence) || ' confidence) — "


@query("chn8_narratives", with_ctes(f"""select anchor_id, pattern, case when n_events <= 1
    then 'This event appears isolated — no strongly related events found nearby.' else concat_ws(' ',
    'This ' || lower(coalesce(a_quad_label, 'event')) || ' event' || case when coalesce(a_root_label, '') <> ''
      then ' (' || lower(a_root_label) || ')' else '' end || ' involving ' || case when a_actor1 <> 'Unknown' and
      a_actor2 <> 'Unknown' then a_actor1 || ' and ' || a_actor2 when a_actor1 <> 'Unknown' then a_actor1
      else 'unidentified actors' end || ' in ' || a_country || ' is connected to ' || (n_events - 1) || ' related events.',
    case pattern when 'Escalation' then 'The chain shows an escalation {_KT}conflict intensity increases over the sequence.'
      when 'De-escalation' then 'The chain shows a de-escalation {_KT}tensions ease over the sequence.'
      when 'Persistence' then 'No significant directional trend detected — the event type persists with consistent intensity ('
        || {_STATS} || ').' when 'Mixed' then 'The chain shows high variability with no clear direction (' || {_STATS} ||
        '). Events alternate between conflict and cooperation.' end,
    case when len(gs) >= 3 and {_GE} < {_GS} - 2 then 'Conflict intensity increased' || {_SPAN}
      when len(gs) >= 3 and {_GE} > {_GS} + 2 then 'Tensions eased over time' || {_SPAN} end) end as narrative
    from c_pattern join c_a using (anchor_id)""", "c_pattern", "c_a"))
def _(spark, sf):
    chain, anchors = strong_chains(spark, sf)
    return CH.narratives(CH.chain_patterns(chain, anchors), anchors)


@query("win9_trajectory_ends", with_ctes(f"""select anchor_id, {_GS} as g_start, {_GE} as g_end, case when {_GE} < {_GS} - 2
    then 'increased' when {_GE} > {_GS} + 2 then 'eased' else 'level' end as change from c_pattern where len(gs) >= 3""",
                                         "c_pattern"), floats="g_start g_end")
def _(spark, sf):
    chain, anchors = strong_chains(spark, sf)
    start, end = CH.end_means(F.col("goldstein_trajectory"))
    return CH.trajectories(chain, anchors).where(F.size("goldstein_trajectory") >= 3).select(
        "anchor_id", start.alias("g_start"), end.alias("g_end"),
        F.when(end < start - 2, "increased").when(end > start + 2, "eased").otherwise("level").alias("change"))


@query("agg26_chain_summary", with_ctes("""select anchor_id, count(*) as linked, avg(chain_score) as mean_score,
    max(chain_score) as max_score from c_chain group by 1""", "c_chain"), floats="mean_score")
def _(spark, sf):
    return CH.chain_summary(strong_chains(spark, sf)[0])


_CROSS = f"""select *, row_number() over (partition by anchor_id order by chain_score desc, event_id) as rank from (select *,
    {score(C.CROSS_COUNTRY_WEIGHTS)} as chain_score, {REASONS} as score_reasons from o_pairs
    where actor_exact_match > 0 or actor_country_match > 0) qualify rank <= 5"""
add("o_links", ["o_pairs"], _CROSS)


@query("chn9_cross_country_links", with_ctes(
    "select anchor_id, event_id, country, chain_score, score_reasons, rank::int as rank from o_links", "o_links"))
def _(spark, sf):
    ev = placed(spark, sf)
    return CH.cross_country_links(ev, strong_anchors(ev)).select(
        "anchor_id", "event_id", "country", "chain_score", "score_reasons", "rank")


@query("chn9_countries_involved", with_ctes("""select anchor_id, count(*) as n_links, (select string_agg(distinct country, ', '
    order by country) from o_links i where i.anchor_id = o.anchor_id) as countries from o_links o group by 1""", "o_links"))
def _(spark, sf):
    ev = placed(spark, sf)
    return CH.countries_involved(CH.cross_country_links(ev, strong_anchors(ev)))


@query("chn10_missing_anchors", with_ctes("""select i.anchor_id, coalesce(n_events, 0)::int as n_events,
    coalesce(pattern, 'Unknown') as pattern from (select anchor_id from anchors100 union select -1 - anchor_id from anchors100) i
    left join c_pattern p on p.anchor_id = i.anchor_id""", "anchors100", "c_pattern"))
def _(spark, sf):
    """Every second id asked for does not exist."""
    ev = placed(spark, sf)
    known = settle(A.strongest(ev).select(F.col("event_id").alias("anchor_id")))
    ids = known.unionByName(known.select((-1 - F.col("anchor_id")).alias("anchor_id")))
    anchors = CH.anchor_rows(ev, ids)
    chain = settle(CH.find_chains(ev, anchors))
    return CH.chain_patterns(chain, anchors, ids).select("anchor_id", "n_events", "pattern")


# --- lead-lag --------------------------------------------------------------------

def order_series(spark, sf):
    """Daily orders per region over several years, zero-filled."""
    dense = B.dense_days(settle(A.daily_counts(orders_as_events(spark, sf))))
    return settle(L.burst_series(dense))


def event_series(spark, sf, metric="z_score"):
    return settle(L.burst_series(B.burst_table(slim(spark, sf)), metric))


def lag_ctes(p: str, source: str, metric: str) -> None:
    add(f"{p}_series", [source], f"select country, day, {metric}::double as value from {source}")
    add(f"{p}_common", [f"{p}_series"], f"""select *, count(*) over (partition by country_a, country_b) as n_common,
        row_number() over (partition by country_a, country_b order by day) as pos from (select a.day, a.country as country_a,
        b.country as country_b, a.value as va, b.value as vb from {p}_series a join {p}_series b
        on a.day = b.day and a.country < b.country)""")
    df, z = "(n - 2)::double", "t"
    add(f"{p}_raw", [f"{p}_common"], f"""select a.country_a, a.country_b, lag, count(*) as n, covar_pop(a.va, b.vb) as cov,
        stddev_pop(a.va) as sa, stddev_pop(b.vb) as sb from (select *, unnest(range(-7, 8)) as lag from {p}_common
        where n_common >= 14) a join {p}_common b on a.country_a = b.country_a and a.country_b = b.country_b
        and b.pos = a.pos + a.lag group by 1, 2, 3 having count(*) >= 10""")
    add(f"{p}_r", [f"{p}_raw"], f"""select *, case when abs(r0) > 1 - 1e-12 then sign(r0)::double else r0 end as r from (select *,
        (sa < 1e-9 or sb < 1e-9) as flat, case when sa < 1e-9 or sb < 1e-9 then 0e0
        else greatest(-1e0, least(1e0, cov / (sa * sb))) end as r0 from {p}_raw)""")
    add(f"{p}_t", [f"{p}_r"], f"""select *, abs(r * sqrt({df} / case when abs(r) < 1 then 1 - r * r else 1e0 end))
        * case when n - 2 > 30 then 1e0 else sqrt(greatest({df} - 2, 0.5e0) / greatest({df}, 1e0)) end as z from {p}_r""")
    add(f"{p}_lags", [f"{p}_t"], f"""select country_a, country_b, lag::int as lag, n, {rnd('r', 4)} as correlation,
        case when flat then 1e0 when abs(r) >= 1 then 0e0 else {rnd(f"2e0 * {norm_sf('z')}", 4)} end as p_value from {p}_t""")
    add(f"{p}_best", [f"{p}_lags"], f"""select country_a, country_b, lag as best_lag, correlation as best_correlation,
        p_value as best_p_value from {p}_lags qualify row_number() over (partition by country_a, country_b
        order by (p_value < 0.05e0) desc, abs(correlation) desc, lag) = 1""")


lag_ctes("lo", "ogrid", "event_count")
lag_ctes("lz", "bursts", "z_score")


@query("jn8_shifted_pairs", with_ctes("""select a.country_a, a.country_b, lag::int as lag, count(*) as n, sum(a.va) as sum_a,
    sum(b.vb) as sum_b from (select *, unnest(range(-7, 8)) as lag from lo_common) a join lo_common b
    on a.country_a = b.country_a and a.country_b = b.country_b and b.pos = a.pos + a.lag group by 1, 2, 3""", "lo_common"))
def _(spark, sf):
    return L.shifted_pairs(L.common_days(order_series(spark, sf))).groupBy("country_a", "country_b", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_a").alias("sum_a"), F.sum("value_b").alias("sum_b"))


@query("lag1_pearson", with_ctes("select country_a, country_b, n, correlation, p_value from lo_lags where lag = 0", "lo_lags"))
def _(spark, sf):
    return L.lag_correlations(order_series(spark, sf), 0).drop("lag")


@query("lag2_correlations", with_ctes("select * from lo_lags", "lo_lags"))
def _(spark, sf):
    return L.lag_correlations(order_series(spark, sf))


@query("lag2_correlations_z", with_ctes("select * from lz_lags", "lz_lags"))
def _(spark, sf):
    return L.lag_correlations(event_series(spark, sf))


@query("lag3_best_lag", with_ctes("select * from lo_best", "lo_best"))
def _(spark, sf):
    return L.best_lags(L.lag_correlations(order_series(spark, sf)))


_TAIL = (f"'(' || case when best_correlation > 0 then 'positive' else 'inverse' end || ' r=' || {fixed('best_correlation', 3)} "
         "|| ')' || case when best_p_value < 0.05e0 then ' (statistically significant)' else '' end || '.'")


def sentence() -> str:
    precede = lambda a, b: (f"'Spikes in ' || {a} || ' precede spikes in ' || {b} || ' by ~' || abs(best_lag) || 'd ' "  # noqa: E731
                            f"|| {_TAIL}")
    return (f"case when abs(best_correlation) < 0.15e0 then 'No meaningful correlation between ' || country_a || ' and ' || "
            f"country_b || '.' when best_lag > 0 then {precede('country_a', 'country_b')} when best_lag < 0 then "
            f"{precede('country_b', 'country_a')} else 'Spikes in ' || country_a || ' and ' || country_b || ' co-occur ' "
            f"|| {_TAIL} end")


_REPORT_SQL = """select p.country_a, p.country_b, coalesce(n_common, 0) as n_common_days, best_lag, best_correlation,
    best_p_value, case when coalesce(n_common, 0) < 14 then 'Not enough overlapping dates (' || coalesce(n_common, 0) || ')'
    when best_lag is null then 'No valid lag computations' end as error, {sentence} as interpretation
    from (select a.country as country_a, b.country as country_b from (select distinct country from {p}_series) a
    join (select distinct country from {p}_series) b on a.country < b.country) p left join (select country_a, country_b,
    count(*) as n_common from {p}_common group by 1, 2) n on n.country_a = p.country_a and n.country_b = p.country_b
    left join {p}_best b on b.country_a = p.country_a and b.country_b = p.country_b"""


def report_sql(p: str) -> str:
    text = sentence().replace("country_a", "p.country_a").replace("country_b", "p.country_b")
    return with_ctes(_REPORT_SQL.format(p=p, sentence=text), f"{p}_best")


@query("lag4_all_pairs", report_sql("lo"))
def _(spark, sf):
    return L.pair_report(order_series(spark, sf))


@query("lag5_sentences", report_sql("lz"))
def _(spark, sf):
    return L.pair_report(event_series(spark, sf))
