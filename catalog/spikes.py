"""Facts, comparisons and texts of spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens import config as C
from spikelens import fixed_text as T
from spikelens.functions import exprs as X
from spikelens.functions.dist import settle
from spikelens.operators import bursts as B, compare as P, evidence as V, keywords as K, reports as R
from spikelens.sources import world_events as W

from . import wording  # noqa: F401  (its SQL is used below)
from .activity import order_bursts, orders_as_events
from .cleaning import events, slim
from .registry import query
from .sql import CTES, add, fixed, grouped, quote, rnd, signed, with_ctes


def facts_and_bursts(spark, sf):
    ev = slim(spark, sf)
    return P.day_facts(ev), B.burst_table(ev)


# --- statistics of a spike -------------------------------------------------------

add("facts", ["ev"], """select day, country, count(*) as n, sum(avg_tone) as tone_sum, count(avg_tone) as tone_n,
    count(*) filter (quad_class = 1) as q1, count(*) filter (quad_class = 2) as q2, count(*) filter (quad_class = 3) as q3,
    count(*) filter (quad_class = 4) as q4 from ev group by 1, 2""")
add("tone7", ["facts"], """select f.day, f.country, f.tone_sum / f.tone_n as day_tone, sum(b.tone_sum) / sum(b.tone_n) as base_tone
    from facts f left join facts b on b.country = f.country and b.day between f.day - 7 and f.day - 1
    group by f.day, f.country, f.tone_sum, f.tone_n""")
add("info", ["spikes", "tone7"], f"""select s.day, s.country, event_count, rolling_mean as baseline, z_score,
    coalesce({rnd('day_tone - base_tone', 2)}, 0e0) as tone_delta from spikes s left join tone7 t on t.day = s.day
    and t.country = s.country""")
add("paths", ["facts", "spikes"], f"""select s.day, s.country, list({rnd('f.tone_sum / f.tone_n', 2)} order by f.day) as path
    from spikes s join facts f on f.country = s.country and f.day between s.day - 3 and s.day + 3 group by 1, 2""")
add("runs0", ["bursts"], """select day, country, count(*) over (partition by country, island) as consecutive_days from (select day,
    country, day - cast(row_number() over (partition by country order by day) as int) as island from bursts where is_burst)""")
_LABELS = sorted((label, q) for q, label in C.QUAD_LABELS.items())
_BEST = "greatest(q1, q2, q3, q4)"
TOP_QUAD = "case " + " ".join(f"when q{q} = {_BEST} then {quote(label)}" for label, q in _LABELS) + " end"
add("stats", ["spikes", "facts", "paths", "runs0"], f"""select s.day, s.country, s.event_count, s.z_score,
    s.rolling_mean as baseline, f.tone_sum / f.tone_n as avg_tone, 100e0 * (q3 + q4) / f.n as conflict_pct,
    100e0 - 100e0 * (q3 + q4) / f.n as coop_pct, {TOP_QUAD} as top_quad, path, consecutive_days
    from spikes s join facts f on f.day = s.day and f.country = s.country join paths p on p.day = s.day and
    p.country = s.country join runs0 r on r.day = s.day and r.country = s.country""")
_FIRST = "list_avg(path[1:len(path) // 2])"
_SECOND = "list_avg(path[len(path) // 2 + 1:])"
add("stats2", ["stats"], f"""select *, case when len(path) < 3 then 'Insufficient data' when {_SECOND} < {_FIRST} - 0.5e0
    then 'Escalating' when {_SECOND} > {_FIRST} + 0.5e0 then 'De-escalating' else 'Stable' end as direction from stats""")


def path_text(df):
    return df.withColumn("path", F.array_join(F.transform("tone_trajectory", lambda v: X.fixed(v, 2)), ",")).drop(
        "tone_trajectory")


_PATH = "array_to_string(list_transform(path, lambda v: printf('%.2f', v)), ',')"


@query("jn10_trailing_tone", with_ctes("select day, country, day_tone, base_tone from tone7", "tone7"),
       floats="day_tone base_tone", dates="day")
def _(spark, sf):
    return P.trailing_tone(P.day_facts(slim(spark, sf)))


@query("jn11_tone_trajectory", with_ctes(f"select day, country, {_PATH} as path from paths", "paths"), dates="day")
def _(spark, sf):
    facts, bursts = facts_and_bursts(spark, sf)
    return path_text(P.tone_paths(facts).join(B.burst_days(bursts), ["day", "country"]))


add("past", ["stats2"], """select * from (select c.day, c.country, h.day as h_day, h.event_count as h_count, h.z_score as h_z,
    h.avg_tone as h_tone, h.conflict_pct as h_conflict, h.consecutive_days as h_days, c.event_count, c.z_score, c.avg_tone,
    c.conflict_pct, c.consecutive_days, (row_number() over (partition by c.country, c.day order by h.day desc))::int as recency
    from stats2 c join stats2 h on h.country = c.country and h.day < c.day) where recency <= 5""")


@query("jn12_earlier_spikes", with_ctes("""select * from (select c.day, c.country, h.day as past_day, h.event_count as past_count,
    h.z_score as past_z, (row_number() over (partition by c.country, c.day order by h.day desc))::int as recency
    from ospikes c join ospikes h on h.country = c.country and h.day < c.day) where recency <= 5""", "ospikes"),
       dates="day past_day")
def _(spark, sf):
    spikes = order_bursts(spark, sf).where("is_burst").select("day", "country", "event_count", "z_score")
    return P.earlier_spikes(spikes).select(
        "day", "country", F.col("h_day").alias("past_day"), F.col("h_event_count").alias("past_count"),
        F.col("h_z_score").alias("past_z"), "recency")


@query("agg18_class_distribution", with_ctes("""select day, country, quad_label, count(*) as events from ev join spikes
    using (day, country) where quad_label is not null group by 1, 2, 3""", "ev", "spikes"), dates="day")
def _(spark, sf):
    ev = slim(spark, sf)
    return R.class_distribution(ev, B.burst_table(ev))


_PARTS = {"class": ("quad_label", 4), "family": ("root_label", 5), "actor": ("actor1", 5), "domain": ("source_domain", 5)}
add("on_spike", ["ev", "spikes"], "select e.*, s.event_count as total from ev e join spikes s using (day, country)")
add("sheet", ["on_spike"], " union all ".join(
    f"""select day, country, '{name}' as section, rank::int as rank, label, n::double as value,
    {'100e0 * n / total' if name == 'class' else 'null::double'} as pct from (select *, row_number() over (partition by day, country
    order by n desc, label) as rank from (select day, country, {col} as label, total, count(*) as n from on_spike
    where {col} is not null group by 1, 2, 3, 4)) where rank <= {limit}"""
    for name, (col, limit) in _PARTS.items()) + "".join(
    f""" union all select day, country, 'tone', {i}, '{m}', {f}(avg_tone), null from on_spike group by 1, 2"""
    for i, m, f in ((1, "mean", "avg"), (2, "min", "min"), (3, "max", "max"))))


@query("agg20_fact_sheet", with_ctes("select * from sheet", "sheet"), floats="value pct", dates="day")
def _(spark, sf):
    ev = events(spark, sf)
    return R.fact_sheet(ev, B.burst_table(ev))


@query("agg21_spike_stats", with_ctes(f"select * replace ({_PATH} as path) from stats", "stats"),
       floats="avg_tone conflict_pct coop_pct", dates="day")
def _(spark, sf):
    return path_text(P.spike_stats(*facts_and_bursts(spark, sf)))


@query("win8_trajectory_direction", with_ctes("select day, country, direction from stats2", "stats2"), dates="day")
def _(spark, sf):
    return P.spike_stats(*facts_and_bursts(spark, sf)).select("day", "country", P.direction().alias("direction"))


add("means", ["past"], """select day, country, count(*) as n, avg(h_count) as m_count, avg(h_z) as m_z, avg(h_tone) as m_tone,
    avg(h_conflict) as m_conflict, avg(h_days) as m_days from past group by 1, 2""")
add("compared", ["stats2", "means"], f"""select s.day, s.country, n is not null as has_history, coalesce(n, 0) as n_historical,
    {rnd('event_count / greatest(m_count, 1e0)', 2)} as count_ratio_, {rnd('z_score / greatest(m_z, 0.01e0)', 2)} as z_ratio_,
    {rnd('avg_tone - m_tone', 2)} as tone_diff, {rnd('conflict_pct - m_conflict', 1)} as conflict_pct_diff,
    {rnd('consecutive_days / greatest(m_days, 1e0)', 2)} as duration_ratio_,
    case when n is null then 'Unknown' else direction end as escalation_direction, {rnd('m_count', 0)} as avg_historical_count,
    {rnd('m_z', 2)} as avg_historical_z, {rnd('m_tone', 2)} as avg_historical_tone
    from stats2 s left join means m on m.day = s.day and m.country = s.country""")
add("comparison", ["compared"], """select * exclude (count_ratio_, z_ratio_, duration_ratio_),
    case when has_history then count_ratio_ end as count_ratio, case when has_history then z_ratio_ end as z_ratio,
    case when has_history then duration_ratio_ end as duration_ratio from compared""")


@query("agg23_spike_comparison", with_ctes("select * from comparison", "comparison"), dates="day",
       floats="tone_diff conflict_pct_diff avg_historical_tone")
def _(spark, sf):
    return P.compare_spikes(P.spike_stats(*facts_and_bursts(spark, sf)))


@query("agg24_versus_each", with_ctes(f"""select country, day, recency, h_day as past_day,
    {rnd('event_count / greatest(h_count, 1)::double', 2)} as count_ratio, {rnd('z_score - h_z', 2)} as z_diff,
    {rnd('avg_tone - h_tone', 2)} as tone_diff, {rnd('conflict_pct - h_conflict', 1)} as conflict_diff from past""", "past"),
       dates="day past_day", floats="z_diff tone_diff conflict_diff")
def _(spark, sf):
    return P.versus_each(P.spike_stats(*facts_and_bursts(spark, sf)))


@query("agg25_comparison_table", with_ctes(f"""select country, day as spike_day, 0 as row_no, cast(day as varchar) || ' ★' as date,
    event_count as events, {rnd('z_score', 2)} as z, {rnd('avg_tone', 2)} as avg_tone, {rnd('conflict_pct', 1)} as conflict_pct,
    consecutive_days as burst_days from stats2 union all select country, day, recency, cast(h_day as varchar), h_count,
    {rnd('h_z', 2)}, {rnd('h_tone', 2)}, {rnd('h_conflict', 1)}, h_days from past""", "stats2", "past"), dates="spike_day")
def _(spark, sf):
    return P.comparison_table(P.spike_stats(*facts_and_bursts(spark, sf)))


# --- texts -----------------------------------------------------------------------

@query("rpt1_spike_info", with_ctes("select * from info", "info"), dates="day", floats="tone_delta")
def _(spark, sf):
    return P.spike_info(*facts_and_bursts(spark, sf))


_MEAN, _MZ = grouped("avg_historical_count"), fixed("avg_historical_z", 1)


@query("rpt5_comparison_text", with_ctes(f"""select day, country, case when not has_history then
    'No historical burst data is available for ' || country || ', so a comparative assessment cannot be made. This appears to be '
    || 'the first detected spike in the current dataset.' else concat_ws(' ',
    case when count_ratio >= 1.5e0 then 'This spike is ' || {fixed('count_ratio', 1)} || '× larger than the average of the '
      || 'previous ' || n_historical || ' burst' || case when n_historical = 1 then '' else 's' end || ' (historical mean: '
      || {_MEAN} || ' events), making it notably atypical.'
    when count_ratio <= 0.7e0 then 'This spike is smaller than average, with event counts ' || {fixed('(1 - count_ratio) * 100', 0)}
      || '% below the historical mean of ' || {_MEAN} || ' events.'
    else 'Event volume is broadly consistent with historical spikes for ' || country || ', at ' || {fixed('count_ratio', 1)}
      || '× the average of ' || {_MEAN} || ' events.' end,
    case when z_ratio >= 1.5e0 then 'The statistical intensity (z-score ratio: ' || {fixed('z_ratio', 1)} || '×) significantly '
      || 'exceeds the historical average of ' || {_MZ} || 'σ, indicating this is among the most statistically extreme events '
      || 'in the dataset.'
    when z_ratio <= 0.7e0 then 'Despite the absolute event volume, the z-score (' || {fixed('z_ratio', 1)} || '×) is lower than '
      || 'historical averages (' || {_MZ} || 'σ), suggesting the baseline has also elevated.' end,
    case when tone_diff < -1.5e0 then 'Tone is ' || {fixed('abs(tone_diff)', 1)} || ' points more negative than the historical '
      || 'average for burst periods, suggesting an unusually adversarial or hostile environment compared to past spikes.'
    when tone_diff > 1.5e0 then 'Tone is ' || {fixed('tone_diff', 1)} || ' points more positive than historical burst averages, '
      || 'indicating a more cooperative character than previous spikes.'
    else 'Tone (Δ' || {signed('tone_diff', 1)} || ' vs. historical average) is broadly consistent with previous burst periods '
      || 'for this country.' end,
    case when abs(conflict_pct_diff) >= 10 then 'The share of conflict-type events is ' || {fixed('abs(conflict_pct_diff)', 0)}
      || ' percentage points ' || case when conflict_pct_diff > 0 then 'higher' else 'lower' end || ' than the historical '
      || 'average for burst days, which is analytically significant.' end,
    case when escalation_direction in ('Escalating', 'De-escalating') then 'The tone trajectory over the burst window shows a '
      || lower(escalation_direction) || ' pattern, distinguishing this event from a simple one-day shock.' end) end as narrative
    from comparison""", "comparison"), dates="day")
def _(spark, sf):
    return P.comparison_text(P.compare_spikes(P.spike_stats(*facts_and_bursts(spark, sf))))


def fill(template: str, **fields: str) -> str:
    """SQL text expression of a template."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(fields[p] if i % 2 else quote(p) for i, p in enumerate(parts) if i % 2 or p) + ")"


def choose(templates, seed: str, **fields: str) -> str:
    texts = ", ".join(fill(t, **fields) for t in templates)
    return f"[{texts}][({seed}) % {len(templates)} + 1]"


TONE_TEXT = f"""case when tone_delta < -1.5e0 then {fill(T.TONE_MARKED, tone=fixed('tone_delta', 2))}
    when tone_delta < -0.3e0 then {fill(T.TONE_MILD, tone=fixed('tone_delta', 2))}
    when tone_delta > 1 then {fill(T.TONE_GOOD, tone=signed('tone_delta', 2))}
    else {fill(T.TONE_FLAT, tone=signed('tone_delta', 2))} end"""
OUTLOOK = f"""case when tone_delta < -1 and z_score >= 3 then {quote(T.OUTLOOK_RISK)} when tone_delta > 0.5e0
    then {quote(T.OUTLOOK_PEAK)} else {quote(T.OUTLOOK_OPEN)} end"""


@query("rpt7_tone_and_outlook", with_ctes(
    f"select day, country, {TONE_TEXT} as tone_text, {OUTLOOK} as outlook_text from info", "info"), dates="day")
def _(spark, sf):
    return R.readings(P.spike_info(*facts_and_bursts(spark, sf)))


add("kwlist", ["ks_kw"], """select day, country, list(keyword order by rank) as keywords from ks_kw where rank <= 10
    group by 1, 2""")
_FIELDS = dict(country="country", date="cast(day as varchar)", count=grouped("event_count"),
               ratio=fixed("event_count / greatest(baseline, 1e0)", 1), baseline=fixed("baseline", 0), z=fixed("z_score", 1))
_MOOD = dict(tone=signed("tone_delta", 1), tone_abs=fixed("abs(tone_delta)", 1))
_MIX = dict(conflict_pct=fixed("cp", 0), coop_pct=fixed("100e0 - cp", 0), top_type="top_type")
QUOTED6 = "array_to_string(list_transform(keywords[1:{n}], lambda k: '\"' || k || '\"'), ', ')"
add("brief_in", ["info", "facts", "kwlist"], f"""select i.*, q1 + q2 + q3 + q4 as typed, {TOP_QUAD} as top_type,
    100e0 * (q3 + q4) / (q1 + q2 + q3 + q4) as cp, coalesce(keywords, []) as keywords,
    ('0x' || substr(md5(i.country || cast(i.day as varchar)), 1, 8))::bigint % 7 as seed from info i
    join facts f on f.day = i.day and f.country = i.country left join kwlist k on k.day = i.day and k.country = i.country""")


def briefing_sql(evidence: str, source: str) -> str:
    return f"""select day, country, concat_ws(' ',
    case when z_score >= 3 then {choose(T.HIGH_Z, 'seed', **_FIELDS)} else {choose(T.MODERATE_Z, 'seed', **_FIELDS)} end,
    case when tone_delta < -0.5e0 then {choose(T.TONE_NEGATIVE, 'seed + 1', **_MOOD)}
      when tone_delta > 0.5e0 then {choose(T.TONE_POSITIVE, 'seed + 1', **_MOOD)}
      else {choose(T.TONE_NEUTRAL, 'seed + 1', **_MOOD)} end,
    case when len(keywords) > 0 then {choose(T.KEYWORDS, 'seed + 2', keywords=QUOTED6.format(n=6))} end,
    case when cp >= 60 then {choose(T.MIX_CONFLICT, 'seed + 3', **_MIX)}
      when 100e0 - cp >= 60 then {choose(T.MIX_COOPERATION, 'seed + 3', **_MIX)}
      when typed > 0 then {choose(T.MIX_BOTH, 'seed + 3', **_MIX)} end,
    {evidence},
    case when tone_delta < -1 then {choose(T.WATCH_ESCALATION, 'seed + 5')}
      when tone_delta > 1 then {choose(T.WATCH_DEESCALATION, 'seed + 5')}
      else {choose(T.WATCH_GENERIC, 'seed + 5', country='country')} end) as briefing from {source}"""


@query("rpt2_briefings", with_ctes(briefing_sql(quote(T.NO_EVIDENCE[0]), "brief_in"), "brief_in"), dates="day")
def _(spark, sf):
    ev = events(spark, sf, url=False)
    bursts, facts = B.burst_table(ev), P.day_facts(ev)
    words = R.keyword_lists(K.per_spike(ev, bursts, K.event_vocabulary(ev)))
    return R.briefings(P.spike_info(facts, bursts), facts, words)


def _lines(section: str, text: str, title: str) -> str:
    return (f"(select {quote(chr(10) + title + chr(10))} || string_agg('  ' || {text}, {quote(chr(10))} order by rank) from sheet h "
            f"where h.section = '{section}' and h.day = i.day and h.country = i.country)")


_COUNT = f"label || ': ' || {grouped('value')}"
_TONE = "(select value from sheet h where h.section = 'tone' and h.label = '{m}' and h.day = i.day and h.country = i.country)"
add("context", ["info", "sheet"], f"""select i.*, concat_ws({quote(chr(10))}, '[Event Context: ' || country || ' on '
    || cast(day as varchar) || ']', 'Event count: ' || {grouped('event_count')} || '  (baseline: ' || {fixed('baseline', 0)}
    || ',  z-score: ' || {fixed('z_score', 2)} || 'σ)', 'Tone shift vs. baseline: ' || {signed('tone_delta', 2)} || ' points',
    {_lines('class', f"{_COUNT} || ' (' || {fixed('pct', 0)} || '%)'", 'Event type breakdown:')},
    {_lines('family', _COUNT, 'Top event categories:')},
    {quote(chr(10))} || 'Tone — mean: ' || {fixed(_TONE.format(m='mean'), 2)} || ',  range: [' || {fixed(_TONE.format(m='min'), 1)}
    || ', ' || {fixed(_TONE.format(m='max'), 1)} || ']',
    {_lines('actor', f"{_COUNT} || ' events'", 'Top Actor 1 entities:')},
    {_lines('domain', f"{_COUNT} || ' articles'", 'Top news sources:')}) as context from info i""")


@query("agg20_event_context", with_ctes("select day, country, context from context", "context"), dates="day")
def _(spark, sf):
    ev = events(spark, sf)
    bursts = B.burst_table(ev)
    return R.event_context(R.fact_sheet(ev, bursts), P.spike_info(P.day_facts(ev), bursts))


def intent(text: str) -> str:
    whens = " ".join(f"when regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({w})($|[^\\p{{L}}\\p{{N}}_])') then '{i}'"
                     for i, w in C.INTENT_WORDS)
    return f"case {whens} else 'general' end"


# Standing questions asked about every spike, one per intent.
QUESTIONS = (
    "Why did it spike?", "Show me the evidence", "Was it worse than before?", "Which topic stands out?",
    "Which quad dominates?", "What was the tone?", "Name every actor", "What will follow?", "Hello",
)


@query("rpt3_question_intents", f"""select conv_id, turn, {intent('text')} as intent from (select conv_id, turn,
    case turn % 10 {' '.join(f"when {i} then {quote(q)} || ' ' || text" for i, q in enumerate(QUESTIONS))} else text end as text
    from conversations where role = 'user')""")
def _(spark, sf):
    """User turns, most with a standing question in front (their own text has no intent words)."""
    text = F.col("text")
    asked = F.when(F.col("turn") % 10 == 0, F.concat(F.lit(QUESTIONS[0] + " "), text))
    for i, q in enumerate(QUESTIONS[1:], 1):
        asked = asked.when(F.col("turn") % 10 == i, F.concat(F.lit(q + " "), text))
    turns = W.table(spark, sf, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", R.parse_intent(asked.otherwise(text)).alias("intent"))


def spike_rows(spark, sf, passages=None):
    ev = events(spark, sf)
    bursts = B.burst_table(ev)
    info = settle(P.spike_info(P.day_facts(ev), bursts))
    context = R.event_context(R.fact_sheet(ev, bursts), info)
    words = R.keyword_lists(K.per_spike(ev, bursts, K.event_vocabulary(ev)))
    return settle(R.spike_rows(info, context, words, passages(ev, bursts) if passages else None))


_BASE = dict(country="country", date="cast(day as varchar)", context="context", z=fixed("z_score", 1),
             tone=signed("tone_delta", 2))
_BULLETS = f"array_to_string(list_transform(keywords[1:10], lambda k: '  • ' || k), {quote(chr(10))})"


def answers_sql(cause: str = "", evidence: str = quote(T.NO_PASSAGES), general: str = "") -> str:
    """Answer by intent; ``cause`` and ``general`` are put behind the answers of those kinds."""
    return f"""case intent
    when 'spike_cause' then {fill(T.CAUSE_ANSWER, tone_word="case when tone_delta < -0.5e0 then 'negative' when tone_delta > 0.5e0 then 'positive' else 'neutral' end", keywords=QUOTED6.format(n=5), **_BASE)}{cause}
    when 'evidence' then {evidence}
    when 'keywords' then {fill(T.KEYWORD_ANSWER, list=_BULLETS)}
    when 'event_types' then {fill(T.TYPES_ANSWER, **_BASE)}
    when 'tone' then {fill(T.TONE_ANSWER, interp='(' + TONE_TEXT + ')', **_BASE)}
    when 'actors' then {fill(T.ACTORS_ANSWER, **_BASE)}
    when 'prediction' then {fill(T.OUTLOOK_ANSWER, outlook='(' + OUTLOOK + ')', **_BASE)}
    when 'comparison' then {quote(T.COMPARISON_ANSWER)}
    else {fill(T.GENERAL_ANSWER, context='context')}{general} end"""


_ANSWERS = answers_sql()


@query("rpt4_answers", with_ctes(f"""select question, day, country, intent, {_ANSWERS} as answer from (select q.question,
    {intent('q.question')} as intent, c.*, keywords from (select unnest([{', '.join(quote(q) for q in QUESTIONS)}]) as question) q,
    context c join kwlist k on k.day = c.day and k.country = c.country)""", "context", "kwlist"), dates="day")
def _(spark, sf):
    """Every standing question answered for every spike."""
    spikes = spike_rows(spark, sf)
    asked = spikes.select("day", "country", F.explode(F.array(*[F.lit(q) for q in QUESTIONS])).alias("question"))
    return R.answers(asked, spikes)


@query("rpt4_conversation_answers", with_ctes(f"""select conv_id, turn, day, country, intent, md5({_ANSWERS}) as digest from (
    select q.conv_id, q.turn, {intent('q.text')} as intent, c.*, keywords from (select * from conversations where role = 'user') q
    join (select *, row_number() over (order by day, country) - 1 as no, count(*) over () as n from context) c
    on c.no = q.conv_id % c.n join kwlist k on k.day = c.day and k.country = c.country)""", "context", "kwlist"), dates="day")
def _(spark, sf):
    """User turns of the conversations, each conversation being about one spike."""
    from pyspark.sql import Window

    spikes = spike_rows(spark, sf)
    numbered = spikes.select(
        "day", "country", (F.row_number().over(Window.orderBy("day", "country")) - 1).alias("no"))  # one row per spike
    n = spikes.agg(F.count(F.lit(1))).scalar()
    turns = W.table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("conv_id") % n).alias("no"))
    return R.answers(turns.join(numbered, "no").drop("no"), spikes).select(
        "conv_id", "turn", "day", "country", "intent", F.md5("answer").alias("digest"))


@query("agg22_historical_stats", with_ctes(f"""select c.day, c.country, recency, h_day as past_day, h.event_count, h.z_score,
    h.baseline, h.avg_tone, h.conflict_pct, h.top_quad, h.consecutive_days, array_to_string(list_transform(h.path,
    lambda v: printf('%.2f', v)), ',') as path from past c join stats2 h on h.country = c.country and h.day = c.h_day""",
    "past", "stats2"), dates="day past_day", floats="avg_tone conflict_pct")
def _(spark, sf):
    """Full statistics of the predecessors of every spike."""
    past = P.earlier_spikes(P.spike_stats(*facts_and_bursts(spark, sf)))
    names = ("event_count", "z_score", "baseline", "avg_tone", "conflict_pct", "top_quad", "consecutive_days")
    path = F.array_join(F.transform("h_tone_trajectory", lambda v: X.fixed(v, 2)), ",")
    return past.select("day", "country", "recency", F.col("h_day").alias("past_day"),
                       *[F.col(f"h_{n}").alias(n) for n in names], path.alias("path"))
