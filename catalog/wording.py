"""Keywords of event texts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens import config as C
from spikelens.functions.dist import settle
from spikelens.operators import aggregate as A, bursts as B, keywords as K
from spikelens.sources import tables
from spikelens.sources import world_events as W

from .cleaning import events, scratch
from .registry import query
from .sql import add, in_list, rnd, with_ctes


def placed(spark, sf):
    return events(spark, sf, url=False)


def documents(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", "lang", "text", F.lit(1).alias("n"))


def words(text: str, country: str | None = None) -> str:
    extra = ""
    if country:
        extra = "".join(f" and not ({country} = '{c}' and w in {in_list(ws)})" for c, ws in C.COUNTRY_STOPWORDS.items())
    return (f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z\\s]', ' ', 'g'), '\\s+'), "
            f"lambda w: length(w) > 1 and w not in {in_list(C.STOPWORDS)}{extra})")


def grams(w: str) -> str:
    return (f"list_concat({w}, list_transform(range(1, greatest(len({w}), 1)::bigint), "
            f"lambda i: {w}[i] || ' ' || {w}[i + 1]))")


def fit_ctes(p: str, source: str, key: str, text: str, needs) -> None:
    add(f"{p}_words", needs, f"select {key} as id, {words(text)} as w from {source}")
    add(f"{p}_terms", [f"{p}_words"], f"""select id, term, count(*) as tf from (select id, unnest({grams('w')}) as term
        from {p}_words) group by 1, 2""")
    add(f"{p}_vocab", [f"{p}_terms", f"{p}_words"], f"""select term, count(*) as df, sum(tf)::bigint as total_tf,
        ln((1e0 + (select count(*) from {p}_words)) / (1e0 + count(*))) + 1e0 as idf from {p}_terms group by 1
        having count(*) >= 2 order by total_tf desc, term limit 800""")


def score_ctes(p: str, vocab: str, source: str, groups: str, text: str, needs, country: str | None = "country") -> None:
    """``{p}_kw``: all terms of each group with their rank."""
    g = f"{groups}, " if groups else ""
    part = f"partition by {groups}" if groups else ""
    on = " and ".join(f"s.{c} is not distinct from d.{c}" for c in groups.split(", ")) if groups else "true"
    by = f"group by {groups}" if groups else ""
    add(f"{p}_docs", needs, f"select {g}row_number() over () as id, {words(text, country)} as w from {source}")
    add(f"{p}_tf", [f"{p}_docs", vocab], f"""select {g}id, term, (1e0 + ln(count(*))) * any_value(idf) as w from (select {g}id,
        unnest({grams('w')}) as term from {p}_docs) join {vocab} using (term) group by {g}id, term""")
    add(f"{p}_unit", [f"{p}_tf"], f"select {g}term, w / sqrt(sum(w * w) over (partition by id)) as weight from {p}_tf")
    add(f"{p}_mean", [f"{p}_unit", f"{p}_docs"], f"""select {g.replace('country', 's.country').replace('on_burst', 's.on_burst')
        .replace('day', 's.day').replace('lang', 's.lang')}s.term as keyword, s.total / d.n as mean from (select {g}term,
        sum(weight) as total from {p}_unit group by {g}term) s join (select {g}count(*) as n from {p}_docs {by}) d on {on}""")
    add(f"{p}_kw", [f"{p}_mean"], f"""select {g}keyword, {rnd('mean', 5)} as score, (row_number() over ({part}
        order by {rnd('mean', 10)} desc, keyword))::int as rank from {p}_mean where mean > 0""")


fit_ctes("kv", "ev", "event_id", "text_for_tfidf", ["ev"])
fit_ctes("dv", "documents", "doc_id", "text", [])
add("marked", ["ev", "spikes"], "select e.*, coalesce(is_burst, false) as on_burst from ev e left join spikes using (day, country)")
score_ctes("kc", "kv_vocab", "ev", "country", "text_for_tfidf", ["ev"])
score_ctes("kb", "kv_vocab", "marked where on_burst", "country", "text_for_tfidf", ["marked"])
score_ctes("kn", "kv_vocab", "marked", "country, on_burst", "text_for_tfidf", ["marked"])
score_ctes("ks", "kv_vocab", "marked where on_burst", "day, country", "text_for_tfidf", ["marked"])
score_ctes("kd", "dv_vocab", "documents", "lang", "text", [], None)


@query("kw1_clean_documents", f"""select doc_id, len(w) as n_tokens, md5(array_to_string(w, ' ')) as digest
    from (select doc_id, {words('text')} as w from documents)""")
def _(spark, sf):
    """Cleaned whole documents, as token count and digest."""
    return documents(spark, sf).select(
        "doc_id", F.size(K.tokens(F.col("text"))).cast("bigint").alias("n_tokens"),
        F.md5(K.clean_text(F.col("text"))).alias("digest"))


@query("kw2_country_stopwords", with_ctes(
    f"select event_id, array_to_string({words('text_for_tfidf', 'country')}, ' ') as text from ev", "ev"))
def _(spark, sf):
    return placed(spark, sf).select("event_id", K.clean_text(F.col("text_for_tfidf"), F.col("country")).alias("text"))


@query("kw3_fit_tfidf", with_ctes("select * from kv_vocab", "kv_vocab"), floats="idf", places=9)
def _(spark, sf):
    return K.fit_tfidf(K.event_texts(placed(spark, sf)))


@query("kw3_fit_tfidf_documents", with_ctes("select * from dv_vocab", "dv_vocab"), floats="idf", places=9)
def _(spark, sf):
    """On whole documents, where the 800-term limit takes effect."""
    return K.fit_tfidf(K.spread(documents(spark, sf), "doc_id"), ["doc_id"])


@query("src11_stored_vocabulary", with_ctes("select term, df, total_tf from kv_vocab", "kv_vocab"))
def _(spark, sf):
    path = scratch(spark)
    tables.save_table(K.fit_tfidf(K.event_texts(placed(spark, sf))), path)
    return tables.load_table(spark, path).drop("idf")


@query("kw4_top_keywords_documents", with_ctes("select lang, rank, keyword, score from kd_kw where rank <= 15", "kd_kw"))
def _(spark, sf):
    docs = K.spread(documents(spark, sf), "doc_id")
    return K.top_keywords(docs, settle(K.fit_tfidf(docs, ["doc_id"])), ["lang"], 15, ["doc_id"])


@query("kw5_keywords_by_country", with_ctes("select country, rank, keyword, score from kc_kw where rank <= 15", "kc_kw"))
def _(spark, sf):
    ev = placed(spark, sf)
    return K.by_country(ev, K.event_vocabulary(ev))


@query("kw6_keywords_on_spikes", with_ctes("select country, rank, keyword, score from kb_kw where rank <= 15", "kb_kw"))
def _(spark, sf):
    ev = placed(spark, sf)
    return K.on_bursts(ev, B.burst_table(ev), K.event_vocabulary(ev))


@query("kw7_normal_vs_spike", with_ctes("select country, on_burst, rank, keyword, score from kn_kw where rank <= 15", "kn_kw"))
def _(spark, sf):
    ev = placed(spark, sf)
    return K.normal_vs_burst(ev, B.burst_table(ev), K.event_vocabulary(ev))


add("deltas", ["kn_kw"], f"""select coalesce(b.country, n.country) as country, coalesce(b.keyword, n.keyword) as term,
    coalesce(b.score, 0e0) as burst_score, coalesce(n.score, 0e0) as normal_score,
    {rnd('coalesce(b.score, 0e0) - coalesce(n.score, 0e0)', 5)} as delta from (select * from kn_kw where on_burst and rank <= 12) b
    full join (select * from kn_kw where not on_burst and rank <= 12) n on n.country = b.country and n.keyword = b.keyword""")
add("delta_view", ["deltas"], """select *, case when delta > 0 then 'Higher during spikes' else 'Lower during spikes' end as
    direction, (row_number() over (partition by country order by delta, term))::int as position,
    count(*) over (partition by country) as n from deltas qualify n <= 16 or position <= 8 or position > n - 8""")


def deltas(spark, sf):
    ev = placed(spark, sf)
    vocabulary = K.event_vocabulary(ev)
    return K.term_deltas(K.normal_vs_burst(ev, B.burst_table(ev), vocabulary, 12)), ev, vocabulary


@query("set3_term_union", with_ctes("""select *, case when delta > 0 then 'Higher during spikes' else 'Lower during spikes' end
    as direction from deltas""", "deltas"), floats="delta")
def _(spark, sf):
    return deltas(spark, sf)[0]


@query("top7_balanced_view", with_ctes("select * exclude (n) from delta_view", "delta_view"), floats="delta")
def _(spark, sf):
    return K.balanced(deltas(spark, sf)[0])


@query("kw8_shift_insights", with_ctes("""select country, case
    when len(fresh) > 0 then 'During spike periods, **' || country || '** coverage shifts toward **' || fresh[1] || '**'
      || case when len(fresh) > 1 then ' and **' || fresh[2] || '**' else '' end || ' — terms not prominent in day-to-day '
      || 'activity, suggesting heightened geopolitical or crisis-related coverage.'
    when len(raised) > 0 then 'Spike periods in **' || country || '** reinforce existing patterns — **' || raised[1]
      || '** remains the dominant theme across both normal and elevated activity days.'
    else 'Insufficient spike data for **' || country || '** to identify meaningful pattern shifts.' end as insight
    from (select *, list_filter(raised[1:3], lambda t: not list_contains(lead3, t)) as fresh from (select v.country,
      coalesce(list(term order by delta desc, term) filter (delta > 0), []) as raised, (select coalesce(list(keyword), [])
      from kc_kw k where k.country = v.country and k.rank <= 3) as lead3 from delta_view v group by 1))""",
    "delta_view", "kc_kw"))
def _(spark, sf):
    table, ev, vocabulary = deltas(spark, sf)
    return K.shift_insights(K.balanced(table), K.by_country(ev, vocabulary, 12))


@query("kw9_keywords_per_spike", with_ctes("select day, country, rank, keyword, score from ks_kw where rank <= 10", "ks_kw"),
       dates="day")
def _(spark, sf):
    ev = placed(spark, sf)
    return K.per_spike(ev, B.burst_table(ev), K.event_vocabulary(ev))


@query("kw10_relative_keywords", with_ctes(f"""select lang, rank, keyword, score from (select lang, keyword,
    {rnd('mean', 5)} as score, (row_number() over (partition by lang order by {rnd('mean', 10)} desc, keyword))::int as rank
    from (select t.lang, t.term as keyword, sum(tf / nw::double * idf) / any_value(s.n) as mean from terms t
    join vocab using (term) join sizes s using (lang) group by 1, 2)) where rank <= 15""",
    ws=((), f"select doc_id, lang, {words('text')} as w from documents"),
    terms=(("ws",), "select doc_id, lang, nw, term, count(*) as tf from (select doc_id, lang, len(w) as nw, unnest(w) as term "
                    "from ws) group by all"),
    vocab=(("terms", "ws"), "select term, ln((1e0 + (select count(*) from ws)) / (1e0 + count(*))) + 1e0 as idf from terms "
                            "group by 1 having count(*) >= 2 order by count(*) desc, term limit 500"),
    sizes=(("ws",), "select lang, count(*) as n from ws group by 1")))
def _(spark, sf):
    docs = documents(spark, sf)
    return K.relative_keywords(docs, settle(K.fit_relative(docs, ["doc_id"])), ["lang"], 15, ["doc_id"])


@query("agg27_country_sheet", with_ctes("""select country, count(event_id) as event_count, avg(avg_tone) as avg_tone,
    avg((event_type = 'Conflict')::int) * 100 as conflict_pct, (select count(*) from spikes s where s.country = e.country)
    as burst_days, (select coalesce(string_agg(keyword, ', ' order by rank), 'N/A') from kc_kw k where k.country = e.country
    and k.rank <= 5) as top_keywords from ev e group by 1""", "ev", "spikes", "kc_kw"), floats="avg_tone conflict_pct")
def _(spark, sf):
    ev = placed(spark, sf)
    return A.country_sheet(ev, B.burst_table(ev), K.by_country(ev, K.event_vocabulary(ev), 5))
