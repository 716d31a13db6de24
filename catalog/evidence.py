"""Pages, passages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens import config as C, fixed_text as T
from spikelens.functions.dist import settle
from spikelens.operators import bursts as B, compare as P, evidence as V, keywords as K, reports as R
from spikelens.sources import tables, world_events as W

from .cleaning import events, scratch
from .registry import query
from .spikes import QUESTIONS, answers_sql, briefing_sql, choose, intent, spike_rows
from .sql import add, article_domain, blocked, fixed, quote, rnd, with_ctes
from .wording import words

KEYS = ["day", "country"]


def pages(spark, sf):
    return W.table(spark, sf, "pages")


add("urls", ["ev", "spikes"], f"""select day, country, source_url, (row_number() over (partition by day, country order by c, m,
    event_id))::int as rank from (select day, country, source_url, c, m, event_id from (select day, country, source_url,
    -(quad_class >= 3)::int as c, -num_mentions as m, event_id from ev semi join spikes using (day, country)
    where source_url is not null) qualify row_number() over (partition by day, country, source_url order by c, m, event_id) = 1)
    where not {blocked('source_url')}""")


def urls(spark, sf, n=20):
    ev = events(spark, sf, place=False)
    bursts = B.burst_table(ev)
    return V.spike_urls(ev, bursts, n)


@query("top6_spike_urls", with_ctes("select day, country, rank, source_url from urls where rank <= 20", "urls"), dates="day")
def _(spark, sf):
    return urls(spark, sf)


_HTML = "html"
for _tag in C.DROPPED_TAGS:
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}(?:\\s[^>]*)?>.*?</{_tag}\\s*>', ' ', 'g')"
_HTML = f"replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', ' ', 'g'), chr(1), ' ')"
_PARTS = f"string_split(regexp_replace({_HTML}, '(?i)<p(?:\\s[^>]*)?/?>', chr(1), 'g'), chr(1))[2:]"
_ENDS = f"'(?is)</?(?:{'|'.join(C.BLOCK_TAGS)})(?:\\s[^>]*)?/?>.*\\z'"
_NUMBER = "lower(regexp_extract(r, '(?i)^(x[0-9a-f]{1,6}|[0-9]{1,7});', 1))"
_CODE = f"(case when {_NUMBER} like 'x%' then '0' || {_NUMBER} else {_NUMBER} end)::int"
_ONE = (f"case when {_NUMBER} = '' then '&#' || r else (case when {_CODE} = 38 then '&amp;' when {_CODE} between 1 and 55295 or {_CODE} "
        f"between 57344 and 1114111 then chr({_CODE}) else chr(65533) end) || substr(r, length({_NUMBER}) + 2) end")
_BARE = f"regexp_replace(regexp_replace(p, {_ENDS}, ''), '<[^>]*>', ' ', 'g')"
_PLAIN = (f"string_split({_BARE}, '&#')[1] || coalesce(array_to_string(list_transform(string_split({_BARE}, '&#')[2:], lambda r: {_ONE}), "
          "''), '')")
for _name, _char in (*C.CHARACTER_REFERENCES, ("amp", "&")):
    _PLAIN = f"replace({_PLAIN}, {quote(f'&{_name};')}, {quote(_char)})"
_PLAIN = f"trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))"
_NATIVE = (f"coalesce(array_to_string(list_filter(list_transform({_PARTS}, lambda p: {_PLAIN}), "
           f"lambda p: length(p) > {C.MIN_PARAGRAPH_CHARS}), ' '), '')")


def clean_sql(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[\\r\\n\\t]+', ' ', 'g'), ' {{2,}}', ' ', 'g'), "
            f"'[^\\x20-\\x7E]', ' ', 'g'))")


@query("txt1_page_text", f"""select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, {_NATIVE} as t
    from pages)""")
def _(spark, sf):
    """Main text: paragraphs, open ones too."""
    return V.read_pages(pages(spark, sf)).select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("txt1_page_text_native", f"""select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, {clean_sql(_NATIVE)} as t
    from pages)""")
def _(spark, sf):
    """Main text, cleaned as articles are."""
    text = V.clean_article(F.col("text"))
    return V.read_pages(pages(spark, sf)).select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


@query("txt2_clean_text", f"""select doc_id, length(t) as n_chars, md5(t) as digest from (select doc_id, {clean_sql('text')} as t
    from documents)""")
def _(spark, sf):
    """Whole documents."""
    text = V.clean_article(F.col("text"))
    return W.table(spark, sf, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


@query("txt4_url_keys", "select page_id, substr(md5(url), 1, 16) as url_key from pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", V.url_key(F.col("url")).alias("url_key"))


add("store", [], f"""select url_key, text from (select substr(md5(url), 1, 16) as url_key, page_id, {clean_sql(_NATIVE)} as text
    from pages) qualify row_number() over (partition by url_key order by page_id) = 1""")
add("articles", ["urls", "store"], f"""select day, country, rank, source_url, {article_domain('source_url')} as domain, text
    from urls join store on url_key = substr(md5(source_url), 1, 16) where rank <= 10 and length(text) >= 150""")


def articles(spark, sf):
    """Texts behind the first URLs of each spike."""
    return V.spike_articles(urls(spark, sf, 3 * C.MAX_ARTICLES), pages(spark, sf))


@query("txt3_spike_articles", with_ctes("select day, country, rank, source_url, domain, md5(text) as digest from articles",
                                        "articles"), dates="day")
def _(spark, sf):
    return articles(spark, sf).select("day", "country", "rank", "source_url", "domain", F.md5("text").alias("digest"))


# The cut positions of a text, each depending on the one before.
def cuts_sql(source: str) -> str:
    """Pieces of the texts of ``source (doc_id, text)``."""
    return f"""with recursive flat as (select doc_id, t, length(t) as n from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))
    as t from ({source}))),
    ends as (select doc_id, t, n, 0::bigint as s, 0 as step from flat where n > 0
      union all select doc_id, t, n, case when e - 80 > s then e - 80 else s + 420 end, step + 1 from (select *, case
        when s + 500 < n and p > 0 then s + 380 + length(w) - p + 1 else least(s + 500, n) end as e from (select *,
        instr(reverse(w), ' .') as p from (select *, substr(t, s + 381, 120) as w from ends))) where
        (case when e - 80 > s then e - 80 else s + 420 end) < n),
    pieces as (select doc_id, step, trim(substr(t, s + 1, e - s)) as piece from (select *, case when s + 500 < n and p > 0
      then s + 380 + length(w) - p + 1 else least(s + 500, n) end as e from (select *, instr(reverse(w), ' .') as p from
      (select *, substr(t, s + 381, 120) as w from ends))))
    select doc_id, (row_number() over (partition by doc_id order by step) - 1)::int as chunk_idx, piece from pieces
    where length(piece) >= 80"""


@query("txt5_chunks", f"select doc_id, chunk_idx, md5(piece) as digest from ({cuts_sql('select doc_id, text from documents')})")
def _(spark, sf):
    """Whole documents in overlapping pieces that end with a sentence where possible."""
    docs = W.table(spark, sf, "documents").select("doc_id", "text")
    return V.chunk(docs).select("doc_id", "chunk_idx", F.md5("text").alias("digest"))


@query("txt5_chunks_fixed_stride", """select doc_id, ((s - 1) / 420)::int as chunk_idx, md5(piece) as digest from (select doc_id, s,
    trim(substr(t, s, 500)) as piece from (select doc_id, t, unnest(range(1, greatest(length(t), 1) + 1, 420)) as s from
    (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents))) where length(piece) >= 80""")
def _(spark, sf):
    docs = W.table(spark, sf, "documents").select("doc_id", "text")
    return V.fixed_chunks(docs).select("doc_id", "chunk_idx", F.md5("text").alias("digest"))


add("passages", ["articles"], """select day, country, rank as article, source_url, domain, ((s - 1) / 420)::int as chunk_idx, piece
    as text from (select *, trim(substr(text, s, 500)) as piece from (select *, unnest(range(1, length(text) + 1, 420)) as s
    from (select * replace (trim(regexp_replace(text, '\\s+', ' ', 'g')) as text) from articles))) where length(piece) >= 80""")
add("ranked_passages", ["passages"], """select *, (row_number() over (partition by day, country order by article, chunk_idx))::int
    as rank, 1e0 / article as score from passages""")


def native_passages(spark, sf):
    """Fixed-stride pieces of the articles, ranked by article."""
    from pyspark.sql import Window

    pieces = V.fixed_chunks(articles(spark, sf).withColumnRenamed("rank", "article"))
    w = Window.partitionBy(*KEYS).orderBy("article", "chunk_idx")  # at most ten articles per spike
    return pieces.withColumns({"rank": F.row_number().over(w), "score": 1.0 / F.col("article")})


@query("txt6_passages_with_sources", with_ctes("""select day, country, source_url, domain, chunk_idx, md5(text) as digest
    from passages""", "passages"), dates="day")
def _(spark, sf):
    return native_passages(spark, sf).select("day", "country", "source_url", "domain", "chunk_idx", F.md5("text").alias("digest"))


_ENTRY = f"""'[Source: ' || (case when coalesce(domain, '') <> '' then domain else substr(source_url, 1, 40) end) || ' | Relevance: '
    || {fixed('score', 2)} || {quote(']' + chr(10) + '"')} || trim(text) || {quote('"' + chr(10))}"""


@query("txt10_context_blocks", with_ctes(f"""select day, country, string_agg(entry, {quote(chr(10))} order by rank) as context,
    count(*) as n_passages from (select *, sum(length(entry)) over (partition by day, country order by rank) as used from
    (select *, {_ENTRY} as entry from ranked_passages)) where used <= {C.CONTEXT_CHARS} group by 1, 2""", "ranked_passages"),
       dates="day")
def _(spark, sf):
    return V.context_block(native_passages(spark, sf), KEYS)


@query("txt11_one_per_domain", with_ctes("""select day, country, domain, source_url, (row_number() over (partition by day, country
    order by rank))::int as position from (select * from ranked_passages qualify row_number() over (partition by day, country,
    domain order by rank) = 1)""", "ranked_passages"), dates="day")
def _(spark, sf):
    return V.one_per_domain(native_passages(spark, sf), KEYS).select("day", "country", "domain", "source_url", "position")


# --- vectors -----------------------------------------------------------------------

add("cent", [], """select label, list(m order by i) as e from (select label, i, avg(v) as m from (select label,
    unnest(embedding)::double as v, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2) group by 1""")
add("unitcent", ["cent"], """select label::bigint as query_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e,
    lambda y: y * y)))) as e from cent""")
add("sims", ["unitcent"], f"""select query_id, vec_id, {rnd('list_dot_product(e, embedding::double[])', 6)} as score
    from embeddings, unitcent""")


@query("txt8_vector_search", with_ctes("""select query_id, vec_id, score, rank::int as rank from (select *, row_number() over
    (partition by query_id order by score desc, vec_id) as rank from sims) where rank <= 10""", "sims"), floats="score")
def _(spark, sf):
    """The ten vectors closest to the centre of each label."""
    vectors = W.table(spark, sf, "embeddings")
    return V.search(vectors, settle(V.centroids(vectors, "label")), 10)


@query("jn14_nearest_vector", with_ctes("""select query_id, vec_id, score, label = query_id as same_label from (select *,
    row_number() over (partition by query_id order by score desc, vec_id) as r from sims) join embeddings using (vec_id)
    where r = 1""", "sims"), floats="score")
def _(spark, sf):
    """The vector closest to each label's centre, and whether it carries that label."""
    vectors = W.table(spark, sf, "embeddings")
    best = V.search(vectors, settle(V.centroids(vectors, "label")), 1)
    return best.join(vectors.select("vec_id", "label"), "vec_id").select(
        "query_id", "vec_id", "score", (F.col("label") == F.col("query_id")).alias("same_label"))


def vector_ctes(p: str, needs, source: str, weights: str | None = None) -> None:
    """``{p}_vec``: entries of the unit vectors of ``source (id, text)``; ``weights`` names the vectors whose weights hold."""
    w = weights or p
    add(f"{p}_src", needs, source)
    add(f"{p}_raw", [f"{p}_src"], f"""select id, ('0x' || substr(md5(word), 1, 8))::bigint % {V.DIM} as b,
        sum(case when substr(md5(word), 9, 1) < '8' then 1 else -1 end)::double as s from (select id, unnest({words('text')})
        as word from {p}_src) group by 1, 2""")
    if weights is None:
        add(f"{p}_idf", [f"{p}_raw", f"{p}_src"], f"""select b, ln(((select count(*) from {p}_src) + 1e0) / (count(r.b) + 1e0)) as idf
            from (select unnest(range({V.DIM})) as b) d left join {p}_raw r using (b) group by 1""")
    add(f"{p}_vec", [f"{p}_raw", f"{w}_idf"], f"""select id, b, (case when norm > 0 then v / norm else 0e0 end)::float::double as v
        from (select id, b, s * idf as v, sqrt(sum(s * idf * s * idf) over (partition by id)) as norm from {p}_raw
        join {w}_idf using (b))""")


vector_ctes("dv", [], "select doc_id as id, text from documents")
vector_ctes("bv", [], "select item_id as id, text from benchmark", "dv")


@query("txt7_embed_documents", with_ctes("""select doc_id, coalesce(norm, 0e0) as norm, coalesce(n, 0)::int as n_terms
    from documents left join (select id, sqrt(sum(v * v)) as norm, count(*) filter (v <> 0) as n from dv_vec group by 1)
    on id = doc_id""", "dv_vec"), floats="norm", places=5)
def _(spark, sf):
    """Hashed, weighted word vectors of whole documents: length and non-zero entries."""
    docs = W.table(spark, sf, "documents").select("doc_id", "text")
    embedded = V.embed(docs, V.fit_embedder(docs))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return embedded.select("doc_id", norm.alias("norm"), F.size(F.filter("embedding", lambda x: x != 0)).alias("n_terms"))


@query("txt8_search_documents", with_ctes(f"""select query_id, vec_id, score, (row_number() over (partition by query_id
    order by score desc, vec_id))::int as rank from (select q.item_id as query_id, d.doc_id as vec_id, {rnd('coalesce(s, 0e0)', 6)} as score
    from benchmark q cross join documents d left join (select x.id as i, y.id as j, sum(x.v * y.v) as s from bv_vec x join dv_vec y
    using (b) group by 1, 2) on i = item_id and j = doc_id) qualify rank <= 10""", "bv_vec", "dv_vec"), floats="score")
def _(spark, sf):
    """The ten documents closest to each benchmark text."""
    docs = W.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    model = V.fit_embedder(docs)
    asked = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.search(V.embed(docs, model), settle(V.embed(asked, model).select("query_id", "embedding")), 10)


add("art", ["articles"], "select *, row_number() over (order by day, country, rank) as no from articles")
add("art_pieces", ["art"], f"select * from ({cuts_sql('select no as doc_id, text from art')})")
add("art_chunks", ["art_pieces", "art"], """select row_number() over (order by a.day, a.country, a.rank, p.chunk_idx) as id, a.day,
    a.country, a.rank as article, a.source_url, a.domain, p.chunk_idx, p.piece as text from art_pieces p join art a on a.no = p.doc_id""")
vector_ctes("pv", ["art_chunks"], "select id, text from art_chunks")
add("asked", ["spikes"], """select row_number() over (order by day, country) as id, day, country,
    'geopolitical events ' || country || ' ' || cast(day as varchar) as text from spikes""")
vector_ctes("qv", ["asked"], "select id, text from asked", "pv")
add("found", ["art_chunks", "asked", "pv_vec", "qv_vec"], f"""select day, country, source_url, domain, score, text, (row_number() over (
    partition by day, country order by score desc, article, chunk_idx))::int as rank from (select c.*, {rnd('coalesce(s, 0e0)', 6)} as score
    from art_chunks c join asked a using (day, country) left join (select x.id as i, y.id as j, sum(x.v * y.v) as s from pv_vec x
    join qv_vec y using (b) group by 1, 2) on i = c.id and j = a.id)""")


def retrieved(spark, sf, k=C.EVIDENCE_TOP_K):
    """Passages of each spike closest to the spike's search text."""
    pieces = settle(V.chunk(articles(spark, sf)))
    model = V.fit_embedder(pieces)
    ev = events(spark, sf, place=False, url=False)
    asked = V.embed(V.spike_queries(B.burst_table(ev)), model)
    pieces = pieces.withColumnRenamed("rank", "article")
    return V.search_within(V.embed(pieces, model), asked.drop("text"), KEYS, k, ("article", "chunk_idx"))


@query("src13_build_when_absent", with_ctes("""select day, country, article, source_url, domain, chunk_idx::int as chunk_idx,
    md5(text) as digest from art_chunks""", "art_chunks"), dates="day")
def _(spark, sf):
    """Passages of the spikes, from a store that is first asked for one country, then for all, then for all again."""
    texts, path = settle(articles(spark, sf).withColumnRenamed("rank", "article")), scratch(spark)
    spikes = settle(texts.select("country", "day").distinct())

    def build(absent):
        return V.chunk(texts.join(absent, ["country", "day"], "left_semi"))

    for wanted in (spikes.where(F.col("country") == "Iran"), spikes, spikes):
        stored = tables.build_absent(wanted, path, build)
    return stored.select("day", "country", "article", "source_url", "domain", "chunk_idx", F.md5("text").alias("digest"))


@query("txt9_spike_passages", with_ctes(f"""select day, country, rank, source_url, domain, score, text from found
    where rank <= {C.EVIDENCE_TOP_K}""", "found"), dates="day", floats="score")
def _(spark, sf):
    return retrieved(spark, sf).select("day", "country", "rank", "source_url", "domain", "score", "text")


@query("txt11_evidence_links", with_ctes(f"""select day, country, domain, source_url, (row_number() over (partition by day, country
    order by rank))::int as position from (select * from found where rank <= {C.LINK_TOP_K} and source_url <> '' qualify
    row_number() over (partition by day, country, domain order by rank) = 1)""", "found"), dates="day")
def _(spark, sf):
    """Links of the passages found for each spike, one per domain, best first."""
    return V.one_per_domain(retrieved(spark, sf, C.LINK_TOP_K), KEYS).select("day", "country", "domain", "source_url", "position")


def excerpts(n: int, size: int) -> str:
    return (f"array_to_string(list_transform(passages[1:{n}], lambda p: chr(10) || '[' || p.domain || '] ' || substr(p.text, 1, {size}) "
            "|| '...' || chr(10)), '')")


_LISTED = f"""array_to_string(list_transform(passages, lambda p, i: '[' || i || '] Source: ' || p.domain || '  (relevance: '
    || {fixed('p.score', 2)} || ')' || chr(10) || '    URL: ' || p.source_url || chr(10) || '    Excerpt: "' || substr(p.text, 1, 300)
    || '..."' || chr(10)), chr(10))"""
_HAS = "len(passages) > 0"
_WITH_TEXT = answers_sql(
    f" || case when {_HAS} then {quote(chr(10) * 2 + 'Supporting evidence from news sources:' + chr(10))} || {excerpts(2, 250)} else '' end",
    f"case when {_HAS} then 'Retrieved ' || len(passages) || {quote(' relevant article passage(s):' + chr(10) * 2)} || {_LISTED} "
    f"else {quote(T.NO_PASSAGES)} end",
    f" || case when {_HAS} then {quote('Relevant news evidence:' + chr(10))} || {excerpts(2, 200)} else '' end")
add("evidence", ["found"], f"""select day, country, list({{'domain': domain, 'source_url': source_url, 'score': score, 'text': text}}
    order by rank) as passages from found where rank <= {C.EVIDENCE_TOP_K} group by 1, 2""")


@query("rpt4_answers_with_evidence", with_ctes(f"""select question, day, country, intent, {_WITH_TEXT} as answer from (select q.question,
    {intent('q.question')} as intent, c.*, keywords, coalesce(passages, []) as passages
    from (select unnest([{', '.join(quote(q) for q in QUESTIONS)}]) as question) q, context c
    join kwlist k on k.day = c.day and k.country = c.country left join evidence e on e.day = c.day and e.country = c.country)""",
    "context", "kwlist", "evidence"), dates="day")
def _(spark, sf):
    """Standing questions about every spike, answered with its passages."""
    spikes = spike_rows(spark, sf, lambda ev, bursts: V.passage_arrays(retrieved(spark, sf)))
    asked = spikes.select("day", "country", F.explode(F.array(*[F.lit(q) for q in QUESTIONS])).alias("question"))
    return R.answers(asked, spikes)


add("led", ["found"], """select day, country, list(domain order by r) as domains from (select day, country, domain, min(rank) as r
    from found where rank <= 4 and domain <> '' group by 1, 2, 3) group by 1, 2""")
add("brief_led", ["brief_in", "led"], """select b.*, coalesce(domains, []) as domains from brief_in b left join led l
    on l.day = b.day and l.country = b.country""")


@query("rpt2_briefings_with_evidence", with_ctes(briefing_sql(
    f"case when len(domains) > 0 then {choose(T.EVIDENCE, 'seed + 4', domains="array_to_string(domains[1:3], ', ')")} "
    f"else {quote(T.NO_EVIDENCE[0])} end", "brief_led"), "brief_led"), dates="day")
def _(spark, sf):
    ev = events(spark, sf, url=False)
    bursts, facts = B.burst_table(ev), P.day_facts(ev)
    words = R.keyword_lists(K.per_spike(ev, bursts, K.event_vocabulary(ev)))
    domains = V.leading_domains(retrieved(spark, sf))
    return R.briefings(P.spike_info(facts, bursts), facts, words, domains)
