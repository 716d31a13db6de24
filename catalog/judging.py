"""Silver labels, evaluation and the learned relevance model."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikelens import config as C
from spikelens.functions.dist import settle
from spikelens.operators import bursts as B, chains as CH, evaluate as E, model as M, silver as S
from spikelens.plans import prepare
from spikelens.sources import tables
from spikelens.sources import world_events as W

from . import activity, chaining  # noqa: F401  (their SQL is used below)
from .activity import sensitive
from .chain_sql import chain_ctes, pair_ctes, pattern_ctes, score
from .cleaning import events, scratch, slim
from .registry import query
from .sql import add, fixed, rnd, with_ctes


def adopt(ctes: dict) -> None:
    for name, (needs, text) in ctes.items():
        add(name, needs, text)


adopt(chain_ctes("s", "owners", C.SILVER_TOP_N))
adopt(pattern_ctes("s"))
adopt(chain_ctes("e", "owners", 5))
adopt(pattern_ctes("e"))
adopt(pair_ctes("m", "owners", "any", 7))
add("relevant", ["s_chain"], f"""select anchor_id, event_id as item, side, position from s_chain
    where least(chain_score / {C.CHAIN_MAX_SCORE}, 1e0) >= {C.RELEVANCE_THRESHOLD}e0""")


def placed(spark, sf):
    return events(spark, sf, url=False)


def silver(spark, sf):
    ev = placed(spark, sf)
    bursts = B.burst_table(ev)
    return ev, bursts, S.silver_labels(ev, bursts)


_REAL = f"z_score >= 2e0 and event_count >= {C.SILVER_MIN_COUNT}"
_BURST_LABELS = f"""select day, country, event_count, z_score, {_REAL} as is_real_burst,
    'Auto-labeled: z=' || {fixed('z_score', 2)} || ', count=' || event_count as description from top8"""


@query("ml8_silver_spike_labels", with_ctes(_BURST_LABELS, "top8"), dates="day")
def _(spark, sf):
    return silver(spark, sf)[2].bursts


_IDS = """(select string_agg(item::varchar, ',' order by side = 'after', position) from relevant r
    where r.anchor_id = o.anchor_id)"""
_CHAIN_LABELS = f"""select o.anchor_id as anchor_event_id, cast(o.day as varchar) as date, o.country, a_actor1 || ' → ' || a_actor2
    as actors, a_quad_label as event_type, coalesce({_IDS}, '') as relevant_ids, pattern as expected_pattern,
    'Auto-labeled via heuristic chain scorer. z=' || {fixed('z_score', 2)} || ', ' || (select count(*) from relevant r
    where r.anchor_id = o.anchor_id) || ' relevant events found.' as description from owners o join s_a using (anchor_id)
    join s_pattern using (anchor_id) join top8 t on t.day = o.day and t.country = o.country"""


def flat_ids(df):
    return df.withColumn("relevant_ids", F.array_join(F.col("relevant_event_ids").cast("array<string>"), ",")).drop(
        "relevant_event_ids")


@query("ml8_silver_chain_labels", with_ctes(_CHAIN_LABELS, "owners", "s_a", "s_pattern", "top8", "relevant"))
def _(spark, sf):
    return flat_ids(silver(spark, sf)[2].chains)


@query("src12_label_file", with_ctes(f"""select 'chain' as kind, anchor_event_id::varchar as key, relevant_ids as detail
    from ({_CHAIN_LABELS}) union all select 'burst', cast(day as varchar) || country, is_real_burst::varchar
    from ({_BURST_LABELS})""", "owners", "s_a", "s_pattern", "top8", "relevant"))
def _(spark, sf):
    """Silver labels written as one JSON document and read back."""
    path = scratch(spark)
    made = silver(spark, sf)[2]
    tables.write_label_file(made.bursts, made.chains, path)
    bursts, chains = tables.read_labels(spark, path)
    a = flat_ids(chains).select(F.lit("chain").alias("kind"), F.col("anchor_event_id").cast("string").alias("key"),
                                F.col("relevant_ids").alias("detail"))
    b = bursts.select(F.lit("burst").alias("kind"), F.concat(F.col("day").cast("string"), "country").alias("key"),
                      F.col("is_real_burst").cast("string").alias("detail"))
    return a.unionByName(b)


@query("ml9_spike_template", with_ctes(f"""select cast(day as varchar) as day, country, event_count, {rnd('z_score', 2)} as z_score,
    true as is_real_burst, 'TODO: describe what happened' as description from (select * from bursts order by z_score desc, day,
    country limit 15)""", "bursts"))
def _(spark, sf):
    return S.burst_template(B.burst_table(slim(spark, sf)))


# --- spikes against labels ----------------------------------------------------------

add("labels1", ["spikes1"], "select day, country, event_count >= (select avg(event_count) from spikes1) as is_real_burst from spikes1")
add("outcomes", ["labels1", "spikes"], """select l.*, case when is_real_burst and s.day is not null then 'true_positive'
    when is_real_burst then 'false_negative' when s.day is not null then 'false_positive' else 'true_negative' end as result
    from labels1 l left join spikes s on s.day = l.day and s.country = l.country""")
add("p95", ["bursts"], "select quantile_cont(event_count, 0.95) as t from bursts")
add("outcomes95", ["labels1", "bursts", "p95"], """select l.*, case when is_real_burst and s.day is not null then 'true_positive'
    when is_real_burst then 'false_negative' when s.day is not null then 'false_positive' else 'true_negative' end as result
    from labels1 l left join (select * from bursts where event_count > (select t from p95)) s
    on s.day = l.day and s.country = l.country""")


def judged_days(spark, sf):
    """Days found at a lower threshold; those with more events than the mean of them count as real."""
    found = sensitive(spark, sf).where("is_burst")
    mean = found.agg(F.avg("event_count")).scalar()
    return found.select("day", "country", (F.col("event_count") >= mean).alias("is_real_burst"))


def _prf(source: str) -> str:
    return f"""select *, {rnd('p', 3)} as precision, {rnd('r', 3)} as recall, {rnd('2 * p * r / greatest(p + r, 1e-9)', 3)} as f1
        from (select *, true_positives / greatest(true_positives + false_positives, 1)::double as p,
        true_positives / greatest(true_positives + false_negatives, 1)::double as r from (select
        count(*) filter (result = 'true_positive') as true_positives, count(*) filter (result = 'false_positive') as
        false_positives, count(*) filter (result = 'false_negative') as false_negatives,
        count(*) filter (result = 'true_negative') as true_negatives, count(*) as total_labels from {source}))"""


@query("jn9_label_outcomes", with_ctes("select * from outcomes", "outcomes"), dates="day")
def _(spark, sf):
    return E.label_outcomes(B.burst_table(slim(spark, sf)).where("is_burst"), judged_days(spark, sf))


@query("evl2_spike_scores", with_ctes(f"select * exclude (p, r) from ({_prf('outcomes')})", "outcomes"))
def _(spark, sf):
    return E.outcome_scores(E.label_outcomes(B.burst_table(slim(spark, sf)).where("is_burst"), judged_days(spark, sf)))


@query("evl4_percentile_baseline", with_ctes(f"""select a.precision, a.recall, a.f1, b.precision as baseline_precision,
    b.recall as baseline_recall, b.f1 as baseline_f1, {rnd('a.f1 - b.f1', 3)} as f1_improvement
    from ({_prf('outcomes')}) a, ({_prf('outcomes95')}) b""", "outcomes", "outcomes95"))
def _(spark, sf):
    return E.versus_percentile(B.burst_table(slim(spark, sf)), judged_days(spark, sf))


# --- chains against labels ----------------------------------------------------------

add("retrieved", ["e_chain"], """select anchor_id, event_id as item, row_number() over (partition by anchor_id
    order by side = 'after', position) as rank from e_chain""")


def metrics_sql(retrieved: str, queries: str, keys: str) -> str:
    """Metrics per query; ``keys`` besides anchor_id as ', name' text."""
    k = "anchor_id" + keys
    g = lambda n: f"sum(rel) filter (rank <= {n})"
    return f"""select {k}, coalesce(n, 0) as retrieved_count, relevant_count,
        {rnd('case when n > 0 then h3 / least(n, 3)::double else 0e0 end', 4)} as precision_at_3,
        {rnd('case when n > 0 then h5 / least(n, 5)::double else 0e0 end', 4)} as precision_at_5,
        {rnd('coalesce(h5 / relevant_count::double, 0e0)', 4)} as recall_at_5,
        {rnd('coalesce(dcg / (select sum(1e0 / log2(i + 1)) from range(1, least(relevant_count, 5) + 1) x(i)), 0e0)', 4)}
          as ndcg_at_5,
        {rnd('coalesce(1e0 / first_hit, 0e0)', 4)} as mrr, {rnd('coalesce(ap / relevant_count, 0e0)', 4)} as ap
        from (select {k} from {queries}) q left join (select {k}, count(*) as n, {g(3)} as h3, {g(5)} as h5,
        sum(rel / log2(rank + 1)) filter (rank <= 5) as dcg, min(rank) filter (rel > 0) as first_hit,
        sum(hits / rank) filter (rel > 0) as ap from (select *, sum(rel) over (partition by {k} order by rank) as hits
        from (select x.*, (r.item is not null)::int::double as rel from {retrieved} x left join relevant r
        on r.anchor_id = x.anchor_id and r.item = x.item)) group by {k}) m using ({k})
        join (select anchor_id, count(*) as relevant_count from relevant group by 1) using (anchor_id)"""


add("metrics", ["retrieved", "relevant", "e_a"], metrics_sql("retrieved", "e_a", ""))


def evaluated(spark, sf):
    ev, _, made = silver(spark, sf)
    chain = settle(CH.find_chains(ev, made.anchors))
    return ev, made, chain


@query("win10_result_ranks", with_ctes("select * from retrieved", "retrieved"))
def _(spark, sf):
    return E.chain_retrieved(evaluated(spark, sf)[2]).withColumn("rank", F.col("rank").cast("bigint"))


@query("evl1_ranking_metrics", with_ctes("select * from metrics", "metrics"))
def _(spark, sf):
    _, made, chain = evaluated(spark, sf)
    return E.ranking_metrics(E.chain_retrieved(chain), made.relevant, made.anchors)


def m4(c: str) -> str:
    return f"round_even(avg(round_even({c} * 1e4, 0)), 0) / 1e4"


@query("evl5_chain_metrics", with_ctes("select " + ", ".join(
    f"{m4(c)} as mean_{'map' if c == 'ap' else c}" for c in
    ("precision_at_3", "precision_at_5", "recall_at_5", "ndcg_at_5", "mrr", "ap")) + ", count(*) as num_queries from metrics",
    "metrics"))
def _(spark, sf):
    _, made, chain = evaluated(spark, sf)
    return E.mean_metrics(E.ranking_metrics(E.chain_retrieved(chain), made.relevant, made.anchors))


add("sample15", ["ev"], "select event_id as anchor_id from ev order by md5('42:' || event_id), event_id limit 15")
adopt(chain_ctes("q", "sample15", 5))
adopt(pattern_ctes("q"))
_QUALITY = f"""select anchor_id, pattern, coalesce(n, 0) as chain_size, coalesce(actors, 0e0) as actor_overlap,
    coalesce(countries, 0e0) as country_overlap, coalesce(mean, 0e0) as avg_chain_score from q_pattern left join (select anchor_id,
    count(*) as n, {rnd('avg(actor_hit::int)', 3)} as actors, {rnd('avg((country = a_country)::int)', 3)} as countries,
    round_even(avg(round_even(chain_score * 1e4, 0)) / 10, 0) / 1e3 as mean from q_chain group by 1) using (anchor_id)"""


def sampled(spark, sf):
    """A seeded sample of events with their chains."""
    ev = placed(spark, sf)
    anchors = CH.anchor_rows(ev, S.sample_ids(ev))
    chain = settle(CH.find_chains(ev, anchors))
    return ev, anchors, CH.with_details(chain, ev, anchors, ("event_id", "actor1", "actor2", "country")), chain


@query("evl6_chain_quality", with_ctes(_QUALITY, "q_pattern", "q_chain"))
def _(spark, sf):
    _, anchors, detailed, chain = sampled(spark, sf)
    return E.chain_quality(detailed, anchors, CH.chain_patterns(chain, anchors))


add("pattern_pairs", ["s_pattern", "e_pattern"], """select s.pattern as expected, e.pattern as predicted from s_pattern s
    join e_pattern e using (anchor_id)""")


def pattern_pairs(spark, sf):
    ev, made, chain = evaluated(spark, sf)
    predicted = CH.chain_patterns(chain, made.anchors).select("anchor_id", F.col("pattern").alias("predicted"))
    return settle(made.chains.select(F.col("anchor_event_id").alias("anchor_id"), F.col("expected_pattern").alias("expected"))
                  .join(predicted, "anchor_id").select("expected", "predicted"))


_CLASSES = """(select label, tp, coalesce(ne, 0) as ne, coalesce(np, 0) as np, 2 * (tp / greatest(coalesce(np, 0), 1)::double)
    * (tp / greatest(coalesce(ne, 0), 1)::double) / greatest(tp / greatest(coalesce(np, 0), 1)::double
    + tp / greatest(coalesce(ne, 0), 1)::double, 1e-9) as f1 from (select coalesce(e.label, p.label) as label, ne, np,
    (select count(*) from pattern_pairs where expected = coalesce(e.label, p.label) and predicted = expected) as tp
    from (select expected as label, count(*) as ne from pattern_pairs group by 1) e full join (select predicted as label,
    count(*) as np from pattern_pairs group by 1) p on e.label = p.label))"""


@query("evl7_pattern_scores", with_ctes(f"""select {rnd('sum(tp) / sum(ne)', 3)} as accuracy, {rnd('avg(f1)', 3)} as macro_f1,
    sum(ne)::bigint as n_evaluated, string_agg(label || '=' || {fixed('f1', 3)}, ', ' order by label) as per_class_f1
    from {_CLASSES}""", "pattern_pairs"))
def _(spark, sf):
    from spikelens.functions.exprs import fixed as fix

    text = F.transform(F.map_entries("per_class_f1"), lambda e: F.concat(e["key"], F.lit("="), fix(e["value"], 3)))
    return E.pattern_scores(pattern_pairs(spark, sf)).withColumn("per_class_f1", F.array_join(F.array_sort(text), ", "))


_PATTERNS = ("De-escalation", "Escalation", "Isolated", "Mixed", "Persistence", "Unknown")


@query("evl7_confusion_matrix", with_ctes("select expected, " + ", ".join(
    f"""count(*) filter (predicted = '{p}') as "{p}" """ for p in _PATTERNS) + " from pattern_pairs group by 1", "pattern_pairs"))
def _(spark, sf):
    return E.confusion(pattern_pairs(spark, sf))


_UNION = " union all ".join(f"select anchor_id, event_id as item, '{name}' as config, {score(w, 10)} as score from m_pairs"
                            for name, w in E.ablation_weights().items())
add("ablated", ["m_pairs"], f"""select *, row_number() over (partition by anchor_id, config order by score desc, item) as rank
    from ({_UNION}) qualify rank <= 10""")
_CONFIGS = "(select anchor_id, unnest([" + ", ".join(f"'{n}'" for n in E.ablation_weights()) + "]) as config from e_a) qs"


@query("evl8_ablation", with_ctes(f"""select config, mean_ndcg_5, std_ndcg_5, n_queries, {rnd('mean_ndcg_5 - max(mean_ndcg_5) '
    "filter (config = 'full_model') over ()", 4)} as delta_vs_full from (select config, {m4('ndcg_at_5')} as mean_ndcg_5,
    {rnd('stddev_pop(ndcg_at_5)', 4)} as std_ndcg_5, count(*) as n_queries
    from ({metrics_sql('ablated', _CONFIGS, ', config')}) group by 1)""", "ablated", "relevant", "e_a"), floats="delta_vs_full")
def _(spark, sf):
    ev, _, made = silver(spark, sf)
    return E.ablation_scores(E.ablation_ranks(ev, made.anchors), made.relevant, made.anchors)


def random_cte(p: str) -> str:
    return f"""select *, row_number() over (partition by anchor_id, trial order by substr(md5('42:' || anchor_id || ':' || item),
        1 + {E.TRIAL_DIGITS} * (trial - 1), {E.TRIAL_DIGITS}), item) as rank from (select *, event_id as item,
        unnest([1, 2, 3, 4, 5]) as trial from {p}_hits) qualify rank <= 10"""


add("drawn", ["m_hits"], """select *, row_number() over (partition by anchor_id, trial order by md5('42:' || trial || ':' || anchor_id
    || ':' || item), item) as rank from (select *, event_id as item, unnest([1, 2, 3, 4, 5]) as trial from m_hits) qualify rank <= 10""")
_TRIALS = "(select anchor_id, unnest([1, 2, 3, 4, 5]) as trial from e_a) qs"


@query("evl9_random_baseline", with_ctes(f"""select 'random_baseline' as config, round_even(avg(s) / 5, 0) / 1e4 as mean_ndcg_5,
    {rnd('stddev_pop(s) / 5 / 1e4', 4)} as std_ndcg_5, count(*) as n_queries from (select anchor_id,
    sum(round_even(ndcg_at_5 * 1e4, 0)) as s from
    ({metrics_sql('(select anchor_id, trial, item, rank from drawn)', _TRIALS, ', trial')}) group by 1)""",
    "drawn", "relevant", "e_a"))
def _(spark, sf):
    ev, _, made = silver(spark, sf)
    return E.random_baseline(E.random_ranks(ev, made.anchors), made.relevant, made.anchors)


adopt(pair_ctes("qx", "sample15", "any", 7))
add("qdrawn", ["qx_hits"], random_cte("qx"))


@query("evl10_lift_over_random", with_ctes(f"""select {', '.join(rnd(c, 3) + ' as ' + n for c, n in (
    ('sa', 'scored_actor_overlap'), ('sc', 'scored_country_overlap'), ('ra', 'random_actor_overlap'),
    ('rc', 'random_country_overlap'), ('sa - ra', 'actor_overlap_lift'), ('sc - rc', 'country_overlap_lift')))}, n_scored,
    n_random_trials from (select avg(a) as sa, avg(c) as sc, count(*) as n_scored from (select anchor_id, avg(actor_hit::int) as a,
    avg((country = a_country)::int) as c from q_chain group by 1)), (select avg(a) as ra, avg(c) as rc, count(*) as
    n_random_trials from (select anchor_id, trial, avg(actor_hit::int) as a, avg((country = a_country)::int) as c
    from qdrawn group by 1, 2))""", "q_chain", "qdrawn"))
def _(spark, sf):
    ev, anchors, chain, _ = sampled(spark, sf)
    return E.lift_over_random(chain, anchors, E.random_ranks(ev, anchors, one_hash=True))


@query("evl11_summary")
def _(spark, sf):
    """All evaluation sections as long rows."""
    from spikelens.operators import clean

    ev, bursts, made = silver(spark, sf)
    report = clean.cleaning_report(W.raw_view(spark, sf))
    return prepare.evaluation(ev, bursts, report, made.bursts, made.chains)


# --- learned model --------------------------------------------------------------------

add("pool", ["m_pairs", "relevant"], """select p.*, (r.item is not null)::int as label from m_pairs p left join relevant r
    on r.anchor_id = p.anchor_id and r.item = p.event_id where p.anchor_id in (select anchor_id from relevant)""")
add("training", ["pool"], f"""select anchor_id, event_id, label, {', '.join(C.FEATURES)} from (select *, row_number() over (
    partition by anchor_id, label order by md5('42:' || anchor_id || ':' || event_id), event_id) as r,
    sum(label) over (partition by anchor_id) as n_pos from pool) where n_pos > 0 and (label = 1 or r <= 5 * n_pos)""")


def training(spark, sf):
    ev, _, made = silver(spark, sf)
    return settle(M.training_pairs(ev, made.anchors, made.relevant))


@query("jn13_pool_split", with_ctes("select anchor_id, label, count(*) as n from pool group by 1, 2", "pool"))
def _(spark, sf):
    ev, _, made = silver(spark, sf)
    used = settle(made.anchors.join(made.relevant.select("anchor_id").distinct(), "anchor_id", "left_semi"))
    return M.labelled_pool(ev, used, made.relevant).groupBy("anchor_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("ml6_training_pairs", with_ctes("select * from training", "training"), floats=" ".join(C.FEATURES))
def _(spark, sf):
    return training(spark, sf)


@query("ml1_feature_scaling", with_ctes(" union all ".join(
    f"select {i} as i, '{f}' as feature, avg({f}) as mean, greatest(stddev_pop({f}), 1e-9) as std from training"
    for i, f in enumerate(C.FEATURES)), "training"), floats="mean std")
def _(spark, sf):
    return M.fit_scaler(training(spark, sf))


@query("ml2_class_weights", with_ctes("""select label, count(*) as n, (select count(*) from training) / (2e0 * count(*)) as weight
    from training group by 1""", "training"), floats="weight")
def _(spark, sf):
    return M.class_weights(training(spark, sf))


_N = len(C.FEATURES)
add("scaler", ["training"], "select " + ", ".join(
    f"avg({f}) as m{i}, greatest(stddev_pop({f}), 1e-9) as s{i}" for i, f in enumerate(C.FEATURES)) + " from training")
add("scaled", ["training", "scaler"], f"""select anchor_id, event_id, label, x, least(((row_number() over (
    order by md5('fold:' || anchor_id || ':' || event_id), anchor_id, event_id) - 1) // (n // k)), k - 1)::int as fold, n, k
    from (select anchor_id, event_id, label, [{', '.join(f'({f} - m{i}) / s{i}' for i, f in enumerate(C.FEATURES))}] as x,
    count(*) over () as n, least(5, greatest(2, count(*) over () // 5)) as k from training, scaler)""")
# one model per fold, which does not see it, and one (fold k) that sees all; materialized, as the steps read it often
add("seen", ["scaled"], """select m.m, s.x, s.label, s.label::double as y, count(*) over (partition by m.m) as n,
    count(*) over (partition by m.m) / (2e0 * count(*) over (partition by m.m, s.label)) as share
    from scaled s, (select unnest(range(max(k) + 1))::int as m from scaled) m where s.fold <> m.m""")
#: Plain gradient steps from zero; the library takes Newton steps to the same optimum.
_STEPS, _RATE = 700, "0.4e0"
add("fitted", ["seen"], f"""select * from (with recursive steps(i, m, w, b) as (
    select 0, m, [{', '.join(['0e0'] * _N)}], 0e0 from (select distinct m from seen)
    union all
    select i + 1, m, [{', '.join(f'any_value(w[{j}]) - {_RATE} * (sum(e * x[{j}]) / any_value(n) + any_value(w[{j}]))'
                                 for j in range(1, _N + 1))}], any_value(b) - {_RATE} * (sum(e) / any_value(n))
    from (select i, steps.m, w, b, x, n, share * (1e0 / (1e0 + exp(-(list_dot_product(x, w) + b))) - y) as e
        from steps join seen on seen.m = steps.m where i < {_STEPS}) group by i, m)
    select m, w, b from steps where i = {_STEPS})""")
add("model", ["fitted", "scaled"], "select w, b from fitted where m = (select max(k) from scaled)")
add("judged_folds", ["fitted", "scaled"], """select fold, count(*) filter (label = 1 and said) as tp,
    count(*) filter (label = 0 and said) as fp, count(*) filter (label = 1 and not said) as fn from (select s.fold, s.label,
    list_dot_product(s.x, f.w) + f.b >= 0 as said from scaled s join fitted f on f.m = s.fold) group by 1""")
add("fold_f1", ["judged_folds"], """select *, 2 * p * r / greatest(p + r, 1e-9) as f1 from (select *, tp / greatest(tp + fp, 1) as p,
    tp / greatest(tp + fn, 1) as r from judged_folds)""")
_MODEL_TABLE = " union all ".join(
    f"select {i} as i, '{f}' as feature, m{i} as mean, s{i} as std, w[{i + 1}] as coef from model, scaler"
    for i, f in enumerate(C.FEATURES)) + f" union all select {_N}, 'intercept', 0e0, 1e0, b from model"


@query("ml3_logistic_fit", with_ctes(_MODEL_TABLE, "model", "scaler"), floats="mean std coef", places=3)
def _(spark, sf):
    """Model table: scaling and coefficient of every feature, and the intercept."""
    return M.train(training(spark, sf))[0]


@query("ml4_cross_validation", with_ctes("select fold, tp, fp, fn, f1 from fold_f1", "fold_f1"), floats="f1")
def _(spark, sf):
    return M.train(training(spark, sf))[1]


@query("ml4_summary", with_ctes(f"""select count(*) as n_folds, {rnd('avg(f1)', 3)} as cv_f1_mean,
    {rnd('stddev_pop(f1)', 3)} as cv_f1_std, (select count(*) from training) as n_samples,
    (select count(*) from training where label = 1) as n_positive, (select count(*) from training where label = 0) as n_negative
    from fold_f1""", "fold_f1", "training"))
def _(spark, sf):
    """Mean and deviation of the folds' F1, and the sample counts."""
    pairs = training(spark, sf)
    return M.validation_summary(M.train(pairs)[1], pairs)


@query("ml5_importance", with_ctes(" union all ".join(
    f"select '{f}' as feature, w[{i + 1}] as coef from model" for i, f in enumerate(C.FEATURES)), "model"), floats="coef", places=3)
def _(spark, sf):
    return M.importance(M.train(training(spark, sf))[0])


@query("ml7_stored_model", with_ctes(_MODEL_TABLE, "model", "scaler"), floats="mean std coef", places=3)
def _(spark, sf):
    """Labels to stored model and back."""
    path = scratch(spark)
    M.save_model(M.train(training(spark, sf))[0], path)
    return M.load_model(spark, path)


_LOGIT = " + ".join(f"({f} - m{i}) / s{i} * w[{i + 1}]" for i, f in enumerate(C.FEATURES))
adopt({k: (needs, text) for k, (needs, text) in chain_ctes("ml", "owners", 5).items() if k != "ml_scored"})
add("ml_scored", ["ml_pairs", "model", "scaler"], f"""select *, {rnd(f'1e0 / (1e0 + exp(-(b + {_LOGIT})))', 4)} as chain_score,
    case when event_date < a_event_date then 'before' when event_date > a_event_date then 'after' else 'same' end as pool
    from ml_pairs, model, scaler""")


@query("chn3_model_chains", with_ctes("select anchor_id, event_id, side, position, chain_score from ml_chain", "ml_chain"))
def _(spark, sf):
    """Chains of the spike anchors ranked by the trained model."""
    ev, _, made = silver(spark, sf)
    model, _ = M.train(settle(M.training_pairs(ev, made.anchors, made.relevant)))
    return CH.find_chains(ev, made.anchors, score=M.model_score(model)).select(
        "anchor_id", "event_id", "side", "position", "chain_score")
