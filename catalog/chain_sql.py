"""SQL of the chain operators, for any anchor list."""

from __future__ import annotations

from spikelens import config as C
from spikelens.operators.chains import ANCHOR_COLUMNS

from .sql import quote, rnd

FEATURE_SQL = {
    "same_country": "coalesce(country = a_country, false)::int::double",
    "same_event_root": "(root_code is not distinct from a_root_code)::int::double",
    "same_quad_class": "coalesce(quad_class = a_quad_class, false)::int::double",
    "same_location": "coalesce(location = a_location and a_location <> '', false)::int::double",
    "actor_exact_match": "actor_hit::int::double",
    "actor_country_match": "code_hit::int::double",
    "actor_country_interact": "actor_hit::int::double * coalesce(country = a_country, false)::int::double",
    "tone_distance": "least(abs(coalesce(avg_tone, 0e0) - coalesce(a_avg_tone, 0e0)) / 20e0, 1e0)",
    "goldstein_distance": "least(abs(coalesce(goldstein, 0e0) - coalesce(a_goldstein, 0e0)) / 20e0, 1e0)",
    "temporal_decay": f"exp(-abs(event_date - a_event_date) / {C.TEMPORAL_TAU}e0)",
    "is_precursor": "(event_date < a_event_date)::int::double",
    "is_followup": "(event_date > a_event_date)::int::double",
    "candidate_strength": "least(coalesce(event_strength, 0e0) / 10e0, 1e0)",
    "anchor_strength": "least(coalesce(a_event_strength, 0e0) / 10e0, 1e0)",
    "mention_ratio": "least(greatest(coalesce(num_mentions, 1)::double, 1e0) "
                     "/ greatest(coalesce(a_num_mentions, 1)::double, 1e0), 5e0) / 5e0",
    "cross_country": "(not coalesce(country = a_country, false) and actor_hit)::int::double",
}


def hit(anchor_names, own_names, blanks) -> str:
    blank = ", ".join(quote(b) for b in blanks)
    return "(" + " or ".join(f"coalesce({a} = {c} and {a} not in ({blank}), false)"
                             for a in anchor_names for c in own_names) + ")"


def score(weights: dict, places: int = 4) -> str:
    return rnd(" + ".join(f"{f} * ({float(weights[f])!r}e0)" for f in C.FEATURES), places)


def pair_ctes(p: str, anchor_cte: str, scope: str = "same", window: int = 7) -> dict:
    """``{p}_a``: anchor rows; ``{p}_pairs``: candidates with features."""
    a_cols = ", ".join(f"{c} as a_{c}" for c in ANCHOR_COLUMNS)
    where = {"same": "and e.country = a.a_country", "other": "and e.country <> a.a_country", "any": ""}[scope]
    features = ", ".join(f"{s} as {f}" for f, s in FEATURE_SQL.items())
    return {
        f"{p}_a": (("ev", anchor_cte), f"select event_id as anchor_id, {a_cols} from ev where event_id in "
                                       f"(select anchor_id from {anchor_cte})"),
        f"{p}_hits": ((f"{p}_a",), f"""select *, {hit(('a_actor1', 'a_actor2'), ('actor1', 'actor2'), ('Unknown', ''))}
            as actor_hit, {hit(('a_actor1_cc', 'a_actor2_cc'), ('actor1_cc', 'actor2_cc'), ('UNK', ''))} as code_hit
            from ev e join {p}_a a on e.event_date between a.a_event_date - {window} and a.a_event_date + {window}
            and e.event_id <> a.anchor_id {where}"""),
        f"{p}_pairs": ((f"{p}_hits",), f"select *, {features} from {p}_hits"),
    }


REASONS = "concat_ws(', ', " + ", ".join(
    f"case when {f} > 0 then '{code}' end" for f, code in C.REASON_CODES
) + ", case when candidate_strength > 0.5e0 then 'importance' end)"


def chain_ctes(p: str, anchor_cte: str, top_n: int = 5, scope: str = "same", window: int = 7) -> dict:
    """Adds ``{p}_chain``: chain rows with side and position."""
    return {
        **pair_ctes(p, anchor_cte, scope, window),
        f"{p}_scored": ((f"{p}_pairs",), f"""select *, {score(C.CHAIN_WEIGHTS)} as chain_score, {REASONS} as score_reasons,
            case when event_date < a_event_date then 'before' when event_date > a_event_date then 'after' else 'same' end
            as pool from {p}_pairs"""),
        f"{p}_ranked": ((f"{p}_scored",), f"""select *, row_number() over (partition by anchor_id, pool
            order by chain_score desc, event_id) as rank from {p}_scored qualify rank <= {top_n}"""),
        f"{p}_sized": ((f"{p}_ranked",), f"""select *, count(*) filter (pool = 'before') over (partition by anchor_id) as nb,
            count(*) filter (pool = 'after') over (partition by anchor_id) as na,
            count(*) filter (pool = 'same') over (partition by anchor_id) as ns from {p}_ranked"""),
        f"{p}_placed": ((f"{p}_sized",), f"""select * exclude (rank), case when pool <> 'same' then pool
            when rank <= least({top_n} - nb, greatest(ns // 2, 1)) then 'before'
            when rank > ns - greatest(least({top_n} - na, ns - greatest(ns // 2, 1)), 0) then 'after' end as side
            from {p}_sized"""),
        f"{p}_chain": ((f"{p}_placed",), f"""select *, (row_number() over (partition by anchor_id, side order by event_date,
            chain_score desc, event_id))::int as position from {p}_placed where side is not null"""),
    }


def norm_sf(z: str) -> str:
    c = C.NORM_COEF
    t = f"(1e0 / (1e0 + {C.NORM_T}e0 * {z}))"
    poly = f"({c[4]}e0)"
    for k in reversed(c[:4]):
        poly = f"(({k}e0) + {t} * {poly})"
    return f"greatest(0e0, least(1e0, {C.NORM_D}e0 * exp(-{z} * {z} / 2e0) * {t} * {poly}))"


def pattern_ctes(p: str) -> dict:
    """Adds ``{p}_pattern`` on top of :func:`chain_ctes`."""
    strong = "(p < 0.10e0 and abs(tau) > 0.3e0)"
    few = "(n_events < 2 or n < 3)"
    return {
        f"{p}_seq": ((f"{p}_chain", f"{p}_a"), f"""select *, row_number() over (partition by anchor_id order by event_date, part,
            position) as i from (select anchor_id, event_date, case side when 'before' then 0 else 2 end as part, position,
            goldstein, quad_class from {p}_chain union all select anchor_id, a_event_date, 1, 1, a_goldstein, a_quad_class
            from {p}_a)"""),
        f"{p}_g": ((f"{p}_seq",), f"select anchor_id, i, goldstein as g from {p}_seq where goldstein is not null"),
        f"{p}_s": ((f"{p}_g",), f"""select x.anchor_id, sum(sign(y.g - x.g))::double as s, sum((y.g = x.g)::int)::double as ties
            from {p}_g x join {p}_g y on x.anchor_id = y.anchor_id and x.i < y.i group by 1"""),
        f"{p}_n": ((f"{p}_g", f"{p}_seq"), f"""select q.*, coalesce(g.n, 0) as n, g.std, g.traj, g.gs from (select anchor_id,
            count(*) as n_events, avg((quad_class in (3, 4))::int) as cr, count(quad_class) as nq from {p}_seq group by 1) q
            left join (select anchor_id, count(*) as n, stddev_pop(g) as std, list(g order by i) as gs,
            string_agg(printf('%.1f', g), ',' order by i) as traj from {p}_g group by 1) g using (anchor_id)"""),
        f"{p}_t": ((f"{p}_n", f"{p}_s"), f"""select *, case when n >= 2 and den > 0 then s / den else 0e0 end as tau,
            case when n >= 2 and den > 0 then 2e0 * {norm_sf("(abs(s) / sqrt(n * (n - 1) * (2 * n + 5) / 18e0))")} else 1e0 end
            as p from (select a.*, s, ties, sqrt((n * (n - 1) / 2e0) * (n * (n - 1) / 2e0 - ties)) as den from {p}_n a
            left join {p}_s using (anchor_id))"""),
        f"{p}_pattern": ((f"{p}_t",), f"""select anchor_id, n_events, coalesce(traj, '') as traj, gs,
            case when n_events < 2 then 'Isolated' when n < 3 then case when nq = 0 then 'Isolated'
              when cr > 0.7e0 or cr < 0.3e0 then 'Persistence' else 'Mixed' end
              when {strong} and tau < -0.3e0 then 'Escalation' when {strong} then 'De-escalation'
              when p >= 0.10e0 and std > 4 then 'Mixed' when p >= 0.10e0 then 'Persistence' else 'Mixed' end as pattern,
            case when {few} then 'Low' when {strong} and p < 0.05e0 then 'High'
              when {strong} or (p >= 0.10e0 and std > 4) then 'Moderate' else 'Low' end as confidence,
            case when {few} then 0e0 else {rnd('tau', 3)} end as tau,
            case when {few} then 1e0 else {rnd('p', 4)} end as p_value from {p}_t"""),
    }
