"""Common table expressions for the SQL side."""

from __future__ import annotations

from spikelens import config as C
from spikelens.sources.world_events import EXPR, PLACE, RAW_EXPR, URL

from .registry import r6


def rnd(expr: str, places: int) -> str:
    return f"round_even({expr}, 0)" if places == 0 else r6(expr, places)


def fixed(expr: str, places: int) -> str:
    return f"printf('%.{places}f', {rnd(expr, places)})"


def signed(expr: str, places: int) -> str:
    return f"printf('%+.{places}f', {rnd(expr, places)})"


def grouped(expr: str) -> str:
    return f"format('{{:,}}', cast({rnd(f'cast({expr} as double)', 0)} as bigint))"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


def case_map(expr: str, mapping: dict) -> str:
    whens = " ".join(f"when {quote(k) if isinstance(k, str) else k} then {quote(v)}" for k, v in mapping.items())
    return f"case {expr} {whens} end"


def title(x: str) -> str:
    part = (
        "lambda t: regexp_extract(t, '^[^\\p{L}]*') || upper(substr(regexp_extract(t, '\\p{L}+$'), 1, 1)) "
        "|| substr(regexp_extract(t, '\\p{L}+$'), 2)"
    )
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[^\\p{{L}}]*\\p{{L}}*'), {part}), '')"


def clean_actor(x: str) -> str:
    t = title(f"trim(coalesce({x}, 'Unknown'))")
    return f"case when lower({t}) in ('', 'nan', 'none', 'na') then 'Unknown' else {t} end"


def domain(url: str) -> str:
    return f"coalesce(replace(regexp_extract({url}, '^https?://([^/?#]*)', 1), 'www.', ''), '')"


def article_domain(url: str) -> str:
    return f"coalesce(regexp_replace(regexp_extract({url}, '^https?://([^/?#]*)', 1), '^www\\.', ''), '')"


def blocked(url: str) -> str:
    pattern = "|".join(d.replace(".", "\\.") for d in C.BLOCKED_DOMAINS)
    return f"regexp_matches({article_domain(url)}, '(^|\\.)({pattern})$')"


def strength(m: str, s: str, t: str, g: str) -> str:
    return rnd(f"ln(1e0 + coalesce({m}, 0)) + ln(1e0 + coalesce({s}, 0)) + abs({t}) / 10e0 "
               f"+ coalesce(abs({g}), 0e0) / 10e0", 3)


def root_label(code: str) -> str:
    return case_map(f"(case when length({code}) < 2 then lpad({code}, 2, '0') else {code} end)", C.ROOT_LABELS)


def tone_label(t: str) -> str:
    return (f"case when {t} is null then 'Unknown' when {t} < -3 then 'Very Negative' when {t} < -0.3e0 then 'Negative' "
            f"when {t} <= 0.3e0 then 'Neutral' when {t} <= 3 then 'Positive' else 'Very Positive' end")


def match_strength(score: str, best: str) -> str:
    ratio = f"(case when {best} > 0 then {score} / {best} else 0e0 end)"
    return f"case when {ratio} >= 0.65e0 then 'Strong' when {ratio} >= 0.4e0 then 'Moderate' else 'Weak' end"


def week(day: str) -> str:
    monday = f"date_trunc('week', {day})::date"
    return f"cast({monday} as varchar) || '/' || cast(({monday} + 6) as varchar)"


def sel(exprs: dict) -> str:
    return ", ".join(f"{e} as {c}" for c, e in exprs.items())


_FROM = (
    "from (select *, cast(json_extract(props, '$.k') as int) as k, (select count(*) from pages) as n_pages from events) e "
    "join nation n on n.n_nationkey = e.user_id % 25 "
    "left join pages p on e.event_id % 13 <> 12 and p.page_id = e.event_id % e.n_pages"
)

# name -> (names it needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev0": ((), f"select {sel({**EXPR, **PLACE, **URL})} {_FROM}"),
    "ev1": (("ev0",), f"""select *, cast(year(day) as int) as year, cast(month(day) as int) as month,
        strftime(day, '%Y-%m') as month_label, {week('day')} as week_label,
        {case_map('quad_class', C.QUAD_LABELS)} as quad_label,
        case when quad_class in (1, 2) then 'Cooperation' when quad_class in (3, 4) then 'Conflict' end as event_type,
        {root_label('root_code')} as root_label, actor1 || ' → ' || actor2 as actor_pair,
        {strength('num_mentions', 'num_sources', 'avg_tone', 'goldstein')} as event_strength,
        coalesce(actor1_cc, 'UNK') || ' → ' || coalesce(actor2_cc, 'UNK') as country_pair,
        {domain('source_url')} as source_domain from ev0"""),
    "ev": (("ev1",), """select *, cast(event_id as varchar) || ' | ' || cast(event_date as varchar) || ' | ' || actor_pair
        || ' | ' || coalesce(quad_label, 'Unknown') as event_label,
        trim(coalesce(actor1, '') || ' ' || coalesce(actor2, '') || ' ' || coalesce(location, '') || ' '
        || coalesce(quad_label, '') || ' ' || coalesce(root_label, '')) as text_for_tfidf from ev1"""),
    "raw": ((), f"""select {sel(RAW_EXPR)},
        replace(cast(cast(e.ts as date) as string), '-', '') || '.export.CSV' as file_name, e.event_id as line_no
        {_FROM}"""),
    # read as text, tokens that mean "missing" are null
    "daily": (("ev",), "select day, country, count(event_id) as event_count from ev group by 1, 2"),
    "grid": (("daily",), """select d.day, c.country, coalesce(x.event_count, 0) as event_count
        from (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from daily) d
        cross join (select distinct country from daily) c left join daily x on x.day = d.day and x.country = c.country"""),
    "baseline": (("grid",), f"""select day, country, event_count,
        {rnd('coalesce(avg(event_count) over w, 0e0)', 2)} as rolling_mean,
        {rnd('coalesce(stddev_samp(event_count) over w, 0e0)', 2)} as rolling_std
        from grid window w as (partition by country order by day rows between 7 preceding and 1 preceding)"""),
    "scored": (("baseline",), f"""select *, case when rolling_std > 0
        then {rnd('(event_count - rolling_mean) / rolling_std', 3)} else 0e0 end as z_score from baseline"""),
    "bursts": (("scored",), "select *, z_score > 2.0e0 and event_count >= 5 as is_burst from scored"),
    "spikes": (("bursts",), "select * from bursts where is_burst"),
}


def add(name: str, needs, text: str) -> None:
    CTES[name] = (tuple(needs), text)


def with_ctes(final: str, *names: str, **extra: tuple[tuple[str, ...], str]) -> str:
    """``final`` with the named expressions and all they need placed before it.

    ``extra`` adds expressions for this statement only: ``name=(needs, text)``.
    """
    ctes = {**CTES, **extra}
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in ctes[name][0]:
            visit(need)
        done.append(name)

    for name in (*names, *extra):
        visit(name)
    return "with " + ",\n".join(f"{n} as ({ctes[n][1]})" for n in done) + "\n" + final
