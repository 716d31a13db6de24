"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import config as C


def np_round(x: Column, places: int) -> Column:
    """Scale, round half to even, unscale: the float rounding used for all reports."""
    if places == 0:
        return F.rint(x)
    scale = F.lit(float(10 ** places))
    return F.rint(x * scale) / scale


def fixed(x: Column, places: int) -> Column:
    """Text with a fixed number of decimals, half-even (Java's formatter is half-up)."""
    return F.format_string(f"%.{places}f", np_round(x, places))


def signed(x: Column, places: int) -> Column:
    """Like :func:`fixed`, always with a sign."""
    return F.format_string(f"%+.{places}f", np_round(x, places))


def grouped(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_string("%,d", np_round(x.cast("double"), 0).cast("bigint"))


def lookup(mapping: dict, key: Column) -> Column:
    """Value for ``key`` from a small constant table, null when absent."""
    items = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*items), key)


def title_case(x: Column) -> Column:
    """Capitalise every run of letters, also after hyphens, dots and apostrophes."""
    words = F.split(F.lower(x), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, F.initcap), "")


def strip(x: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_actor(x: Column) -> Column:
    name = title_case(strip(F.coalesce(x, F.lit("Unknown"))))
    return F.when(F.lower(name).isin("", "nan", "none", "na"), "Unknown").otherwise(name)


def source_domain(url: Column) -> Column:
    """Network location of an http(s) URL without "www."; '' for anything else."""
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    return F.coalesce(F.replace(host, F.lit("www."), F.lit("")), F.lit(""))


def article_domain(url: Column) -> Column:
    """Like :func:`source_domain`, but only a leading "www." is removed."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), r"^www\.", ""), F.lit(""))


def is_blocked(url: Column) -> Column:
    """URL belongs to a blocked domain or to one of its subdomains."""
    alternatives = "|".join(re.escape(d) for d in C.BLOCKED_DOMAINS)
    return article_domain(url).rlike(rf"(^|\.)({alternatives})$")


def quad_label(quad: Column) -> Column:
    return lookup(C.QUAD_LABELS, quad.cast("int"))


def event_type(quad: Column) -> Column:
    return F.when(quad.isin(1, 2), "Cooperation").when(quad.isin(3, 4), "Conflict")


def root_label(code: Column) -> Column:
    padded = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
    return lookup(C.ROOT_LABELS, padded)


def event_strength(mentions: Column, sources: Column, tone: Column, goldstein: Column) -> Column:
    """Composite signal; a missing tone leaves it missing."""
    return np_round(
        F.log1p(F.coalesce(mentions, F.lit(0)).cast("double"))
        + F.log1p(F.coalesce(sources, F.lit(0)).cast("double"))
        + F.abs(tone) / 10.0
        + F.coalesce(F.abs(goldstein), F.lit(0.0)) / 10.0,
        3,
    )


def week_label(day: Column) -> Column:
    """Monday/Sunday pair, e.g. 2025-12-29/2026-01-04."""
    monday = F.date_trunc("week", day).cast("date")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def tone_label(tone: Column) -> Column:
    return (
        F.when(tone.isNull() | F.isnan(tone), "Unknown")
        .when(tone < -3, "Very Negative")
        .when(tone < -0.3, "Negative")
        .when(tone <= 0.3, "Neutral")
        .when(tone <= 3, "Positive")
        .otherwise("Very Positive")
    )


def tone_with_value(tone: Column) -> Column:
    text = F.concat(tone_label(tone), F.lit(" ("), fixed(tone, 1), F.lit(")"))
    return F.when(tone.isNull() | F.isnan(tone), "Unknown").otherwise(text)


def goldstein_label(g: Column) -> Column:
    return (
        F.when(g.isNull() | F.isnan(g), "Unknown")
        .when(g <= -7, "Extreme Conflict")
        .when(g <= -3, "High Conflict")
        .when(g < 0, "Low Conflict")
        .when(g == 0, "Neutral")
        .when(g <= 3, "Low Cooperation")
        .when(g <= 7, "High Cooperation")
        .otherwise("Extreme Cooperation")
    )


def match_strength(score: Column, max_score: Column) -> Column:
    ratio = F.when(max_score > 0, score / max_score).otherwise(0.0)
    return F.when(ratio >= 0.65, "Strong").when(ratio >= 0.4, "Moderate").otherwise("Weak")


def severity(z: Column) -> Column:
    return F.when(z >= 3, "High").otherwise("Moderate")


def readable_reasons(codes: Column) -> Column:
    """'country, actor' -> ['Same country', 'Shared actor']; unknown codes pass through."""
    keys = F.filter(F.transform(F.split(F.coalesce(codes, F.lit("")), ","), lambda k: F.trim(k)),
                    lambda k: k != "")
    return F.transform(keys, lambda k: F.coalesce(lookup(C.REASON_LABELS, k), k))


def norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal for z >= 0, by the usual polynomial."""
    t = 1.0 / (1.0 + F.lit(C.NORM_T) * z)
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(C.NORM_COEF[:-1]), F.lit(C.NORM_COEF[-1]))
    p = F.lit(C.NORM_D) * F.exp(-z * z / 2.0) * t * poly
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def dot(features: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum over the fixed feature order."""
    return reduce(lambda a, b: a + b, [features[f] * F.lit(float(weights[f])) for f in C.FEATURES])


def array_mean(a: Column) -> Column:
    """Mean of an array of doubles, null when empty."""
    total = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(a) > 0, total / F.size(a))
