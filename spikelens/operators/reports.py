"""Texts about spikes: fact sheets, briefings and answers, for all spikes at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from .. import fixed_text as T
from ..functions import exprs as X
from ..functions.dist import attach
from .bursts import burst_days

KEYS = ["day", "country"]


def fill(template: str, **fields: Column) -> Column:
    """Template text with its ``{name}`` fields replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def choose(templates, seed: Column, **fields: Column) -> Column:
    """Template number ``seed mod size``, filled."""
    texts = [fill(t, **fields) for t in templates]
    if len(texts) == 1:
        return texts[0]
    return F.get(F.array(*texts), F.pmod(seed, F.lit(len(texts))).cast("int"))


def spike_seed() -> Column:
    """0..6 from country and day, the same in every run."""
    digest = F.md5(F.concat("country", F.date_format("day", "yyyy-MM-dd")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(7))


def class_distribution(events: DataFrame, bursts: DataFrame) -> DataFrame:
    """Events per class of every spike."""
    on_spike = attach(events, burst_days(bursts), KEYS, "left_semi", spread=["event_id"])
    return (
        on_spike.where(F.col("quad_label").isNotNull()).groupBy(*KEYS, "quad_label")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def fact_sheet(events: DataFrame, bursts: DataFrame) -> DataFrame:
    """Leading classes, families, actors and domains and the tone range of every spike.

    Long rows ``(day, country, section, rank, label, value, pct)``. Events are turned
    into (section, label) counts in one pass; the ranking sees only these counts.
    """
    limits = {"class": 4, "family": 5, "actor": 5, "domain": 5}
    source = {"class": "quad_label", "family": "root_label", "actor": "actor1", "domain": "source_domain"}
    on_spike = attach(events, burst_days(bursts), KEYS, "left_semi", spread=["event_id"])
    labels = F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(c).alias("label")) for s, c in source.items()]))
    counts = (
        on_spike.select(*KEYS, labels.alias("l")).select(*KEYS, "l.section", "l.label")
        .where(F.col("label").isNotNull()).groupBy(*KEYS, "section", "label").agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(*KEYS, "section").orderBy(F.desc("n"), "label")
    size = bursts.where("is_burst").select(*KEYS, F.col("event_count").alias("total"))
    ranked = (
        counts.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= X.lookup(limits, F.col("section")))
        .join(size, KEYS)
        .select(*KEYS, "section", "rank", "label", F.col("n").cast("double").alias("value"),
                F.when(F.col("section") == "class", 100.0 * F.col("n") / F.col("total")).alias("pct"))
    )
    tone = on_spike.groupBy(*KEYS).agg(
        F.avg("avg_tone").alias("mean"), F.min("avg_tone").alias("min"), F.max("avg_tone").alias("max"))
    tone_rows = tone.select(*KEYS, F.posexplode(F.array(*[
        F.struct(F.lit(m).alias("label"), F.col(m).alias("value")) for m in ("mean", "min", "max")])).alias("i", "t"))
    return ranked.unionByName(tone_rows.select(
        *KEYS, F.lit("tone").alias("section"), (F.col("i") + 1).alias("rank"), F.col("t.label").alias("label"),
        F.col("t.value").alias("value"), F.lit(None).cast("double").alias("pct")))


def event_context(sheet: DataFrame, info: DataFrame) -> DataFrame:
    """The fact sheet of every spike as one block of lines."""
    count = F.concat(F.col("label"), F.lit(": "), X.grouped(F.col("value")))
    line = (
        F.when(F.col("section") == "class", F.concat(count, F.lit(" ("), X.fixed(F.col("pct"), 0), F.lit("%)")))
        .when(F.col("section") == "actor", F.concat(count, F.lit(" events")))
        .when(F.col("section") == "domain", F.concat(count, F.lit(" articles")))
        .otherwise(count)
    )
    # at most 22 rows per spike
    sections = sheet.withColumn("line", line).groupBy(*KEYS).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("rank", "line")))).alias(s)
          for s in ("class", "family", "actor", "domain")],
        *[F.max(F.when((F.col("section") == "tone") & (F.col("label") == m), F.col("value"))).alias(f"tone_{m}")
          for m in ("mean", "min", "max")])

    def block(title: str, name: str) -> Column:
        lines = F.transform(name, lambda s: F.concat(F.lit("  "), s["line"]))
        return F.when(F.size(name) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(lines, "\n")))

    date = F.date_format("day", "yyyy-MM-dd")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("[Event Context: "), F.col("country"), F.lit(" on "), date, F.lit("]")),
        F.concat(F.lit("Event count: "), X.grouped(F.col("event_count")), F.lit("  (baseline: "),
                 X.fixed(F.col("baseline"), 0), F.lit(",  z-score: "), X.fixed(F.col("z_score"), 2), F.lit("σ)")),
        F.concat(F.lit("Tone shift vs. baseline: "), X.signed(F.col("tone_delta"), 2), F.lit(" points")),
        block("Event type breakdown:", "class"),
        block("Top event categories:", "family"),
        F.concat(F.lit("\nTone — mean: "), X.fixed(F.col("tone_mean"), 2), F.lit(",  range: ["),
                 X.fixed(F.col("tone_min"), 1), F.lit(", "), X.fixed(F.col("tone_max"), 1), F.lit("]")),
        block("Top Actor 1 entities:", "actor"),
        block("Top news sources:", "domain"),
    )
    return info.join(sections, KEYS).select(*KEYS, text.alias("context"))


def keyword_lists(keywords: DataFrame, n: int = 10) -> DataFrame:
    """Per spike the first ``n`` keywords in rank order."""
    return (
        keywords.where(F.col("rank") <= n).groupBy(*KEYS)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"])
             .alias("keywords"))
    )


def quoted(words: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(words, 1, n), lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ", ")


def briefings(info: DataFrame, facts: DataFrame, keywords: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Four to six sentences per spike.

    ``keywords``: :func:`keyword_lists`; ``evidence``: ``(day, country, domains)`` with
    the leading source domains, absent when no text was found.
    """
    from .compare import top_quad

    empty = F.array().cast("array<string>")
    known = sum((F.col(f"q{q}") for q in C.QUAD_LABELS), F.lit(0))
    shares = facts.select(
        *KEYS, known.alias("typed"), top_quad().alias("top_type"),
        F.when(known > 0, 100.0 * (F.col("q3") + F.col("q4")) / known).alias("conflict_pct"))
    df = info.join(shares, KEYS, "left").join(keywords, KEYS, "left")
    df = df.join(evidence, KEYS, "left") if evidence is not None else df.withColumn("domains", empty)
    df = df.withColumns({c: F.coalesce(c, empty) for c in ("keywords", "domains")}).withColumn("seed", spike_seed())
    z, tone, pct, seed = F.col("z_score"), F.col("tone_delta"), F.col("conflict_pct"), F.col("seed")
    coop = 100.0 - pct
    first = dict(
        country=F.col("country"), date=F.date_format("day", "yyyy-MM-dd"), count=X.grouped(F.col("event_count")),
        ratio=X.fixed(F.col("event_count") / F.greatest("baseline", F.lit(1.0)), 1),
        baseline=X.fixed(F.col("baseline"), 0), z=X.fixed(z, 1))
    mood = dict(tone=X.signed(tone, 1), tone_abs=X.fixed(F.abs(tone), 1))
    mix = dict(conflict_pct=X.fixed(pct, 0), coop_pct=X.fixed(coop, 0), top_type=F.col("top_type"))
    text = F.concat_ws(
        " ",
        F.when(z >= 3, choose(T.HIGH_Z, seed, **first)).otherwise(choose(T.MODERATE_Z, seed, **first)),
        F.when(tone < -0.5, choose(T.TONE_NEGATIVE, seed + 1, **mood))
        .when(tone > 0.5, choose(T.TONE_POSITIVE, seed + 1, **mood))
        .otherwise(choose(T.TONE_NEUTRAL, seed + 1, **mood)),
        F.when(F.size("keywords") > 0, choose(T.KEYWORDS, seed + 2, keywords=quoted(F.col("keywords"), 6))),
        F.when(pct >= 60, choose(T.MIX_CONFLICT, seed + 3, **mix))
        .when(coop >= 60, choose(T.MIX_COOPERATION, seed + 3, **mix))
        .when(F.col("typed") > 0, choose(T.MIX_BOTH, seed + 3, **mix)),
        F.when(F.size("domains") > 0, choose(T.EVIDENCE, seed + 4, domains=F.array_join(F.slice("domains", 1, 3), ", ")))
        .otherwise(T.NO_EVIDENCE[0]),
        F.when(tone < -1, choose(T.WATCH_ESCALATION, seed + 5))
        .when(tone > 1, choose(T.WATCH_DEESCALATION, seed + 5))
        .otherwise(choose(T.WATCH_GENERIC, seed + 5, country=F.col("country"))),
    )
    return df.select(*KEYS, text.alias("briefing"))


def parse_intent(question: Column, stem: bool = False) -> Column:
    """First intent one of whose words occurs in the question, else 'general'.

    Words must end where the listed word ends ("compare" is not "compar");
    ``stem=True`` also accepts longer words.
    """
    tail = r"\w*" if stem else ""
    out = None
    for intent, words in C.INTENT_WORDS:
        hit = question.rlike(rf"(?iU)\b({words}){tail}\b")
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("general")


def tone_reading(tone: Column) -> Column:
    return (
        F.when(tone < -1.5, fill(T.TONE_MARKED, tone=X.fixed(tone, 2)))
        .when(tone < -0.3, fill(T.TONE_MILD, tone=X.fixed(tone, 2)))
        .when(tone > 1.0, fill(T.TONE_GOOD, tone=X.signed(tone, 2)))
        .otherwise(fill(T.TONE_FLAT, tone=X.signed(tone, 2)))
    )


def outlook(tone: Column, z: Column) -> Column:
    return F.when((tone < -1.0) & (z >= 3), T.OUTLOOK_RISK).when(tone > 0.5, T.OUTLOOK_PEAK).otherwise(T.OUTLOOK_OPEN)


def readings(info: DataFrame) -> DataFrame:
    """Tone reading and outlook of every spike."""
    return info.select(*KEYS, tone_reading(F.col("tone_delta")).alias("tone_text"),
                       outlook(F.col("tone_delta"), F.col("z_score")).alias("outlook_text"))


def answers(questions: DataFrame, spikes: DataFrame) -> DataFrame:
    """Rule-based answer to every question about its spike.

    ``questions``: ``(question, day, country)``. ``spikes``: one row per spike with the
    columns of spike info, ``context``, ``keywords`` and ``passages`` (array of structs
    ``domain, source_url, score, text``, best first; empty when there is no text).
    """
    df = questions.join(spikes, KEYS)
    if "intent" not in df.columns:
        df = df.withColumn("intent", parse_intent(F.col("question")))
    z, tone, context = F.col("z_score"), F.col("tone_delta"), F.col("context")
    words, passages = F.col("keywords"), F.col("passages")
    base = dict(country=F.col("country"), date=F.date_format("day", "yyyy-MM-dd"), context=context, z=X.fixed(z, 1),
                tone=X.signed(tone, 2))
    has_text = F.size(passages) > 0

    def excerpts(n: int, size: int) -> Column:
        one = lambda p: F.concat(
            F.lit("\n["), p["domain"], F.lit("] "), F.substring(p["text"], 1, size), F.lit("...\n"))
        return F.array_join(F.transform(F.slice(passages, 1, n), one), "")

    word = F.when(tone < -0.5, "negative").when(tone > 0.5, "positive").otherwise("neutral")
    cause = F.concat(
        fill(T.CAUSE_ANSWER, tone_word=word, **base,
             keywords=F.when(F.size(words) > 0, quoted(words, 5)).otherwise("unavailable")),
        F.when(has_text, F.concat(F.lit("\n\nSupporting evidence from news sources:\n"), excerpts(2, 250)))
        .otherwise(""))
    listed = F.transform(passages, lambda p, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), p["domain"], F.lit("  (relevance: "),
        X.fixed(p["score"], 2), F.lit(")\n    URL: "), p["source_url"], F.lit('\n    Excerpt: "'),
        F.substring(p["text"], 1, 300), F.lit('..."\n')))
    evidence = F.when(has_text, F.concat(
        F.lit("Retrieved "), F.size(passages).cast("string"), F.lit(" relevant article passage(s):\n\n"),
        F.array_join(listed, "\n"))).otherwise(T.NO_PASSAGES)
    bullets = F.array_join(F.transform(F.slice(words, 1, 10), lambda k: F.concat(F.lit("  • "), k)), "\n")
    terms = F.when(F.size(words) > 0, fill(T.KEYWORD_ANSWER, list=bullets)).otherwise(
        fill(T.NO_KEYWORDS_ANSWER, context=context))
    general = F.concat(fill(T.GENERAL_ANSWER, context=context), F.when(
        has_text, F.concat(F.lit("Relevant news evidence:\n"), excerpts(2, 200))).otherwise(""))
    by_intent = {
        "spike_cause": cause,
        "evidence": evidence,
        "keywords": terms,
        "event_types": fill(T.TYPES_ANSWER, **base),
        "tone": fill(T.TONE_ANSWER, interp=tone_reading(tone), **base),
        "actors": fill(T.ACTORS_ANSWER, **base),
        "prediction": fill(T.OUTLOOK_ANSWER, outlook=outlook(tone, z), **base),
        "comparison": F.lit(T.COMPARISON_ANSWER),
    }
    out = None
    for intent, text in by_intent.items():
        hit = F.col("intent") == intent
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return df.select(*questions.columns, "intent", out.otherwise(general).alias("answer"))


def spike_rows(info: DataFrame, context: DataFrame, keywords: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """Everything :func:`answers` needs about each spike."""
    kind = "array<struct<domain string, source_url string, score double, text string>>"
    none = F.array().cast(kind)
    df = info.join(context, KEYS).join(keywords, KEYS, "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    if passages is None:
        return df.withColumn("passages", none)
    return df.join(passages, KEYS, "left").withColumn("passages", F.coalesce("passages", none))
