"""URL filters: hand-written host and path rules first, mined association rules for the rest.

Urls that a hand-written rule decides are the labelled ones. Their tokens (host parts, path parts, query keys) and a token
for the verdict go through Spark's FP-growth; rules that end in a verdict, with enough support and confidence and no shorter
rule as good, judge the other urls. A rule is looked up by its rarest token, so a url meets only rules it may hold.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from spikelens.functions.dist import attach

from .common import pin, settle, stored

# Host and start of the path, with verdicts.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
VERDICT = "verdict="


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` plus host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({
        "host": _ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def by_rules(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict by the longest fitting rule, from host and path; null where none fits."""
    rule, verdict = None, None
    for text, word in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, start = text.split("/", 1)
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + start))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(word)) if verdict is None else verdict.when(fits, F.lit(word))
    return rule, verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens: host suffixes, words of host and path (digits dropped), query keys."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n), ".")))
    part = F.transform(F.split(F.regexp_replace("path", r"[0-9]+", ""), r"[/._-]+"), lambda x: F.concat(F.lit("path:"), x))
    word = F.transform(F.split("host", r"[.-]+"), lambda x: F.concat(F.lit("word:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(F.col(url), F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    return F.filter(F.array_distinct(F.concat(ends, part, word, keys)), lambda x: ~x.endswith(":"))


def classes(kinds: DataFrame, least: float) -> DataFrame:
    """(token, same): tokens of at least ``least`` rows; ``same`` is the first token that stands in exactly the same rows.

    ``kinds`` has distinct token sets and how many rows (``n``) have each. The rows of a token are told apart by their number
    and by sums of two hashes of their sets. Few tokens are left: a row with t tokens gives t, of which ``least`` make one.
    """
    low, names = F.lit(0xFFFFFFFF), [f"_f{i}" for i in range(4)]
    hashed = [F.xxhash64("items"), F.xxhash64("items", F.lit(1))]
    halves = [x for h in hashed for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    each = kinds.select("n", F.explode("items").alias("token"), *[(F.col("n") * x).alias(f) for f, x in zip(names, halves, strict=True)])
    rows = each.groupBy("token").agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in names]).where(F.col("n") >= least)
    return rows.select("token", F.min("token").over(Window.partitionBy("n", *names)).alias("same"))


def merged(kinds: DataFrame, same: DataFrame) -> DataFrame:
    """``kinds`` with their tokens replaced by the first of each class (``merged``); tokens without a class are left out."""
    each = attach(kinds.select("items", F.explode("items").alias("token")), same, ["token"], spread=["items"])
    return each.groupBy("items").agg(F.sort_array(F.collect_set("same")).alias("merged"))


def mine_classes(labelled: DataFrame, support: float = 0.01, confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rules over token classes from all rows with ``items`` and ``verdict``, and the classes.

    Tokens that always stand together are one class, so a long run of them is one item to FP-growth, not all its subsets. A
    row holds a class if it holds any of its tokens: a rule stands for all rules that name one token of each class.
    """
    labelled = pin(labelled.select(F.array_sort(F.array_distinct("items")).alias("items"), "verdict"))
    kinds = settle(labelled.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    total = kinds.agg(F.sum("n")).first()[0] or 0
    same = settle(classes(kinds, support * total))
    rows = attach(labelled, settle(merged(kinds, same)), ["items"], "left", spread=["verdict"])
    rows = rows.select(F.array_append(F.coalesce("merged", F.array().cast("array<string>")), F.concat(F.lit(VERDICT), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(stored(rows))
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(VERDICT)))
    found = found.where(~F.exists("antecedent", lambda x: x.startswith(VERDICT)))
    return without_redundant(found.select(
        F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], len(VERDICT) + 1, 99).alias("verdict"), "confidence", "support")), same


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.8) -> DataFrame:
    """Rules (items, verdict, confidence, support) from all rows with ``items`` and ``verdict``, one per choice of tokens."""
    rules, same = mine_classes(labelled, support, confidence)
    members = same.groupBy(F.col("same").alias("item")).agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    key = ["items", "verdict", "confidence", "support"]
    listed = rules.select(*key, F.explode("items").alias("item")).join(members, "item").groupBy(*key).agg(F.collect_list("tokens").alias("lists"))
    one = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("lists", one, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.array_append(d, m)))))
    return listed.withColumn("choice", F.explode(choices)).select(F.array_sort("choice").alias("items"), *key[1:])


def without_redundant(found: DataFrame) -> DataFrame:
    """Rules of which no shorter part says the same at least as surely.

    By rising length: the shortest rules stay, and all longer ones that hold one of them and are no surer go. A rule that
    went needs no look again, since what removed it also removes whatever it would. Rules are met by their first item.
    """
    rest, kept = settle(found), None
    while (size := rest.agg(F.min(F.size("items"))).first()[0]) is not None:
        now = rest.where(F.size("items") == size)
        kept = now if kept is None else kept.unionByName(now)
        index = settle(now.select(F.col("items")[0].alias("token"), "verdict", F.col("items").alias("part"), F.col("confidence").alias("least")))
        longer = rest.where(F.size("items") > size)
        met = attach(longer.withColumn("token", F.explode("items")), index, ["token", "verdict"], spread=["items"])
        gone = met.where((F.col("least") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
        rest = settle(longer.join(gone.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti"))
    return settle(kept) if kept is not None else rest


def judge(pages: DataFrame, page: str = "page_id", url: str = "url", rules=RULES, support: float = 0.01, confidence: float = 0.8,
          default: str = "allow") -> DataFrame:
    """``page``, host, path, rule, verdict, confidence: one row per row.

    The rule is null where no hand-written rule fits; the verdict then is that of the surest mined rule (ties: the larger
    support, then the name), or ``default`` where none is held. Confidence is null for hand-written rules and defaults.
    Null urls have empty parts and no tokens; null or repeated pages are rows of their own; an empty table gives no rows.
    """
    rule, verdict = by_rules(rules)
    rows = with_parts(pages.select(F.col(page).alias("page"), F.col(url).alias("url")))
    rows = pin(rows.withColumns({"rule": rule, "given": verdict, "items": tokens("url")}))
    mined, same = mine_classes(rows.where("given is not null").select("items", F.col("given").alias("verdict")), support, confidence)
    # each rule under the token that the fewest rules hold
    each = mined.withColumn("token", F.explode("items"))
    rare = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    lookup = (attach(each, settle(rare), ["token"], spread=["items"]).groupBy("items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("least"))
              .select(F.col("least.token").alias("token"), F.struct("items", "confidence", "support", "verdict").alias("r")))
    # one row per distinct token set: urls repeat their tokens much more often than their numbers
    kinds = merged(rows.where("given is null").select("items").distinct(), same).withColumn("kind", F.array_join("items", " "))
    held = attach(kinds.withColumn("token", F.explode("merged")), settle(lookup), ["token"], spread=["kind"])
    held = held.where(F.size(F.array_except("r.items", "merged")) == 0)
    best = held.groupBy("kind").agg(F.max(F.struct(F.col("r.confidence").alias("confidence"), F.col("r.support").alias("support"),
                                                   F.col("r.verdict").alias("verdict"))).alias("best"))
    best = settle(best)
    out = rows.withColumn("kind", F.when(F.col("given").isNull(), F.array_join("items", " "))).join(best, "kind", "left")
    return out.select(F.col("page").alias(page), "host", "path", "rule",
                      F.coalesce("given", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.confidence").alias("confidence"))
