import math

import pytest
from pyspark.sql import functions as F

from spikelens.functions import exprs as X
from conftest import events
from spikelens.functions.dist import SALTS, among, attach, near_top, packed, packed_minor, prefer, settle, top_k, top_k_bounded, top_many
from spikelens.operators import bursts as B, evidence as V


@pytest.mark.parametrize("raw, want", [
    (None, "Unknown"), ("", "Unknown"), ("  ", "Unknown"), ("nan", "Unknown"), ("None", "Unknown"), ("NA", "Unknown"),
    ("AL-QAEDA", "Al-Qaeda"), ("O'NEIL", "O'Neil"), ("U.S. ARMY", "U.S. Army"), ("\tUNITED STATES ", "United States"),
])
def test_clean_actor(one, raw, want):
    assert one(X.clean_actor(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.bbc.co.uk/a?b", "bbc.co.uk"), ("http://a.b:8080/x", "a.b:8080"), ("https://u:p@h.org/", "u:p@h.org"),
    ("http://newswww.site.com", "newssite.com"), ("ftp://a.b", ""), ("a.b/c", ""), (None, ""),
])
def test_source_domain(one, url, want):
    assert one(X.source_domain(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.washingtonpost.com/x", True), ("https://wsj.com/x", True), ("https://m.ft.com/x", True),
    ("https://notft.com/x", False), ("https://ft.com.org/x", False), ("https://bbc.co.uk", False),
])
def test_blocked(one, url, want):
    assert one(X.is_blocked(F.lit(url))) is want


@pytest.mark.parametrize("x, places, want", [(0.125, 2, 0.12), (2.675, 2, 2.68), (0.5, 0, 0.0), (1.5, 0, 2.0), (-0.125, 2, -0.12)])
def test_np_round(one, x, places, want):
    assert one(X.np_round(F.lit(x), places)) == want


def test_event_strength(one):
    s = lambda m, n, t, g: one(X.event_strength(
        F.lit(m).cast("bigint"), F.lit(n).cast("bigint"), F.lit(t).cast("double"), F.lit(g).cast("double")))
    assert s(9, 3, -2.0, 5.0) == round(math.log(10) + math.log(4) + 0.2 + 0.5, 3)
    assert s(None, None, 1.0, None) == 0.1
    assert s(9, 3, None, 5.0) is None


def test_labels(one):
    tone = lambda v: one(X.tone_label(F.lit(v).cast("double")))
    assert [tone(v) for v in (None, -3.1, -3.0, -0.3, 0.3, 3.0, 3.1)] == [
        "Unknown", "Very Negative", "Negative", "Neutral", "Neutral", "Positive", "Very Positive"]
    gold = lambda v: one(X.goldstein_label(F.lit(v).cast("double")))
    assert [gold(v) for v in (-7, -3, -0.1, 0, 3, 7, 7.1)] == [
        "Extreme Conflict", "High Conflict", "Low Conflict", "Neutral", "Low Cooperation", "High Cooperation",
        "Extreme Cooperation"]
    assert one(X.root_label(F.lit("4"))) == "Consult"
    assert one(X.root_label(F.lit("145"))) is None
    assert one(X.tone_with_value(F.lit(-1.44))) == "Negative (-1.4)"
    assert one(X.match_strength(F.lit(11.71), F.lit(18.0))) == "Strong"
    assert one(X.readable_reasons(F.lit("country, actor, odd"))) == ["Same country", "Shared actor", "odd"]
    assert one(X.week_label(F.lit("2026-01-01").cast("date"))) == "2025-12-29/2026-01-04"


def test_norm_sf(one):
    for z in (0.0, 0.5, 1.96, 4.0):
        assert one(X.norm_sf(F.lit(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-7)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_beyond_the_broadcast_bound(spark, how):
    """One key holds a third of the rows; the salted join equals the plain one."""
    big = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    small = settle(spark.range(0, 30, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")))
    plain = big.join(small, "k", how)
    salted = attach(big, small, ["k"], how, spread=["id"], max_rows=1)
    assert "_salt" not in salted.columns
    assert sorted(map(tuple, salted.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    tasks = attach(big, small, ["k"], "inner", spread=["id"], max_rows=1).where("k = 7")
    assert tasks.count() == big.join(small, "k").where("k = 7").count() and SALTS > 1


def test_top_k_equals_a_plain_sort(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("s"))
    got = {(r.g, r["rank"]): r.id for r in top_k(df, ["g"], [F.desc("s"), F.col("id")], 5).collect()}
    rows = df.collect()
    for g in range(3):
        best = sorted((r for r in rows if r.g == g), key=lambda r: (-r.s, r.id))[:5]
        assert [got[(g, i + 1)] for i in range(5)] == [r.id for r in best]
    assert len(got) == 15


def test_prefer(spark):
    df = spark.range(5)
    assert prefer(df, F.col("id") > 3).count() == 1
    assert prefer(df, F.col("id") > 30).count() == 5
    assert prefer(df, F.lit(None).cast("boolean")).count() == 5


def test_packed_numbers_keep_their_order(spark):
    pairs = [(a, b) for a in (-(10**16), -1, 0, 1, 10**16) for b in (-(2**63), -5, 0, 7, 2**63 - 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("p", packed(F.col("a"), F.col("b")))
    rows = df.withColumn("back", packed_minor(F.col("p"))).orderBy("p").collect()
    assert [(r.a, r.b) for r in rows] == sorted(pairs) and all(r.back == r.b for r in rows)
    plan = df.groupBy("a").agg(F.min("p"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_many_equals_ranking_every_copy(spark, k):
    rows = [(i % 3, i, float(i * 7 % 11), float(-(i % 5)), None if i % 2 else float(i)) for i in range(500)] + [(9, 900, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "g int, item bigint, x double, y double, z double")
    got = top_many(df, ["g"], "item", {"x": F.col("x"), "y": F.col("y"), "z": F.col("z")}, k, "name")
    want = []
    for g in (0, 1, 2, 9):
        for i, name in enumerate("xyz"):
            best = sorted((-r[2 + i], r[1]) for r in rows if r[0] == g and r[2 + i] is not None)[:k]
            want += [(g, name, item, -s, n) for n, (s, item) in enumerate(best, 1)]
    assert sorted((r.g, r.name, r.item, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def test_narrow_minima_are_hash_aggregates(spark):
    rows = [dict(event_id=i, day="2024-01-10", source_url=f"http://a{i % 3}.com/x", num_mentions=i) for i in range(9)]
    ev = events(spark, rows)
    days = spark.createDataFrame([("2024-01-10", "USA", True)], "day string, country string, is_burst boolean").withColumn(
        "day", F.col("day").cast("date"))
    assert B.day_anchors(ev, days).first().anchor_id == 8
    for df in (B.day_anchors(ev, days), V.spike_urls(ev, days)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.source_url for r in V.spike_urls(ev, days).orderBy("rank").collect()] == ["http://a2.com/x", "http://a1.com/x", "http://a0.com/x"]


def test_bounded_top_k_equals_sorting_all(spark):
    rows = [(i % 2, i, float(i * 7 % 40) if i % 9 else None, f"{i * 31 % 100:02d}") for i in range(6000)] + [(None, 7000, 1.0, "x")]
    df = spark.createDataFrame(rows, "g int, item bigint, x double, h string")
    for order, by in (({"x": True, "item": False}, [F.desc("x"), F.col("item")]), ({"h": False, "item": False}, [F.col("h"), F.col("item")])):
        got = top_k_bounded(df, ["g"], order, 12, "item")
        assert sorted(map(str, got.collect())) == sorted(map(str, top_k(df, ["g"], by, 12).collect()))


def test_few_rows_are_left_to_sort(spark):
    """Also where all rows tie in the first column."""
    df = spark.range(0, 60_000, 1, 2).select((F.col("id") % 2).alias("g"), F.col("id").alias("item"), F.lit(1.0).alias("x"))
    assert 6 <= near_top(df, ["g"], {"x": True, "item": False}, 3, "item").count() < 6000
    best = top_many(df, ["g"], "item", {"x": F.col("x")}, 3, "name", down=False).collect()
    assert sorted((r.g, r.item) for r in best) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_rows_beyond_all_bounds_are_dropped_before_arrays_are_made(spark):
    df = spark.range(4000).selectExpr("id % 2 as a", "id as item", "(id * 7919) % 4001 as x", "(id * 31) % 4001 as y", "id % 5 as z")
    scores = {c: F.col(c) for c in "xyz"}
    whole = top_many(df, ["a"], "item", scores, 3, "score_of")
    plan = whole._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "Generate inline" in line)
    assert any("Filter" in line and "coalesce" in line for line in plan[made:])
    by_two = top_many(df, ["a"], "item", scores, 3, "score_of", at_once=2)
    want = sorted((r.a, s, r.item) for a in (0, 1) for s in "xyz"
                  for r in sorted((r for r in df.collect() if r.a == a), key=lambda r: (-r[s], r.item))[:3])
    for got in (whole, by_two):
        assert sorted((r.a, r.score_of, r.item) for r in got.collect()) == want


def test_few_ids_become_a_filter_of_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    big = spark.read.parquet(str(tmp_path / "t")).withColumn("made", F.upper("s"))
    small = spark.sql("select explode(array(3L, 5L, null)) as id")
    few = attach(among(big, small, "id"), small, ["id"], "left_semi")
    assert "In(id, [3,5])" in few._jdf.queryExecution().executedPlan().toString().replace("[5,3]", "[3,5]")
    assert sorted(r.id for r in few.collect()) == [3, 5]
    assert among(big, small, "id", max_ids=1).count() == 100
    assert among(big, small.where("id > 9"), "id").count() == 0
