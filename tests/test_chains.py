import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import events
from spikelens import config as C
from spikelens.functions.dist import settle
from spikelens.operators import chains as CH, evaluate as E, model as M


def build(spark, rows, top_n=5, anchor=100, scope="same"):
    ev = events(spark, [dict(event_id=anchor, day="2024-01-10"), *rows])
    ids = spark.createDataFrame([(anchor,)], "anchor_id bigint")
    anchors = CH.anchor_rows(ev, ids)
    return ev, anchors, settle(CH.find_chains(ev, anchors, top_n=top_n, scope=scope))


def sides(chain):
    rows = chain.orderBy("side", "position").collect()
    return [r.event_id for r in rows if r.side == "before"], [r.event_id for r in rows if r.side == "after"]


@pytest.mark.parametrize("same, before, after", [
    ([1], [1], []), ([1, 2], [1], [2]), ([1, 2, 3], [1], [2, 3]), ([1, 2, 3, 4, 5], [1, 2], [3, 4, 5]),
])
def test_own_day_is_shared_out(spark, same, before, after):
    _, _, chain = build(spark, [dict(event_id=i) for i in same])
    assert sides(chain) == (before, after)


def test_own_day_with_full_sides(spark):
    rows = [dict(event_id=i, day="2024-01-09") for i in range(1, 6)] + [dict(event_id=i, day="2024-01-11") for i in range(11, 14)]
    _, _, chain = build(spark, rows + [dict(event_id=i) for i in (21, 22, 23)])
    before, after = sides(chain)
    assert before == [1, 2, 3, 4, 5]  # full
    assert after == [22, 23, 11, 12, 13]  # two free places, the last two of three


def test_window_country_and_ties(spark):
    rows = [dict(event_id=1, day="2024-01-02"), dict(event_id=2, day="2024-01-03"), dict(event_id=3, day="2024-01-17"),
            dict(event_id=4, day="2024-01-18"), dict(event_id=5, day="2024-01-09", country="Iran")]
    _, _, chain = build(spark, rows)
    assert sides(chain) == ([2], [3])
    _, _, chain = build(spark, [dict(event_id=i, day="2024-01-09") for i in (9, 7, 8)], top_n=2)
    assert sides(chain)[0] == [7, 8]


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [dict(event_id=i, day=f"2024-01-{int(rng.integers(4, 17)):02d}", quad_class=int(rng.integers(1, 5)),
                 root_code=str(rng.integers(10, 13)), goldstein=None if i % 7 == 0 else float(rng.uniform(-10, 10)),
                 avg_tone=float(rng.uniform(-30, 30)), num_mentions=int(rng.integers(0, 40)), actor1=str(rng.choice(["A", "Z", "Unknown"])),
                 actor2=str(rng.choice(["B", "Q"])), actor1_cc=str(rng.choice(["C1", "UNK"])), actor2_cc=str(rng.choice(["C9", "C2"])),
                 location=str(rng.choice(["X", "Y"])), country=str(rng.choice(["USA", "Iran"]))) for i in range(1, 60)]
    ev, anchors, _ = build(spark, rows, scope="any")
    strength = {r.event_id: r.event_strength for r in ev.collect()}
    out = CH.scored_pairs(ev, anchors, 7, "any").collect()
    assert len(out) == 59
    w = [C.CHAIN_WEIGHTS[f] for f in C.FEATURES]
    for r in out:
        e = rows[r.event_id - 1]
        days = (r.event_date - r.a_event_date).days
        actor = float(bool({"A", "B"} & ({e["actor1"], e["actor2"]} - {"Unknown"})))
        code = float(bool({"C1", "C2"} & {e["actor1_cc"], e["actor2_cc"]}))
        same = float(e["country"] == "USA")
        f = [same, float(e["root_code"] == "10"), float(e["quad_class"] == 3), float(e["location"] == "X"), actor, code,
             actor * same, min(abs(e["avg_tone"]) / 20, 1), min(abs(e["goldstein"] or 0) / 20, 1), math.exp(-abs(days) / 3),
             float(days < 0), float(days > 0), min(strength[r.event_id] / 10, 1), min(strength[100] / 10, 1),
             min(max(e["num_mentions"], 1) / 1, 5) / 5, float(same == 0 and actor > 0)]
        assert [r[n] for n in C.FEATURES] == pytest.approx(f, abs=1e-9)
        assert r.chain_score == pytest.approx(float(np.dot(f, w)), abs=6e-5)


def test_reasons_and_details(spark):
    ev, anchors, chain = build(spark, [dict(event_id=1, day="2024-01-09", actor2="Q", quad_class=1, location="elsewhere",
                                            root_code="11", actor1_cc=None, actor2_cc="UNK")])
    row = CH.with_details(chain, ev, anchors).first()
    assert row.score_reasons == "country, actor" and row.actor2 == "Q" and row.side == "before"


def test_no_cross_product_in_the_plan(spark):
    ev, anchors, _ = build(spark, [dict(event_id=1)])
    for scope in ("same", "other", "any"):
        plan = CH.candidate_pairs(ev, anchors, 7, scope)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def pattern_of(spark, values, quads=None):
    rows = [(1, len(values), [v for v in values if v is not None], quads if quads is not None else [3] * len(values))]
    df = spark.createDataFrame(rows, "anchor_id int, n_events int, goldstein_trajectory array<double>, quads array<int>")
    return CH.classify(df).first()


@pytest.mark.parametrize("values, quads, want", [
    ([5.0, 4.0, 3.0, 2.0, 1.0, 0.0], None, ("Escalation", "High", -1.0)),
    ([0.0, 1.0, 2.0, 3.0, 4.0, 5.0], None, ("De-escalation", "High", 1.0)),
    ([2.0] * 6, None, ("Persistence", "Low", 0.0)),
    ([9.0, -9.0, 9.0, -9.0, 9.0], None, ("Mixed", "Moderate", -0.0)),
    ([1.0, None], [3, 3], ("Persistence", "Low", 0.0)),
    ([1.0, None], [3, 1], ("Mixed", "Low", 0.0)),
    ([None, None], [], ("Isolated", "Low", 0.0)),
    ([1.0], [3], ("Isolated", "Low", 0.0)),
])
def test_patterns(spark, values, quads, want):
    r = pattern_of(spark, values, quads)
    assert (r.pattern, r.confidence) == want[:2]
    if abs(want[2]) == 1:
        assert r.tau == want[2]
    assert -1 <= r.tau <= 1 and 0 <= r.p_value <= 1


def test_isolated_and_unknown_anchors(spark):
    ev = events(spark, [dict(event_id=1), dict(event_id=2, day="2024-03-10")])
    ids = spark.createDataFrame([(1,), (77,)], "anchor_id bigint")
    anchors = CH.anchor_rows(ev, ids)
    chain = settle(CH.find_chains(ev, anchors))
    got = {r.anchor_id: r.pattern for r in CH.chain_patterns(chain, anchors, ids).collect()}
    assert got == {1: "Isolated", 77: "Unknown"}
    assert CH.narratives(CH.chain_patterns(chain, anchors), anchors).first().narrative.startswith("This event appears isolated")


def test_cross_country_links(spark):
    rows = [dict(event_id=1, country="Iran"), dict(event_id=2, country="India", actor1="Z", actor2="Y", actor1_cc="C8", actor2_cc="C7"),
            dict(event_id=3), dict(event_id=4, country="India", day="2024-01-16"), dict(event_id=5, country="India", day="2024-01-15")]
    ev, anchors, _ = build(spark, rows)
    links = CH.cross_country_links(ev, anchors)
    assert [r.event_id for r in links.orderBy("rank").collect()] == [1, 5]
    assert CH.countries_involved(links).first().countries == "India, Iran"


def metrics(spark, retrieved, relevant):
    got = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(retrieved)], "anchor_id bigint, item bigint, rank int")
    rel = spark.createDataFrame([(1, x) for x in relevant], "anchor_id bigint, item bigint")
    return E.ranking_metrics(got, rel, spark.createDataFrame([(1,)], "anchor_id bigint")).first()


def test_ranking_metrics(spark):
    m = metrics(spark, [7, 1, 8, 2], [1, 2, 3])
    assert (m.precision_at_3, m.precision_at_5, m.recall_at_5) == (0.3333, 0.5, 0.6667)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert m.ndcg_at_5 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal, abs=5e-5)
    assert m.mrr == 0.5 and m.ap == pytest.approx((1 / 2 + 2 / 4) / 3, abs=5e-5)
    full = metrics(spark, [1, 2], [1, 2])
    assert (full.precision_at_5, full.recall_at_5, full.ndcg_at_5, full.mrr, full.ap) == (1, 1, 1, 1, 1)
    none = metrics(spark, [], [1])
    assert (none.retrieved_count, none.precision_at_3, none.ndcg_at_5, none.mrr, none.ap) == (0, 0, 0, 0, 0)


def test_label_outcomes(spark):
    labels = spark.createDataFrame([("2024-01-01", "A", True), ("2024-01-02", "A", True), ("2024-01-03", "A", False),
                                    ("2024-01-04", "A", False), ("2024-01-05", "A", None)],
                                   "day string, country string, is_real_burst boolean").withColumn("day", F.col("day").cast("date"))
    found = labels.where("day in (date '2024-01-01', date '2024-01-03')").select("day", "country")
    s = E.outcome_scores(E.label_outcomes(found, labels)).first()
    assert (s.true_positives, s.false_negatives, s.false_positives, s.true_negatives) == (1, 2, 1, 1)
    assert (s.precision, s.recall, s.f1) == (0.5, 0.333, 0.4)


def test_training_pairs_and_model(spark):
    rows = [dict(event_id=i, day="2024-01-09", actor1="A" if i <= 12 else "Z", actor2="Y", quad_class=3 if i <= 12 else 1,
                 avg_tone=float(i)) for i in range(1, 100)]
    ev, anchors, _ = build(spark, rows)
    relevant = settle(spark.createDataFrame([(100, i) for i in range(1, 13)] + [(100, 5000)], "anchor_id bigint, item bigint"))
    pairs = settle(M.training_pairs(ev, anchors, relevant))
    counts = {r.label: r["count"] for r in pairs.groupBy("label").count().collect()}
    assert counts == {1: 12, 0: 60}
    assert pairs.count() == pairs.select("event_id").distinct().count()
    table, scores = M.train(pairs)
    assert table.count() == 17 and scores.agg(F.avg("f1")).first()[0] > 0.95
    ranked = CH.find_chains(ev, anchors, score=M.model_score(table)).collect()
    assert all(r.event_id <= 12 for r in ranked)
    with pytest.raises(ValueError):
        M.train(pairs.limit(5))


def test_logistic_fit_reaches_the_documented_optimum(spark):
    """Same objective as plain gradient descent on the weighted mean loss plus |w|^2 / 2C."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, len(C.FEATURES)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=80) > 0.8).astype(int)
    rows = [(1, i, int(y[i]), *map(float, x[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "anchor_id bigint, event_id bigint, label int, " + ", ".join(f"{f} double" for f in C.FEATURES))
    table, _ = M.train(settle(df))
    got = {r.feature: r.coef for r in table.collect()}
    z = (x - x.mean(0)) / x.std(0)
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (1 - y).sum()))
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(20000):
        err = (1 / (1 + np.exp(-(z @ w + b))) - y) * weight
        w, b = w - 0.1 * (z.T @ err / 80 + w), b - 0.1 * err.mean()
    assert [got[f] for f in C.FEATURES] == pytest.approx(w, abs=1e-3)
    assert got["intercept"] == pytest.approx(b, abs=1e-3)


def test_linked_pairs_meet_by_key_and_once(spark):
    shared = dict(actor1="A", actor2="B", actor1_cc="C1", actor2_cc="C2")
    rows = [dict(event_id=1, country="India", **shared), dict(event_id=2, country="India", actor1="B", actor2="A", actor1_cc="C2", actor2_cc=None),
            dict(event_id=3, country="India", actor1="Unknown", actor2="", actor1_cc="UNK", actor2_cc="C9"),
            dict(event_id=4, country="USA", **shared), dict(event_id=5, country="India", day="2024-03-01", **shared),
            dict(event_id=6, country="India", actor1=None, actor2="A", actor1_cc="C7", actor2_cc="C7")]
    ev, anchors, _ = build(spark, rows)
    for max_rows in (CH.MAX_ANCHOR_DAYS, 0):  # broadcast, and copied per salt
        CH.MAX_ANCHOR_DAYS, kept = max_rows, CH.MAX_ANCHOR_DAYS
        try:
            pairs = CH.linked_pairs(ev, anchors)
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            got = sorted((r.anchor_id, r.event_id) for r in pairs.collect())
        finally:
            CH.MAX_ANCHOR_DAYS = kept
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "_key" in plan
        brute = CH.with_features(CH.candidate_pairs(ev, anchors, 5, "other")).where("actor_exact_match > 0 or actor_country_match > 0")
        assert got == sorted((r.anchor_id, r.event_id) for r in brute.collect())


def test_months_outside_the_windows_are_not_read(spark, tmp_path):
    from spikelens.sources import tables

    days = ["2023-11-05", "2024-01-28", "2024-02-02", "2024-02-20", "2024-04-01"]
    ev = events(spark, [dict(event_id=i, day=d) for i, d in enumerate(days)])
    tables.save_events(ev, str(tmp_path / "events"))
    stored = tables.load_events(spark, str(tmp_path / "events"), "2024-12-31")
    anchors = CH.anchor_rows(stored, spark.sql("select 1L as anchor_id, date'2024-01-28' as event_date"))
    assert anchors.count() == 1
    assert CH.anchor_rows(stored, spark.sql("select 1L as anchor_id, date'2024-01-29' as event_date")).count() == 0
    chain = settle(CH.find_chains(stored, anchors))
    assert [r.event_id for r in chain.collect()] == [2]
    detailed = CH.with_details(chain, stored, anchors)
    assert [r.event_id for r in detailed.collect()] == [2]
    for df, months in ((CH.near_days(stored, anchors, "a_event_date"), {"2024-01"}),
                       (CH.candidate_pairs(stored, anchors, 7, "same"), {"2024-01", "2024-02"}), (detailed, {"2024-02"})):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x]
        text = " ".join(scans).split("PartitionFilters")[1].split("PushedFilters")[0]
        assert {m for m in ("2023-11", "2024-01", "2024-02", "2024-04") if m in text} == months, text
    assert CH.candidate_pairs(stored, anchors.where("false"), 7, "any").count() == 0


def test_random_trials_have_whole_hashes_of_their_own(spark):
    from hashlib import md5

    from spikelens.operators import evaluate as E

    ev = events(spark, [dict(event_id=i) for i in range(300)])
    anchors = CH.anchor_rows(ev, spark.sql("select 7L as anchor_id"))
    got = {(r.trial, r["rank"]): r.item for r in E.random_ranks(ev, anchors).collect()}
    for t in range(1, 6):
        order = sorted((i for i in range(300) if i != 7), key=lambda i: md5(f"42:{t}:7:{i}".encode()).hexdigest())
        assert [got[t, n] for n in range(1, 11)] == order[:10]


def test_event_columns_are_made_once_per_event(spark):
    ev = events(spark, [dict(event_id=i) for i in range(9)])
    anchors = CH.anchor_rows(ev, spark.sql("select 7L as anchor_id union all select 8L"))
    for df in (CH.scored_pairs(ev, anchors), CH.find_chains(ev, anchors)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joined = plan.index("Join Inner")
        assert "Generate inline" in plan[joined:]
