import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import events
from spikelens.functions.dist import settle
from spikelens.operators import bursts as B, compare as P, leadlag as L, reports as R


def daily(spark, series, start="2024-01-01"):
    rows = [(pd.Timestamp(start).date() + dt.timedelta(days=i), c, n) for c, s in series.items() for i, n in enumerate(s)
            if n is not None]
    return spark.createDataFrame(rows, "day date, country string, event_count bigint")


def expected(series, window=7, z=2.0, least=5):
    s = pd.Series(series, dtype=float)
    mean = s.rolling(window, min_periods=1).mean().shift(1).fillna(0).round(2)
    std = s.rolling(window, min_periods=1).std().shift(1).fillna(0).round(2)
    score = np.where(std > 0, ((s - mean) / std.where(std > 0, 1)).round(3), 0.0)
    return list(zip(mean, std, score, (score > z) & (s >= least)))


def test_baseline_against_pandas(spark):
    rng = np.random.default_rng(7)
    series = {"A": [int(x) for x in rng.poisson(9, 60)], "B": [5] * 30 + [5, 20, 5] + [0] * 27}
    got = B.score_days(B.dense_days(daily(spark, series))).orderBy("country", "day").collect()
    for country, s in series.items():
        mine = [(r.rolling_mean, r.rolling_std, r.z_score, r.is_burst) for r in got if r.country == country]
        for a, b in zip(mine, expected(s)):
            assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])
            assert a[3] == b[3]


def test_grid_fills_gaps_over_the_whole_span(spark):
    dense = B.dense_days(daily(spark, {"A": [3, None, 4], "B": [None, 1, None]}))
    rows = {(r.country, r.day.day): r.event_count for r in dense.collect()}
    assert rows == {("A", 1): 3, ("A", 2): 0, ("A", 3): 4, ("B", 1): 0, ("B", 2): 1, ("B", 3): 0}


def test_thresholds_are_strict_and_inclusive(spark):
    # days 3: mean 2, std sqrt(2)=1.41; count 4 never counts, constant series never counts
    out = B.score_days(B.dense_days(daily(spark, {"A": [1, 3, 4], "C": [5, 5, 50]}))).collect()
    assert not any(r.is_burst for r in out)
    exact = B.score_days(B.dense_days(daily(spark, {"A": [4, 8, 6, 6]})), z_threshold=0.0).orderBy("day").collect()
    assert exact[2].z_score == 0.0 and not exact[2].is_burst


def burst_rows(spark, days, country="USA", total=15):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), country, 10, 5.0, 1.0, 5.0 if i + 1 in days else 0.0, i + 1 in days)
            for i in range(total)]
    return spark.createDataFrame(rows, "day date, country string, event_count bigint, rolling_mean double, "
                                       "rolling_std double, z_score double, is_burst boolean")


def test_run_lengths(spark):
    got = {r.day.day: r.consecutive_days for r in B.run_lengths(burst_rows(spark, {2, 4, 5, 6, 8})).collect()}
    assert [got[d] for d in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12)] == [2, 1, 5, 3, 3, 3, 5, 1, 2, 1]


def test_semi_join_and_marking(spark):
    ev = events(spark, [dict(event_id=1, day="2024-01-02"), dict(event_id=2, day="2024-01-03"),
                        dict(event_id=3, day="2024-01-02", country="Iran")])
    bursts = burst_rows(spark, {2})
    joined = B.events_on_bursts(ev, bursts)
    assert [r.event_id for r in joined.collect()] == [1]
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert {r.event_id: r.on_burst for r in B.mark_bursts(ev, bursts).collect()} == {1: True, 2: False, 3: False}


def test_anchor_of_a_day(spark):
    ev = events(spark, [dict(event_id=5, num_mentions=9), dict(event_id=4, num_mentions=9), dict(event_id=6, num_mentions=None)])
    days = settle(ev.select("day", "country").distinct())
    assert B.day_anchors(ev, days).first().anchor_id == 4


def test_tone_shift_and_paths(spark):
    rows = [dict(event_id=i, day=f"2024-01-{d:02d}", avg_tone=t) for i, (d, t) in enumerate(
        [(1, 99.0), (2, 1.0), (8, 3.0), (9, -4.0), (9, None), (11, 0.125)])]
    facts = P.day_facts(events(spark, rows))
    info = {r.day.day: r.tone_delta for r in P.spike_info(facts, burst_rows(spark, {1, 9})).collect()}
    assert info == {1: 0.0, 9: -6.0}  # base = mean(1, 3) over days 2..8
    paths = {r.day.day: r.tone_trajectory for r in P.tone_paths(facts).collect()}
    assert paths[9] == [3.0, -4.0, 0.12]


def test_comparison(spark):
    bursts = burst_rows(spark, {2, 4, 6})
    rows = [dict(event_id=d * 10 + k, day=f"2024-01-{d:02d}", quad_class=3 if k < d else 1, avg_tone=-float(d))
            for d in (2, 4, 6) for k in range(8)]
    stats = P.spike_stats(P.day_facts(events(spark, rows)), bursts)
    out = {r.day.day: r for r in P.compare_spikes(stats).collect()}
    assert not out[2].has_history and out[2].count_ratio is None and out[2].escalation_direction == "Unknown"
    assert out[6].n_historical == 2 and out[6].count_ratio == 1.0 and out[6].tone_diff == -3.0
    assert out[6].conflict_pct_diff == 37.5
    text = {r.day.day: r.narrative for r in P.comparison_text(P.compare_spikes(stats)).collect()}
    assert text[2].startswith("No historical burst data is available for USA")
    assert "37" in text[6] or "38" in text[6]
    each = {(r.day.day, r.recency): r.past_day.day for r in P.versus_each(stats).collect()}
    assert each == {(4, 1): 2, (6, 1): 4, (6, 2): 2}
    assert P.comparison_table(stats).count() == 6


@pytest.mark.parametrize("question, want", [
    ("Why did it spike?", "spike_cause"), ("compare it", "general"), ("worse than before", "comparison"),
    ("What was the tone?", "tone"), ("hello", "general"), ("Any SOURCES? a source!", "evidence"), ("keywords", "general"),
    ("which event type", "event_types"), ("anyway", "general"), ("éwhy", "general"),
])
def test_intents(one, question, want):
    assert one(R.parse_intent(F.lit(question))) == want


def test_intent_stems(one):
    assert one(R.parse_intent(F.lit("compare it"), stem=True)) == "comparison"


def test_lead_lag_of_a_shifted_copy(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 50, 40)
    series = {"A": base[2:38].tolist(), "B": base[:36].tolist(), "C": [4] * 36, "D": rng.integers(0, 9, 13).tolist()}
    table = settle(L.burst_series(daily(spark, series)))
    lags = {(r.country_a, r.country_b, r.lag): r for r in L.lag_correlations(table).collect()}
    assert lags[("A", "B", 2)].correlation == 1.0 and lags[("A", "B", 2)].p_value == 0.0
    assert lags[("A", "C", 0)].correlation == 0.0 and lags[("A", "C", 0)].p_value == 1.0
    x, y = np.array(series["A"][:33]), np.array(series["B"][3:])
    assert lags[("A", "B", 3)].correlation == pytest.approx(np.corrcoef(x, y)[0, 1], abs=6e-5)
    report = {(r.country_a, r.country_b): r for r in L.pair_report(table).collect()}
    assert len(report) == 6
    assert report[("A", "B")].best_lag == 2
    assert report[("A", "B")].interpretation == (
        "Spikes in A precede spikes in B by ~2d (positive r=1.000) (statistically significant).")
    assert report[("A", "D")].error == "Not enough overlapping dates (13)"
    assert report[("A", "C")].interpretation == "No meaningful correlation between A and C."
