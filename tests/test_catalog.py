"""Every registered query beside its SQL on the smallest tables, plus contract checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.check import TABLES, compare
from conftest import SF

# Slow training and summary runs are left to `python -m catalog.check`.
SLOW = {"evl11_summary", "ml4_cross_validation", "ml5_importance", "ml7_stored_model", "chn3_model_chains",
        "rpt4_answers_with_evidence", "rpt2_briefings_with_evidence"}
FAST = ("agg1_by_week", "agg9_half_periods", "agg11_insights", "agg14_cleaning_report", "agg20_event_context", "agg23_spike_comparison",
        "chn4_event_chains", "chn7_patterns", "chn9_cross_country_links", "evl1_ranking_metrics", "evl8_ablation", "flt6_search",
        "jn2_events_on_spikes", "kw7_normal_vs_spike", "lag4_all_pairs", "prj4_clean_actors", "rpt2_briefings", "rpt4_answers",
        "src2_read_export_folder", "str4_streaming_spikes", "str5_sliding_tone", "top6_spike_urls", "txt5_chunks",
        "txt8_vector_search", "win3_detect_bursts", "win5_run_lengths")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.execute(entry.oracle_sql()[name])
    verdict = compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), [d[0] for d in rel.description])
    assert verdict in ("", "EMPTY")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SLOW <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns[:3] == ["day", "country", "event_count"] and df.count() == 90
