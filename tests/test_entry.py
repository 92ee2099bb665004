import __spark_entry__ as entry
import pytest
from conftest import SF
from oracle_check import compare

SAMPLE = ["q_item_matchups", "q_counter_recommend", "q_merge_latest", "q_scan_nested_payload", "q_rank_pivot", "q_best_series", "q_standings",
          "q_resolve_names", "q_member_rating_history", "q_pool_percentile", "q_extract_measures", "q_series_checks"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 110


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
