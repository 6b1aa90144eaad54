"""The driver contract, and a few queries against their SQL twins at the smallest scale."""

import pytest
from compare import check, duck

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["hourly_priced_buckets", "round_rollup", "work_wait_spans", "exact_split", "snapshot_kinds", "peeled_rounds", "recap_requests", "cost_timeline", "context_series", "retained_rounds", "history_changes",
          "rewrite_counters", "streamed_rounds", "live_gauges", "refreshed_rounds", "clipped_week_buckets", "session_list", "model_hint_window", "exact_split_of_a_hot_key",
          "reasoning_on_calls", "session_bills", "result_sizes", "zoomed_sessions", "tool_schema_sizes", "streamed_side_events", "streamed_child_bills", "hook_placements",
          "sql_usage_buckets", "sql_remainders", "cumulative_buckets", "exact_split_of_near_unique_weights", "log_compaction_bills", "bucketed_tools", "cache_baselines"]


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, name):
    from __spark_entry__ import catalogue

    con = duck(SMALL)
    assert check(spark, con, SMALL, catalogue()[name])[1] == "ok"
