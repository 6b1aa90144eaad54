"""From the log to bills: what must add up, and the placement of hooks by hand."""

import pytest
from pyspark.sql import functions as F

from sessionledger.operators import bills
from sessionledger.operators import sessionize as s
from sessionledger.operators.grouping import BlockedGroups, PlainGroups
from sessionledger.plans import log_queries as lq

c = F.col
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark):
    full = bills.ledger(lq.log_lines(spark, SMALL))
    calls = bills.priced_calls(full)
    return full, calls.cache(), bills.prompt_rows(full.rounds, calls).cache()


def test_sums(book):
    """Official counters are split without loss, node by node and dollar by dollar."""
    full, calls, rounds = book
    official = {(r.session_id, r.round_no): r for r in full.rounds.collect()}
    for r in rounds.collect():
        o = official[r.session_id, r.round_no]
        assert r.input_tokens == o.off_in and r.output_tokens == o.off_out
        assert r.uncached_tokens == max(0, o.off_in - min(o.off_cache, o.off_in))
        assert r.total_usd == pytest.approx(r.tree_in_usd + r.cached_usd + r.output_usd if r.cold else r.api_usd)
    nodes = lq.tree_nodes(full, calls).cache()
    by_call = nodes.groupBy(*bills.CALL).agg(
        *[F.sum(F.when(c("kind").isin(*kinds), c(x)).otherwise(0)).alias(n) for n, kinds, x in (
            ("out", ["reasoning", "message", "tool_request"], "tokens"), ("harness", ["tool", "hook", "llm_to_in"], "tokens"), ("llm", ["phase_llm"], "tokens"), ("whole", ["phase_harness"], "tokens"),
            ("est", ["phase_harness", "unaccounted"], "est_tokens"))])
    n = 0
    for r in by_call.join(calls.select(*bills.CALL, "o_emit", "tools_in", "start", "end", "tool_count", "hook_to_llm"), bills.CALL).collect():
        n += 1
        assert r.out == r.llm - (r.o_emit if not r.tool_count else 0)
        assert r.est == r.end - r.start
        if r.tool_count:
            assert r.harness == r.whole
    assert n == calls.count() > 100
    order = [r.kind for r in nodes.join(nodes.filter("kind = 'hook'").select(*bills.CALL).distinct().limit(1), bills.CALL).orderBy("phase", "rank", "line_no").collect()]
    assert order[0] == "phase_llm" and order[-1] == "unaccounted" and order.index("phase_harness") < order.index("llm_to_in") < order.index("hook")


def test_last_answer_is_given_back(book):
    """The open round shows every answer as input of the next prompt; the bill takes the last one back."""
    full, calls, _ = book
    rows = lq.tree_nodes(full, calls).filter("kind = 'llm_to_in'").join(calls.select(*bills.CALL, "is_last", "output"), bills.CALL).collect()
    assert all(r.tokens == 0 for r in rows if r.is_last)
    assert any(r.is_last and r.est_tokens > 0 for r in rows) and any(not r.is_last and r.tokens > 0 for r in rows)


@pytest.mark.parametrize("groups", [PlainGroups(["session_id"], "line_no"), BlockedGroups(["session_id"], "line_no", 3)])
def test_hook_places(spark, groups):
    rows = [(1, 1, s.HOOK, "user_prompt_submit"), (1, 2, "user_message_chunk", None), (1, 3, s.HOOK, "pre_tool"), (1, 4, "agent_thought_chunk", None), (1, 5, s.HOOK, "pre_tool"), (1, 6, s.HOOK, "Stop"),
            (1, 7, s.HOOK, "before_stop"), (1, 8, s.TURN, None), (1, 9, s.HOOK, "stop"), (1, 10, s.HOOK, "user_prompt_submit"), (1, 11, "user_message_chunk", None), (1, 12, s.HOOK, None), (1, 13, s.TURN, None),
            (1, 14, s.HOOK, "pre_tool")]
    df = spark.createDataFrame([(*r, 10 * r[1], None) for r in rows], "session_id long, line_no long, kind string, event_name string, tokens_est long, stream_ms long")
    d = s.place_hooks(s.assign_calls(s.assign_rounds(df, groups), groups), groups)
    got = {r.line_no: (r.place, r.round_no, r.call_no, r.to_llm_tokens) for r in d.collect()}
    assert got == {1: ("user", 1, None, 0), 3: ("before_llm", 1, None, 0), 5: ("call", 1, 1, 50), 6: ("call", 1, 1, 0), 7: ("call", 1, 1, 70), 9: ("after", 2, None, 0), 10: ("user", 2, None, 0),
                   12: ("before_llm", 2, None, 0), 14: ("pending", None, None, 0)}


def test_reload_moves_from_call_to_compaction(spark, book):
    full, calls, _ = book
    lines = lq.log_lines(spark, SMALL).withColumn("tokens_before", F.when(c("kind") == s.COMPACT, c("k") * 3000))
    rows = bills.compaction_bills(lines, full, calls, lq.tree_items(full, calls)).collect()
    for r in rows:
        assert r.caused_in == 0 or r.call_in_left + r.reload_tokens == r.caused_in
        assert r.pre_in_tokens + r.pre_cached_tokens == r.tokens_before and r.call_usd_left == r.in_usd_left + r.cache_usd + r.call_out_usd


def test_residual_input_is_the_reload(spark):
    """Input that nothing explains comes first, then what was emitted beyond the arguments, then what tools leave."""
    from sessionledger.operators.anomaly import deferred_reload, reprice_after_reload

    rows = [(1, 500, 10, 900, 100, 300), (2, 500, 10, 900, 100, 0), (3, 20, 10, 900, 100, 0), (4, 500, 10, 200, 100, 0), (5, 20, 10, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id int, emit_delta long, arg_tokens long, caused_in long, tool_in long, residual_in long").withColumns({
        "paid": F.lit(1000), "input": F.lit(250_000), "cache_usd": F.lit(0.5), "out_usd": F.lit(0.25), "family": F.lit("4.5"), "tokens_before": F.lit(300_000), "tokens_after": F.lit(6_000)})
    got = {r.id: r for r in reprice_after_reload(deferred_reload(df)).collect()}
    assert {i: (r.reload_tokens, r.call_in_left, r.paid_left) for i, r in got.items()} == {1: (300, 600, 700), 2: (490, 410, 510), 3: (800, 100, 200), 4: (200, 0, 800), 5: (0, 0, 1000)}
    assert got[1].reload_usd == pytest.approx(300 * 2 / 1e6) and got[1].in_usd_left == pytest.approx(600 * 4 / 1e6) and got[1].call_usd_left == pytest.approx(600 * 4 / 1e6 + 0.75)
