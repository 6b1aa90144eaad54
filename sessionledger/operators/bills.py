"""From log lines to bills: rounds, calls, tools and hooks of the log are weighed, split and priced in one chain.

Lines need what :mod:`sessionize` needs, and ``tool_name`` on tool lines, ``event_name, tokens_est`` on hooks, and
``input, cached, output, model`` on turns. Every step is skew-safe on its own key. Steps that are read more than once are written
once, as narrow tables without texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.functions.text import tokens_of_chars
from sessionledger.operators import reconstruct as r
from sessionledger.operators import sessionize as s
from sessionledger.operators.allocate import floor0, split_exact
from sessionledger.operators.anomaly import attach_cards, compaction_cards, deferred_reload, detect_miss, reprice_after_reload
from sessionledger.operators.grouping import Groups, skew_safe
from sessionledger.session import materialize

c = F.col
ROUND = ["session_id", "round_no"]
CALL = [*ROUND, "call_no"]
LINE = ["session_id", "line_no", "kind", "context_tokens", "stream_ms", "agent_ms", "chars", "tokens_after", "tool_call_id", "tool_name", "event_name", "tokens_est", "elapsed_ms",
        "input", "cached", "output", "model"]


@dataclass(frozen=True)
class Ledger:
    """What the log holds, before anything is split: one row per line, call, tool, hook and closed round."""

    lines: DataFrame
    calls: DataFrame
    tools: DataFrame
    hooks: DataFrame
    rounds: DataFrame


def sized_tools(rows: DataFrame) -> DataFrame:
    """Declared tools with name, growth, and the weights of their arguments and results (characters / 4)."""
    update = c("kind") == "tool_call_update"
    d = rows.filter(c("owner_no").isNotNull()).groupBy(*CALL, c("owner_no").alias("tool_no")).agg(
        F.min("line_no").alias("line_no"), F.min_by("tool_name", "line_no").alias("name"), F.sum("tool_delta").alias("tool_delta"),
        F.max(F.when(~update, c("chars"))).alias("arg_chars"), F.max(F.when(update, c("chars"))).alias("result_chars"))
    return d.withColumns({"request_w": tokens_of_chars(c("arg_chars")), "result_w": tokens_of_chars(c("result_chars"))})


def ledger(lines: DataFrame) -> Ledger:
    """Sessionise the log and weigh it."""
    base = s.by_session(lines.select(*LINE), lambda x, g: s.cache_baselines(s.assign_calls(s.assign_rounds(x, g), g), g), deal=True)
    base = materialize(base)
    rows = materialize(s.by_session(base, lambda x, g: s.owning_tool(s.context_cursor(x, g), g), deal=True))
    calls = s.by_session(rows, lambda x, g: s.call_rollup(x, g.reorder("line_no")))
    hooks = materialize(s.by_session(base, s.place_hooks, deal=True))
    tools = sized_tools(rows).join(calls.select(*CALL, "late_delta"), CALL).withColumns({"ch_result_tokens": F.lit(0).cast("long"), "result_tokens": c("result_w")})
    tools = materialize(skew_safe(materialize(tools), CALL, "tool_no", r.tool_pool, deal=True))
    calls = materialize(weighed_calls(calls, tools, hooks))
    rounds = s.by_session(base, lambda x, g: s.idle_gaps(s.round_rollup(x), g.reorder("round_no")))
    return Ledger(base, calls, tools, hooks, closed_rounds(base, rounds, calls))


def weighed_calls(calls: DataFrame, tools: DataFrame, hooks: DataFrame) -> DataFrame:
    """Calls with the weights of :func:`reconstruct.call_weights`; hooks that reach the model enlarge the harness pool."""
    pools = tools.groupBy(*CALL).agg(F.sum("pool_share").alias("tool_pool"), F.sum("request_w").alias("arg_tokens"))
    own = hooks.filter("place = 'call'").groupBy(*CALL).agg(F.sum("tokens_est").alias("hook_tokens"), F.sum("to_llm_tokens").alias("hook_to_llm"))
    d = calls.join(pools, CALL, "left").join(own, CALL, "left")
    d = d.fillna(0, ["tool_pool", "arg_tokens", "hook_tokens", "hook_to_llm"])
    none = F.lit(0).cast("long")
    d = d.withColumns({
        "harness_pool": c("tool_pool") + c("hook_to_llm"), "start": F.coalesce("context_start", none), "end": F.coalesce("context_end", "context_start", none),
        "thought_tokens": none, "message_tokens": none, "enc_tokens": none, "enc_chars": none})
    sized = tools.withColumn("ch_result_chars", none).drop("arg_tokens").withColumn("arg_tokens", none)
    return r.call_weights(d, sized, CALL).drop("thought_tokens", "message_tokens", "enc_tokens", "enc_chars", "context_start", "context_end")


def closed_rounds(lines: DataFrame, rounds: DataFrame, calls: DataFrame) -> DataFrame:
    """Closed rounds with their official counters, the user's share and a cache miss, if there was one."""
    turns = lines.filter(c("kind") == s.TURN).select(
        *ROUND, c("input").alias("off_in"), c("cached").alias("off_cache"), c("output").alias("off_out"), p.family_or_default(p.price_family(c("model"))).alias("family"), c("agent_ms").alias("event_ms"))
    first = calls.groupBy(*ROUND).agg(F.min_by("start", "call_no").alias("start0"))
    d = rounds.join(turns, ROUND).join(first, ROUND).withColumns({"prior": c("baseline"), "is_first": c("baseline").isNull()})
    typed, grown = tokens_of_chars(c("user_chars")), F.when(c("is_first"), 0).otherwise(floor0(c("start0") - c("prior")))
    d = detect_miss(d).withColumn("user_unc", F.greatest(typed, grown).cast("long"))
    return materialize(d.withColumn("system_unc", F.when(c("is_first"), floor0(c("start0") - c("user_unc"))).otherwise(0).cast("long")))


def priced_calls(book: Ledger) -> DataFrame:
    """Calls of closed rounds, split and priced (:func:`reconstruct.reconstruct`)."""
    facts = book.rounds.select(*ROUND, "off_in", "off_cache", "off_out", "prior", "reread", "user_unc", "system_unc", "family")
    d = materialize(book.calls.drop("baseline").join(facts, ROUND))
    return materialize(skew_safe(d, ROUND, "call_no", r.reconstruct, deal=True))


def prompt_rows(rounds: DataFrame, calls: DataFrame) -> DataFrame:
    """Round totals of the calls with the priced prompt of the round."""
    d = r.round_breakdown(calls, ROUND).join(rounds.select(*ROUND, "event_ms", "prior", "reread", "user_unc", "system_unc", "start0", "family"), ROUND)
    d = d.withColumns({"is_first": c("cold"), "system_in": c("system_unc"), "user_in": c("user_unc"), "tier_ctx": F.greatest("start0", F.lit(1)), "reread_in": c("reread")})
    d = r.price_prompts(d)
    return r.round_tree(d.withColumn("reread_usd", p.price_tokens("input", F.coalesce("reread", F.lit(0)), c("family"), c("tier_ctx"))))


def harness_items(calls: DataFrame, tools: DataFrame, hooks: DataFrame, g: Groups) -> DataFrame:
    """Tools and hooks of a call in line order with their shares of its tool input (``tokens``) and, for tools, of its requests.

    A hook that answers the user weighs nothing.
    """
    t = tools.select(*CALL, "line_no", F.lit("tool").alias("kind"), "name", "tool_no", "request_w", c("result_w").alias("weight"), c("pool_share").alias("est"))
    h = hooks.filter("place = 'call'").select(
        *CALL, "line_no", F.lit("hook").alias("kind"), c("event_name").alias("name"), F.lit(0).cast("long").alias("tool_no"), F.lit(0).cast("long").alias("request_w"),
        c("to_llm_tokens").alias("weight"), c("to_llm_tokens").alias("est"))
    d = t.unionByName(h).join(calls.select(*CALL, "o_emit", "emit_usd", "tools_in", "tier_ctx", "family"), CALL)
    is_tool = c("kind") == "tool"
    some = F.max(F.when(c("weight") > 0, 1).otherwise(0))
    d = d.join(d.groupBy(*CALL).agg(some.alias("__some")), CALL)
    # without any weight the tools share evenly, never the hooks
    d = split_exact(d, g, "request", c("request_w"), c("o_emit"), is_tool)
    return split_exact(d, g, "tokens", c("weight"), c("tools_in"), is_tool | (c("__some") == 1)).drop("__some")


def phase_tree(calls: DataFrame, items: DataFrame) -> DataFrame:
    """The nodes of every call in order of ``phase, rank, line_no``: what the model wrote, then what the harness made of it.

    ``est_tokens`` is what the log shows while the round is open: the whole answer counts as input of the next prompt
    (``llm_to_in``). ``tokens`` and ``usd`` are what the bill says: no prompt takes the last answer, so it gives that back. The node
    ``unaccounted`` is window growth that no node explains. A part that is billed has a node even where the log shows nothing of it.
    """
    emit = F.when(c("emit_delta") > 0, c("emit_delta")).otherwise(c("arg_tokens"))
    thought, message = tokens_of_chars(c("thought_chars")), tokens_of_chars(c("message_chars"))
    back = thought + emit + message
    pool = c("tool_pool") + c("hook_to_llm")
    has_tools = c("tool_count") > 0
    some = F.lit(True)

    def node(kind: str, phase: int, rank: int, est: Column, tokens: Column, usd: Column, shown: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(phase).alias("phase"), F.lit(rank).alias("rank"), est.cast("long").alias("est_tokens"), tokens.cast("long").alias("tokens"),
                        usd.cast("double").alias("usd"), shown.alias("shown"))

    none, free = F.lit(0), F.lit(0.0)
    own = F.array(
        node("phase_llm", 0, 0, emit, c("output"), c("out_usd"), some),
        node("thought", 0, 1, thought, c("o_thought"), c("thought_usd"), (c("thought_chunks") > 0) | (thought > 0) | (c("o_thought") > 0)),
        node("reasoning", 0, 2, none, c("o_reason"), c("reason_usd"), (thought > 0) | (emit > 0) | has_tools | (c("o_reason") > 0)),
        node("message", 0, 3, message, c("o_message"), c("message_usd"), (c("message_chunks") > 0) | (c("o_message") > 0)),
        node("phase_harness", 1, 0, pool + back, c("harness_in"), c("in_usd"), has_tools | (back > 0) | (c("hook_tokens") > 0) | (c("harness_in") > 0)),
        node("llm_to_in", 1, 1, back, c("out_in"), c("out_in_usd"), has_tools | (back > 0) | (c("out_in") > 0)),
        node("unaccounted", 2, 0, c("end") - c("start") - back - pool, none, free, some))
    flat = calls.select(*CALL, F.inline(own)).filter("shown").drop("shown").withColumns({"name": F.lit(None).cast("string"), "line_no": F.lit(0).cast("long")})
    tool = c("kind") == "tool"
    usd = p.price_tokens("input", c("tokens"), c("family"), c("tier_ctx"))
    share = F.when(c("o_emit") > 0, c("emit_usd") * (c("request") / c("o_emit"))).otherwise(0.0)
    rows = F.array(node("tool_request", 0, 4, c("request_w"), c("request"), share, tool), node("tool", 1, 2, c("est"), c("tokens"), usd, tool), node("hook", 1, 3, c("est"), c("tokens"), usd, ~tool))
    lines = items.select(*CALL, "name", "line_no", F.explode(rows).alias("x")).select(*CALL, "name", "line_no", "x.*").filter("shown").drop("shown")
    return flat.unionByName(lines)


def compaction_bills(lines: DataFrame, book: Ledger, calls: DataFrame, items: DataFrame) -> DataFrame:
    """Compactions between two rounds with what they cost: the window read once more, the history written, and the reload that the
    first call of the next round paid, which moves from that call to the compaction.

    ``lines`` carry ``tokens_before, tokens_after``. Of several compactions before a round the last one counts.
    """
    cards = s.by_session(lines, attach_cards).filter((c("kind") == s.COMPACT) & c("before_round").isNotNull())
    last = cards.groupBy("session_id", c("before_round").alias("round_no")).agg(
        F.max_by(F.struct("line_no", "agent_ms", "tokens_before", "tokens_after"), "line_no").alias("x")).select(*ROUND, "x.*")
    missed = book.rounds.select("session_id", (c("round_no") + 1).alias("round_no"), c("miss_kind").isNotNull().alias("prev_missed"))
    explained = items.groupBy(*CALL).agg(F.sum("tokens").alias("explained"))
    first = calls.filter("i = 1").join(explained, CALL, "left").withColumns({
        "caused_in": c("harness_in"), "tool_in": c("tool_pool"), "residual_in": floor0(c("harness_in") - c("out_in") - F.coalesce("explained", F.lit(0)))})
    first = first.select(*ROUND, "emit_delta", "arg_tokens", "caused_in", "tool_in", "residual_in", "paid", "input", "cache_usd", "out_usd", "family")
    d = last.join(first, ROUND).join(missed, ROUND, "left").withColumn("prev_missed", F.coalesce("prev_missed", F.lit(False)))
    return compaction_cards(reprice_after_reload(deferred_reload(d)).withColumnRenamed("out_usd", "call_out_usd"))
