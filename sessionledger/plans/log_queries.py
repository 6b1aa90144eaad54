"""From the bound log to bills, trees and stacks: lines -> rounds -> calls -> reconstruction -> segments."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators import bills
from sessionledger.operators import segments as sg
from sessionledger.operators import sessionize as s
from sessionledger.operators.grouping import skew_safe
from sessionledger.plans import allocation_queries as aq
from sessionledger.plans import binding as b
from sessionledger.plans import event_queries as eq
from sessionledger.plans import segment_queries as sq
from sessionledger.plans.registry import query
from sessionledger.plans.sessionize_queries import ACT, UPTO

c = F.col
TOOL_NAMES = ["grep", "read_file", "search_replace", "todo_write", "run_command"]
HOOK_NAMES = ["user_prompt_submit", "Stop", "pre_tool", "before_stop"]
DAY = sq.DAY


def log_lines(spark, sf):
    """The bound log with names of tools and hooks."""
    tool, hook = c("kind").isin(s.TOOL_KINDS), c("kind") == s.HOOK
    pick = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))
    return b.v_updates(spark, sf).withColumns({
        "tool_name": F.when(tool, pick(TOOL_NAMES, c("k") % 5)), "event_name": F.when(hook, pick(HOOK_NAMES, F.least(F.floor(c("k") / 25), F.lit(3)))),
        "tokens_est": F.when(hook, F.greatest(F.lit(1), F.floor(c("k") / 4))).cast("long"), "elapsed_ms": F.when(hook, c("chars"))})


_SLOT = "CASE WHEN lower(event_name) LIKE 'user_prompt%' THEN 'user' WHEN lower(event_name) IN ('stop','session_stop','agent_stop','session_end') OR lower(event_name) LIKE '%\\_stop' ESCAPE '\\' THEN 'to_user' ELSE 'stream' END"
b.VIEWS["v_log_hooks"] = f"""
  SELECT session_id, line_no, event_name, slot, tokens_est, elapsed_ms, place, CASE WHEN place <> 'pending' THEN round_no END AS round_no, CASE WHEN place = 'call' THEN call_no END AS call_no,
    CASE WHEN place = 'call' AND lower(event_name) NOT IN ('stop','session_stop','agent_stop') THEN tokens_est ELSE 0 END AS to_llm_tokens
  FROM (SELECT *, CASE WHEN b4 = 0 AND aft = 0 THEN 'pending' WHEN slot = 'user' THEN 'user' WHEN b4 > 0 AND call_no > 0 THEN 'call' WHEN slot = 'to_user' THEN 'after' ELSE 'before_llm' END AS place
    FROM (SELECT *, {_SLOT} AS slot FROM (SELECT *, {HOOK_NAMES}[1 + least(k // 25, 3)] AS event_name, greatest(1, k // 4) AS tokens_est, chars AS elapsed_ms,
        count(*) FILTER (kind IN {ACT}) OVER (PARTITION BY session_id, round_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4,
        count(*) FILTER (kind IN {ACT}) OVER (PARTITION BY session_id, round_no ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft FROM v_call_lines)
      WHERE kind = 'hook_execution'))"""
HOOK_COLS = ["session_id", "line_no", "event_name", "slot", "place", "round_no", "call_no", "tokens_est", "to_llm_tokens", "elapsed_ms"]


@query("hook_placements", "P29 A18 J15", f"SELECT {', '.join(HOOK_COLS)} FROM v_log_hooks")
def hook_placements(spark, sf):
    d = s.by_session(log_lines(spark, sf), lambda x, g: s.place_hooks(s.assign_calls(s.assign_rounds(x, g), g), g))
    return d.select(*HOOK_COLS)


PT = "PARTITION BY session_id, round_no, call_no"
b.VIEWS["v_log_tools"] = f"""
  SELECT session_id, round_no, call_no, owner AS tool_no, min(line_no) AS line_no, {TOOL_NAMES}[1 + arg_min(k, line_no) % 5] AS name, CAST(sum(tool_delta) AS BIGINT) AS tool_delta,
    coalesce(max(chars) FILTER (kind = 'tool_call'), 0) // 4 AS request_w, coalesce(max(chars) FILTER (kind = 'tool_call_update'), 0) // 4 AS result_w
  FROM v_owned GROUP BY ALL"""
b.VIEWS["v_log_shares"] = f"""
  SELECT * EXCLUDE (signal, late_delta, ww, pool, sw, last, sh), CAST(CASE WHEN pool <= 0 OR ww <= 0 THEN 0 WHEN tool_no = last THEN greatest(pool - sum(sh) OVER ({PT}), 0) ELSE sh END AS BIGINT) AS pool_share FROM (
  SELECT *, CASE WHEN pool > 0 AND ww > 0 AND tool_no IS DISTINCT FROM last THEN CAST(round_even(pool * ww / sw, 0) AS BIGINT) ELSE 0 END AS sh FROM (
  SELECT *, sum(ww) OVER ({PT}) AS sw, max(CASE WHEN ww > 0 THEN tool_no END) OVER ({PT}) AS last FROM (
  SELECT *, CASE WHEN signal > 0 THEN raw_w ELSE 1 END AS ww, signal + late_delta AS pool FROM (
  SELECT *, sum(raw_w) OVER ({PT}) AS signal FROM (
  SELECT t.*, late_delta, CASE WHEN result_w < 48 AND greatest(tool_delta, 0) > greatest(result_w * 3, 32) THEN greatest(tool_delta, 0) WHEN result_w > 0 THEN result_w ELSE greatest(tool_delta, 0) END AS raw_w
  FROM v_log_tools t JOIN (SELECT session_id, round_no, call_no, late_delta FROM v_call_sum) USING (session_id, round_no, call_no))))))"""
b.VIEWS["v_log_weighed"] = """
  SELECT c.session_id, c.round_no, c.call_no, coalesce(context_start, 0) AS start, coalesce(context_end, context_start, 0) AS "end", emit_delta, thought_chunks, thought_chars, message_chunks, message_chars,
    coalesce(tool_pool, 0) AS tool_pool, coalesce(req, 0) AS arg_tokens, coalesce(hook_tokens, 0) AS hook_tokens, coalesce(hook_to_llm, 0) AS hook_to_llm, coalesce(tool_count, 0) AS tool_count,
    thought_chars // 4 AS w_thought, message_chars // 4 AS w_message, 0 AS w_enc,
    CASE WHEN req > 0 THEN req WHEN emit_delta > 0 AND emit_delta < 2000 THEN emit_delta ELSE 0 END AS w_emit,
    CASE WHEN coalesce(tool_pool, 0) + coalesce(hook_to_llm, 0) > 0 THEN coalesce(tool_pool, 0) + coalesce(hook_to_llm, 0) WHEN grown > 0 THEN grown ELSE coalesce(res, 0) END AS w_harness
  FROM v_call_sum c LEFT JOIN (SELECT session_id, round_no, call_no, CAST(sum(pool_share) AS BIGINT) AS tool_pool, CAST(sum(request_w) AS BIGINT) AS req, CAST(sum(result_w) AS BIGINT) AS res,
      CAST(sum(greatest(tool_delta, 0)) AS BIGINT) AS grown, count(*) AS tool_count FROM v_log_shares GROUP BY ALL) t USING (session_id, round_no, call_no)
  LEFT JOIN (SELECT session_id, round_no, call_no, CAST(sum(tokens_est) AS BIGINT) AS hook_tokens, CAST(sum(to_llm_tokens) AS BIGINT) AS hook_to_llm FROM v_log_hooks WHERE place = 'call' GROUP BY ALL) h
    USING (session_id, round_no, call_no)"""
WEIGHT_COLS = ["session_id", "round_no", "call_no", "start", "end", "tool_pool", "hook_tokens", "hook_to_llm", "w_thought", "w_message", "w_emit", "w_harness"]


@query("log_call_weights", "L5 A18", f"SELECT {', '.join(f'\"{x}\"' for x in WEIGHT_COLS)} FROM v_log_weighed")
def log_call_weights(spark, sf):
    """Weights of the log's calls; hooks that can reach the model enlarge the harness pool."""
    return bills.ledger(log_lines(spark, sf)).calls.select(*WEIGHT_COLS)


# round_id: the twins of the reconstruction know rounds by one number
RID = "session_id * 1000000 + round_no"
b.VIEWS["v_log_round_in"] = """
  SELECT r.session_id, r.round_no, r.completed, r.baseline AS prior, r.baseline IS NULL AS is_first, r.context_end, r.idle_gap_ms, r.user_chars, t.input AS off_in, t.cached AS off_cache, t.output AS off_out,
    t.agent_ms AS event_ms, t.family, f.start0
  FROM v_round_sum r JOIN (SELECT session_id, round_no, input, cached, output, agent_ms,
      CASE WHEN model LIKE '%4.6%' THEN '4.6' ELSE '4.5' END AS family FROM v_lines WHERE kind = 'turn_completed') t USING (session_id, round_no)
  JOIN (SELECT session_id, round_no, arg_min(start, call_no) AS start0 FROM v_log_weighed GROUP BY ALL) f USING (session_id, round_no)"""
b.VIEWS["v_log_rounds"] = f"""
  SELECT *, CASE WHEN is_first THEN greatest(start0 - user_unc, 0) ELSE 0 END AS system_unc FROM (
  SELECT *, greatest(user_chars // 4, CASE WHEN is_first THEN 0 ELSE greatest(start0 - prior, 0) END) AS user_unc FROM ({eq.miss_sql("v_log_round_in")}))"""
b.VIEWS["v_log_facts"] = aq.facts_sql(f"""
    SELECT {RID} AS round_id, w.*, off_in, off_cache, off_out, prior, reread, user_unc, system_unc, family FROM v_log_weighed w
    JOIN (SELECT session_id, round_no, off_in, off_cache, off_out, prior, reread, user_unc, system_unc, family FROM v_log_rounds) USING (session_id, round_no)""")
_CHAIN = ["v_facts", "v_inputs", "v_outputs", "v_harness", "v_recon", "v_breakdown", "v_prompts"]
for _name in _CHAIN[1:]:
    b.VIEWS[_name.replace("v_", "v_log_")] = re.sub(r"\b(" + "|".join(_CHAIN) + r")\b", lambda m: m[0].replace("v_", "v_log_"), b.VIEWS[_name])
BILL_TOKENS = ["calls", "input_tokens", "uncached_tokens", "cached_tokens", "output_tokens", "harness_tokens", "tool_in_tokens", "out_in_tokens", "reasoning_tokens", "tree_in_tokens", "cold"]
BILL_USD = ["harness_usd", "cached_usd", "output_usd", "user_usd", "system_usd", "tree_in_usd", "total_usd", "api_total_usd"]
b.VIEWS["v_log_bills"] = f"""
  SELECT p.*, {', '.join(f'r.{x}' for x in ('session_id', 'round_no', 'event_ms'))}, coalesce(p.reread, 0) + p.user_unc + harness_tokens AS tree_in_tokens, reread_usd + user_usd + harness_usd AS tree_in_usd,
    CASE WHEN cold THEN reread_usd + user_usd + harness_usd + cached_usd + output_usd ELSE api_usd END AS total_usd,
    CASE WHEN cold THEN system_usd + reread_usd + user_usd + harness_usd + cached_usd + output_usd ELSE api_usd END AS api_total_usd
  FROM (SELECT * EXCLUDE (session_id) FROM v_log_prompts) p JOIN v_log_rounds r ON p.round_id = r.session_id * 1000000 + r.round_no"""


def billed(spark, sf):
    """The log's ledger, its priced calls and its round bills."""
    book = bills.ledger(log_lines(spark, sf))
    calls = bills.priced_calls(book)
    return book, calls, bills.prompt_rows(book.rounds, calls)


@query("session_round_bills", "L15 A19 L6 L8 L9 L10", f"SELECT session_id, round_no, event_ms, {', '.join(BILL_TOKENS)}, {', '.join(b.r6(x) + ' AS ' + x for x in BILL_USD)} FROM v_log_bills")
def session_round_bills(spark, sf):
    """Bills of the log's closed rounds, rebuilt call by call."""
    return billed(spark, sf)[2].select("session_id", "round_no", "event_ms", *BILL_TOKENS, *[p.gold(c(x)).alias(x) for x in BILL_USD])


_ITEMS = """(SELECT i.*, max(CASE WHEN weight > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY i.round_id, i.call_no) AS weighs, o_emit, emit_usd, tools_in, ri FROM (
    SELECT session_id * 1000000 + round_no AS round_id, session_id, round_no, call_no, line_no, 'tool' AS kind, name, request_w, result_w AS weight, pool_share AS est FROM v_log_shares
    UNION ALL SELECT session_id * 1000000 + round_no, session_id, round_no, call_no, line_no, 'hook', event_name, 0, to_llm_tokens, to_llm_tokens FROM v_log_hooks WHERE place = 'call') i
  JOIN v_log_recon USING (round_id, call_no))"""
PC = "PARTITION BY round_id, call_no"
_i1 = aq.split_sql(_ITEMS, "request", "request_w", "o_emit", "kind = 'tool'", part=PC, order="line_no")
b.VIEWS["v_log_items"] = aq.split_sql(f"({_i1})", "tokens", "weight", "tools_in", "kind = 'tool' OR weighs = 1", part=PC, order="line_no")


def _own(kind, phase, rank, est, tokens, usd, shown):
    return f"SELECT session_id, round_no, call_no, '{kind}' AS kind, {phase} AS phase, {rank} AS rank, NULL AS name, 0 AS line_no, CAST({est} AS BIGINT) AS est_tokens, CAST({tokens} AS BIGINT) AS tokens, CAST({usd} AS DOUBLE) AS usd FROM v_log_tree_calls WHERE {shown}"


b.VIEWS["v_log_tree_calls"] = """
  SELECT *, th + em + ms AS back, tool_pool + hook_to_llm AS pool FROM (
  SELECT *, thought_chars // 4 AS th, CASE WHEN emit_delta > 0 THEN emit_delta ELSE arg_tokens END AS em, message_chars // 4 AS ms FROM v_log_recon)"""
b.VIEWS["v_log_tree"] = " UNION ALL ".join([
    _own("phase_llm", 0, 0, "em", "output", "out_usd", "true"), _own("thought", 0, 1, "th", "o_thought", "thought_usd", "thought_chunks > 0 OR th > 0 OR o_thought > 0"),
    _own("reasoning", 0, 2, "0", "o_reason", "reason_usd", "th > 0 OR em > 0 OR tool_count > 0 OR o_reason > 0"), _own("message", 0, 3, "ms", "o_message", "message_usd", "message_chunks > 0 OR o_message > 0"),
    _own("phase_harness", 1, 0, "pool + back", "harness_in", "in_usd", "tool_count > 0 OR back > 0 OR hook_tokens > 0 OR harness_in > 0"), _own("llm_to_in", 1, 1, "back", "out_in", "out_in_usd", "tool_count > 0 OR back > 0 OR out_in > 0"),
    _own("unaccounted", 2, 0, "\"end\" - start - back - pool", "0", "0", "true"),
    "SELECT session_id, round_no, call_no, 'tool_request', 0, 4, name, line_no, request_w, request, CASE WHEN o_emit > 0 THEN emit_usd * (request / o_emit) ELSE 0.0 END FROM v_log_items WHERE kind = 'tool'",
    "SELECT session_id, round_no, call_no, kind, 1, CASE kind WHEN 'tool' THEN 2 ELSE 3 END, name, line_no, est, tokens, CASE WHEN tokens > 0 THEN tokens * ri / 1e6 ELSE 0.0 END FROM v_log_items"])
TREE = ["session_id", "round_no", "call_no", "phase", "rank", "line_no", "kind", "name", "est_tokens", "tokens"]


def tree_items(book, calls):
    return skew_safe(calls.select(*bills.CALL, "o_emit", "emit_usd", "tools_in", "tier_ctx", "family"), bills.CALL, "call_no",
                      lambda x, g: bills.harness_items(x, book.tools, book.hooks, g.reorder("line_no")), mode="plain")

def tree_nodes(book, calls):
    return bills.phase_tree(calls, tree_items(book, calls))


@query("call_phase_tree", "L18 L17", f"SELECT {', '.join(TREE)}, {b.r8('usd')} AS usd FROM v_log_tree")
def call_phase_tree(spark, sf):
    """Every call of the log as an ordered list of model and harness nodes."""
    book, calls, _ = billed(spark, sf)
    return tree_nodes(book, calls).select(*TREE, p.gold(c("usd"), 8).alias("usd"))


_AFTER = "CASE WHEN tokens_after > 0 THEN tokens_after WHEN tokens_before > 0 THEN tokens_before ELSE 1 END"
_RATE = "(SELECT ri FROM rate_card r WHERE r.family = x.family AND {0} > r.lo AND {0} <= r.hi)"
b.VIEWS["v_log_reloads"] = f"""
  SELECT *, CASE WHEN reload_tokens > 0 THEN reload_tokens * rate_after / 1e6 ELSE 0.0 END AS reload_usd, CASE WHEN left_in > 0 THEN left_in * rate_call / 1e6 ELSE 0.0 END AS in_usd_left,
    CASE WHEN left_in > 0 THEN left_in * rate_call / 1e6 ELSE 0.0 END + cache_usd + out_usd AS call_usd_left
  FROM (SELECT *, greatest(harness_in - reload_tokens, 0) AS left_in, greatest(paid - reload_tokens, 0) AS paid_left
    FROM (SELECT *, CASE WHEN harness_in > 0 THEN least(raw, harness_in) ELSE raw END AS reload_tokens
      FROM (SELECT x.*, CASE WHEN residual > 0 THEN residual WHEN emit_delta > greatest(arg_tokens, 1) * 3 THEN greatest(emit_delta - arg_tokens, 0) ELSE greatest(harness_in - tool_pool, 0) END AS raw,
          r1.ri AS rate_after, r2.ri AS rate_call
        FROM (SELECT *, {_AFTER} AS after_, CASE WHEN input > 0 THEN input ELSE {_AFTER} END AS peak_ FROM (
          SELECT c.session_id, c.round_no, c.line_no, c.tokens_before, c.tokens_after, f.* EXCLUDE (session_id, round_no), coalesce(m.miss_kind IS NOT NULL, false) AS prev_missed,
            greatest(f.harness_in - f.out_in - coalesce(e.explained, 0), 0) AS residual
          FROM (SELECT s.session_id, s.before_round AS round_no, max(s.line_no) AS line_no, arg_max(k * 3000, s.line_no) AS tokens_before, arg_max_null(tokens_after, s.line_no) AS tokens_after
            FROM ({eq.SIDE_SQL}) s JOIN v_updates u ON u.session_id = s.session_id AND u.line_no = s.line_no WHERE s.kind = 'auto_compact_completed' AND before_round IS NOT NULL GROUP BY ALL) c
          JOIN (SELECT session_id, round_no, call_no, emit_delta, arg_tokens, harness_in, out_in, tool_pool, paid, input, cache_usd, out_usd, family FROM v_log_recon WHERE i = 1) f ON f.session_id = c.session_id AND f.round_no = c.round_no
          LEFT JOIN (SELECT session_id, round_no, call_no, sum(tokens) AS explained FROM v_log_items GROUP BY ALL) e ON e.session_id = f.session_id AND e.round_no = f.round_no AND e.call_no = f.call_no
          LEFT JOIN v_log_rounds m ON m.session_id = c.session_id AND m.round_no = c.round_no - 1)) x
        JOIN rate_card r1 ON r1.family = x.family AND after_ > r1.lo AND after_ <= r1.hi JOIN rate_card r2 ON r2.family = x.family AND peak_ > r2.lo AND peak_ <= r2.hi)))"""
RELOAD = ["session_id", "line_no", "round_no", "reload_tokens", "pre_in_tokens", "pre_cached_tokens", "out_tokens"]


@query("log_compaction_bills", "D4 D3", f"""
SELECT session_id, line_no, round_no, CAST(reload_tokens AS BIGINT) AS reload_tokens, CASE WHEN prev_missed THEN tokens_before ELSE 0 END AS pre_in_tokens, CASE WHEN prev_missed THEN 0 ELSE tokens_before END AS pre_cached_tokens,
  CAST(CASE WHEN tokens_after > 0 THEN greatest(1, tokens_after - reload_tokens) ELSE 0 END AS BIGINT) AS out_tokens, CAST(left_in AS BIGINT) AS call_in_left, CAST(paid_left AS BIGINT) AS paid_left,
  {b.r8('reload_usd')} AS reload_usd, {b.r8('in_usd_left')} AS in_usd_left, {b.r8('call_usd_left')} AS call_usd_left FROM v_log_reloads""")
def log_compaction_bills(spark, sf):
    """Compactions of the log with the reload that moves to them from the next round's first call, which is priced again."""
    lines = log_lines(spark, sf).withColumn("tokens_before", F.when(c("kind") == s.COMPACT, c("k") * 3000))
    book = bills.ledger(lines)
    calls = bills.priced_calls(book)
    d = bills.compaction_bills(lines, book, calls, tree_items(book, calls))
    return d.select(*RELOAD, "call_in_left", "paid_left", *[p.gold(c(x), 8).alias(x) for x in ("reload_usd", "in_usd_left", "call_usd_left")])


# ---- stacks per bucket ----------------------------------------------------------------------
_SIDE = "SELECT key, k, label, usd, tok, agent_ms AS event_ms FROM v_side_segs WHERE stack = 'parts'"
_BUCKETS = f"""SELECT key, CASE WHEN grouping(bucket_ms) = 0 THEN bucket_ms END AS bucket_ms, any_value(k) AS k, any_value(label) AS label, sum(usd) AS usd, sum(tok) AS tok
  FROM (SELECT *, event_ms // {DAY} * {DAY} AS bucket_ms FROM (SRC)) GROUP BY GROUPING SETS ((key, bucket_ms), (key))"""
b.VIEWS["v_log_part_segs"] = f"""
  SELECT key, k, label, usd, tok, event_ms FROM ({sq.unpivot(sq._PARTS, 'event_ms', 'v_log_bills')}) WHERE usd > 0 OR tok > 0
  UNION ALL SELECT 'system', 'system', 'system', system_usd, CAST(system_unc AS DOUBLE), event_ms FROM v_log_bills WHERE cold AND (system_usd > 0 OR system_unc > 0) UNION ALL {_SIDE}"""
b.VIEWS["v_log_tool_segs"] = f"""
  SELECT CASE kind WHEN 'llm_to_in' THEN 'llm_out_in' WHEN 'tool' THEN 'tool:' || name WHEN 'tool_request' THEN 'toolreq:' || name WHEN 'hook' THEN 'hook:' || name ELSE kind END AS key,
    CASE kind WHEN 'llm_to_in' THEN 'llm_out_in' WHEN 'tool_request' THEN 'toolreq' ELSE kind END AS k, CASE WHEN kind = 'llm_to_in' THEN 'LLM Out→In' WHEN kind IN ('tool', 'tool_request', 'hook') THEN name ELSE kind END AS label,
    usd, CAST(tokens AS DOUBLE) AS tok, event_ms FROM v_log_tree JOIN (SELECT session_id, round_no, event_ms FROM v_log_rounds) USING (session_id, round_no)
    WHERE kind NOT IN ('phase_llm', 'phase_harness', 'unaccounted') AND (usd > 0 OR tokens > 0)
  UNION ALL SELECT 'cached', 'cached', 'Cached', cache_usd, CAST(cache AS DOUBLE), event_ms FROM v_log_recon JOIN (SELECT session_id, round_no, event_ms FROM v_log_rounds) USING (session_id, round_no) WHERE cache_usd > 0 OR cache > 0
  UNION ALL SELECT 'user', 'user', 'user', user_usd, CAST(user_unc AS DOUBLE), event_ms FROM v_log_bills WHERE user_usd > 0 OR user_unc > 0 UNION ALL {_SIDE}"""
STACK = ["bucket_ms", "key", "k", "label"]
_STACK_SQL = f"SELECT bucket_ms, key, k, label, {b.r8('usd')} AS usd, round(tok, 4) AS tok FROM ({_BUCKETS}) WHERE usd > 0 OR tok > 0"


def side_parts(spark, sf):
    """Recaps and compactions of the log as categories."""
    keep = ["event_ms"]
    r, k = eq.recaps(spark, sf).withColumnRenamed("agent_ms", "event_ms"), eq.compactions(spark, sf).withColumnRenamed("agent_ms", "event_ms")
    return sg.recap_parts(r, keep).unionByName(sg.compaction_parts(k, keep))


def per_day(segments):
    d = segments.withColumn("bucket_ms", (F.floor(c("event_ms") / DAY) * DAY).cast("long"))
    return sg.category_sums(d, "bucket_ms").select(*STACK, "usd", "tok")


@query("bucketed_parts", "C4 A6 G1", _STACK_SQL.replace("SRC", "SELECT * FROM v_log_part_segs"))
def bucketed_parts(spark, sf):
    """Parts stack per day: users, harness, thought, reasoning, requests, messages, Cached, the system card, recaps and compactions."""
    rounds = billed(spark, sf)[2]
    d = sg.round_parts(rounds, ["event_ms"]).unionByName(sg.system_segments(rounds, ["event_ms"])).unionByName(side_parts(spark, sf))
    return per_day(d)


def tool_stack(spark, sf):
    book, calls, rounds = billed(spark, sf)
    nodes = tree_nodes(book, calls).filter(~c("kind").isin("phase_llm", "phase_harness", "unaccounted"))
    at = book.rounds.select(*bills.ROUND, "event_ms")
    d = sg.round_tools(calls.join(at, bills.ROUND), nodes.join(at, bills.ROUND), rounds, ["event_ms"])
    return d.unionByName(side_parts(spark, sf))


@query("bucketed_tools", "C4 A6 G2 G7", _STACK_SQL.replace("SRC", "SELECT * FROM v_log_tool_segs"))
def bucketed_tools(spark, sf):
    """Tools stack per day: every tool, request and kind of hook by name."""
    return per_day(tool_stack(spark, sf))


@query("tool_label_totals", "A7 T5", f"""
SELECT key, label, CAST(CASE WHEN coalesce(list_position({sg.LEGEND}, key), 0) > 0 THEN list_position({sg.LEGEND}, key) - 1 WHEN coalesce(list_position({sg.LEGEND}, label), 0) > 0 THEN list_position({sg.LEGEND}, label) - 1
    WHEN key LIKE 'toolreq:%' THEN 50 WHEN key LIKE 'tool:%' THEN 90 WHEN key LIKE 'hook:%' THEN 999 ELSE 100 END AS BIGINT) AS rank, {b.r6('usd')} AS usd, round(tok, 4) AS tok
FROM (SELECT key, any_value(CASE WHEN k = 'llm_out_in' THEN 'LLM Out→In' WHEN k = 'cached' THEN 'Cached' ELSE lower(label) END) AS label, sum(usd) AS usd, sum(tok) AS tok FROM v_log_tool_segs WHERE k <> 'user' GROUP BY key)""")
def tool_label_totals(spark, sf):
    """One bar per category of the tools stack, without the users."""
    d = sg.label_totals(tool_stack(spark, sf), ["user"])
    return d.select("key", "label", "rank", p.gold(c("usd")).alias("usd"), F.round("tok", 4).alias("tok"))


# ---- bills of session trees -----------------------------------------------------------------
MEASURES = ["official_usd", "round_usd", "recap_usd"]


@query("session_tree_bills", "A13", f"""
WITH RECURSIVE own AS (
  SELECT s.session_id, coalesce(o, 0) AS official_usd, coalesce(r, 0) AS round_usd, coalesce(p, 0) AS recap_usd FROM v_sessions s
  LEFT JOIN (SELECT session_id, sum(official_usd) AS o FROM v_priced GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, sum(total_usd) AS r FROM v_log_bills GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, sum(cost_usd) AS p FROM v_recaps GROUP BY 1) USING (session_id)),
up AS (SELECT session_id, session_id - 1 - session_id % 3 // 2 AS parent_id FROM v_sessions WHERE session_id % 10 <> 0),
anc AS (SELECT session_id, parent_id AS ancestor_id, 1 AS depth FROM up UNION ALL SELECT a.session_id, u.parent_id, a.depth + 1 FROM anc a JOIN up u ON u.session_id = a.ancestor_id),
below AS (SELECT ancestor_id AS session_id, count(*) AS n, max(depth) AS levels, sum(official_usd) AS o, sum(round_usd) AS r, sum(recap_usd) AS p FROM anc JOIN own USING (session_id) GROUP BY 1)
SELECT w.session_id, coalesce(n, 0) AS descendants, coalesce(levels, 0) AS levels, {', '.join(b.r6(x) + ' AS ' + x for x in MEASURES)},
  {', '.join(f"{b.r6(f'coalesce({y}, 0)')} AS children_{x}, {b.r6(f'{x} + coalesce({y}, 0)')} AS combined_{x}" for x, y in zip(MEASURES, 'orp'))}
FROM own w LEFT JOIN below l USING (session_id)""")
def session_tree_bills(spark, sf):
    """Official, round and recap bills of every session, of all sessions below it, and together. Here a session hangs below one of the
    two before it, and every tenth starts a tree."""
    from sessionledger.operators import sessions as o
    from sessionledger.plans.pricing_queries import priced
    from sessionledger.session import materialize

    def per_session(d, usd, name):
        return d.groupBy("session_id").agg(F.sum(usd).alias(name))

    own = b.v_sessions(spark, sf).select("session_id")
    for d in (per_session(priced(spark, sf), "official_usd", MEASURES[0]), per_session(billed(spark, sf)[2], "total_usd", MEASURES[1]), per_session(eq.recaps(spark, sf), "cost_usd", MEASURES[2])):
        own = own.join(d, "session_id", "left")
    own = materialize(own.fillna(0.0, MEASURES))
    up = own.filter(c("session_id") % 10 != 0).select("session_id", (c("session_id") - 1 - F.floor(c("session_id") % 3 / 2)).cast("long").alias("parent_id"))
    d = o.tree_bills(up, own, MEASURES)
    return d.select("session_id", "descendants", "levels", *[p.gold(c(f"{k}{m}")).alias(f"{k}{m}") for m in MEASURES for k in ("", "children_", "combined_")])
