"""Rounds, calls, tools, phases and context over the bound log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.operators import sessionize as s
from sessionledger.operators.grouping import Run
from sessionledger.plans import binding as b
from sessionledger.plans.registry import query

c = F.col
PREV = "ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
CALLS = "('agent_thought_chunk','agent_message_chunk','tool_call','tool_call_update')"
STREAM = "('agent_thought_chunk','agent_message_chunk')"
ACT = "('user_message_chunk','agent_thought_chunk','agent_message_chunk','tool_call','tool_call_update','turn_completed')"

b.VIEWS["v_lines"] = f"""
  SELECT *, kind IN {CALLS} AS in_call, 1 + count(*) FILTER (kind = 'turn_completed') OVER (PARTITION BY session_id {PREV}) AS round_no
  FROM v_updates"""
b.VIEWS["v_opens"] = f"""
  SELECT *, CASE WHEN in_call AND (calls_before = 0 OR (stream_ms IS NOT NULL AND stream_ms IS DISTINCT FROM last_stream))
      THEN 1 ELSE 0 END AS opens_call
  FROM (SELECT *, count(*) FILTER (in_call) OVER (PARTITION BY session_id, round_no {PREV}) AS calls_before,
      last_value(CASE WHEN in_call THEN stream_ms END IGNORE NULLS) OVER (PARTITION BY session_id, round_no {PREV}) AS last_stream
    FROM v_lines)"""
b.VIEWS["v_call_lines"] = f"""
  SELECT *, CAST(sum(opens_call) OVER (PARTITION BY session_id, round_no {UPTO}) AS BIGINT) AS call_no FROM v_opens"""
b.VIEWS["v_moves"] = f"""
  SELECT *, last_value(moved IGNORE NULLS) OVER (PARTITION BY session_id, round_no {PREV}) AS round_ctx
  FROM (SELECT *, CASE WHEN kind = 'auto_compact_completed' AND acts_before = 0 THEN 1 ELSE 0 END AS cut,
      CASE WHEN in_call THEN context_tokens WHEN kind = 'auto_compact_completed' AND acts_before > 0 THEN tokens_after END AS moved
    FROM (SELECT *, count(*) FILTER (kind IN {ACT}) OVER (PARTITION BY session_id, round_no {PREV}) AS acts_before FROM v_call_lines))"""
b.VIEWS["v_base"] = f"""
  SELECT session_id, round_no, first_line, baseline FROM (
    SELECT session_id, round_no, line_no AS first_line, known AS baseline,
      row_number() OVER (PARTITION BY session_id, round_no ORDER BY line_no) AS rn
    FROM (SELECT *, max(CASE WHEN cut = 1 THEN tokens_after WHEN in_call THEN context_tokens WHEN kind = 'turn_completed' THEN round_ctx END)
          OVER (PARTITION BY session_id, seg {PREV}) AS known
      FROM (SELECT *, sum(cut) OVER (PARTITION BY session_id {UPTO}) AS seg FROM v_moves))
    WHERE kind IN {ACT}) WHERE rn = 1"""
b.VIEWS["v_cursor"] = f"""
  SELECT *, CASE WHEN declares = 1 THEN coalesce(greatest(context_tokens - cursor, 0), 0) ELSE 0 END AS emit_delta,
    CASE WHEN is_tool AND declares = 0 THEN coalesce(greatest(context_tokens - cursor, 0), 0) ELSE 0 END AS tool_delta,
    CASE WHEN kind IN {STREAM} OR is_phase OR context_tokens > cursor OR opens_call = 1 THEN context_tokens END AS moved_to
  FROM (SELECT *, CASE WHEN phases_before > 0
        THEN max(context_tokens) OVER (PARTITION BY session_id, round_no, call_no, phases_before > 0 OR is_phase {PREV})
        ELSE CASE WHEN call_start IS NULL THEN max_before WHEN max_before IS NULL THEN call_start
          ELSE greatest(call_start, max_before) END END AS cursor
    FROM (SELECT *, phase AND phases_before = 0 AS is_phase
      FROM (SELECT *, count(*) FILTER (phase) OVER (PARTITION BY session_id, round_no, call_no {PREV}) AS phases_before,
          CAST(sum(declares) OVER (PARTITION BY session_id, round_no, call_no {UPTO}) AS BIGINT) AS tool_no
        FROM (SELECT *, declares = 1 AND context_tokens IS NOT NULL AS phase
          FROM (SELECT *, CASE WHEN kind = 'tool_call' OR (is_tool AND tools_before = 0) THEN 1 ELSE 0 END AS declares,
              last_value(st IGNORE NULLS) OVER (PARTITION BY session_id, round_no, call_no {UPTO}) AS call_start
            FROM (SELECT *, kind IN ('tool_call','tool_call_update') AS is_tool,
                count(*) FILTER (kind IN ('tool_call','tool_call_update')) OVER (PARTITION BY session_id, round_no, call_no {PREV}) AS tools_before,
                max(context_tokens) OVER (PARTITION BY session_id, round_no, call_no {PREV}) AS max_before,
                CASE WHEN opens_call = 1 THEN coalesce(context_tokens, round_ctx, baseline) END AS st
              FROM v_moves JOIN v_base USING (session_id, round_no) WHERE in_call))))))"""


@query("round_numbers", "W3", "SELECT session_id, line_no, round_no FROM v_lines")
def round_numbers(spark, sf):
    return s.by_session(b.v_updates(spark, sf), s.assign_rounds).select("session_id", "line_no", "round_no")


@query("call_numbers", "W4", "SELECT session_id, line_no, round_no, call_no, opens_call FROM v_call_lines WHERE in_call")
def call_numbers(spark, sf):
    d = s.by_session(b.v_updates(spark, sf), lambda x, g: s.assign_calls(s.assign_rounds(x, g), g))
    return d.filter(c("kind").isin(s.CALL_KINDS)).select("session_id", "line_no", "round_no", "call_no",
                                                         c("opens_call").cast("int").alias("opens_call"))


@query("context_jumps", "W1", f"""
SELECT session_id, line_no, kind, prev_ctx, context_tokens - prev_ctx AS ctx_delta FROM (SELECT *,
  last_value(context_tokens IGNORE NULLS) OVER (PARTITION BY session_id {PREV}) AS prev_ctx FROM v_updates)
WHERE context_tokens <> prev_ctx""")
def context_jumps(spark, sf):
    d = s.by_session(b.v_updates(spark, sf), s.context_deltas)
    return d.filter(c("ctx_delta") != 0).select("session_id", "line_no", "kind", "prev_ctx", "ctx_delta")


@query("context_series", "W11 T2", f"""
SELECT session_id, line_no, agent_ms, context_tokens, rn AS age FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rn
  FROM (SELECT *, lag(context_tokens) OVER (PARTITION BY session_id ORDER BY line_no) AS prev FROM v_updates WHERE context_tokens IS NOT NULL)
  WHERE prev IS NULL OR prev <> context_tokens)""")
def context_series(spark, sf):
    d = s.by_session(b.v_updates(spark, sf), s.context_series)
    return d.select("session_id", "line_no", "agent_ms", "context_tokens", "age")


@query("stream_phases", "W2 A2", f"""
WITH x AS (SELECT *, lag(kind) OVER w AS pk, lag(prompt_id) OVER w AS pp FROM v_updates WINDOW w AS (PARTITION BY session_id ORDER BY line_no)),
y AS (SELECT *, sum(CASE WHEN kind IN {STREAM} AND (pk IS NULL OR pk <> kind OR pp IS DISTINCT FROM prompt_id) THEN 1 ELSE 0 END)
  OVER (PARTITION BY session_id {UPTO}) AS phase_no FROM x),
z AS (SELECT session_id, CAST(phase_no AS BIGINT) AS phase_no, first(kind) AS kind, first(prompt_id) AS prompt_id, count(*) AS chunks,
    CAST(sum(chars) AS BIGINT) AS chars, arg_min(agent_ms, line_no) AS first_ms, arg_max(agent_ms, line_no) AS last_ms,
    arg_min(stream_ms, line_no) FILTER (stream_ms IS NOT NULL) AS stream_ms, arg_min(context_tokens, line_no) FILTER (context_tokens IS NOT NULL) AS ctx_first,
    arg_max(context_tokens, line_no) FILTER (context_tokens IS NOT NULL) AS ctx_last, min(k) AS chunk_min, max(k) AS chunk_max
  FROM y WHERE kind IN {STREAM} GROUP BY session_id, phase_no)
SELECT *, greatest(last_ms - first_ms, 0) AS span_ms, wall AS wall_ms, CASE WHEN wall > 0 THEN round(chars / (wall / 1000.0), 3) END AS chars_per_s,
  CASE WHEN wall > 0 THEN round(chunks / (wall / 1000.0), 3) END AS chunks_per_s, ctx_last - ctx_first AS ctx_delta
FROM (SELECT *, CASE WHEN stream_ms IS NOT NULL THEN greatest(last_ms - stream_ms, 0) ELSE greatest(last_ms - first_ms, 0) END AS wall FROM z)""".replace("SELECT *, greatest(last_ms - first_ms, 0) AS span_ms, wall AS wall_ms", "SELECT * EXCLUDE (wall), greatest(last_ms - first_ms, 0) AS span_ms, wall AS wall_ms"))
def stream_phases(spark, sf):
    lines = b.v_updates(spark, sf).withColumn("chunk_id", c("k"))
    return s.phase_rollup(s.by_session(lines, s.stream_phases))


@query("event_counts", "A1 F1", """
SELECT session_id, kind, count(*) AS n FROM v_updates WHERE kind IN ('agent_thought_chunk','agent_message_chunk','user_message_chunk')
GROUP BY session_id, kind ORDER BY session_id, n DESC, kind""")
def event_counts(spark, sf):
    return s.counts_by_kind(s.keep_kinds(b.v_updates(spark, sf), [*s.STREAM_KINDS, "user_message_chunk"]))


@query("cache_baselines", "W8", "SELECT session_id, round_no, baseline FROM v_base")
def cache_baselines(spark, sf):
    def body(x, g):
        return s.cache_baselines(s.assign_rounds(x, g), g)

    d = s.by_session(b.v_updates(spark, sf), body)
    return d.filter(c("kind").isin(s.ROUND_KINDS)).groupBy("session_id", "round_no").agg(F.max("baseline").alias("baseline"))


@query("context_cursor", "W6", """
SELECT session_id, line_no, round_no, call_no, call_start, cursor, CAST(emit_delta AS BIGINT) AS emit_delta,
  CAST(tool_delta AS BIGINT) AS tool_delta, moved_to FROM v_cursor""")
def context_cursor(spark, sf):
    def body(x, g):
        return s.context_cursor(s.cache_baselines(s.assign_calls(s.assign_rounds(x, g), g), g), g)

    return s.by_session(b.v_updates(spark, sf), body).select(
        "session_id", "line_no", "round_no", "call_no", "call_start", "cursor", "emit_delta", "tool_delta", "moved_to")


b.VIEWS["v_owned"] = f"""
  SELECT *, CASE WHEN declares = 1 THEN tool_no ELSE coalesce(last_value(CASE WHEN declares = 1 THEN tool_no END IGNORE NULLS)
      OVER (PARTITION BY session_id, round_no, call_no, tool_call_id {UPTO}), tool_no) END AS owner FROM v_cursor WHERE is_tool"""
b.VIEWS["v_tools"] = """
  SELECT session_id, round_no, call_no, owner AS tool_no, min(line_no) AS line_no, arg_min(tool_call_id, line_no) AS tool_call_id,
    CAST(sum(tool_delta) AS BIGINT) AS tool_delta, count(*) FILTER (declares = 0) AS updates
  FROM v_owned GROUP BY ALL"""


@query("tool_results", "J1 A8", "SELECT * FROM v_tools")
def tool_results(spark, sf):
    return s.tool_rollup(s.by_session(b.v_updates(spark, sf), s.sessionized))


@query("tool_chain", "W17", """
SELECT session_id, round_no, call_no, tool_no, phase_start + coalesce(sum(tool_delta) OVER (PARTITION BY session_id, round_no, call_no
    ORDER BY tool_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ctx_before,
  phase_start + sum(tool_delta) OVER (PARTITION BY session_id, round_no, call_no ORDER BY tool_no) AS ctx_after
FROM v_tools JOIN (SELECT session_id, round_no, call_no, max(call_start) AS phase_start FROM v_cursor GROUP BY ALL) USING (session_id, round_no, call_no)"""
       .replace("phase_start + coalesce(sum", "phase_start + CAST(coalesce(sum").replace("1 PRECEDING), 0) AS ctx_before", "1 PRECEDING), 0) AS BIGINT) AS ctx_before")
       .replace("phase_start + sum(tool_delta) OVER (PARTITION BY session_id, round_no, call_no ORDER BY tool_no) AS", "phase_start + CAST(sum(tool_delta) OVER (PARTITION BY session_id, round_no, call_no ORDER BY tool_no) AS BIGINT) AS"))
def tool_chain(spark, sf):
    rows = s.by_session(b.v_updates(spark, sf), s.sessionized)
    starts = rows.groupBy("session_id", "round_no", "call_no").agg(F.max("call_start").alias("phase_start"))
    out = s.skew_safe(s.tool_rollup(rows), ["session_id"], "tool_no", lambda t, g: s.serial_chain(t, starts, g))
    return out.select("session_id", "round_no", "call_no", "tool_no", "ctx_before", "ctx_after")


b.VIEWS["v_call_sum"] = """
  SELECT session_id, round_no, call_no, line_no, stream_ms, context_start, own_end, emit_delta, tool_delta, tools, thought_chunks, thought_chars,
    message_chunks, message_chars, baseline, next_ctx, late AS late_delta, coalesce(own_end + late, next_ctx) AS context_end,
    greatest(context_start, max_ctx, coalesce(own_end + late, next_ctx)) AS context_peak
  FROM (SELECT *, coalesce(greatest(next_ctx - own_end, 0), 0) AS late FROM (SELECT *,
      lead(first_ctx) OVER (PARTITION BY session_id, round_no ORDER BY call_no) AS next_ctx FROM (
    SELECT session_id, round_no, call_no, min(line_no) AS line_no, arg_min_null(context_tokens, line_no) AS first_ctx,
      arg_min_null(stream_ms, line_no) AS stream_ms, max(call_start) AS context_start,
      coalesce(arg_max(moved_to, line_no) FILTER (moved_to IS NOT NULL), max(call_start)) AS own_end, max(context_tokens) AS max_ctx,
      CAST(sum(emit_delta) AS BIGINT) AS emit_delta, CAST(sum(tool_delta) AS BIGINT) AS tool_delta, max(tool_no) AS tools,
      count(*) FILTER (kind = 'agent_thought_chunk') AS thought_chunks, CAST(coalesce(sum(chars) FILTER (kind = 'agent_thought_chunk'), 0) AS BIGINT) AS thought_chars,
      count(*) FILTER (kind = 'agent_message_chunk') AS message_chunks, CAST(coalesce(sum(chars) FILTER (kind = 'agent_message_chunk'), 0) AS BIGINT) AS message_chars,
      max(baseline) AS baseline
    FROM v_cursor GROUP BY session_id, round_no, call_no)))"""


def calls(spark, sf):
    return s.by_session(b.v_updates(spark, sf), lambda x, g: s.call_rollup(s.sessionized(x, g), g.reorder("line_no")))


@query("call_rollup", "A11 W5", "SELECT * FROM v_call_sum")
def call_rollup(spark, sf):
    return calls(spark, sf)


@query("live_calls", "F5", """
SELECT session_id, round_no, call_no, row_number() OVER (PARTITION BY session_id, round_no ORDER BY call_no) AS call_index FROM v_call_sum
WHERE thought_chunks > 0 OR message_chunks > 0 OR tools > 0 OR context_end > context_start OR emit_delta > 0""")
def live_calls(spark, sf):
    def body(x, g):
        return s.drop_empty_calls(s.call_rollup(s.sessionized(x, g), g), g)

    return s.by_session(b.v_updates(spark, sf), body).select("session_id", "round_no", "call_no", "call_index")


@query("named_tools", "F6", """
SELECT session_id, round_no, call_no, tool_no FROM v_tools WHERE NOT (tool_no % 2 = 0 AND tool_delta = 0 AND updates <= 1)""")
def named_tools(spark, sf):
    t = s.tool_rollup(s.by_session(b.v_updates(spark, sf), s.sessionized)).withColumns({
        "name": F.when(c("tool_no") % 2 == 1, "grep"), "title": F.when(c("updates") > 1, "x"), "result_chars": F.lit(0)})
    return s.drop_anonymous_tools(t).select("session_id", "round_no", "call_no", "tool_no")


b.VIEWS["v_round_sum"] = f"""
  SELECT *, coalesce(baseline, f) AS context_start, greatest(coalesce(baseline, f), mx) AS context_peak,
    coalesce(l, coalesce(baseline, f)) - coalesce(baseline, f) AS context_delta,
    CASE WHEN completed_ms IS NOT NULL THEN greatest(coalesce(baseline, f), mx, l) ELSE coalesce(l, baseline, f) END AS context_end, completed_ms IS NOT NULL AS completed,
    greatest(started_ms - lag(completed_ms) OVER (PARTITION BY session_id ORDER BY round_no), 0) AS idle_gap_ms
  FROM (SELECT session_id, round_no, min(line_no) AS line_no, arg_min(agent_ms, line_no) AS started_ms,
      max(agent_ms) FILTER (kind = 'turn_completed') AS completed_ms, max(baseline) AS baseline,
      arg_min(context_tokens, line_no) FILTER (in_call AND context_tokens IS NOT NULL) AS f,
      arg_max(moved, line_no) FILTER (moved IS NOT NULL) AS l, max(context_tokens) FILTER (in_call) AS mx,
      CAST(coalesce(sum(chars) FILTER (kind = 'user_message_chunk'), 0) AS BIGINT) AS user_chars,
      count(*) FILTER (kind IN {STREAM}) AS chunks, count(*) FILTER (kind = 'tool_call') AS tool_calls,
      CAST(sum(opens_call) AS BIGINT) AS call_count
    FROM v_moves JOIN v_base USING (session_id, round_no) WHERE kind IN {ACT} OR (kind = 'auto_compact_completed' AND moved IS NOT NULL) GROUP BY session_id, round_no)"""


def rounds(spark, sf):
    def body(x, g):
        d = s.round_rollup(s.cache_baselines(s.assign_calls(s.assign_rounds(x, g), g), g))
        return s.idle_gaps(d, g.reorder("round_no"))

    return s.by_session(b.v_updates(spark, sf), body)


@query("round_rollup", "A10 W7", """
SELECT * EXCLUDE (f, l, mx) FROM v_round_sum""")
def round_rollup(spark, sf):
    return rounds(spark, sf)


@query("retained_rounds", "T2", """
SELECT session_id, round_no, row_number() OVER (PARTITION BY session_id ORDER BY round_no DESC) AS age FROM v_round_sum""")
def retained_rounds(spark, sf):
    def body(x, g):
        return s.aged(s.round_rollup(s.cache_baselines(s.assign_calls(s.assign_rounds(x, g), g), g)), g.reorder("round_no"))

    return s.by_session(b.v_updates(spark, sf), body).select("session_id", "round_no", "age")


@query("char_rates", "W15", f"""
WITH x AS (SELECT *, CASE WHEN pk IS NULL OR pk <> kind OR (stream_ms IS NOT NULL AND stream_ms IS DISTINCT FROM ps) THEN 1 ELSE 0 END AS o
  FROM (SELECT *, lag(kind) OVER (PARTITION BY session_id ORDER BY line_no) AS pk, last_value(stream_ms IGNORE NULLS) OVER (PARTITION BY session_id {PREV}) AS ps
    FROM v_updates WHERE kind IN {STREAM})),
y AS (SELECT *, CAST(sum(o) OVER (PARTITION BY session_id {UPTO}) AS BIGINT) AS stream_no,
  last_value(CASE WHEN o = 1 THEN coalesce(stream_ms, agent_ms) END IGNORE NULLS) OVER (PARTITION BY session_id {UPTO}) AS started_ms FROM x)
SELECT session_id, line_no, stream_no, started_ms, round(sum(chars) OVER (PARTITION BY session_id, stream_no {UPTO}) / (greatest(agent_ms - started_ms, 1) / 1000.0), 1) AS chars_per_s
FROM y""")
def char_rates(spark, sf):
    return s.by_session(b.v_updates(spark, sf), s.char_rates).select("session_id", "line_no", "stream_no", "started_ms", "chars_per_s")


@query("turn_peaks", "W18", f"""
SELECT session_id, line_no, max(CASE WHEN kind <> 'user_message_chunk' THEN context_tokens END) OVER (PARTITION BY session_id, seg {UPTO}) AS turn_peak
FROM (SELECT *, count(*) FILTER (kind = 'user_message_chunk') OVER (PARTITION BY session_id {UPTO}) AS seg FROM v_updates)""")
def turn_peaks(spark, sf):
    return s.by_session(b.v_updates(spark, sf), s.turn_peaks).select("session_id", "line_no", "turn_peak")


@query("hook_slots", "P29 A18", """
WITH h AS (SELECT session_id, line_no, CASE k // 25 WHEN 0 THEN 'user_prompt_submit' WHEN 1 THEN 'Stop' WHEN 2 THEN 'pre_tool' ELSE 'before_stop' END AS ev,
  chars AS elapsed_ms, greatest(1, k // 4) AS tokens_est FROM v_updates WHERE kind = 'hook_execution')
SELECT session_id, CASE WHEN lower(ev) LIKE 'user_prompt%' THEN 'user' WHEN lower(ev) IN ('stop','session_stop','agent_stop','session_end') OR lower(ev) LIKE '%\\_stop' ESCAPE '\\'
    THEN 'to_user' ELSE 'stream' END AS slot, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, CAST(sum(tokens_est) AS BIGINT) AS hook_tokens,
  CAST(coalesce(sum(tokens_est) FILTER (lower(ev) NOT IN ('stop','session_stop','agent_stop')), 0) AS BIGINT) AS to_llm_tokens,
  CAST(coalesce(sum(tokens_est) FILTER (lower(ev) IN ('stop','session_stop','agent_stop')), 0) AS BIGINT) AS to_user_tokens
FROM h GROUP BY ALL""")
def hook_slots(spark, sf):
    q = F.floor(c("k") / 25)
    ev = F.when(q == 0, "user_prompt_submit").when(q == 1, "Stop").when(q == 2, "pre_tool").otherwise("before_stop")
    h = b.v_updates(spark, sf).filter(c("kind") == s.HOOK).select(
        "session_id", ev.alias("event_name"), c("chars").alias("elapsed_ms"),
        F.greatest(F.lit(1), F.floor(c("k") / 4)).alias("tokens_est")).withColumn("slot", s.hook_slot(c("event_name")))
    return s.hook_totals(h, ["session_id", "slot"])


@query("turn_usage_totals", "A3", """
SELECT session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning,
  CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(total) AS BIGINT) AS total, CAST(sum(ticks) AS BIGINT) AS ticks,
  CAST(sum(api_ms) AS BIGINT) AS api_ms, CAST(sum(calls) AS BIGINT) AS calls FROM v_turns GROUP BY session_id""")
def turn_usage_totals(spark, sf):
    from sessionledger.functions.pricing import official_usage_sums

    return b.v_turns(spark, sf).groupBy("session_id").agg(*official_usage_sums())


@query("turns_with_round_peak", "J4", f"""
WITH r AS (SELECT session_id, prompt_id, max_by_round AS context_peak FROM (
    SELECT t.session_id, t.prompt_id, arg_max(r.context_peak, r.round_no) AS max_by_round
    FROM v_lines t JOIN v_round_sum r USING (session_id, round_no) WHERE t.kind = 'turn_completed' GROUP BY ALL))
SELECT line_no, context_peak, CASE WHEN context_peak > 0 THEN context_peak WHEN calls > 1 AND input > 0 THEN greatest(1, input // calls) ELSE input END AS tier_ctx,
  CASE WHEN context_peak > 0 THEN 'peak_meta_total_tokens' WHEN calls > 1 AND input > 0 THEN 'input_div_model_calls' ELSE 'input_tokens' END AS method
FROM v_turns LEFT JOIN r USING (session_id, prompt_id)""")
def turns_with_round_peak(spark, sf):
    """Turns meet the newest completed round with their prompt id and are re-tiered by its peak."""
    from sessionledger.functions import pricing as p

    lines = b.v_updates(spark, sf)

    def body(x, g):
        d = s.cache_baselines(s.assign_calls(s.assign_rounds(x, g), g), g)
        return s.round_rollup(d.withColumn("baseline", c("baseline"))).join(
            d.filter(c("kind") == s.TURN).select("session_id", "round_no", "prompt_id"), ["session_id", "round_no"])

    r = s.by_session(lines, body).groupBy("session_id", "prompt_id").agg(
        F.max_by("context_peak", F.when(c("context_peak").isNotNull(), c("round_no"))).alias("context_peak"))
    t = b.v_turns(spark, sf).join(r, ["session_id", "prompt_id"], "left")
    return t.select("line_no", "context_peak",
                    p.tier_context(c("context_peak"), c("input"), c("calls")).alias("tier_ctx"),
                    p.tier_method(c("context_peak"), c("input"), c("calls")).alias("method"))
