"""Log lines to rounds, model calls, tools and stream phases.

Input: one row per log line with ``session_id, line_no, kind, context_tokens, stream_ms,
agent_ms`` and whatever else is carried along. ``line_no`` is unique inside a session.
Every function takes the grouping engine so that a session of any size can be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.operators.grouping import Groups, Run, skew_safe

c = F.col

# Event kinds.
STREAM_KINDS = ["agent_thought_chunk", "agent_message_chunk"]
TOOL_KINDS = ["tool_call", "tool_call_update"]
CALL_KINDS = STREAM_KINDS + TOOL_KINDS
USER_KINDS = ["user_message_chunk", "user_message", "user_prompt_submit"]
TURN = "turn_completed"
COMPACT = "auto_compact_completed"
RECAP = "session_recap"
HOOK = "hook_execution"
ROUND_KINDS = ["user_message_chunk", *CALL_KINDS, TURN]


def by_session(lines: DataFrame, body, **kw) -> DataFrame:
    """Run ``body(lines, groups)`` per session in line order, splitting hot sessions."""
    return skew_safe(lines, ["session_id"], "line_no", body, **kw)


def keep_kinds(lines: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Selected kinds only; lines that did not parse are always kept."""
    return lines if not kinds else lines.filter(c("kind").isin(*kinds, "parse_error"))


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def context_deltas(lines: DataFrame, g: Groups) -> DataFrame:
    """Change of the context size since the previous line that carries one."""
    d = g.running(lines, {"prev_ctx": Run("last", c("context_tokens"))})
    return d.withColumn("ctx_delta", c("context_tokens") - c("prev_ctx"))


def context_series(lines: DataFrame, g: Groups) -> DataFrame:
    """Context samples without consecutive duplicates, with their ``age`` in the session (1: the newest)."""
    d = context_deltas(lines.filter(c("context_tokens").isNotNull()), g)
    d = d.filter(c("prev_ctx").isNull() | (c("ctx_delta") != 0))
    return g.running(d, {"age": Run("count", F.lit(1), "from")})


def stream_phases(lines: DataFrame, g: Groups) -> DataFrame:
    """Number runs of thought or message chunks of one prompt; any other kind ends a run."""
    d = g.running(lines, {
        "prev_kind": Run("adjacent", c("kind")), "prev_prompt": Run("adjacent", c("prompt_id")),
    })
    streaming = c("kind").isin(STREAM_KINDS)
    opens = streaming & (
        c("prev_kind").isNull() | (c("prev_kind") != c("kind")) | ~c("prev_prompt").eqNullSafe(c("prompt_id")))
    d = g.running(d.withColumn("__open", flag(opens)), {"phase_no": Run("sum", c("__open"), "upto")})
    return d.filter(streaming).drop("prev_kind", "prev_prompt", "__open")


def phase_rollup(phases: DataFrame) -> DataFrame:
    """Chunks, sizes, durations and rates of each stream phase."""
    def first(x: str) -> Column:
        return F.min_by(x, F.when(c(x).isNotNull(), c("line_no")))

    def last(x: str) -> Column:
        return F.max_by(x, F.when(c(x).isNotNull(), c("line_no")))

    a = phases.groupBy("session_id", "phase_no").agg(
        F.first("kind").alias("kind"), F.first("prompt_id").alias("prompt_id"), F.count(F.lit(1)).alias("chunks"),
        F.sum("chars").alias("chars"), first("agent_ms").alias("first_ms"), last("agent_ms").alias("last_ms"),
        first("stream_ms").alias("stream_ms"), first("context_tokens").alias("ctx_first"),
        last("context_tokens").alias("ctx_last"), F.min("chunk_id").alias("chunk_min"), F.max("chunk_id").alias("chunk_max"),
    )
    span = F.greatest(c("last_ms") - c("first_ms"), F.lit(0))
    a = a.withColumn("span_ms", span).withColumn(
        "wall_ms", F.when(c("stream_ms").isNotNull(), F.greatest(c("last_ms") - c("stream_ms"), F.lit(0))).otherwise(c("span_ms")))
    rate = lambda x: F.when(c("wall_ms") > 0, F.round(c(x) / (c("wall_ms") / 1000.0), 3))
    return a.withColumns({
        "chars_per_s": rate("chars"), "chunks_per_s": rate("chunks"), "ctx_delta": c("ctx_last") - c("ctx_first"),
    })


def assign_rounds(lines: DataFrame, g: Groups) -> DataFrame:
    """``round_no``: a round ends with its turn; the next activity opens another."""
    return g.running(lines, {"__turns": Run("count", F.when(c("kind") == TURN, 1))}).withColumn(
        "round_no", c("__turns") + 1).drop("__turns")


def assign_calls(lines: DataFrame, g: Groups) -> DataFrame:
    """``call_no`` inside a round: a new call starts when another stream start shows up.

    Lines without a stream start stay with the call before them.
    """
    gr = g.sub("round_no")
    in_call = c("kind").isin(CALL_KINDS)
    d = gr.running(lines, {
        "__stream": Run("last", F.when(in_call, c("stream_ms"))), "__calls": Run("count", F.when(in_call, 1)),
    })
    other = c("stream_ms").isNotNull() & ~c("stream_ms").eqNullSafe(c("__stream"))
    d = d.withColumn("opens_call", flag(in_call & ((c("__calls") == 0) | other)))
    d = gr.running(d, {"call_no": Run("sum", c("opens_call"), "upto")})
    return d.drop("__stream", "__calls")


def cache_baselines(lines: DataFrame, g: Groups) -> DataFrame:
    """``baseline``: the context a round inherits, on every line of the round.

    It only grows from round to round, until a compaction between two rounds resets it to the size the compaction left behind.
    A compaction inside an open round moves the round's context (``moved``: where a line leaves it, ``round_ctx``: where it
    stood before the line); the turn that closes the round takes the larger of its peak and where it stood at last.
    """
    gr = g.sub("round_no")
    d = gr.running(lines, {"__before": Run("count", F.when(c("kind").isin(ROUND_KINDS), 1))})
    between = (c("kind") == COMPACT) & (c("__before") == 0)
    moved = F.when(c("kind").isin(CALL_KINDS), c("context_tokens")).when((c("kind") == COMPACT) & ~between, c("tokens_after"))
    d = gr.running(d.withColumns({"__cut": between, "moved": moved}), {"round_ctx": Run("last", c("moved"))})
    size = F.when(c("__cut"), c("tokens_after")).when(c("kind").isin(CALL_KINDS), c("context_tokens")).when(c("kind") == TURN, c("round_ctx"))
    d = g.running(d.withColumn("__size", size), {"__known": Run("max", c("__size"), reset=c("__cut"))})
    opening = c("kind").isin(ROUND_KINDS) & (c("__before") == 0)
    d = gr.running(d.withColumn("__base", F.when(opening, F.struct("__known"))), {
        "__held": Run("last", c("__base"), "upto")})
    return d.withColumn("baseline", c("__held")["__known"]).drop("__before", "__cut", "__size", "__known", "__base", "__held")


def context_cursor(lines: DataFrame, g: Groups) -> DataFrame:
    """Serial context cursor of a call: who moved the context forward, and by how much.

    The first tool declared with a context size closes the model's own part: growth up to it
    is the model's emission and the cursor restarts there. Afterwards growth on a tool result
    belongs to that tool, growth on a further declaration to the model.
    """
    gc = g.sub("round_no", "call_no")
    d = lines.filter(c("kind").isin(CALL_KINDS))
    d = d.withColumn("__start", F.when(c("opens_call") == 1, F.coalesce("context_tokens", "round_ctx", "baseline")))
    is_tool = c("kind").isin(TOOL_KINDS)
    d = gc.running(d, {
        "call_start": Run("last", c("__start"), "upto"), "__tools": Run("count", F.when(is_tool, 1)),
        "__max": Run("max", c("context_tokens")),
    })
    d = d.withColumn("declares", flag((c("kind") == "tool_call") | (is_tool & (c("__tools") == 0))))
    d = d.withColumn("__phase", flag((c("declares") == 1) & c("context_tokens").isNotNull()))
    d = gc.running(d, {"__phases": Run("max", c("__phase")), "tool_no": Run("sum", c("declares"), "upto")})
    d = d.withColumn("__after", F.coalesce(c("__phases"), F.lit(0)))
    d = d.withColumn("is_phase", flag((c("__phase") == 1) & (c("__after") == 0)))
    d = d.withColumn("__part", F.greatest("__after", "is_phase"))
    d = g.sub("round_no", "call_no", "__part").running(d, {"__part_max": Run("max", c("context_tokens"))})
    cursor = F.when(c("__after") == 1, c("__part_max")).otherwise(F.greatest("call_start", "__max"))
    grow = F.greatest(c("context_tokens") - c("cursor"), F.lit(0))
    d = d.withColumn("cursor", cursor).withColumns({
        "emit_delta": F.when(c("declares") == 1, F.coalesce(grow, F.lit(0))).otherwise(0).cast("long"),
        "tool_delta": F.when(is_tool & (c("declares") == 0), F.coalesce(grow, F.lit(0))).otherwise(0).cast("long"),
    })
    moves = c("kind").isin(STREAM_KINDS) | (c("is_phase") == 1) | (c("context_tokens") > c("cursor")) | (c("opens_call") == 1)
    d = d.withColumn("moved_to", F.when(moves, c("context_tokens")))
    return d.drop("round_ctx", "moved", "__start", "__tools", "__max", "__phase", "__phases", "__after", "__part", "__part_max")


def owning_tool(d: DataFrame, g: Groups) -> DataFrame:
    """``owner_no``: the tool a result belongs to — same id in this call, else the last declared."""
    by_id = d.withColumn("__id", F.coalesce("tool_call_id", F.lit("")))
    by_id = g.sub("round_no", "call_no", "__id").running(by_id, {
        "__same": Run("last", F.when((c("declares") == 1) & c("tool_call_id").isNotNull(), c("tool_no")), "upto")})
    own = F.when(c("declares") == 1, c("tool_no")).otherwise(F.coalesce("__same", "tool_no"))
    return by_id.withColumn("owner_no", F.when(c("kind").isin(TOOL_KINDS), own)).drop("__id", "__same")


def sessionized(lines: DataFrame, g: Groups) -> DataFrame:
    """Rounds, calls, baselines, cursor and tool ownership of every call line."""
    d = cache_baselines(assign_calls(assign_rounds(lines, g), g), g)
    return owning_tool(context_cursor(d, g), g)


def call_rollup(rows: DataFrame, g: Groups) -> DataFrame:
    """One row per model call. Input: :func:`sessionized` rows.

    Late context (seen only when the next call starts) is folded into the call before it.
    """
    def chars(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(c("kind") == kind, c("chars"))), F.lit(0)).cast("long")

    a = rows.groupBy("session_id", "round_no", "call_no").agg(
        F.min("line_no").alias("line_no"), F.min_by("context_tokens", "line_no").alias("first_ctx"),
        F.min_by("stream_ms", "line_no").alias("stream_ms"), F.max("call_start").alias("context_start"),
        F.max_by("moved_to", F.when(c("moved_to").isNotNull(), c("line_no"))).alias("own_end"),
        F.max("context_tokens").alias("max_ctx"), F.sum("emit_delta").alias("emit_delta"),
        F.sum("tool_delta").alias("tool_delta"), F.max("tool_no").alias("tools"),
        F.count(F.when(c("kind") == STREAM_KINDS[0], 1)).alias("thought_chunks"), chars(STREAM_KINDS[0]).alias("thought_chars"),
        F.count(F.when(c("kind") == STREAM_KINDS[1], 1)).alias("message_chunks"), chars(STREAM_KINDS[1]).alias("message_chars"),
        F.max("baseline").alias("baseline"),
    ).withColumn("own_end", F.coalesce("own_end", "context_start"))
    a = g.sub("round_no").running(a, {"next_ctx": Run("adjacent", c("first_ctx"), "after")})
    late = F.coalesce(F.greatest(c("next_ctx") - c("own_end"), F.lit(0)), F.lit(0)).cast("long")
    return a.withColumn("late_delta", late).withColumns({
        "context_end": F.coalesce(c("own_end") + c("late_delta"), c("next_ctx")),
    }).withColumn("context_peak", F.greatest("context_start", "max_ctx", "context_end")).drop("first_ctx", "max_ctx")


def tool_rollup(rows: DataFrame) -> DataFrame:
    """One row per declared tool with the context growth it caused."""
    return rows.filter(c("owner_no").isNotNull()).groupBy(
        "session_id", "round_no", "call_no", c("owner_no").alias("tool_no")).agg(
        F.min("line_no").alias("line_no"), F.min_by("tool_call_id", "line_no").alias("tool_call_id"),
        F.sum("tool_delta").alias("tool_delta"), F.count(F.when(c("declares") == 0, 1)).alias("updates"),
    )


def serial_chain(tools: DataFrame, starts: DataFrame, g: Groups) -> DataFrame:
    """Before / after display positions of the tools of a call, one behind the other."""
    d = g.sub("round_no", "call_no").running(
        tools.join(starts, ["session_id", "round_no", "call_no"]), {"__sum": Run("sum", c("tool_delta"))})
    return d.withColumn("ctx_before", c("phase_start") + c("__sum")).withColumn(
        "ctx_after", c("ctx_before") + c("tool_delta")).drop("__sum")


def drop_empty_calls(calls: DataFrame, g: Groups) -> DataFrame:
    """Calls that did something, numbered again from 1."""
    live = (
        (c("thought_chunks") > 0) | (c("message_chunks") > 0) | (c("tools") > 0)
        | (c("context_end") > c("context_start")) | (c("emit_delta") > 0)
    )
    return g.sub("round_no").number(calls.filter(live), "call_index")


def drop_anonymous_tools(tools: DataFrame) -> DataFrame:
    """A tool without a name, a title, a result or any growth is noise."""
    noise = (
        (F.coalesce("name", F.lit("tool")) == "tool") & (F.coalesce("tool_delta", F.lit(0)) == 0)
        & (F.coalesce("title", F.lit("")) == "") & (F.coalesce("result_chars", F.lit(0)) == 0)
    )
    return tools.filter(~noise)


def round_rollup(lines: DataFrame) -> DataFrame:
    """One row per round. Input: lines of :func:`assign_calls` and :func:`cache_baselines`.

    ``context_end`` is where the round stands: the last size seen or left by a compaction inside it; a closed round's is
    never below its peak.
    """
    d = lines.filter(c("kind").isin(ROUND_KINDS) | ((c("kind") == COMPACT) & c("moved").isNotNull()))
    ctx = F.when(c("kind").isin(CALL_KINDS), c("context_tokens"))
    seen = F.when(ctx.isNotNull(), c("line_no"))
    a = d.groupBy("session_id", "round_no").agg(
        F.min("line_no").alias("line_no"), F.min_by("agent_ms", "line_no").alias("started_ms"),
        F.max(F.when(c("kind") == TURN, c("agent_ms"))).alias("completed_ms"), F.max("baseline").alias("baseline"),
        F.min_by(ctx, seen).alias("__first"), F.max_by("moved", F.when(c("moved").isNotNull(), c("line_no"))).alias("__last"), F.max(ctx).alias("__max"),
        F.coalesce(F.sum(F.when(c("kind") == "user_message_chunk", c("chars"))), F.lit(0)).cast("long").alias("user_chars"),
        F.count(F.when(c("kind").isin(STREAM_KINDS), 1)).alias("chunks"),
        F.count(F.when(c("kind") == "tool_call", 1)).alias("tool_calls"),
        F.coalesce(F.sum("opens_call"), F.lit(0)).cast("long").alias("call_count"),
    )
    start = F.coalesce("baseline", "__first")
    return a.withColumns({
        "completed": c("completed_ms").isNotNull(), "context_start": start,
        "context_peak": F.greatest(start, c("__max")), "context_delta": F.coalesce("__last", start) - start,
        "context_end": F.when(c("completed_ms").isNotNull(), F.greatest(start, "__max", "__last")).otherwise(F.coalesce("__last", start)),
    }).drop("__first", "__last", "__max")


def idle_gaps(rounds: DataFrame, g: Groups) -> DataFrame:
    """Milliseconds between the end of the previous round and the start of this one."""
    d = g.running(rounds, {"__prev_end": Run("adjacent", c("completed_ms"))})
    return d.withColumn("idle_gap_ms", F.greatest(c("started_ms") - c("__prev_end"), F.lit(0))).drop("__prev_end")


def char_rates(lines: DataFrame, g: Groups) -> DataFrame:
    """Characters per second of the stream each chunk belongs to, so far."""
    d = lines.filter(c("kind").isin(STREAM_KINDS))
    d = g.running(d, {"__kind": Run("adjacent", c("kind")), "__stream": Run("last", c("stream_ms"))})
    opens = c("__kind").isNull() | (c("__kind") != c("kind")) | (
        c("stream_ms").isNotNull() & ~c("stream_ms").eqNullSafe(c("__stream")))
    d = d.withColumns({"__open": flag(opens), "__at": F.when(opens, F.coalesce("stream_ms", "agent_ms"))})
    d = g.running(d, {"stream_no": Run("sum", c("__open"), "upto"), "started_ms": Run("last", c("__at"), "upto")})
    d = g.sub("stream_no").running(d, {"stream_chars": Run("sum", c("chars"), "upto")})
    sec = F.greatest(c("agent_ms") - c("started_ms"), F.lit(1)) / 1000.0
    return d.withColumn("chars_per_s", F.round(c("stream_chars") / sec, 1)).drop("__kind", "__stream", "__open", "__at")


def turn_peaks(lines: DataFrame, g: Groups) -> DataFrame:
    """Running peak of the context, reset by every user message."""
    user = c("kind") == "user_message_chunk"
    d = g.running(lines, {"turn_seg": Run("count", F.when(user, 1), "upto")})
    return g.sub("turn_seg").running(d, {"turn_peak": Run("max", F.when(~user, c("context_tokens")), "upto")})


def aged(rows: DataFrame, g: Groups) -> DataFrame:
    """Rows with their ``age`` in the group (1: the newest); who shows a few filters by it."""
    return g.running(rows, {"age": Run("count", F.lit(1), "from")})


def counts_by_kind(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "session_id", c("n").desc(), "kind")


def hook_slot(event_name: Column) -> Column:
    """Where a hook is shown: with the user prompt, after the answer, or in the stream."""
    ev = F.lower(F.trim(F.coalesce(event_name, F.lit("hook"))))
    return (
        F.when(ev.startswith("user_prompt"), "user")
        .when(ev.isin("stop", "session_stop", "agent_stop", "session_end") | ev.endswith("_stop"), "to_user")
        .otherwise("stream")
    )


def place_hooks(lines: DataFrame, g: Groups) -> DataFrame:
    """Hooks with the round and the call they belong to. Input: lines of :func:`assign_calls` with ``event_name, tokens_est``.

    A hook inside an open round goes to the call in progress (``place`` call), unless it stands with the user's prompt (user) or
    no call has begun (before_llm, and after for hooks that answer the user). A hook between two rounds waits for the next one;
    while there is none it is pending. Only hooks on a call that do not end it can reach the model: ``to_llm_tokens``.
    """
    act = F.when(c("kind").isin(ROUND_KINDS), 1)
    d = g.sub("round_no").running(lines, {"__before": Run("count", act), "__after": Run("count", act, "after")})
    d = d.filter(c("kind") == HOOK).withColumn("slot", hook_slot(c("event_name")))
    in_call = (c("__before") > 0) & (c("call_no") > 0) & (c("slot") != "user")
    known = (c("__before") > 0) | (c("__after") > 0)
    place = F.when(~known, "pending").when(c("slot") == "user", "user").when(in_call, "call").when(c("slot") == "to_user", "after").otherwise("before_llm")
    ends = F.lower(F.coalesce("event_name", F.lit("hook"))).isin("stop", "session_stop", "agent_stop")
    return d.withColumns({
        "place": place, "round_no": F.when(known, c("round_no")), "call_no": F.when(in_call, c("call_no")),
        "to_llm_tokens": F.when(in_call & ~ends, c("tokens_est")).otherwise(0).cast("long")}).drop("__before", "__after")


def hook_totals(hooks: DataFrame, keys: list[str]) -> DataFrame:
    """Elapsed time and token size of hooks, and the share that can reach the model."""
    ev = F.lower(F.coalesce("event_name", F.lit("hook")))
    to_user = ev.isin("stop", "session_stop", "agent_stop")
    return hooks.groupBy(*keys).agg(
        F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("tokens_est").alias("hook_tokens"),
        F.coalesce(F.sum(F.when(~to_user, c("tokens_est"))), F.lit(0)).cast("long").alias("to_llm_tokens"),
        F.coalesce(F.sum(F.when(to_user, c("tokens_est"))), F.lit(0)).cast("long").alias("to_user_tokens"),
    )
