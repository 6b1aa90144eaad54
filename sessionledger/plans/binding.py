"""Views that give the provided tables the shape of session logs.

Every view exists twice: as a DataFrame here and as a DuckDB common table expression in
``VIEWS``; both must read the same.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionledger.functions.logline import compute_once
from sessionledger.operators.grouping import by_rows

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ms(col):
    return F.unix_millis(col.cast("timestamp"))


def v_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per row of ``events``; a session is a user."""
    return updates_of(table(spark, sf_dir, "events"))


def updates_of(events: DataFrame) -> DataFrame:
    """Log lines of an ``events`` frame, batch or streaming."""
    k = F.regexp_extract(c("props"), "([0-9]+)", 1).cast("long")
    e = events.select(
        c("user_id").alias("session_id"), c("event_id").alias("line_no"), "event_type", "value", "props",
        ms(c("ts")).alias("agent_ms"), ms(F.date_trunc("hour", c("ts"))).alias("hour_ms"),
    )
    e = compute_once(e, "k", k).drop("props")
    turn = c("event_type") == "purchase"
    tool = c("event_type").isin("click", "error")
    signup = c("event_type") == "signup"
    kind = (
        F.when(signup & (c("k") % 25 == 0), "auto_compact_completed")
        .when(signup & (c("k") % 25 == 1), "session_recap")
        .when(signup & (c("k") % 25 == 2), "hook_execution")
        .when(signup, "user_message_chunk")
        .when((c("event_type") == "view") & (c("k") % 3 == 2), "agent_message_chunk")
        .when(c("event_type") == "view", "agent_thought_chunk")
        .when(c("event_type") == "click", "tool_call")
        .when(c("event_type") == "error", "tool_call_update")
        .otherwise("turn_completed")
    )
    inp = F.floor(c("value") * 1000).cast("long")
    out = F.floor(c("value") * 10).cast("long")
    return e.select(
        "session_id", "line_no", kind.alias("kind"), "k", "agent_ms",
        F.when(c("k") % 11 != 0, c("k") * 3000).alias("context_tokens"),
        F.when(c("k") % 13 != 0, c("hour_ms")).alias("stream_ms"),
        F.floor(c("value")).cast("long").alias("chars"),
        F.concat(F.lit("p"), (c("k") % 7).cast("string")).alias("prompt_id"),
        F.when(tool, F.concat(F.lit("call-"), c("session_id").cast("string"), F.lit("-"),
                              (c("k") % 5).cast("string"))).alias("tool_call_id"),
        F.when(turn, inp).alias("input"), F.when(turn, F.floor(inp * c("k") / 100).cast("long")).alias("cached"),
        F.when(turn, out).alias("output"), F.when(turn, F.floor(out / 2).cast("long")).alias("reasoning"),
        F.when(turn, inp + out).alias("total"),
        F.when(turn, 1 + c("k") % 5).alias("calls"), F.when(turn, c("k") * 17).alias("api_ms"),
        F.when(turn, F.when(c("k") % 4 == 0, F.lit(0).cast("long"))
               .otherwise(F.floor(c("value") * 1e8).cast("long"))).alias("ticks"),
        F.when(c("event_type") == "signup", c("k") * 200).alias("tokens_after"),
        F.when(turn & (c("k") % 3 == 0), F.lit("build-4.6")).when(turn & (c("k") % 3 == 1), F.lit("build_4.5"))
        .alias("model"),
    )


def v_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates_of(table(spark, sf_dir, "events").filter(c("event_type") == "purchase"))


def v_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session headers: every fifth user is a child of the user before it."""
    u = table(spark, sf_dir, "events").groupBy(c("user_id").alias("session_id")).agg(
        F.min(ms(c("ts"))).alias("created_ms"), F.max(ms(c("ts"))).alias("active_ms"))
    child = c("session_id") % 5 == 4
    return u.select(
        "session_id",
        F.when(child, F.lit("subagent")).when(c("session_id") % 5 == 3, F.lit("main")).alias("session_kind"),
        F.when(child & (c("session_id") % 2 == 0), c("session_id") - 1).alias("parent_id"),
        (c("created_ms") - 60_000 * (c("session_id") % 3)).alias("created_ms"),
        F.when(c("session_id") % 4 != 0, c("active_ms") + 30_000 * (c("session_id") % 7)).alias("active_ms"),
        F.when(c("session_id") % 3 == 0, F.concat(F.lit("  Task "), c("session_id").cast("string")))
        .when(c("session_id") % 3 == 1, F.lit(" ")).alias("session_summary"),
        F.when(c("session_id") % 2 == 0, F.concat(F.lit("Generated title number "), c("session_id").cast("string"),
               F.lit(" with a deliberately long tail that has to be cut somewhere"))).alias("generated_title"),
        F.concat(F.lit("C:\\work\\proj"), (c("session_id") % 10).cast("string")).alias("cwd"),
        F.when(c("session_id") % 10 == 9, F.lit("reviewer")).when(child, F.lit("general-purpose")).alias("agent_name"),
    )


def v_history(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Conversation snapshots before (``old``) and after (``new``) a rewrite."""
    h = table(spark, sf_dir, "conversations").select(
        c("conv_id").alias("session_id"), c("turn").alias("idx"), c("role").alias("type"), "text")
    if which == "new":
        last = table(spark, sf_dir, "conversations").groupBy(c("conv_id").alias("session_id")).agg(F.max("turn").alias("last_idx"))
        g = c("session_id") % 5
        h = h.join(last, "session_id").filter(~((g == 3) & (c("idx") > 1)))
        edited = ((g == 2) & (c("idx") == 1)) | ((g == 4) & (c("idx") == c("last_idx")))
        extra = last.filter(c("session_id") % 5 == 1).select(
            "session_id", (c("last_idx") + 1).alias("idx"), F.lit("assistant").alias("type"), F.lit("one more answer").alias("text"))
        h = h.select("session_id", "idx", "type",
                     F.when(edited, F.concat(c("text"), F.lit(" ran out of context"))).otherwise(c("text")).alias("text"))
        h = h.unionByName(extra)
    key = (
        F.when(c("type") == "system", F.lit("system"))
        .when(c("type") == "user", F.concat(F.lit("user:"), c("idx").cast("string")))
    )
    return h.select("session_id", "idx", "type", "text", key.alias("key"),
                    F.substring(F.sha2(c("text"), 256), 1, 16).alias("hash"))


def v_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: a round is an order, a call is one of its lines."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    j = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )
    j = by_rows(j, ["l_orderkey"], li.count()).withColumn("call_no", F.row_number().over(w).cast("long"))
    return j.join(o.select("o_orderkey", "o_totalprice", "o_custkey"), c("l_orderkey") == c("o_orderkey")).select(
        c("l_orderkey").alias("round_id"), c("call_no"), c("o_custkey").alias("session_id"),
        F.floor(c("l_quantity")).cast("long").alias("weight"),
        F.floor(c("l_extendedprice")).cast("long").alias("start"),
        (F.floor(c("l_extendedprice")) + F.floor(c("l_quantity"))).cast("long").alias("end"),
        F.floor(c("o_totalprice")).cast("long").alias("off_in"),
        (c("l_partkey") % 97).alias("w_thought"), (c("l_partkey") % 53).alias("w_message"),
        (c("l_suppkey") % 41).alias("w_emit"), (c("l_partkey") % 211).alias("w_enc"),
        (c("l_suppkey") % 67).alias("w_tool"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound log written back as JSON lines, with the format's loose ends.

    Meta data sits in either of two places, clocks come in several units, content is a string
    or an object, every 29th line is cut off and every 31st is blank.
    """
    u = v_updates(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    if u.rdd.getNumPartitions() < cores:  # one small file: writing and parsing JSON would be one task
        u = u.repartition(cores)
    k = c("k")
    meta = F.struct(c("context_tokens").alias("totalTokens"), c("agent_ms").alias("agentTimestampMs"),
                    c("stream_ms").alias("streamStartMs"), c("prompt_id").alias("promptId"), k.alias("chunkId"))
    usage = F.when(c("kind") == "turn_completed", F.struct(
        c("input").alias("inputTokens"), c("output").alias("outputTokens"), c("cached").alias("cachedReadTokens"),
        c("reasoning").alias("reasoningTokens"), c("total").alias("totalTokens"), c("ticks").alias("costUsdTicks"),
        c("calls").alias("modelCalls"), c("api_ms").alias("apiDurationMs"),
        F.when(c("model").isNotNull(), F.create_map(c("model"), F.lit(1))).alias("modelUsage")))
    stamp = F.when(k % 4 == 0, c("agent_ms").cast("double")).when(k % 4 == 1, F.floor(c("agent_ms") / 1000).cast("double")).when(
        k % 4 == 3, F.lit(12.0))
    body = F.concat(F.lit("line "), k.cast("string"), F.lit("\nrest"), F.when(k % 2 == 0, "\n").otherwise(""))
    head = [stamp.alias("timestamp"), F.lit("session/update").alias("method")]
    upd = [c("kind").alias("sessionUpdate"), c("tool_call_id").alias("toolCallId"),
           F.when(c("tool_call_id").isNotNull(), F.concat(F.lit("Read `file"), k.cast("string"), F.lit("`"))).alias("title"),
           usage.alias("usage"), c("tokens_after").alias("tokens_after")]
    sid = c("session_id").cast("string").alias("sessionId")
    outer = F.when(k % 3 != 0, meta).alias("_meta")
    inner = F.when(k % 3 == 0, meta).alias("_meta")
    as_text = F.to_json(F.struct(*head, F.struct(sid, outer, F.struct(*upd, inner, body.alias("content")).alias("update")).alias("params")))
    as_object = F.to_json(F.struct(*head, F.struct(sid, outer, F.struct(
        *upd, inner, F.struct(body.alias("text")).alias("content")).alias("update")).alias("params")))
    line = F.when(k % 5 == 0, as_text).otherwise(as_object)
    bad = F.when(c("line_no") % 29 == 0, F.substring("line", 1, 60)).when(c("line_no") % 31 == 0, F.lit("   ")).otherwise(c("line"))
    return compute_once(compute_once(u, "line", line).drop(*[x for x in u.columns if x not in ("session_id", "line_no")]), "value", bad).drop("line")


# DuckDB twins.
VIEWS: dict[str, str] = {
    "v_updates": """
  SELECT session_id, line_no, kind, k, agent_ms,
    CASE WHEN k % 11 <> 0 THEN k * 3000 END AS context_tokens,
    CASE WHEN k % 13 <> 0 THEN hour_ms END AS stream_ms,
    CAST(floor(value) AS BIGINT) AS chars,
    'p' || (k % 7) AS prompt_id,
    CASE WHEN event_type IN ('click','error') THEN 'call-' || session_id || '-' || (k % 5) END AS tool_call_id,
    CASE WHEN turn THEN inp END AS input, CASE WHEN turn THEN CAST(floor(inp * k / 100) AS BIGINT) END AS cached,
    CASE WHEN turn THEN outp END AS output, CASE WHEN turn THEN outp // 2 END AS reasoning,
    CASE WHEN turn THEN inp + outp END AS total,
    CASE WHEN turn THEN 1 + k % 5 END AS calls, CASE WHEN turn THEN k * 17 END AS api_ms,
    CASE WHEN turn THEN (CASE WHEN k % 4 = 0 THEN 0 ELSE CAST(floor(value * 1e8) AS BIGINT) END) END AS ticks,
    CASE WHEN event_type = 'signup' THEN k * 200 END AS tokens_after,
    CASE WHEN turn AND k % 3 = 0 THEN 'build-4.6' WHEN turn AND k % 3 = 1 THEN 'build_4.5' END AS model
  FROM (SELECT user_id AS session_id, event_id AS line_no, event_type, value,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS agent_ms,
      epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type = 'purchase' AS turn,
      CAST(floor(value * 1000) AS BIGINT) AS inp, CAST(floor(value * 10) AS BIGINT) AS outp,
      CASE WHEN event_type = 'signup' THEN (CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 25
          WHEN 0 THEN 'auto_compact_completed' WHEN 1 THEN 'session_recap' WHEN 2 THEN 'hook_execution'
          ELSE 'user_message_chunk' END)
        WHEN event_type = 'view' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 = 2 THEN 'agent_message_chunk'
        WHEN event_type = 'view' THEN 'agent_thought_chunk' WHEN event_type = 'click' THEN 'tool_call'
        WHEN event_type = 'error' THEN 'tool_call_update' ELSE 'turn_completed' END AS kind
    FROM events)""",
    "v_turns": "SELECT * FROM v_updates WHERE kind = 'turn_completed'",
    "v_sessions": """
  SELECT session_id,
    CASE WHEN session_id % 5 = 4 THEN 'subagent' WHEN session_id % 5 = 3 THEN 'main' END AS session_kind,
    CASE WHEN session_id % 5 = 4 AND session_id % 2 = 0 THEN session_id - 1 END AS parent_id,
    created_ms - 60000 * (session_id % 3) AS created_ms,
    CASE WHEN session_id % 4 <> 0 THEN active_ms + 30000 * (session_id % 7) END AS active_ms,
    CASE WHEN session_id % 3 = 0 THEN '  Task ' || session_id WHEN session_id % 3 = 1 THEN ' ' END AS session_summary,
    CASE WHEN session_id % 2 = 0 THEN 'Generated title number ' || session_id
      || ' with a deliberately long tail that has to be cut somewhere' END AS generated_title,
    'C:\\work\\proj' || (session_id % 10) AS cwd,
    CASE WHEN session_id % 10 = 9 THEN 'reviewer' WHEN session_id % 5 = 4 THEN 'general-purpose' END AS agent_name
  FROM (SELECT user_id AS session_id, min(epoch_us(ts) // 1000) AS created_ms, max(epoch_us(ts) // 1000) AS active_ms
        FROM events GROUP BY user_id)""",
    "v_history_old": """
  SELECT conv_id AS session_id, turn AS idx, role AS type, text,
    CASE WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'user:' || turn END AS key,
    substr(sha256(text), 1, 16) AS hash FROM conversations""",
    "v_history_new": """
  SELECT session_id, idx, type, text,
    CASE WHEN type = 'system' THEN 'system' WHEN type = 'user' THEN 'user:' || idx END AS key,
    substr(sha256(text), 1, 16) AS hash
  FROM (SELECT conv_id AS session_id, turn AS idx, role AS type,
      CASE WHEN (conv_id % 5 = 2 AND turn = 1) OR (conv_id % 5 = 4 AND turn = last_idx)
        THEN text || ' ran out of context' ELSE text END AS text
    FROM conversations JOIN (SELECT conv_id, max(turn) AS last_idx FROM conversations GROUP BY 1) USING (conv_id)
    WHERE NOT (conv_id % 5 = 3 AND turn > 1)
    UNION ALL
    SELECT conv_id, max(turn) + 1, 'assistant', 'one more answer' FROM conversations WHERE conv_id % 5 = 1 GROUP BY conv_id)""",
    "v_calls": """
  SELECT l_orderkey AS round_id, call_no, o_custkey AS session_id,
    CAST(floor(l_quantity) AS BIGINT) AS weight, CAST(floor(l_extendedprice) AS BIGINT) AS start,
    CAST(floor(l_extendedprice) + floor(l_quantity) AS BIGINT) AS "end",
    CAST(floor(o_totalprice) AS BIGINT) AS off_in,
    l_partkey % 97 AS w_thought, l_partkey % 53 AS w_message, l_suppkey % 41 AS w_emit,
    l_partkey % 211 AS w_enc, l_suppkey % 67 AS w_tool
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS call_no FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey""",
}


def r6(expr: str) -> str:
    """SQL twin of ``pricing.gold`` at 6 decimals."""
    return f"round({expr} + 3.7e-11, 6)"


def r8(expr: str) -> str:
    return f"round({expr} + 3.7e-11, 8)"


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it mentions, each after the views it uses itself, whatever module came first."""
    seen: set[str] = set()
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
