"""Sinks, incremental refresh and the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.functions import logline as ll
from sessionledger.operators import sessionize as s
from sessionledger.plans import binding as b
from sessionledger.plans.allocation_queries import split_sql
from sessionledger.plans.registry import query
from sessionledger.session import scratch_dir
from sessionledger.sources import sqlfunctions, store

c = F.col


@query("written_events", "S11", """
SELECT strftime(make_timestamp(agent_ms * 1000), '%Y-%m-%d') AS event_date, kind, count(*) AS n FROM v_updates WHERE line_no % 29 <> 0 AND line_no % 31 <> 0 GROUP BY ALL""")
def written_events(spark, sf):
    """Normalised events written by day and read back."""
    path = f"{scratch_dir(spark)}/events"
    d = ll.normalize(b.raw_lines(spark, sf)).filter(c("kind") != "parse_error")
    store.write_events(d.select("session_id", "line_no", "kind", "agent_ms", "context_tokens"), path)
    return spark.read.parquet(path).groupBy(c("event_date").cast("string").alias("event_date"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("session_documents", "S11 A1", """
SELECT session_id, count(*) AS event_count, min(agent_ms) AS first_ms, count(DISTINCT kind) AS kinds FROM v_updates GROUP BY session_id""")
def session_documents(spark, sf):
    d = store.session_summaries(b.v_updates(spark, sf))
    j = F.from_json("summary", "session_id long, event_count long, first_ms long, counts_by_kind array<struct<kind:string,n:long>>")
    return d.select(j.alias("j")).select("j.session_id", "j.event_count", "j.first_ms", F.size("j.counts_by_kind").cast("long").alias("kinds"))


@query("refreshed_rounds", "S12 U3", "SELECT session_id, max(round_no) AS rounds FROM v_lines WHERE session_id % 11 <> 0 GROUP BY session_id")
def refreshed_rounds(spark, sf):
    """Two refreshes, the first one repeated: the second finds longer logs for some sessions and others gone."""
    path = f"{scratch_dir(spark)}/refresh"
    lines = b.v_updates(spark, sf)

    def run(part, batch):
        cur = part.groupBy("session_id").agg(F.count(F.lit(1)).alias("size"), F.max("agent_ms").alias("mtime"))

        def compute(ids):
            return s.by_session(part.join(ids, "session_id", "left_semi"), s.assign_rounds).groupBy("session_id").agg(F.max("round_no").alias("rounds"))

        return store.refresh(cur, compute, path, batch)

    first = lines.filter((c("session_id") % 3 != 0) | (c("line_no") % 7 < 3))
    run(first, "001")
    run(first, "001")  # a retry of a refresh that went through
    return run(lines.filter(c("session_id") % 11 != 0), "002")


@query("sql_surface", "X3", "SELECT session_id, count(*) AS turns, CAST(sum(input) AS BIGINT) AS input FROM v_turns WHERE agent_ms >= 1704844800000 GROUP BY session_id")
def sql_surface(spark, sf):
    store.register_views(spark, {"turns": b.v_turns(spark, sf)}, "ledger_")
    return spark.sql("SELECT session_id, count(*) AS turns, sum(input) AS input FROM ledger_turns WHERE agent_ms >= :since GROUP BY session_id", {"since": 1704844800000})


def surface(spark, sf):
    tables = {"turns": b.v_turns(spark, sf), "updates": b.v_updates(spark, sf), "sessions": b.v_sessions(spark, sf), "calls": b.v_calls(spark, sf)}
    sqlfunctions.register(spark, tables)


_SINCE, _UNTIL = 1704153600000, 1706745600000


@query("sql_usage_buckets", "X3 J6 C1", f"""
SELECT bucket_ms, s.is_child, count(*) AS turns, CAST(sum(inp - ca) AS BIGINT) AS tokens_in, CAST(sum(ca) AS BIGINT) AS tokens_cached, {b.r6('sum(li + lc + lo_usd)')} AS cost_usd
FROM (SELECT *, {_SINCE} + (agent_ms - {_SINCE}) // 21600000 * 21600000 AS bucket_ms FROM v_rated WHERE agent_ms >= {_SINCE} AND agent_ms < {_UNTIL})
JOIN (SELECT session_id, parent_id IS NOT NULL AS is_child FROM v_sessions) s USING (session_id) GROUP BY ALL""")
def sql_usage_buckets(spark, sf):
    """Written in SQL alone: turns priced and bucketed through the functions, joined with the sessions view."""
    surface(spark, sf)
    return spark.sql("""
        SELECT ledger_bucket_start(t.event_ms, 21600000, :since) AS bucket_ms, s.parent_id IS NOT NULL AS is_child, count(*) AS turns, sum(t.tokens_in) AS tokens_in, sum(t.tokens_cached) AS tokens_cached,
          round(sum(t.cost_usd) + 3.7e-11D, 6) AS cost_usd
        FROM ledger_priced_turns(:since, :until) t JOIN ledger_sessions s ON s.session_id = t.session_id GROUP BY 1, 2""", {"since": _SINCE, "until": _UNTIL})


@query("sql_remainders", "X3 L1", f"""
SELECT round_id, call_no, x FROM ({split_sql('v_calls', 'x', 'weight', 'off_in')})""")
def sql_remainders(spark, sf):
    """Official input of a round over its few calls, by the SQL function."""
    surface(spark, sf)
    return spark.sql("""
        SELECT round_id, call_no, ledger_largest_remainder(ws, off_in)[i] AS x FROM (
          SELECT round_id, off_in, transform(calls, c -> cast(c.weight AS DOUBLE)) AS ws, posexplode(calls) AS (i, c) FROM (
            SELECT round_id, max(off_in) AS off_in, array_sort(collect_list(struct(call_no, weight))) AS calls FROM ledger_calls GROUP BY round_id)) LATERAL VIEW explode(array(c.call_no)) AS call_no""")


@query("sql_daily_usage", "X3 A4", f"""
SELECT {_SINCE} + (agent_ms - {_SINCE}) // 86400000 * 86400000 AS bucket_ms, count(*) AS turns, CAST(sum(outp) AS BIGINT) AS tokens_out, {b.r6('sum(li + lc + lo_usd)')} AS cost_usd
FROM v_rated WHERE agent_ms >= {_SINCE} AND agent_ms < {_UNTIL} GROUP BY 1""")
def sql_daily_usage(spark, sf):
    surface(spark, sf)
    return spark.sql(f"SELECT bucket_ms, turns, tokens_out, round(cost_usd + 3.7e-11D, 6) AS cost_usd FROM ledger_usage_buckets({_SINCE}, {_UNTIL}, 86400000)")


@query("tool_schema_sizes", "S8", """
SELECT session_id, CASE WHEN session_id % 3 = 0 THEN session_id * 10 ELSE 0 END AS tool_tokens, CASE WHEN session_id % 3 = 0 THEN 7 ELSE 25 END AS tool_count, CASE WHEN session_id % 3 = 0 THEN 'file' ELSE 'default' END AS tool_source FROM v_sessions""")
def tool_schema_sizes(spark, sf):
    from sessionledger.sources.files import tool_definitions

    sess = b.v_sessions(spark, sf).select("session_id")
    files = sess.filter(c("session_id") % 3 == 0).select("session_id", (c("session_id") * 10).alias("tokens"), F.lit(7).alias("count"))
    return tool_definitions(sess, files)
