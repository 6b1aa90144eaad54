"""Log-line normalisation and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.functions import history as h
from sessionledger.functions import logline as ll
from sessionledger.functions import text as t
from sessionledger.functions import tools as tl
from sessionledger.plans import binding as b
from sessionledger.plans.registry import query

c = F.col
WS = t.SPACES.encode("utf-8").decode("utf-8")
WSQ = WS.replace("'", "''")
GLUE = " OR ".join(f"lower(X) LIKE '%{g.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'" for g in t.COMPACT_GLUE)


def glue(x):
    return "(" + GLUE.replace("X", x) + ")"


def collapse_sql(x):
    return f"trim(regexp_replace({x}, '[{WSQ}]+', ' ', 'g'))"


def docs(spark, sf):
    return b.table(spark, sf, "documents")


@query("normalized_events", "S2 P1 P2 P3 P5 P6 P7 S11", """
SELECT session_id, line_no, CASE WHEN bad THEN 'parse_error' ELSE kind END AS kind,
  CASE WHEN NOT bad THEN prompt_id END AS prompt_id, CASE WHEN NOT bad THEN context_tokens END AS context_tokens,
  CASE WHEN NOT bad THEN agent_ms END AS agent_ms, CASE WHEN NOT bad THEN stream_ms END AS stream_ms,
  CASE WHEN NOT bad THEN agent_ms - stream_ms END AS ms_since_stream,
  CASE WHEN NOT bad AND k % 3 <> 0 THEN k END AS chunk_id, CASE WHEN NOT bad THEN tool_call_id END AS tool_call_id,
  CASE WHEN bad THEN 0 ELSE length('line ' || k) + 5 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS char_count,
  CASE WHEN bad THEN 0 ELSE 2 END AS line_count,
  CASE WHEN NOT bad THEN CASE WHEN length('line ' || k) + 5 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END <= 10
      THEN 'line ' || k || chr(10) || 'rest' || CASE WHEN k % 2 = 0 THEN chr(10) ELSE '' END
    ELSE substr('line ' || k || chr(10) || 'rest' || CASE WHEN k % 2 = 0 THEN chr(10) ELSE '' END, 1, 10) || '…[+'
      || (length('line ' || k) + 5 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END - 10) || ' chars]' END END AS text_preview,
  CASE WHEN NOT bad THEN CASE k % 4 WHEN 1 THEN agent_ms // 1000 ELSE agent_ms / 1000 END END AS epoch,
  CASE WHEN NOT bad THEN CASE WHEN agent_ms % 1000 = 0 THEN strftime(make_timestamp(agent_ms * 1000), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(agent_ms * 1000), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' END AS agent_iso,
  CASE WHEN NOT bad THEN model END AS model, CASE WHEN NOT bad THEN input END AS input, CASE WHEN NOT bad THEN ticks END AS ticks
FROM (SELECT *, line_no % 29 = 0 AS bad FROM v_updates) WHERE line_no % 29 = 0 OR line_no % 31 <> 0""")
def normalized_events(spark, sf):
    d = ll.normalize(b.raw_lines(spark, sf), preview=10)
    return d.select("session_id", "line_no", "kind", "prompt_id", "context_tokens", "agent_ms", "stream_ms", "ms_since_stream",
                    "chunk_id", "tool_call_id", "char_count", "line_count", "text_preview", "epoch",
                    t.iso_utc(c("agent_ms")).alias("agent_iso"), "model", "input", "ticks")


@query("kind_scan_before_parse", "S13", """
SELECT session_id, CAST(sum(input) AS BIGINT) AS input, count(*) AS turns FROM v_turns WHERE line_no % 29 <> 0 AND line_no % 31 <> 0 GROUP BY session_id""")
def kind_scan_before_parse(spark, sf):
    """Only lines that can be turns are parsed at all."""
    lines = b.raw_lines(spark, sf).filter(ll.mentions(c("value"), "turn_completed"))
    d = ll.normalize(lines).filter(c("kind") == "turn_completed")
    return d.groupBy("session_id").agg(F.sum("input").alias("input"), F.count(F.lit(1)).alias("turns"))


@query("model_hints", "P13 S9", """
SELECT session_id, arg_min(model, line_no) AS first_id, arg_min(CASE k % 3 WHEN 0 THEN '4.6' ELSE '4.5' END, line_no) AS family, false AS assumed
FROM v_turns WHERE model IS NOT NULL AND line_no % 29 <> 0 AND line_no % 31 <> 0 GROUP BY session_id""")
def model_hints(spark, sf):
    d = ll.parse_lines(b.raw_lines(spark, sf).filter(ll.may_name_model(c("value")))).filter(~c("bad"))
    hints = d.select("session_id", F.lit(3).alias("source_rank"), "line_no", ll.model_hints().alias("ids"))
    return ll.model_per_session(hints).select("session_id", "first_id", "family", "assumed")


@query("clock_resolution", "P3 P4 P46", """
SELECT line_no, CASE WHEN ts > 1e12 THEN ts / 1000 WHEN ts > 1e9 THEN ts WHEN agent_ms > 1e12 THEN agent_ms / 1000 END AS event_epoch,
  CASE WHEN mark > 1e11 THEN mark / 1000 WHEN mark > 0 THEN mark END AS mark_epoch,
  CASE WHEN k % 6 = 5 THEN NULL ELSE (agent_ms // 1000)::DOUBLE END AS iso_epoch
FROM (SELECT *, CAST(CASE k % 3 WHEN 0 THEN agent_ms WHEN 1 THEN agent_ms // 1000 ELSE k END AS DOUBLE) AS ts,
  CAST(CASE k % 4 WHEN 0 THEN agent_ms WHEN 1 THEN agent_ms // 1000 WHEN 2 THEN -5 ELSE k END AS DOUBLE) AS mark FROM v_updates)""")
def clock_resolution(spark, sf):
    k = c("k")
    u = b.v_updates(spark, sf)
    ts = F.when(k % 3 == 0, c("agent_ms")).when(k % 3 == 1, F.floor(c("agent_ms") / 1000)).otherwise(k)
    mark = F.when(k % 4 == 0, c("agent_ms")).when(k % 4 == 1, F.floor(c("agent_ms") / 1000)).when(k % 4 == 2, -5).otherwise(k)
    stamp = F.timestamp_millis(c("agent_ms"))
    iso = F.when(k % 6 == 5, F.lit("yesterday")).when(k % 6 == 4, F.date_format(stamp + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return u.select("line_no", t.epoch_of(ts, c("agent_ms"), F.lit(None)).alias("event_epoch"),
                    t.epoch_of_mark(mark).alias("mark_epoch"), t.iso_to_epoch(iso).alias("iso_epoch"))


@query("text_measures", "P7 P9 P10 P8", f"""
WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS u, text, n_chars, {collapse_sql('text')} AS one FROM documents)
SELECT doc_id, CASE WHEN length(u) <= 120 THEN u ELSE substr(u, 1, 120) || '…[+' || (length(u) - 120) || ' chars]' END AS counted,
  CASE WHEN length(one) <= 160 THEN one ELSE substr(one, 1, 159) || '…' END AS collapsed,
  CASE WHEN length(s) <= 80 THEN s ELSE substr(s, 1, 80) || '…' END AS stripped,
  CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lines,
  length(text) AS chars, strlen(text) // 4 AS tokens, greatest(0, n_chars - 500) // 4 AS char_tokens
FROM (SELECT *, regexp_replace(u, '^[{WSQ}]+|[{WSQ}]+$', '', 'g') AS s FROM d)""")
def text_measures(spark, sf):
    x = c("text")
    return docs(spark, sf).select(
        "doc_id", t.preview_counted(x, 120).alias("counted"), t.preview_collapsed(x, 160).alias("collapsed"),
        t.preview_stripped(x, 80).alias("stripped"), t.line_count(x).alias("lines"), t.char_count(x).alias("chars"),
        t.tokens_of_text(x).alias("tokens"), t.tokens_of_chars(c("n_chars") - 500).alias("char_tokens"))


@query("compaction_glue", "P38 P48", f"""
SELECT doc_id, {glue('x')} OR r = 'Auto-Compact' AS glued, CASE WHEN NOT {glue('x')} AND length({collapse_sql('x')}) > 0 THEN x ELSE coalesce(CASE WHEN NOT {glue('text')} THEN text END, '') END AS preview
FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN text || ' This Session Is Being Continued' WHEN 1 THEN ' ' ELSE text END AS x,
  CASE WHEN doc_id % 5 = 0 THEN 'Auto-Compact' ELSE 'other' END AS r FROM documents)""")
def compaction_glue(spark, sf):
    x = F.when(c("doc_id") % 4 == 0, F.concat(c("text"), F.lit(" This Session Is Being Continued"))).when(c("doc_id") % 4 == 1, " ").otherwise(c("text"))
    r = F.when(c("doc_id") % 5 == 0, "Auto-Compact").otherwise("other")
    d = docs(spark, sf).select("doc_id", "text", x.alias("x"), r.alias("r"))
    return d.select("doc_id", t.is_compact_glue(c("x"), c("r")).alias("glued"), t.first_real_preview(c("x"), c("text")).alias("preview"))


@query("tool_names", "P23 P24 P30", r"""
WITH x AS (SELECT line_no, k, session_id, CASE k % 9 WHEN 0 THEN 'grep' WHEN 1 THEN 'Read `a' || k || '`' WHEN 2 THEN 'Execute `ls`' WHEN 3 THEN 'Write b'
    WHEN 4 THEN 'Updating plan' WHEN 5 THEN 'Search for x' WHEN 6 THEN 'List dir' WHEN 7 THEN 'something' END AS title,
  CASE WHEN k % 7 = 0 THEN 'my_tool' WHEN k % 7 = 1 THEN '' END AS meta, CASE k % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 2 THEN 'search' WHEN 3 THEN 'execute' END AS kind,
  CASE k % 4 WHEN 0 THEN 'call-ab-' || k WHEN 1 THEN '' || k WHEN 2 THEN 'call-x' || k END AS tid,
  CASE k % 5 WHEN 0 THEN 'grep x' || k WHEN 1 THEN 'read ×' || k WHEN 2 THEN '  list X 12 ' WHEN 3 THEN ' ' END AS raw FROM v_updates WHERE tool_call_id IS NOT NULL)
SELECT line_no, coalesce(nullif(meta, ''), CASE WHEN title = 'grep' THEN title WHEN title LIKE 'Read %' THEN 'read_file' WHEN title LIKE 'Execute %' THEN 'run_terminal_command'
    WHEN title LIKE 'Write %' THEN 'write' WHEN title LIKE 'Updating plan%' THEN 'todo_write' WHEN title LIKE 'Search%' THEN 'grep' WHEN title LIKE 'List %' THEN 'list_dir' END,
  CASE kind WHEN 'read' THEN 'read_file' WHEN 'edit' THEN 'search_replace' WHEN 'search' THEN 'grep' WHEN 'execute' THEN 'run_terminal_command' END) AS name,
  CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k END AS seq,
  coalesce(nullif(trim(regexp_replace(trim(coalesce(raw, 'tool')), '\s*[x×X]\s*[0-9]+\s*$', '')), ''), 'tool') AS category FROM x""")
def tool_names(spark, sf):
    k = c("k")

    def pick(n, *vals):
        out = None
        for i, v in enumerate(vals):
            v = F.lit(v) if isinstance(v, str) else v
            out = F.when(k % n == i, v) if out is None else out.when(k % n == i, v)
        return out

    ks = k.cast("string")
    u = b.v_updates(spark, sf).filter(c("tool_call_id").isNotNull())
    title = pick(9, "grep", F.concat(F.lit("Read `a"), ks, F.lit("`")), "Execute `ls`", "Write b", "Updating plan", "Search for x", "List dir", "something")
    tid = pick(4, F.concat(F.lit("call-ab-"), ks), ks, F.concat(F.lit("call-x"), ks))
    raw = pick(5, F.concat(F.lit("grep x"), ks), F.concat(F.lit("read ×"), ks), "  list X 12 ", " ")
    return u.select("line_no", tl.tool_name(pick(7, "my_tool", ""), title, pick(5, "read", "edit", "search", "execute")).alias("name"),
                    tl.tool_seq(tid).alias("seq"), tl.category(raw).alias("category"))


@query("plan_steps", "P25", """
SELECT line_no, CASE WHEN k % 3 = 0 THEN 'modify' WHEN k % 3 = 1 THEN 'create' ELSE 'modify' END AS mode, k % 2 = 0 AS planned, n, id, status, content FROM (
  SELECT line_no, k, 7 AS n, '7' AS id, 'completed' AS status, 'first ' || k AS content FROM v_updates WHERE kind = 'tool_call'
  UNION ALL SELECT line_no, k, 2, 'b', CASE k % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'pending' ELSE 'waiting_for_me' END, 'second' FROM v_updates WHERE kind = 'tool_call')""")
def plan_steps(spark, sf):
    k = c("k")
    st = F.when(k % 3 == 0, "running").when(k % 3 == 1, "not started").otherwise("Waiting for me")
    todos = F.to_json(F.array(
        F.struct(F.lit("7").alias("id"), F.lit("Done").alias("status"), F.concat(F.lit("first "), k.cast("string")).alias("content")),
        F.struct(F.lit("b").alias("id"), F.replace(st, F.lit("not started"), F.lit("not_started")).alias("status"), F.lit("second").alias("content"))))
    u = b.v_updates(spark, sf).filter(c("kind") == "tool_call").select("line_no", "k", F.try_parse_json(todos).alias("todos"))
    merge = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    d = u.select("line_no", tl.plan_mode(merge, F.lit("plan"), F.lit(True)).alias("mode"),
                 tl.is_plan(F.when(k % 2 == 0, "TodoWrite").otherwise("grep"), F.lit("x")).alias("planned"),
                 F.explode(tl.plan_steps(c("todos"))).alias("s"))
    return d.select("line_no", "mode", "planned", "s.*")


@query("argument_sizes", "P26", """
SELECT doc_id, greatest(length(j), 2 * length(text)) AS chars, greatest(strlen(j) // 4, 2 * (strlen(text) // 4)) AS tokens
FROM (SELECT doc_id, text, CAST(to_json({'new_string': text, 'old_string': text, 'path': 'a/b'}) AS VARCHAR) AS j FROM documents)""")
def argument_sizes(spark, sf):
    v = F.try_parse_json(F.to_json(F.struct(c("text").alias("new_string"), c("text").alias("old_string"), F.lit("a/b").alias("path"))))
    d = docs(spark, sf).select("doc_id", v.alias("v"))
    return d.select("doc_id", tl.argument_sizes(c("v")).alias("s")).select("doc_id", "s.*")


@query("result_sizes", "P27", f"""
SELECT doc_id, length(body) AS chars, strlen(body) // 4 AS tokens, lines FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'tail'
    WHEN 2 THEN text WHEN 3 THEN 'The file /x/' || doc_id || ' has been updated successfully.' WHEN 4 THEN text ELSE 'plain' END AS body,
  CASE doc_id % 6 WHEN 1 THEN length(text) - length(replace(text, chr(10), '')) + 2 WHEN 3 THEN 1 WHEN 5 THEN 1
    ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines
  FROM documents)""")
def result_sizes(spark, sf):
    g = c("doc_id") % 6
    x = c("text")

    def part(kind, v):
        return F.struct(F.lit(kind).alias("type"), v.alias("text"), F.lit(None).cast("string").alias("newText"))

    diff = F.struct(F.lit("diff").alias("type"), F.lit(None).cast("string").alias("text"), x.alias("newText"))
    content = F.when(g == 0, F.to_json(F.array(part("content", x)))).when(
        g == 1, F.to_json(F.array(part("content", x), diff, part("text", F.lit("tail"))))).when(
        (g == 2) | (g == 3) | (g == 4), F.to_json(F.array(diff)))
    raw = F.when(g == 2, F.to_json(F.struct(F.lit("ReadFile").alias("type"), F.struct(x.alias("content"), x.alias("raw_output")).alias("FileContent")))).when(
        g == 3, F.to_json(F.struct(F.struct(F.concat(F.lit("/x/"), c("doc_id").cast("string")).alias("absolute_path"), F.lit("a").alias("old_string"), x.alias("new_string")).alias("EditsApplied")))).when(
        g == 4, F.to_json(F.struct(F.lit("Bash").alias("type"), x.alias("output_for_prompt"), x.alias("output")))).when(
        g == 5, F.to_json(F.struct(F.lit("plain").alias("message"))))
    d = docs(spark, sf).select("doc_id", F.try_parse_json(content).alias("content"), F.try_parse_json(raw).alias("raw"))
    return d.select("doc_id", tl.result_sizes(c("content"), c("raw")).alias("s")).select("doc_id", "s.chars", "s.tokens", "s.lines")


@query("tool_paths", "P28", r"""
SELECT line_no, CASE k % 4 WHEN 0 THEN 'src/a/b/f' || k WHEN 1 THEN 'meta/g' || k WHEN 2 THEN 'C:\x\y\h' || k END AS path,
  CASE k % 4 WHEN 0 THEN 'b/f' || k WHEN 1 THEN 'meta/g' || k WHEN 2 THEN 'y/h' || k END AS short,
  CASE k % 4 WHEN 0 THEN k WHEN 2 THEN k + 1 END AS start_at
FROM v_updates WHERE kind = 'tool_call'""")
def tool_paths(spark, sf):
    k, ks = c("k"), c("k").cast("string")
    a = F.when(k % 4 == 0, F.to_json(F.struct(F.concat(F.lit("src/a/b/f"), ks).alias("target_file"), k.alias("offset"))))
    m = F.when(k % 4 == 1, F.to_json(F.struct(F.concat(F.lit("meta/g"), ks).alias("path"))))
    o = F.when(k % 4 == 2, F.to_json(F.struct(F.struct(F.concat(F.lit("C:\\x\\y\\h"), ks).alias("absolute_path"), (k + 1).alias("offset")).alias("FileContent"))))
    d = b.v_updates(spark, sf).filter(c("kind") == "tool_call").select(
        "line_no", F.try_parse_json(a).alias("a"), F.try_parse_json(m).alias("m"), F.try_parse_json(o).alias("o"))
    p = tl.path_of(c("a"), c("m"), c("o"))
    return d.select("line_no", p.alias("path"), tl.short_path(p).alias("short"), tl.range_of("offset", c("a"), c("m"), c("o")).alias("start_at"))


def uuid_sql(x):
    return f"lpad(CAST({x} AS VARCHAR), 8, '0') || '-0000-4000-8000-' || lpad(CAST({x} AS VARCHAR), 12, '0')"


def uuid(x):
    s = x.cast("string")
    return F.concat(F.lpad(s, 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(s, 12, "0"))


@query("subagent_mentions", "P34", f"""
SELECT line_no, {uuid_sql('session_id + 1')} AS subagent_id, 'explore' AS subagent_type, 'look at ' || k AS subagent_description, 2 AS n_ids, 1 AS n_tasks
FROM v_updates WHERE kind = 'tool_call_update'""")
def subagent_mentions(spark, sf):
    u = b.v_updates(spark, sf).filter(c("kind") == "tool_call_update")
    one, two = uuid(c("session_id") + 1), uuid(c("session_id") + 2)
    s = F.concat(F.lit("--- Task "), two, F.lit("\nsubagent_id: "), F.upper(one), F.lit("\n type: explore\n description: look at "), c("k").cast("string"),
                 F.lit("\nTask "), one)
    task = F.try_parse_json(F.to_json(F.struct(F.array(F.upper(one), F.lit("nope")).alias("task_ids"))))
    d = u.select("line_no", s.alias("s"), task.alias("task"))
    return d.select("line_no", tl.subagent_meta(c("s")).alias("m"), F.size(tl.subagent_ids(c("s"))).alias("n_ids"), F.size(tl.task_ids(c("task"))).alias("n_tasks")).select(
        "line_no", "m.*", "n_ids", "n_tasks")


@query("first_prompt_buckets", "P40 F11 A12", f"""
WITH x AS (SELECT session_id, idx, type, CASE idx % 4 WHEN 0 THEN text || '<user_query>q</user_query>' WHEN 1 THEN '<user_info>' || text
    WHEN 2 THEN ' <system-reminder>MCP Servers' || text ELSE text END AS text, idx >= 4 AND idx % 4 = 3 AS cut FROM v_history_old),
y AS (SELECT *, bool_or(cut) OVER (PARTITION BY session_id ORDER BY idx) AS after_cut FROM x),
z AS (SELECT *, CASE WHEN type = 'system' THEN 'system' WHEN type = 'assistant' THEN NULL WHEN text LIKE '%<user_info>%' THEN 'user_info'
  WHEN text LIKE ' <system-reminder>%' THEN 'mcp' WHEN {glue('text')} THEN NULL WHEN text LIKE '%<user_query>%' THEN 'user_prompt' ELSE 'other' END AS bucket FROM y WHERE NOT after_cut)
SELECT session_id, bucket, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text) // 4) AS BIGINT) AS tokens,
  arg_min(substr({collapse_sql('text')}, 1, 30), idx) AS preview FROM z WHERE bucket IS NOT NULL GROUP BY ALL""")
def first_prompt_buckets(spark, sf):
    from sessionledger.operators.bootstrap import bucket_sums, before_first

    i = c("idx") % 4
    x = F.when(i == 0, F.concat(c("text"), F.lit("<user_query>q</user_query>"))).when(i == 1, F.concat(F.lit("<user_info>"), c("text"))).when(
        i == 2, F.concat(F.lit(" <system-reminder>MCP Servers"), c("text"))).otherwise(c("text"))
    d = b.v_history(spark, sf, "old").withColumn("text", x)
    d = before_first(d, (c("idx") >= 4) & (i == 3))
    d = d.withColumns({"bucket": h.first_prompt_bucket(c("type"), c("text"), F.lit(None).cast("string")), "chars": t.char_count(c("text")),
                       "tokens": t.tokens_of_text(c("text")), "preview": F.substring(t.collapse(c("text")), 1, 30)})
    return bucket_sums(d)


@query("prompt_split", "P41", """
SELECT doc_id, CAST(round_even((length(text) + 60) * (strlen(q) // 4) / ((strlen(q) // 4) + (strlen(s) // 4)), 0) AS BIGINT) AS query_chars FROM (
  SELECT doc_id, text, '<user_query>' || substr(text, 1, 50 + doc_id % 100) || '</user_query>' AS q, '<skill_information>' || substr(text, 20) || '</skill_information>' AS s FROM documents)""")
def prompt_split(spark, sf):
    x = c("text")
    msg = F.concat(F.lit("<user_query>"), F.substr(x, F.lit(1), (50 + c("doc_id") % 100).cast("int")), F.lit("</user_query> and <skill_information>"),
                   F.substr(x, F.lit(20)), F.lit("</skill_information>"))
    d = docs(spark, sf).select("doc_id", msg.alias("m"), (F.length(x) + 60).cast("long").alias("full"))
    return d.select("doc_id", h.query_share(c("m"), c("full")).alias("query_chars"))


@query("history_fingerprints", "P37 P39", f"""
SELECT session_id, idx, type, CASE WHEN type = 'system' THEN 'system' WHEN type = 'user' THEN 'user:' || idx WHEN type = 'assistant' AND idx % 2 = 1 THEN 'assistant:c1,c2' END AS key,
  length(text) + CASE WHEN idx % 3 = 0 THEN 5 ELSE 0 END AS chars, CASE WHEN length({collapse_sql('text')}) <= 160 THEN {collapse_sql('text')} ELSE substr({collapse_sql('text')}, 1, 159) || '…' END AS preview,
  {glue('text')} AS compact, 16 AS hash_len FROM v_history_old""")
def history_fingerprints(spark, sf):
    calls = F.when((c("type") == "assistant") & (c("idx") % 2 == 1), F.array(F.struct(F.lit("c1").alias("id")), F.struct(F.lit("c2").alias("id"))))
    rec = F.to_json(F.struct(c("type"), F.array(F.struct(F.lit("text").alias("type"), c("text"))).alias("content"), F.when(c("type") == "user", c("idx")).alias("prompt_index"),
                             F.when(c("idx") % 3 == 0, "abcde").alias("encrypted_content"), calls.alias("tool_calls")))
    d = b.v_history(spark, sf, "old").select("session_id", F.lit(0).alias("snapshot_id"), "idx", F.try_parse_json(rec).alias("j"))
    f = h.fingerprints(d)
    return f.select("session_id", "idx", "type", "key", "chars", "preview", "compact", F.length("hash").alias("hash_len"))


@query("reasoning_records", "P44 S3", """
SELECT session_id, idx, 4 + idx AS encrypted_chars, (4 + idx) // 4 AS encrypted_tokens, length(text) + 1 AS summary_chars, (strlen(text) + 1) // 4 AS summary_tokens
FROM v_history_old JOIN (SELECT conv_id AS session_id, max(turn) AS last FROM conversations GROUP BY 1) USING (session_id)
WHERE session_id % 7 <> 0 AND NOT (session_id % 7 = 1 AND idx = 0) AND (session_id % 7 <> 1 OR last > 0)""")
def reasoning_records(spark, sf):
    """Every seventh snapshot is caught mid-write and dropped whole; a bad first line is skipped."""
    hist = b.v_history(spark, sf, "old")
    last = hist.groupBy("session_id").agg(F.max("idx").alias("last"))
    rec = F.to_json(F.struct(F.lit("reasoning").alias("type"), F.repeat(F.lit("e"), (4 + c("idx")).cast("int")).alias("encrypted_content"),
                             F.array(F.struct(c("text")), F.struct(F.lit(".").alias("text"))).alias("summary")))
    g = c("session_id") % 7
    torn = ((g == 0) & (c("idx") == c("last"))) | ((g == 1) & (c("idx") == 0))
    d = hist.join(last, "session_id").select("session_id", F.lit(0).alias("snapshot_id"), c("idx").alias("line_no"),
                                             F.try_parse_json(F.when(torn, F.substring(rec, 1, 20)).otherwise(rec)).alias("j"))
    d = h.drop_mid_write(d)
    return d.select("session_id", c("line_no").alias("idx"), h.reasoning_sizes().alias("s")).select(
        "session_id", "idx", "s.encrypted_chars", "s.encrypted_tokens", "s.summary_chars", "s.summary_tokens")


@query("recap_prompts", "P45 S7", """
SELECT session_id, coalesce(arg_max(text || ' recap', idx) FILTER (type IN ('user', 'system') AND idx % 2 = 0), '') AS prompt FROM v_history_old GROUP BY session_id""")
def recap_prompts(spark, sf):
    x = F.when(c("idx") % 2 == 0, F.concat(c("text"), F.lit(" recap"))).otherwise(F.regexp_replace(F.lower(c("text")), "recap|system-reminder|returning from idle", ""))
    return h.last_recap_prompt(b.v_history(spark, sf, "old").withColumn("text", x))


@query("model_hint_window", "S9", """
SELECT s.session_id, CASE WHEN m LIKE '%4.6%' THEN '4.6' WHEN m LIKE '%4.5%' THEN '4.5' END AS family, m AS first_id
FROM (SELECT session_id, arg_min(model, line_no) AS m FROM v_updates WHERE model IS NOT NULL GROUP BY 1) s""")
def model_hint_window(spark, sf):
    """Every line of a log is asked for a model; the earliest answer counts."""
    from sessionledger.operators.sessions import hint_lines

    d = hint_lines(b.v_updates(spark, sf)).filter(c("model").isNotNull())
    return ll.model_per_session(d.select("session_id", "source_rank", "line_no", F.array("model").alias("ids"))).select("session_id", "family", "first_id")


@query("round_families", "W9", """
WITH f AS (SELECT session_id, round_no, line_no, CASE k % 3 WHEN 0 THEN '4.6' WHEN 1 THEN '4.5' END AS fam FROM v_lines WHERE kind = 'turn_completed'),
g AS (SELECT *, last_value(fam IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM f)
SELECT session_id, round_no, coalesce(held, arg_min(fam, line_no) FILTER (fam IS NOT NULL) OVER (PARTITION BY session_id), '4.5') AS family FROM g""")
def round_families(spark, sf):
    from sessionledger.operators import sessionize as s
    from sessionledger.operators.sessions import round_families as op

    def body(x, g):
        return op(s.assign_rounds(x, g).filter(c("kind") == s.TURN), g)

    return s.by_session(b.v_updates(spark, sf), body).select("session_id", "round_no", "family")


@query("token_counter", "P11 X1", """SELECT doc_id, len(regexp_extract_all(text, '[^ ]+')) AS tokens, strlen(text) // 4 AS estimate FROM documents""")
def token_counter(spark, sf):
    """A caller-supplied counter runs on Arrow batches; the estimate stays an expression."""
    from sessionledger.functions.counting import count_with, words

    return docs(spark, sf).select("doc_id", count_with(words)(c("text")).alias("tokens"), count_with(None)(c("text")).alias("estimate"))
