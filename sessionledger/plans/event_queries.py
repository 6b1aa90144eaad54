"""Misses, compactions, recaps, parent/child accounting and history rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators import anomaly as an
from sessionledger.operators import historydiff as hd
from sessionledger.operators import peel as pl
from sessionledger.operators import sessionize as s
from sessionledger.operators.grouping import skew_safe
from sessionledger.plans import binding as b
from sessionledger.plans.registry import query
from sessionledger.session import materialize

c = F.col

b.VIEWS["v_miss_in"] = """
  SELECT o_orderkey AS round_id, o_orderkey % 31 <> 0 AS completed, o_orderkey % 29 = 0 AS is_first, off_in, off_in * (o_orderkey % 10) // 10 AS off_cache,
    prior, prior + (o_custkey % 50) * 900 AS context_end, CASE WHEN o_orderkey % 37 <> 0 THEN prior * (o_orderkey % 13) // 10 END AS start0,
    CASE WHEN o_orderkey % 41 <> 0 THEN (o_orderkey % 40) * 60000 END AS idle_gap_ms, o_orderkey % 300 AS user_new, o_custkey % 600 AS user_chars
  FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS off_in, (o_custkey % 97) * 1500 AS prior FROM orders)"""
def miss_sql(rounds: str) -> str:
    """Twin of ``anomaly.detect_miss`` over rounds of any source."""
    return f"""
  SELECT *, CASE WHEN miss_kind IS NOT NULL THEN least(prior, extra) END AS reread FROM (
  SELECT *, CASE WHEN completed AND NOT is_first AND off_in > 0 AND prior >= 1000 AND coalesce(start0 >= floor(prior * 0.5), true) THEN CASE
      WHEN off_cache < floor(prior * 0.15) AND off_unc >= floor(prior * 0.5) THEN 'classic_cache_miss'
      WHEN off_unc >= floor(prior * 0.85) AND growth < floor(prior * 0.15) AND holds THEN 'full_context_reread'
      WHEN holds AND extra >= floor(prior * 0.7) AND off_unc >= floor(prior * 0.7) AND growth < floor(prior * 0.4) THEN 'first_call_reread'
      WHEN idle_gap_ms >= 1200000 AND extra >= floor(prior * 0.5) AND growth < floor(prior * 0.3) AND start0 >= floor(prior * 0.5) THEN 'idle_context_reread' END END AS miss_kind
  FROM (SELECT *, greatest(off_unc - growth, 0) AS extra, coalesce(start0 >= floor(prior * 0.85), false) AS holds
    FROM (SELECT *, greatest(off_in - least(off_cache, off_in), 0) AS off_unc, greatest(context_end - prior, 0) AS growth FROM {rounds})))"""


b.VIEWS["v_miss"] = miss_sql("v_miss_in")


def miss_in(spark, sf):
    k = c("o_orderkey")
    o = b.table(spark, sf, "orders").select(k, "o_custkey", F.floor("o_totalprice").cast("long").alias("off_in"), ((c("o_custkey") % 97) * 1500).alias("prior"))
    return o.select(
        k.alias("round_id"), (k % 31 != 0).alias("completed"), (k % 29 == 0).alias("is_first"), "off_in", F.floor(c("off_in") * (k % 10) / 10).cast("long").alias("off_cache"),
        "prior", (c("prior") + (c("o_custkey") % 50) * 900).alias("context_end"), F.when(k % 37 != 0, F.floor(c("prior") * (k % 13) / 10).cast("long")).alias("start0"),
        F.when(k % 41 != 0, (k % 40) * 60000).alias("idle_gap_ms"), (k % 300).alias("user_new"), (c("o_custkey") % 600).alias("user_chars"))


@query("cache_misses", "D1", "SELECT round_id, miss_kind, off_unc, growth, reread FROM v_miss")
def cache_misses(spark, sf):
    return an.detect_miss(miss_in(spark, sf)).select("round_id", "miss_kind", "off_unc", "growth", "reread")


b.VIEWS["v_reattributed"] = """
  SELECT *, greatest(off_unc - reread_in - user_in, 0) AS harness_in, reread_in + user_in + greatest(off_unc - reread_in - user_in, 0) AS tree_in FROM (
  SELECT *, least(CASE WHEN nw > 0 THEN nw WHEN user_chars > 0 THEN greatest(1, user_chars // 4) ELSE 0 END, greatest(off_unc - reread_in, 0)) AS user_in
  FROM (SELECT *, greatest(user_new, CASE WHEN start0 > prior THEN start0 - prior ELSE 0 END) AS nw, least(reread, off_unc) AS reread_in FROM v_miss WHERE miss_kind IS NOT NULL))"""


@query("miss_reattribution", "D2", "SELECT round_id, miss_kind, reread_in, user_in, harness_in, tree_in FROM v_reattributed")
def miss_reattribution(spark, sf):
    d = an.reattribute(an.detect_miss(miss_in(spark, sf)))
    return d.select("round_id", "miss_kind", "reread_in", "user_in", "harness_in", "tree_in")


@query("miss_harness_per_call", "D2 L3", """
WITH x AS (SELECT round_id, call_no, weight AS w, harness_in AS pool, sum(weight) OVER (PARTITION BY round_id) AS s, max(CASE WHEN weight > 0 THEN call_no END) OVER (PARTITION BY round_id) AS last
  FROM v_calls JOIN v_reattributed USING (round_id)),
y AS (SELECT *, CASE WHEN pool > 0 AND w > 0 AND call_no IS DISTINCT FROM last THEN CAST(round_even(pool * w / s, 0) AS BIGINT) ELSE 0 END AS v FROM x)
SELECT round_id, call_no, CAST(CASE WHEN pool <= 0 OR w <= 0 THEN 0 WHEN call_no = last THEN greatest(pool - sum(v) OVER (PARTITION BY round_id), 0) ELSE v END AS BIGINT) AS harness_new FROM y""")
def miss_harness_per_call(spark, sf):
    r = an.reattribute(an.detect_miss(miss_in(spark, sf))).select("round_id", c("harness_in").alias("harness_allowed"))
    d = b.v_calls(spark, sf).select("round_id", "call_no", c("weight").alias("harness_old")).join(r, "round_id")
    return skew_safe(d, ["round_id"], "call_no", an.resplit_harness).select("round_id", "call_no", "harness_new")


b.VIEWS["v_compactions"] = """
  SELECT *, pre_in_usd + pre_cached_usd + out_usd AS cost_usd FROM (
  SELECT x.*, CASE WHEN prev_missed THEN tokens_before ELSE 0 END AS pre_in_tokens, CASE WHEN prev_missed THEN 0 ELSE tokens_before END AS pre_cached_tokens,
    CASE WHEN prev_missed THEN tokens_before * r.ri / 1e6 ELSE 0.0 END AS pre_in_usd, CASE WHEN prev_missed THEN 0.0 ELSE tokens_before * r.rc / 1e6 END AS pre_cached_usd, out_tokens * q.ro / 1e6 AS out_usd
  FROM (SELECT session_id, line_no, agent_ms, k, k * 3000 AS tokens_before, tokens_after, k % 2 = 0 AS prev_missed, CASE WHEN tokens_after > 0 THEN greatest(1, tokens_after - k * 150) ELSE 0 END AS out_tokens,
      CASE WHEN session_id % 2 = 0 THEN '4.6' ELSE '4.5' END AS family FROM v_updates WHERE kind = 'auto_compact_completed') x
  JOIN rate_card r ON r.family = x.family AND greatest(tokens_before, 1) > r.lo AND greatest(tokens_before, 1) <= r.hi
  JOIN rate_card q ON q.family = x.family AND greatest(tokens_after, tokens_before, 1) > q.lo AND greatest(tokens_after, tokens_before, 1) <= q.hi)"""


def compactions(spark, sf):
    d = b.v_updates(spark, sf).filter(c("kind") == s.COMPACT).select(
        "session_id", "line_no", "agent_ms", "k", (c("k") * 3000).alias("tokens_before"), "tokens_after", (c("k") % 2 == 0).alias("prev_missed"),
        (c("k") * 150).alias("reload_tokens"), F.when(c("session_id") % 2 == 0, "4.6").otherwise("4.5").alias("family"))
    return an.compaction_cards(d)


@query("compaction_bills", "D3", f"SELECT session_id, line_no, pre_in_tokens, pre_cached_tokens, out_tokens, {b.r8('out_usd')} AS out_usd, {b.r8('cost_usd')} AS cost_usd FROM v_compactions")
def compaction_bills(spark, sf):
    return compactions(spark, sf).select("session_id", "line_no", "pre_in_tokens", "pre_cached_tokens", "out_tokens", *[p.gold(c(x), 8).alias(x) for x in ("out_usd", "cost_usd")])


@query("deferred_reloads", "D4", """
SELECT round_id, reload AS reload_tokens, greatest(caused - reload, 0) AS call_in_left FROM (
  SELECT round_id, caused, CASE WHEN caused > 0 THEN least(raw, caused) ELSE raw END AS reload FROM (
    SELECT round_id, start % 5000 AS caused, CASE WHEN weight * 50 > greatest(w_emit, 1) * 3 THEN greatest(weight * 50 - w_emit, 0) ELSE greatest(start % 5000 - w_tool, 0) END AS raw FROM v_calls WHERE call_no = 1))""")
def deferred_reloads(spark, sf):
    d = b.v_calls(spark, sf).filter(c("call_no") == 1).select("round_id", (c("start") % 5000).alias("caused_in"), (c("weight") * 50).alias("emit_delta"), c("w_emit").alias("arg_tokens"), c("w_tool").alias("tool_in"))
    return an.deferred_reload(d).select("round_id", "reload_tokens", "call_in_left")


_CTX = "CASE WHEN kind IN ('agent_thought_chunk','agent_message_chunk','tool_call','tool_call_update') THEN context_tokens WHEN kind = 'auto_compact_completed' THEN tokens_after END"
b.VIEWS["v_recaps"] = f"""
  SELECT *, prompt_usd + cached_usd + out_usd AS cost_usd FROM (
  SELECT x.*, prompt_tokens * ri / 1e6 AS prompt_usd, coalesce(context_now, 0) * rc / 1e6 AS cached_usd, out_tokens * ro / 1e6 AS out_usd
  FROM (SELECT session_id, line_no, agent_ms, context_now, k + 300 AS prompt_tokens, chars AS out_tokens, CASE WHEN session_id % 2 = 0 THEN '4.6' ELSE '4.5' END AS family
    FROM (SELECT *, last_value({_CTX} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_now FROM v_updates) WHERE kind = 'session_recap') x
  JOIN rate_card r ON r.family = x.family AND coalesce(context_now, 0) + prompt_tokens > lo AND coalesce(context_now, 0) + prompt_tokens <= hi)"""


def recaps(spark, sf):
    d = s.by_session(b.v_updates(spark, sf), an.context_as_of).filter(c("kind") == s.RECAP).select(
        "session_id", "line_no", "agent_ms", "context_now", (c("k") + 300).alias("prompt_tokens"), c("chars").alias("out_tokens"), F.when(c("session_id") % 2 == 0, "4.6").otherwise("4.5").alias("family"))
    return an.recap_cards(d)


@query("recap_bills", "D5", f"SELECT session_id, line_no, context_now, {b.r8('prompt_usd')} AS prompt_usd, {b.r8('cached_usd')} AS cached_usd, {b.r8('out_usd')} AS out_usd, {b.r8('cost_usd')} AS cost_usd FROM v_recaps")
def recap_bills(spark, sf):
    return recaps(spark, sf).select("session_id", "line_no", "context_now", *[p.gold(c(x), 8).alias(x) for x in ("prompt_usd", "cached_usd", "out_usd", "cost_usd")])


@query("recap_requests", "J12", """
WITH r AS (SELECT doc_id AS line_no, source AS session_id, trim(CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 30) ELSE text END) AS a FROM documents),
q AS (SELECT doc_id AS request_id, source AS session_id, doc_id % 7 AS mtime, trim(CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 45) WHEN 1 THEN substr(text, 1, 200) ELSE text END) AS b FROM documents)
SELECT r.session_id, line_no, arg_max(request_id, mtime * 1000000000 + request_id) AS request_id FROM r JOIN q ON r.session_id = q.session_id AND length(a) > 0 AND length(b) > 0
  AND (starts_with(b, a) OR starts_with(a, b)) GROUP BY ALL""")
def recap_requests(spark, sf):
    x = c("text")
    d = b.table(spark, sf, "documents")
    r = d.select(c("doc_id").alias("line_no"), c("source").alias("session_id"), F.when(c("doc_id") % 3 == 0, F.substring(x, 1, 30)).otherwise(x).alias("summary"))
    q = d.select(c("doc_id").alias("request_id"), c("source").alias("session_id"), (c("doc_id") % 7).alias("mtime"),
                 F.when(c("doc_id") % 4 == 0, F.substring(x, 1, 45)).when(c("doc_id") % 4 == 1, F.substring(x, 1, 200)).otherwise(x).alias("summary"))
    return an.match_requests(r, q)


SIDE_SQL = """
SELECT session_id, line_no, kind, b4 > 0 AS mid_round, CASE WHEN round_no > 1 THEN round_no - 1 END AS after_round, CASE WHEN b4 = 0 AND aft > 0 THEN round_no END AS before_round, CASE WHEN b4 > 0 THEN round_no END AS in_round
FROM (SELECT *, count(*) FILTER (kind NOT IN ('auto_compact_completed','session_recap','hook_execution')) OVER (PARTITION BY session_id, round_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4,
  count(*) FILTER (kind NOT IN ('auto_compact_completed','session_recap','hook_execution')) OVER (PARTITION BY session_id, round_no ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft FROM v_lines)
WHERE kind IN ('auto_compact_completed','session_recap')"""


@query("side_event_rounds", "J15 T3", f"{SIDE_SQL} ORDER BY session_id, agent_ms DESC")
def side_event_rounds(spark, sf):
    d = an.trigger_order(s.by_session(b.v_updates(spark, sf), an.attach_cards))
    return d.select("session_id", "line_no", "kind", "mid_round", "after_round", "before_round", "in_round")


# ---- parents and children --------------------------------------------------------------
b.VIEWS["v_waits"] = """
  SELECT session_id, round_no, call_no, line_no, session_id + 1 AS child_id FROM v_call_lines WHERE kind = 'tool_call' AND k % 10 = 0 AND session_id % 5 = 3"""
_CNT = ["input", "output", "reasoning", "cached", "total", "ticks", "api_ms", "calls"]


def wait_lines(spark, sf):
    d = s.by_session(b.v_updates(spark, sf), lambda x, g: s.assign_calls(s.assign_rounds(x, g), g))
    return d.filter((c("kind") == "tool_call") & (c("k") % 10 == 0) & (c("session_id") % 5 == 3)).select(
        "session_id", "round_no", "call_no", "line_no", (c("session_id") + 1).alias("child_id"))


@query("peeled_rounds", "J10", f"""
WITH fw AS (SELECT session_id, child_id, arg_min(round_no, line_no) AS round_no FROM v_waits GROUP BY ALL),
cu AS (SELECT session_id AS child_id, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in _CNT)} FROM v_turns GROUP BY 1),
tk AS (SELECT fw.session_id, round_no, count(*) AS children, {', '.join(f'CAST(sum({x}) AS BIGINT) AS c_{x}' for x in _CNT)} FROM fw JOIN cu USING (child_id) WHERE input > 0 OR calls > 0 GROUP BY ALL)
SELECT session_id, round_no, coalesce(children, 0) AS children, {', '.join(f'greatest(0, {x} - coalesce(c_{x}, 0)) AS {x}' for x in _CNT)}
FROM (SELECT * FROM v_lines WHERE kind = 'turn_completed') LEFT JOIN tk USING (session_id, round_no)""")
def peeled_rounds(spark, sf):
    lines = b.v_updates(spark, sf)
    turns = s.by_session(lines, s.assign_rounds).filter(c("kind") == s.TURN).select("session_id", "round_no", *_CNT)
    child = b.v_turns(spark, sf).groupBy(c("session_id").alias("child_id")).agg(*p.official_usage_sums())
    taken = pl.first_waits(wait_lines(spark, sf)).join(child, "child_id")
    return pl.peel_rounds(turns, taken).select("session_id", "round_no", "children", *_CNT)


@query("peel_increments", "J10 ST5", f"""
WITH w AS (SELECT w.*, {', '.join(f'(SELECT CAST(coalesce(sum({x}), 0) AS BIGINT) FROM v_turns t WHERE t.session_id = w.child_id AND t.line_no < w.line_no) AS {x}' for x in _CNT)} FROM v_waits w)
SELECT session_id, child_id, line_no, {', '.join(f'greatest(0, {x} - coalesce(lag({x}) OVER (PARTITION BY session_id, child_id ORDER BY line_no), 0)) AS {x}' for x in _CNT)} FROM w""")
def peel_increments(spark, sf):
    """What the child had used by the time of each wait, minus what earlier waits took."""
    from sessionledger.operators.grouping import Run

    w = wait_lines(spark, sf).select("session_id", "line_no", "child_id")
    t = b.v_turns(spark, sf).select(c("session_id").alias("child_id"), "line_no", *_CNT)
    both = w.withColumn("wait", F.lit(True)).unionByName(t.withColumn("wait", F.lit(False)), allowMissingColumns=True)
    cum = skew_safe(both, ["child_id"], "line_no", lambda x, g: g.running(x, {f"cum_{y}": Run("sum", c(y)) for y in _CNT}))
    cum = materialize(cum.filter("wait")).select("session_id", "child_id", "line_no", *[c(f"cum_{y}").alias(y) for y in _CNT])
    return skew_safe(cum, ["session_id", "child_id"], "line_no", pl.increments).select("session_id", "child_id", "line_no", *_CNT)


b.VIEWS["v_child_cards"] = """
  SELECT session_id, round_no, child_id, coalesce(c0, last_call) AS call_no, c0 IS NOT NULL AS waited,
    row_number() OVER (PARTITION BY session_id, round_no ORDER BY coalesce(l0, first_line + 1099511627776)) AS n
  FROM (SELECT session_id, round_no, child_id, min(line_no) AS first_line, min(call_no) FILTER (wait) AS c0, min(line_no) FILTER (wait) AS l0 FROM (
      SELECT session_id, round_no, call_no, line_no, session_id + 1 AS child_id, true AS wait FROM v_call_lines WHERE kind = 'tool_call' AND k % 10 = 0
      UNION ALL SELECT session_id, round_no, call_no, line_no, session_id + 1 + k % 3, false FROM v_call_lines WHERE kind = 'tool_call' AND k % 10 = 1) GROUP BY ALL)
  JOIN (SELECT session_id, round_no, max(call_no) AS last_call FROM v_call_lines WHERE in_call GROUP BY ALL) USING (session_id, round_no)"""


def child_cards(spark, sf):
    d = s.by_session(b.v_updates(spark, sf), lambda x, g: s.assign_calls(s.assign_rounds(x, g), g)).filter(c("kind").isin(s.CALL_KINDS))
    tool = d.filter(c("kind") == "tool_call")
    cols = ["session_id", "round_no", "call_no", "line_no", "child_id"]
    waits = tool.filter(c("k") % 10 == 0).withColumn("child_id", c("session_id") + 1).select(*cols)
    spawns = tool.filter(c("k") % 10 == 1).withColumn("child_id", c("session_id") + 1 + c("k") % 3).select(*cols)
    kids = materialize(pl.distinct_children(waits.unionByName(spawns), ["session_id", "round_no"]))
    last = d.groupBy("session_id", "round_no").agg(F.max("call_no").alias("last_call"))
    return skew_safe(kids, ["session_id", "round_no"], "line_no", lambda x, g: pl.place_cards(waits, x, last, g))


@query("child_cards", "J11 U2", "SELECT session_id, round_no, child_id, call_no, waited, n, 'Sub Agent ' || n AS label FROM v_child_cards")
def child_card_rows(spark, sf):
    return child_cards(spark, sf).select("session_id", "round_no", "child_id", "call_no", "waited", "n", "label")


# ---- history rewrites -----------------------------------------------------------------
def snaps(spark, sf):
    from sessionledger.functions.text import is_compact_glue, preview_collapsed

    def shape(which):
        return b.v_history(spark, sf, which).withColumns({
            "chars": F.length("text").cast("long"), "preview": preview_collapsed(c("text"), 160), "compact": is_compact_glue(c("text"))}).drop("text")

    return shape("old"), shape("new")


b.VIEWS["v_diff"] = """
  SELECT *, CASE WHEN kind NOT IN ('unchanged', 'append') THEN prefix END AS cache_break_index FROM (
  SELECT *, CASE WHEN prefix = old_n AND new_n = old_n THEN 'unchanged' WHEN prefix = old_n AND new_n > old_n THEN 'append'
      WHEN new_n < old_n AND prefix = new_n AND prefix > last_user THEN 'tail' WHEN new_n < old_n AND prefix = new_n THEN 'truncate' WHEN prefix > last_user THEN 'tail' ELSE 'mutate' END AS kind
  FROM (SELECT session_id, count(o.hash) AS old_n, count(n.hash) AS new_n, coalesce(min(CASE WHEN o.hash IS DISTINCT FROM n.hash THEN idx END), count(o.hash)) AS prefix,
      coalesce(max(CASE WHEN o.type = 'user' THEN idx END), -1) AS last_user
    FROM v_history_old o FULL JOIN v_history_new n USING (session_id, idx) GROUP BY session_id))"""


@query("snapshot_kinds", "D6 J13 W16", "SELECT session_id, old_n, new_n, prefix, last_user, kind, cache_break_index FROM v_diff")
def snapshot_kinds(spark, sf):
    return hd.compare_snapshots(*snaps(spark, sf)).select("session_id", "old_n", "new_n", "prefix", "last_user", "kind", "cache_break_index")


@query("common_prefixes", "U5", "SELECT o.session_id, o.idx, o.hash FROM v_history_old o JOIN v_history_new n USING (session_id, idx, hash) JOIN v_diff d ON d.session_id = o.session_id WHERE o.idx < prefix")
def common_prefixes(spark, sf):
    o, n = snaps(spark, sf)
    return hd.common_prefix(o, n, hd.compare_snapshots(o, n))


# Matching by key (unique per snapshot here) first, then by position where the old row has no key.
b.VIEWS["v_changes"] = """
  WITH o AS (SELECT h.* FROM v_history_old h JOIN v_diff USING (session_id) WHERE idx >= prefix AND kind <> 'unchanged'),
  n AS (SELECT h.* FROM v_history_new h JOIN v_diff USING (session_id) WHERE idx >= prefix AND kind <> 'unchanged'),
  nk AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY idx) AS occ FROM n WHERE key IS NOT NULL), ok AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY idx) AS occ FROM o WHERE key IS NOT NULL),
  km AS (SELECT ok.session_id, ok.idx AS oi, nk.idx AS ni, ok.hash AS oh, nk.hash AS nh, nk.type, nk.key, length(ok.text) AS oc, length(nk.text) AS nc FROM ok JOIN nk USING (session_id, key, occ)),
  nf AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM km WHERE km.session_id = n.session_id AND km.ni = n.idx)),
  pm AS (SELECT o.session_id, o.idx AS oi, nf.idx AS ni, o.hash AS oh, nf.hash AS nh, nf.type, nf.key, length(o.text) AS oc, length(nf.text) AS nc FROM nf JOIN o ON o.session_id = nf.session_id AND o.idx = nf.idx AND o.key IS NULL)
  SELECT session_id, 'edit' AS op, oi AS idx, type, key, oc AS old_chars, nc AS new_chars FROM (SELECT * FROM km UNION ALL SELECT * FROM pm) WHERE oh <> nh
  UNION ALL SELECT session_id, 'insert', idx, type, key, NULL, length(text) FROM nf WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.session_id = nf.session_id AND pm.ni = nf.idx)
  UNION ALL SELECT session_id, 'delete', idx, type, key, length(text), NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM km WHERE km.session_id = o.session_id AND km.oi = o.idx)
    AND NOT EXISTS (SELECT 1 FROM pm WHERE pm.session_id = o.session_id AND pm.oi = o.idx)"""


@query("history_changes", "J14 T4", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx, op) AS change_no FROM v_changes")
def history_changes(spark, sf):
    o, n = snaps(spark, sf)
    d = hd.numbered_changes(hd.align_changes(o, n, hd.compare_snapshots(o, n)))
    return d.select("session_id", "op", "idx", "type", "key", "old_chars", "new_chars", "change_no")


@query("new_compaction_records", "J16", """SELECT session_id, idx, hash FROM v_history_new n WHERE lower(text) LIKE '%ran out of context%'
AND NOT EXISTS (SELECT 1 FROM v_history_old o WHERE o.session_id = n.session_id AND o.hash = n.hash)""")
def new_compaction_records(spark, sf):
    return hd.new_glue(*snaps(spark, sf)).select("session_id", "idx", "hash")


HISTORY_DIFF_SQL = """
SELECT d.session_id, kind, old_n, new_n, prefix, cache_break_index, CASE WHEN kind = 'append' THEN greatest(new_n - old_n, 0) ELSE coalesce(ins, 0) END AS added, coalesce(del, 0) AS removed, coalesce(ed, 0) AS changed,
  CASE WHEN kind IN ('unchanged', 'append') THEN NULL WHEN g > 0 THEN 'compact glue' END AS compact_why, CASE WHEN kind IN ('unchanged', 'append') THEN false ELSE coalesce(g > 0, false) END AS from_compact
FROM v_diff d LEFT JOIN (SELECT session_id, count(*) FILTER (op = 'insert') AS ins, count(*) FILTER (op = 'delete') AS del, count(*) FILTER (op = 'edit') AS ed FROM v_changes GROUP BY 1) USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS g FROM v_history_new WHERE lower(text) LIKE '%ran out of context%' GROUP BY 1) USING (session_id)"""


@query("history_diffs", "A14 D6", HISTORY_DIFF_SQL)
def history_diffs(spark, sf):
    d = hd.diff_summary(*snaps(spark, sf))
    return d.select("session_id", "kind", "old_n", "new_n", "prefix", "cache_break_index", "added", "removed", "changed", "compact_why", "from_compact")


@query("rewrite_counters", "A15 T4", """
SELECT session_id, count(*) FILTER (kind = 'append') AS append, count(*) FILTER (kind = 'mutate') AS mutate, count(*) FILTER (kind = 'tail') AS tail, count(*) FILTER (kind = 'truncate') AS truncate,
  count(*) FILTER (kind IN ('mutate', 'truncate')) AS mutations FROM v_diff GROUP BY 1""")
def rewrite_counters(spark, sf):
    return hd.watch_counters(hd.compare_snapshots(*snaps(spark, sf)))
