"""Cost categories and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators import period as per
from sessionledger.operators import segments as sg
from sessionledger.operators.grouping import skew_safe
from sessionledger.plans import allocation_queries as aq
from sessionledger.plans import binding as b
from sessionledger.plans import event_queries as eq
from sessionledger.plans.pricing_queries import priced
from sessionledger.plans.registry import query

c = F.col
DAY = 86_400_000
OUT = f"key, k, label, {b.r8('usd')} AS usd, round(tok, 4) AS tok"


def out(d, *keys):
    return d.select(*keys, "key", "k", "label", p.gold(c("usd"), 8).alias("usd"), F.round("tok", 4).alias("tok"))


def unpivot(rows, keep, src):
    return " UNION ALL ".join(f"SELECT {keep}, {key} AS key, '{k}' AS k, '{lab}' AS label, CAST({usd} AS DOUBLE) AS usd, CAST({tok} AS DOUBLE) AS tok FROM {src}" for key, k, lab, usd, tok in rows)


_PARTS = [("'user'", "user", "user", "user_usd", "user_unc"), ("'harness'", "harness", "harness", "harness_usd", "harness_tokens"), ("'thought'", "thought", "thought", "thought_usd", "thought_tokens"),
          ("'reasoning'", "reasoning", "reasoning", "reasoning_usd", "reasoning_tokens"), ("'toolreq:tool req'", "toolreq", "tool req", "out_to_harness_usd", "out_to_harness_tokens"),
          ("'message'", "message", "message", "out_to_user_usd", "out_to_user_tokens"), ("'cached'", "cached", "Cached", "cached_usd", "cached_tokens")]
b.VIEWS["v_parts"] = f"SELECT * FROM ({unpivot(_PARTS, 'round_id', 'v_prompts')}) WHERE usd > 0 OR tok > 0"


@query("round_parts", "G1 P31", f"SELECT round_id, {OUT} FROM v_parts")
def round_parts(spark, sf):
    return out(sg.round_parts(aq.prompts(spark, sf).withColumn("user_in", c("user_unc")), ["round_id"]), "round_id")


_IO = [("'in'", "in", "In", "tree_usd", "tree_tok"), ("'cached'", "cached", "Cached", "cached_usd", "cached_tokens"), ("'out'", "out", "Out", "CASE WHEN tree_usd + cached_usd + output_usd > 0 THEN output_usd ELSE api_usd END", "output_tokens")]


@query("round_io", "G5", f"""SELECT round_id, {OUT} FROM ({unpivot(_IO, 'round_id', '(SELECT *, reread_usd + user_usd + harness_usd AS tree_usd, coalesce(reread, 0) + user_unc + harness_tokens AS tree_tok FROM v_prompts)')}
  UNION ALL SELECT round_id, 'system', 'system', 'system', system_usd, CAST(system_unc AS DOUBLE) FROM v_prompts WHERE cold) WHERE usd > 0 OR tok > 0""")
def round_io(spark, sf):
    from sessionledger.operators.reconstruct import round_tree

    d = round_tree(aq.prompts(spark, sf))
    return out(sg.round_io(d, ["round_id"], system=True), "round_id")


b.VIEWS["v_tool_segs"] = f"""
  SELECT round_id, key, any_value(k) AS k, any_value(label) AS label, sum(usd) AS usd, sum(tok) AS tok FROM (
    SELECT round_id, CASE kind WHEN 'llm_to_in' THEN 'llm_out_in' WHEN 'tool' THEN 'tool:' || name WHEN 'tool_request' THEN 'toolreq:' || name ELSE kind END AS key,
      CASE kind WHEN 'llm_to_in' THEN 'llm_out_in' WHEN 'tool_request' THEN 'toolreq' ELSE kind END AS k, CASE kind WHEN 'llm_to_in' THEN 'LLM Out→In' WHEN 'tool' THEN name WHEN 'tool_request' THEN name ELSE kind END AS label, usd, CAST(tokens AS DOUBLE) AS tok FROM v_nodes
    UNION ALL SELECT round_id, 'cached', 'cached', 'Cached', cache_usd, CAST(cache AS DOUBLE) FROM v_recon
    UNION ALL SELECT round_id, 'user', 'user', 'user', user_usd, CAST(user_unc AS DOUBLE) FROM v_prompts) WHERE usd > 0 OR tok > 0 GROUP BY round_id, key"""


def tool_segments(spark, sf):
    """Reconstructed calls are read three times (nodes, Cached, prompts): written once."""
    from sessionledger.operators import reconstruct as r
    from sessionledger.session import materialize

    calls = materialize(aq.reconstructed(spark, sf))
    nodes = skew_safe(calls, ["round_id"], "call_no", lambda x, g: r.call_nodes(x, aq.call_tools(spark, sf), ["round_id", "call_no"], g.sub("call_no").reorder("tool_no")))
    first = calls.filter(c("i") == 1).select("round_id", c("user_unc").alias("user_in"), p.price_tokens("input", c("user_unc"), c("family"), F.greatest(c("start"), F.lit(1))).alias("user_usd"))
    return sg.round_tools(calls, nodes, first, ["round_id"])


@query("round_tools", "G2 A8 P30", f"SELECT round_id, {OUT} FROM v_tool_segs")
def round_tools(spark, sf):
    return out(tool_segments(spark, sf), "round_id")


@query("folded_stacks", "G4", f"""
SELECT stack, round_id, {OUT} FROM (
  SELECT 'io' AS stack, round_id, kk AS key, kk AS k, any_value(CASE kk WHEN 'cached' THEN 'Cached' WHEN 'in' THEN 'In' ELSE 'Out' END) AS label, sum(usd) AS usd, sum(tok) AS tok
  FROM (SELECT *, CASE WHEN k = 'cached' THEN 'cached' WHEN k IN ('in','user','harness','tool','llm_out_in','residual') THEN 'in' ELSE 'out' END AS kk FROM v_tool_segs) GROUP BY round_id, kk
  UNION ALL SELECT 'parts', round_id, kk, any_value(CASE WHEN k IN ('tool','llm_out_in') THEN 'harness' ELSE k END), any_value(CASE WHEN k IN ('tool','llm_out_in') THEN 'harness' WHEN k = 'toolreq' THEN 'tool req' ELSE label END), sum(usd), sum(tok)
  FROM (SELECT *, CASE WHEN k IN ('tool','llm_out_in') THEN 'harness' WHEN k = 'toolreq' THEN 'toolreq' ELSE key END AS kk FROM v_tool_segs) GROUP BY round_id, kk)""")
def folded_stacks(spark, sf):
    from sessionledger.session import materialize

    t = materialize(tool_segments(spark, sf))
    d = sg.fold_io(t, ["round_id"]).withColumn("stack", F.lit("io")).unionByName(sg.fold_parts(t, ["round_id"]).withColumn("stack", F.lit("parts")))
    return out(d, "stack", "round_id")


_RIO = [("'in'", "in", "In", "prompt_usd", "prompt_tokens"), ("'cached'", "cached", "Cached", "cached_usd", "coalesce(context_now, 0)"), ("'out'", "out", "Out", "out_usd", "out_tokens")]
_CIO = [("'in'", "in", "In", "pre_in_usd", "pre_in_tokens"), ("'cached'", "cached", "Cached", "pre_cached_usd", "pre_cached_tokens"), ("'out'", "out", "Out", "out_usd", "out_tokens")]
_RP = [("'recap'", "recap", "recap", "cost_usd", "prompt_tokens + coalesce(context_now, 0) + out_tokens")]
_CP = [("'compact'", "compact", "compact", "cost_usd", "tokens_before + out_tokens")]
b.VIEWS["v_side_segs"] = f"""SELECT * FROM (SELECT 'io' AS stack, * FROM ({unpivot(_RIO, 'session_id, line_no, agent_ms', 'v_recaps')}) UNION ALL SELECT 'io', * FROM ({unpivot(_CIO, 'session_id, line_no, agent_ms', 'v_compactions')})
  UNION ALL SELECT 'parts', * FROM ({unpivot(_RP, 'session_id, line_no, agent_ms', 'v_recaps')}) UNION ALL SELECT 'parts', * FROM ({unpivot(_CP, 'session_id, line_no, agent_ms', 'v_compactions')})) WHERE usd > 0 OR tok > 0"""


@query("side_event_segments", "G3", f"SELECT stack, session_id, line_no, {OUT} FROM v_side_segs")
def side_event_segments(spark, sf):
    keep = ["session_id", "line_no"]
    r, k = eq.recaps(spark, sf), eq.compactions(spark, sf)
    d = sg.recap_io(r, keep).unionByName(sg.compaction_io(k, keep)).withColumn("stack", F.lit("io")).unionByName(
        sg.recap_parts(r, keep).unionByName(sg.compaction_parts(k, keep)).withColumn("stack", F.lit("parts")))
    return out(d, "stack", "session_id", "line_no")


@query("child_segments", "G6", f"""
SELECT session_id, round_no, 'sub:' || child_id AS key, 'sub' AS k, 'S' || n AS label, {b.r8('CASE WHEN o > 0 THEN o ELSE e END')} AS usd, CAST(tok AS DOUBLE) AS tok
FROM v_child_cards JOIN (SELECT session_id AS child_id, sum(official_usd) AS o, sum(estimate_usd) AS e, CAST(sum(tokens_in + tokens_cached + tokens_out) AS BIGINT) AS tok FROM v_priced GROUP BY 1) USING (child_id)""")
def child_segments(spark, sf):
    bill = priced(spark, sf).groupBy(c("session_id").alias("child_id")).agg(*[F.sum(x).alias(x) for x in ("official_usd", "estimate_usd", "tokens_in", "tokens_cached", "tokens_out")])
    d = sg.child_segments(eq.child_cards(spark, sf).join(bill, "child_id"), ["session_id", "round_no"])
    return out(d.drop("child_id"), "session_id", "round_no")


_TIO = [("'in'", "in", "In", "cost_in_usd", "tokens_in"), ("'cached'", "cached", "Cached", "cost_cached_usd", "tokens_cached"), ("'out'", "out", "Out", "cost_out_usd", "tokens_out")]
b.VIEWS["v_timeline"] = f"""SELECT 'round' AS event, * FROM ({unpivot(_TIO, 'session_id, event_ms', 'v_priced')}) WHERE usd > 0 OR tok > 0
  UNION ALL SELECT CASE WHEN k = 'recap' THEN 'recap' ELSE 'compaction' END, session_id, agent_ms, key, k, label, usd, tok FROM v_side_segs WHERE stack = 'parts'"""


def timeline(spark, sf):
    keep = ["session_id", "event_ms"]
    turns = sg.explode_segments(priced(spark, sf), keep, [sg.seg("in", "In", c("cost_in_usd"), c("tokens_in")), sg.seg("cached", "Cached", c("cost_cached_usd"), c("tokens_cached")), sg.seg("out", "Out", c("cost_out_usd"), c("tokens_out"))])
    r = sg.recap_parts(eq.recaps(spark, sf).withColumnRenamed("agent_ms", "event_ms"), keep)
    k = sg.compaction_parts(eq.compactions(spark, sf).withColumnRenamed("agent_ms", "event_ms"), keep)
    return sg.event_list(turns, r, k)


@query("cost_timeline", "G7 U1", f"SELECT event, session_id, event_ms, {OUT} FROM v_timeline")
def cost_timeline(spark, sf):
    return out(timeline(spark, sf), "event", "session_id", "event_ms")


b.VIEWS["v_cat_sums"] = f"""
  SELECT key, bucket_ms, any_value(k) AS k, any_value(label) AS label, sum(usd) AS usd, sum(tok) AS tok FROM (SELECT *, event_ms // {DAY} * {DAY} AS bucket_ms FROM v_timeline WHERE session_id % 5 <> 4)
  GROUP BY GROUPING SETS ((key, bucket_ms), (key))"""


def bucketed(spark, sf):
    return timeline(spark, sf).filter(c("session_id") % 5 != 4).withColumn("bucket_ms", (F.floor(c("event_ms") / DAY) * DAY).cast("long"))


@query("category_sums", "A6 F9 C4 T5", f"SELECT bucket_ms, {OUT} FROM v_cat_sums WHERE usd > 0 OR tok > 0 ORDER BY bucket_ms, key")
def category_sums(spark, sf):
    return sg.category_sums(bucketed(spark, sf), "bucket_ms").select("bucket_ms", "key", "k", "label", "usd", "tok")


@query("label_totals", "A7 F12 T5", f"""
SELECT key, label, CAST(CASE key WHEN 'in' THEN 6 WHEN 'cached' THEN 8 WHEN 'out' THEN 15 WHEN 'recap' THEN 17 WHEN 'compact' THEN 18 END AS BIGINT) AS rank, {b.r8('usd')} AS usd, round(tok, 4) AS tok, round(tok, 4) AS measure
FROM (SELECT key, any_value(label) AS label, sum(usd) AS usd, sum(tok) AS tok FROM v_timeline WHERE key <> 'cached' GROUP BY key) ORDER BY rank""")
def label_totals(spark, sf):
    d = sg.label_totals(timeline(spark, sf), ["Cached"], "tokens")
    return d.select("key", "label", "rank", p.gold(c("usd"), 8).alias("usd"), F.round("tok", 4).alias("tok"), F.round("measure", 4).alias("measure"))


@query("cumulative_buckets", "W12", f"""
WITH g AS (SELECT * FROM (SELECT DISTINCT event_ms // {DAY} * {DAY} AS bucket_ms FROM v_priced) CROSS JOIN (SELECT DISTINCT key FROM v_cat_sums)),
v AS (SELECT g.key, g.bucket_ms, coalesce(usd, 0) AS usd, coalesce(tok, 0) AS tok FROM g LEFT JOIN v_cat_sums s ON s.key = g.key AND s.bucket_ms = g.bucket_ms)
SELECT key, bucket_ms, {b.r6('sum(usd) OVER (PARTITION BY key ORDER BY bucket_ms)')} AS cum_usd, CAST(sum(tok) OVER (PARTITION BY key ORDER BY bucket_ms) AS BIGINT) AS cum_tok FROM v""")
def cumulative_buckets(spark, sf):
    from sessionledger.operators.grouping import PlainGroups

    sums = sg.merge(bucketed(spark, sf), ["bucket_ms"])
    spine = priced(spark, sf).select((F.floor(c("event_ms") / DAY) * DAY).cast("long").alias("bucket_ms"))
    d = sg.cumulative_categories(sums, spine, "bucket_ms", lambda x: PlainGroups(["key"], "bucket_ms"))
    return d.select("key", "bucket_ms", p.gold(c("cum_usd")).alias("cum_usd"), c("cum_tok").cast("long").alias("cum_tok"))


@query("cumulative_usage", "W12", f"""
SELECT bucket_ms, CAST(sum(tin) OVER (ORDER BY bucket_ms) AS BIGINT) AS cum_tokens_in, CAST(sum(tout) OVER (ORDER BY bucket_ms) AS BIGINT) AS cum_tokens_out, {b.r6('sum(usd) OVER (ORDER BY bucket_ms)')} AS cum_official_usd
FROM (SELECT event_ms // 3600000 * 3600000 AS bucket_ms, sum(tokens_in) AS tin, sum(tokens_out) AS tout, sum(official_usd) AS usd FROM v_billed GROUP BY 1)""")
def cumulative_usage(spark, sf):
    """Buckets are at most one row per hour of the period, far fewer than turns."""
    from sessionledger.operators.grouping import PlainGroups

    d = priced(spark, sf).filter(c("session_id") % 5 != 4).groupBy((F.floor(c("event_ms") / 3_600_000) * 3_600_000).cast("long").alias("bucket_ms")).agg(*per.usage_sums())
    d = sg.cumulative(d.withColumn("all", F.lit(0)), PlainGroups(["all"], "bucket_ms"), ["tokens_in", "tokens_out", "official_usd"])
    return d.select("bucket_ms", "cum_tokens_in", "cum_tokens_out", p.gold(c("cum_official_usd")).alias("cum_official_usd"))
