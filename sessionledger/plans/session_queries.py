"""Session headers, hierarchy, lifetimes and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.functions import text as t
from sessionledger.operators import sessions as o
from sessionledger.operators.grouping import PlainGroups, skew_safe
from sessionledger.plans import binding as b
from sessionledger.plans.pricing_queries import priced
from sessionledger.plans.registry import query
from sessionledger.plans.text_queries import uuid, uuid_sql

c = F.col
DAY10, DAY13 = 1704844800000, 1705104000000  # a three-day window inside the event table
TITLE = """CASE WHEN length(ti) > 40 THEN substr(ti, 1, 37) || '…' ELSE ti END"""
b.VIEWS["v_titles"] = f"""
  SELECT *, {TITLE} AS title FROM (SELECT *, coalesce(nullif(trim(session_summary), ''), nullif(trim(generated_title), ''),
    CASE WHEN session_id % 11 = 0 THEN agent_name END, regexp_extract(replace(trim(cwd), chr(92), '/'), '([^/]+)/*$', 1)) AS ti FROM v_sessions)"""
b.VIEWS["v_life"] = """
  SELECT s.*, least(lo, created_ms) AS first_ms, CASE WHEN active_ms IS NULL THEN hi ELSE greatest(hi, active_ms) END AS last_ms
  FROM v_sessions s LEFT JOIN (SELECT session_id, min(agent_ms) AS lo, max(agent_ms) AS hi FROM v_updates GROUP BY 1) USING (session_id)"""


@query("session_titles", "P32 J5", """SELECT session_id, title, CASE WHEN session_kind = 'subagent' AND agent_name IS NOT NULL AND agent_name <> 'general-purpose'
  AND NOT contains(title, agent_name) THEN agent_name || ' · ' || title ELSE title END AS shown FROM v_titles""")
def session_titles(spark, sf):
    s = b.v_sessions(spark, sf)
    null = F.lit(None).cast("string")
    title = o.session_title(c("session_summary"), c("generated_title"), null, F.when(c("session_id") % 11 == 0, c("agent_name")), c("cwd"), c("session_id").cast("string"), 40)
    d = s.withColumn("title", title)
    return d.select("session_id", "title", o.child_title(c("title"), c("session_kind"), c("agent_name")).alias("shown"))


@query("updates_with_session", "J5 F3", """SELECT line_no, kind, session_kind, agent_name FROM v_updates JOIN v_sessions USING (session_id)
WHERE session_kind IS NULL OR session_kind <> 'subagent'""")
def updates_with_session(spark, sf):
    """Headers are one row per session; Spark broadcasts them only when they are small enough."""
    s = b.v_sessions(spark, sf).filter(F.coalesce("session_kind", F.lit("")) != "subagent")
    return b.v_updates(spark, sf).join(s, "session_id").select("line_no", "kind", "session_kind", "agent_name")


@query("age_labels", "P33", """
SELECT line_no, CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm' WHEN s // 3600 < 48 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age
FROM (SELECT line_no, greatest(0, k * k * 37 - 50) AS s FROM v_updates)""")
def age_labels(spark, sf):
    return b.v_updates(spark, sf).select("line_no", t.age_label(c("k") * c("k") * 37 - 50).alias("age"))


def spawn_lines(spark, sf):
    u = b.v_updates(spark, sf).filter(c("kind") == "tool_call")
    me, one, two = uuid(c("session_id")), uuid(c("session_id") + 1), uuid(c("session_id") + c("k") % 3)
    hint = F.when(c("k") % 10 == 0, F.lit("spawn_subagent ")).when(c("k") % 10 == 1, F.lit("get_command_or_subagent_output ")).otherwise(F.lit("read_file "))
    return u.select(me.alias("session_id"), "line_no", F.concat(hint, F.upper(one), F.lit(" and "), two, F.lit(" "), one).alias("value"))


@query("spawned_children", "P35 S13 U2", f"""
SELECT {uuid_sql('session_id')} AS session_id, {uuid_sql('child')} AS child_id, min(line_no) AS line_no FROM (
  SELECT session_id, session_id + 1 AS child, line_no FROM v_updates WHERE kind = 'tool_call' AND k % 10 IN (0, 1)
  UNION ALL SELECT session_id, session_id + k % 3, line_no FROM v_updates WHERE kind = 'tool_call' AND k % 10 IN (0, 1)) WHERE child <> session_id GROUP BY ALL""")
def spawned_children(spark, sf):
    return o.spawned_ids(spawn_lines(spark, sf))


b.VIEWS["v_edges"] = """
  SELECT s.session_id, coalesce(s.parent_id, n.named) AS parent_id FROM v_sessions s LEFT JOIN (
    SELECT child AS session_id, max(session_id) AS named FROM (SELECT session_id, session_id + 1 AS child FROM v_updates
      WHERE kind = 'tool_call' AND k % 10 = 0 AND session_id % 5 <> 4) GROUP BY child) n USING (session_id)"""


def edges(spark, sf):
    spawned = b.v_updates(spark, sf).filter((c("kind") == "tool_call") & (c("k") % 10 == 0)).select(
        "session_id", (c("session_id") + 1).alias("child_id"), "line_no")
    return o.parent_edges(b.v_sessions(spark, sf), spawned)


@query("parent_links", "J9 P36", "SELECT * FROM v_edges")
def parent_links(spark, sf):
    return edges(spark, sf)


@query("declared_parents", "P36", """SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'ab' || session_id WHEN session_id % 3 = 1 THEN 'info' || session_id END AS parent FROM v_sessions""")
def declared_parents(spark, sf):
    i = c("session_id").cast("string")
    top = F.when(c("session_id") % 3 == 0, F.concat(F.lit(" AB"), i, F.lit(" "))).when(c("session_id") % 3 == 1, F.lit(" "))
    info = F.when(c("session_id") % 3 == 1, F.concat(F.lit("Info"), i))
    return b.v_sessions(spark, sf).select("session_id", o.parent_of(top, info).alias("parent"))


@query("session_lifetimes", "A9", "SELECT session_id, first_ms, last_ms FROM v_life")
def session_lifetimes(spark, sf):
    return o.lifetimes(b.v_updates(spark, sf), b.v_sessions(spark, sf)).select("session_id", "first_ms", "last_ms")


b.VIEWS["v_spans"] = """
  SELECT session_id, ms AS start_ms, to_ms AS end_ms, kind FROM (
    SELECT session_id, ms, coalesce(nms, last_ms) AS to_ms, CASE WHEN edge = 'U' AND (nedge = 'T' OR nedge IS NULL) THEN 'work'
      WHEN edge = 'T' AND (nedge = 'U' OR nedge IS NULL) THEN 'wait' END AS kind
    FROM (SELECT *, lead(edge) OVER w AS nedge, lead(ms) OVER w AS nms FROM (
        SELECT session_id, ms, last_ms, mark, CASE WHEN r = 2 THEN 'T' WHEN pr IS NULL OR (r = 0 AND pr <> 0) THEN 'U' END AS edge FROM v_marks
        UNION ALL SELECT session_id, ms, last_ms, mark - 1, 'U' FROM v_marks WHERE pr IS NULL AND r = 2) WHERE edge IS NOT NULL
      WINDOW w AS (PARTITION BY session_id ORDER BY mark))) WHERE kind IS NOT NULL AND to_ms > ms"""
b.VIEWS["v_marks"] = """
  SELECT session_id, ms, ms * 3 + r AS mark, r, lag(r) OVER (PARTITION BY session_id ORDER BY ms, r) AS pr, max(ms) OVER (PARTITION BY session_id) AS last_ms
  FROM (SELECT DISTINCT session_id, agent_ms AS ms, CASE WHEN kind = 'user_message_chunk' THEN 0 WHEN kind = 'turn_completed' THEN 2 ELSE 1 END AS r FROM v_updates)"""
# views used by other views come first
b.VIEWS["v_spans"] = b.VIEWS.pop("v_spans")


def spans(spark, sf):
    marks = b.v_updates(spark, sf).select("session_id", "kind", "agent_ms", "line_no")
    return skew_safe(marks, ["session_id"], "line_no", lambda x, g: o.work_spans(x, g.reorder("mark", 10_800_000)))


@query("work_wait_spans", "W13", "SELECT * FROM v_spans")
def work_wait_spans(spark, sf):
    return spans(spark, sf)


b.VIEWS["v_visible"] = f"""
  SELECT *, greatest(first_ms, {DAY10}) AS clip_first_ms, greatest(least(last_ms, {DAY13}), greatest(first_ms, {DAY10})) AS clip_last_ms
  FROM (SELECT l.*, coalesce(n, 0) AS turns FROM v_life l LEFT JOIN (SELECT session_id, count(*) AS n FROM v_priced
      WHERE event_ms >= {DAY10} AND event_ms < {DAY13} GROUP BY 1) USING (session_id))
  WHERE (first_ms < {DAY13} AND last_ms >= {DAY10}) OR turns > 0"""


def visible(spark, sf):
    turns = priced(spark, sf).filter((c("event_ms") >= DAY10) & (c("event_ms") < DAY13)).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    s = o.lifetimes(b.v_updates(spark, sf), b.v_sessions(spark, sf)).join(turns, "session_id", "left").fillna(0, ["turns"])
    return o.visible_sessions(s, F.lit(DAY10), F.lit(DAY13))


@query("window_sessions", "F7 A9", "SELECT session_id, turns, clip_first_ms, clip_last_ms FROM v_visible")
def window_sessions(spark, sf):
    return visible(spark, sf).select("session_id", "turns", "clip_first_ms", "clip_last_ms")


@query("clipped_spans", "J8", f"""
WITH cut AS (SELECT session_id, greatest(start_ms, {DAY10}) AS start_ms, least(end_ms, {DAY13}) AS end_ms, kind FROM v_spans JOIN v_visible USING (session_id)
  WHERE least(end_ms, {DAY13}) > greatest(start_ms, {DAY10}))
SELECT * FROM cut UNION ALL SELECT session_id, clip_first_ms, clip_last_ms, 'work' FROM v_visible
WHERE clip_last_ms > clip_first_ms AND session_id NOT IN (SELECT session_id FROM cut)""")
def clipped_spans(spark, sf):
    return o.clip_spans(spans(spark, sf), visible(spark, sf), F.lit(DAY10), F.lit(DAY13))


b.VIEWS["v_ordered"] = """
  WITH e AS (SELECT v.session_id, v.session_kind, x.parent_id, clip_first_ms AS first_ms, clip_last_ms AS last_ms FROM v_visible v JOIN v_edges x USING (session_id)),
  r AS (SELECT *, row_number() OVER (ORDER BY first_ms, session_id) AS n FROM e WHERE session_kind IS NULL OR session_kind <> 'subagent'),
  k AS (SELECT *, parent_id IN (SELECT session_id FROM e) AS has FROM e WHERE session_kind = 'subagent')
  SELECT session_id, session_kind, parent_id, first_ms, last_ms, n, CAST(NULL AS BIGINT) AS child_n, 0 AS depth, 'Session ' || n AS label FROM r
  UNION ALL SELECT k.session_id, k.session_kind, k.parent_id, k.first_ms, k.last_ms, r.n, k.child_n, 1, 'Sub Agent ' || child_n
    FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY first_ms, session_id) AS child_n FROM k WHERE has) k LEFT JOIN r ON k.parent_id = r.session_id
  UNION ALL SELECT session_id, session_kind, parent_id, first_ms, last_ms, (SELECT greatest(max(n), 1) FROM r), child_n, 1, 'Sub Agent ' || child_n
    FROM (SELECT *, row_number() OVER (ORDER BY first_ms, session_id) AS child_n FROM k WHERE has IS NOT TRUE)"""


def ordered(spark, sf):
    v = visible(spark, sf).select("session_id", "session_kind", c("clip_first_ms").alias("first_ms"), c("clip_last_ms").alias("last_ms"))
    return o.session_order(v.join(edges(spark, sf), "session_id"))


@query("session_order", "W14", "SELECT * FROM v_ordered")
def session_order(spark, sf):
    return ordered(spark, sf)


@query("zoomed_sessions", "F8", f"""
WITH l AS (SELECT *, row_number() OVER (ORDER BY n, coalesce(child_n, 0), session_id) AS list_no FROM v_ordered),
hit AS (SELECT session_id, parent_id FROM l WHERE first_ms < {DAY10} + 3600000 AND last_ms > {DAY10}
  UNION SELECT l.session_id, l.parent_id FROM l JOIN v_spans s ON s.session_id = l.session_id AND start_ms < {DAY10} + 3600000 AND end_ms > {DAY10}),
f AS (SELECT l.*, session_id IN (SELECT session_id FROM hit UNION SELECT parent_id FROM hit WHERE parent_id IS NOT NULL) AS h FROM l)
SELECT session_id, list_no FROM (SELECT *, lag(h) OVER (ORDER BY list_no) AS u, lead(h) OVER (ORDER BY list_no) AS d, bool_or(h) OVER () AS a FROM f) WHERE h OR u OR d OR NOT a""")
def zoomed_sessions(spark, sf):
    d = ordered(spark, sf)
    place = F.struct(F.coalesce("child_n", F.lit(0)), "session_id")
    pos = o.global_numbers(d.withColumn("__place", place), "n", "__place", "list_no").drop("__place")
    pos = pos.withColumn("list_id", F.lit(0))
    out = skew_safe(pos, ["list_id"], "list_no", lambda x, g: o.zoom_sessions(x, spans(spark, sf), F.lit(DAY10), F.lit(DAY10 + 3_600_000), g), mode="blocked")
    return out.select("session_id", "list_no")


@query("session_families", "F13", """
WITH p AS (SELECT session_id, session_kind FROM v_sessions WHERE session_id % 3 = 0)
SELECT session_id FROM p UNION SELECT e.session_id FROM v_edges e JOIN p ON e.parent_id = p.session_id WHERE p.session_kind IS NULL OR p.session_kind <> 'subagent'""")
def session_families(spark, sf):
    s = b.v_sessions(spark, sf).drop("parent_id").join(edges(spark, sf), "session_id")
    return o.with_children(s, s.filter(c("session_id") % 3 == 0).select("session_id"))


@query("group_bounds", "A20", f"""
WITH g AS (SELECT coalesce(parent_id, session_id) AS root, min(first_ms) AS a, max(last_ms) AS z FROM v_life JOIN v_edges USING (session_id, parent_id) GROUP BY 1
  UNION ALL SELECT session_id, first_ms, least(first_ms + (session_id % 9) * 60000, last_ms) FROM v_life),
w AS (SELECT *, {DAY10} AS p0, {DAY13} AS p1, greatest(45000, CAST(floor((z - a) * 0.1) AS BIGINT)) AS pad FROM g),
s AS (SELECT *, least(greatest(300000, p1 - p0), greatest(300000, z - a + 2 * pad)) AS span FROM w),
x AS (SELECT *, CASE WHEN a - pad + span > p1 THEN p1 - span ELSE a - pad END AS lo, CASE WHEN a - pad + span > p1 THEN p1 ELSE a - pad + span END AS hi FROM s)
SELECT root, CASE WHEN lo < p0 THEN p0 ELSE lo END AS lo_ms, CASE WHEN lo < p0 THEN least(p1, p0 + span) ELSE hi END AS hi_ms FROM x""".replace("JOIN v_edges USING (session_id, parent_id)", "JOIN (SELECT session_id, parent_id AS pp FROM v_edges) USING (session_id)").replace("coalesce(parent_id, session_id)", "coalesce(pp, session_id)"))
def group_bounds(spark, sf):
    life = o.lifetimes(b.v_updates(spark, sf), b.v_sessions(spark, sf)).drop("parent_id")
    fam = life.join(edges(spark, sf), "session_id").groupBy(F.coalesce("parent_id", "session_id").alias("root")).agg(
        F.min("first_ms").alias("a"), F.max("last_ms").alias("z"))
    one = life.select(c("session_id").alias("root"), c("first_ms").alias("a"), F.least(c("first_ms") + (c("session_id") % 9) * 60_000, c("last_ms")).alias("z"))
    d = fam.unionByName(one)
    return d.select("root", o.group_bounds(c("a"), c("z"), F.lit(DAY10), F.lit(DAY13)).alias("w")).select("root", "w.*")


@query("session_list", "T1 D7", """
WITH s AS (SELECT session_id, session_id % 17 = 0 AS active, coalesce(active_ms, created_ms) AS recency_ms FROM v_sessions)
SELECT * FROM s""")
def session_list(spark, sf):
    s = b.v_sessions(spark, sf).select("session_id", (c("session_id") % 17 == 0).alias("active"), "active_ms", c("created_ms").alias("mtime_ms"))
    return o.list_sessions(s).select("session_id", "active", "recency_ms")


@query("followed_sessions", "D7 T1", """
SELECT cwd, arg_max(session_id, (active, r, session_id)) AS session_id FROM (SELECT *, session_id % 17 = 0 AS active, coalesce(active_ms, created_ms) AS r FROM v_sessions
  WHERE session_kind IS NULL OR session_kind <> 'subagent') GROUP BY cwd""")
def followed_sessions(spark, sf):
    s = b.v_sessions(spark, sf).withColumns({"active": c("session_id") % 17 == 0, "mtime_ms": c("created_ms")})
    return o.latest_session(s, ["cwd"])


@query("context_pressure", "P42", """
SELECT line_no, least(100.0, context_tokens / w * 100) AS pct, context_tokens >= 200000 AS is_tier, context_tokens / w >= 0.8 AS is_hot
FROM (SELECT *, 1000 * (100 + k * 3) AS w FROM v_updates) WHERE context_tokens IS NOT NULL""")
def context_pressure(spark, sf):
    d = b.v_updates(spark, sf).select("line_no", o.pressure(c("context_tokens"), 1000 * (100 + c("k") * 3)).alias("p"))
    return d.filter(c("p").isNotNull()).select("line_no", "p.*")


@query("cache_health", "P43", """
SELECT session_id, arg_max(idle_gap_ms, round_no) FILTER (TRUE) AS newest_idle_ms, CASE WHEN bool_or(miss) THEN 'miss' WHEN arg_max_null(idle_gap_ms, round_no) >= 600000 THEN 'stale' ELSE 'warm' END AS health
FROM (SELECT *, round_no % 19 = 0 AS miss FROM v_round_sum) GROUP BY session_id""".replace("arg_max(idle_gap_ms, round_no) FILTER (TRUE)", "arg_max_null(idle_gap_ms, round_no)"))
def cache_health(spark, sf):
    from sessionledger.plans.sessionize_queries import rounds

    return o.cache_health(rounds(spark, sf).withColumn("miss", c("round_no") % 19 == 0))


@query("session_bills", "A13", f"""
WITH off AS (SELECT session_id, sum(official_usd) AS o, CAST(sum(coalesce(ticks, 0)) AS BIGINT) AS official_ticks, count(*) AS turns FROM v_priced JOIN (SELECT line_no, ticks FROM v_turns) USING (line_no) GROUP BY 1),
est AS (SELECT session_id, sum(u) AS e FROM (SELECT session_id, estimate_usd AS u FROM v_priced UNION ALL SELECT session_id, k * 0.001 FROM v_updates WHERE kind = 'session_recap') GROUP BY 1),
kid AS (SELECT parent_id AS session_id, sum(o) AS ch, count(*) AS n FROM v_edges JOIN off USING (session_id) WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT session_id, turns, coalesce(n, 0) AS children, official_ticks, {b.r6('o')} AS official_usd, {b.r6('e')} AS estimate_usd, {b.r6('coalesce(ch, 0)')} AS children_usd,
  {b.r6('greatest(o - coalesce(ch, 0), 0)')} AS parent_only_usd FROM off LEFT JOIN est USING (session_id) LEFT JOIN kid USING (session_id)""")
def session_bills(spark, sf):
    from sessionledger.functions.pricing import gold

    t_ = priced(spark, sf)
    recaps = b.v_updates(spark, sf).filter(c("kind") == "session_recap").select("session_id", (c("k") * 0.001).alias("cost_usd"))
    d = o.session_bill(t_, t_.select("session_id", c("estimate_usd").alias("api_usd")), recaps, edges(spark, sf))
    return d.select("session_id", "turns", "children", "official_ticks", *[gold(c(x)).alias(x) for x in ("official_usd", "estimate_usd", "children_usd", "parent_only_usd")])


@query("child_session_lookup", "J17", """
SELECT u.session_id AS parent_id, u.session_id + 1 AS child_id, s.cwd AS child_cwd, count(*) AS mentions FROM v_updates u JOIN v_sessions s ON s.session_id = u.session_id + 1
WHERE u.kind = 'tool_call' AND u.k % 10 = 0 GROUP BY ALL""")
def child_session_lookup(spark, sf):
    """A child is found by its id alone, whatever folder it was started in."""
    named = b.v_updates(spark, sf).filter((c("kind") == "tool_call") & (c("k") % 10 == 0)).groupBy(
        c("session_id").alias("parent_id"), (c("session_id") + 1).alias("child_id")).agg(F.count(F.lit(1)).alias("mentions"))
    s = b.v_sessions(spark, sf).select(c("session_id").alias("child_id"), c("cwd").alias("child_cwd"))
    return named.join(s, "child_id").select("parent_id", "child_id", "child_cwd", "mentions")


@query("stale_children", "U3", """
SELECT DISTINCT session_id + 1 AS session_id FROM v_updates WHERE kind = 'tool_call' AND k % 10 = 0
EXCEPT SELECT session_id FROM v_sessions WHERE session_kind = 'subagent'""")
def stale_children(spark, sf):
    watched = b.v_updates(spark, sf).filter((c("kind") == "tool_call") & (c("k") % 10 == 0)).select((c("session_id") + 1).alias("session_id")).distinct()
    wanted = b.v_sessions(spark, sf).filter(c("session_kind") == "subagent").select("session_id")
    return watched.join(wanted, "session_id", "left_anti")
