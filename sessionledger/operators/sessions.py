"""Session headers, models, hierarchy and lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions.pricing import price_family
from sessionledger.session import materialize

c = F.col


def session_models(lines: DataFrame) -> DataFrame:
    """Model ids of a session in first-seen order, whether families mix, and its family.

    Ids are reduced to one row per (session, id) before any list is built, so a list is as
    long as the number of different models, never as long as the session.
    """
    seen = lines.filter(c("model").isNotNull()).groupBy("session_id", "model").agg(F.min("line_no").alias("first"))
    seen = seen.withColumn("fam", price_family(c("model")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "model"))), lambda x: x["model"])
    return seen.groupBy("session_id").agg(
        listed.alias("models"), (F.count_distinct("fam") > 1).alias("mixed"),
        F.min_by("fam", F.when(c("fam").isNotNull(), c("first"))).alias("family"),
    )


def hint_lines(lines: DataFrame) -> DataFrame:
    """The lines of a log as a source of model ids: all of them, the earliest first."""
    return lines.withColumn("source_rank", F.lit(3))


def round_families(turns: DataFrame, groups) -> DataFrame:
    """Price family of each round: the latest one known; rounds before the first use that one."""
    from sessionledger.functions.pricing import DEFAULT_FAMILY
    from sessionledger.operators.grouping import Run, Total

    d = turns.withColumn("__fam", price_family(c("model")))
    d = groups.totals(groups.running(d, {"__held": Run("last", c("__fam"), "upto")}), {"__first": Total("first", c("__fam"))})
    return d.withColumn("family", F.coalesce("__held", "__first", F.lit(DEFAULT_FAMILY))).drop("__fam", "__held", "__first")


def session_title(summary: Column, generated: Column, last_turn: Column, extra: Column, cwd: Column,
                  session_id: Column, max_len: int = 72) -> Column:
    """First non-blank title; else the working folder's name, else the head of the id."""
    from sessionledger.functions.text import nonempty

    path = F.replace(F.trim(cwd), F.lit("\\"), F.lit("/"))
    folder = F.nullif(F.regexp_extract(path, "([^/]+)/*$", 1), F.lit(""))
    head = F.coalesce(F.nullif(F.substring(session_id, 1, 8), F.lit("")), F.lit("session"))
    title = F.coalesce(nonempty(summary), nonempty(generated), nonempty(last_turn), nonempty(extra), folder, nonempty(cwd), head)
    return F.when(F.length(title) > max_len, F.concat(F.substring(title, 1, max_len - 3), F.lit("…"))).otherwise(title)


def child_title(title: Column, kind: Column, agent_name: Column) -> Column:
    """Sub-agents carry their role in front of the title unless it says nothing new."""
    role = F.coalesce(F.trim(agent_name), F.lit(""))
    shown = (kind == "subagent") & (role != "") & ~F.lower(role).isin("general-purpose", "general purpose") & ~title.contains(role)
    return F.when(shown, F.concat(role, F.lit(" · "), title)).otherwise(title)


def parent_of(*candidates: Column) -> Column:
    """Declared parent id: first non-blank candidate, lower case."""
    from sessionledger.functions.text import nonempty

    return F.lower(F.coalesce(*[nonempty(x) for x in candidates]))


def lifetimes(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """First and last activity: the widest of the log and the declared times."""
    seen = lines.groupBy("session_id").agg(F.min("agent_ms").alias("__lo"), F.max("agent_ms").alias("__hi"))
    d = sessions.join(seen, "session_id", "left")
    return d.withColumns({"first_ms": F.least("__lo", "created_ms"), "last_ms": F.greatest("__hi", "active_ms")}).drop("__lo", "__hi")


def visible_sessions(sessions: DataFrame, start_ms: Column, end_ms: Column) -> DataFrame:
    """Sessions alive inside the half-open window, or with turns in it."""
    alive = (c("first_ms") < end_ms) & (c("last_ms") >= start_ms)
    return sessions.filter(alive | (c("turns") > 0)).withColumns({
        "clip_first_ms": F.greatest(c("first_ms"), start_ms),
        "clip_last_ms": F.greatest(F.least(c("last_ms"), end_ms), F.greatest(c("first_ms"), start_ms))})


def spawned_ids(lines: DataFrame, id_column: str = "value") -> DataFrame:
    """Child ids on lines with a spawn hint, each with its first line; own id left out."""
    from sessionledger.functions.logline import SPAWN_HINTS, mentions
    from sessionledger.functions.tools import uuids

    hit = lines.filter(mentions(c(id_column), *SPAWN_HINTS))
    ids = hit.select("session_id", "line_no", F.explode(uuids(c(id_column))).alias("child_id"))
    return ids.filter(c("child_id") != F.lower(c("session_id"))).groupBy("session_id", "child_id").agg(
        F.min("line_no").alias("line_no"))


def parent_edges(sessions: DataFrame, spawned: DataFrame) -> DataFrame:
    """(session_id, parent_id): the declared parent, else the last main session that names the child."""
    main = sessions.filter(F.coalesce("session_kind", F.lit("")) != "subagent").select("session_id")
    named = spawned.join(main, "session_id", "left_semi").groupBy(c("child_id").alias("session_id")).agg(
        F.max("session_id").alias("__named"))
    return sessions.join(named, "session_id", "left").select(
        "session_id", F.coalesce("parent_id", "__named").alias("parent_id"))


def ancestors(edges: DataFrame) -> DataFrame:
    """``session_id, ancestor_id, depth`` for every session above a session, trees of any depth.

    Pointer jumping: each round joins all pairs known with the pointers of twice the length, so a tree of depth d takes log2(d)
    rounds. A session that comes to itself (a cycle of broken parents) is cut there: no session is its own ancestor, and depth is the
    shortest way.
    """
    from sessionledger.session import materialize

    up = edges.filter(c("parent_id").isNotNull() & (c("parent_id") != c("session_id")))
    pairs = materialize(up.select("session_id", c("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")).distinct())
    known = pairs.count()
    while True:
        further = pairs.select(c("session_id").alias("ancestor_id"), c("ancestor_id").alias("__top"), c("depth").alias("__more"))
        longer = pairs.join(further, "ancestor_id").filter(c("__top") != c("session_id")).select("session_id", c("__top").alias("ancestor_id"), (c("depth") + c("__more")).alias("depth"))
        pairs = materialize(pairs.unionByName(longer).groupBy("session_id", "ancestor_id").agg(F.min("depth").alias("depth")))
        now = pairs.count()
        if now == known:
            return pairs
        known = now


def tree_bills(edges: DataFrame, bills: DataFrame, measures: list[str]) -> DataFrame:
    """Per session of ``bills`` (one row each): its own measures, those of all sessions below it, and both together."""
    below = ancestors(edges).join(bills, "session_id").groupBy(c("ancestor_id").alias("session_id")).agg(
        F.count(F.lit(1)).alias("descendants"), F.max("depth").alias("levels"), *[F.sum(m).alias(f"children_{m}") for m in measures])
    d = bills.join(below, "session_id", "left")
    d = d.withColumns({"descendants": F.coalesce("descendants", F.lit(0).cast("long")), "levels": F.coalesce("levels", F.lit(0)), **{f"children_{m}": F.coalesce(f"children_{m}", F.lit(0.0)) for m in measures}})
    return d.withColumns({f"combined_{m}": c(m) + c(f"children_{m}") for m in measures})



def session_order(sessions: DataFrame) -> DataFrame:
    """Display order: roots by first activity, children behind their parent, orphans last.

    Numbering all roots is a global running count, done as a sort plus offsets per range so
    that no single task ever holds all sessions.
    """
    # Read several times below: cut the lineage at one row per session.
    sessions = materialize(sessions)
    kind = F.coalesce("session_kind", F.lit("main"))
    roots = sessions.filter(kind != "subagent")
    kids = sessions.filter(kind == "subagent")
    numbered = global_numbers(roots, "first_ms", "session_id", "n")
    joined = kids.join(sessions.select(c("session_id").alias("parent_id"), F.lit(True).alias("__has")), "parent_id", "left")
    placed = number_children(joined.filter(c("__has")).drop("__has"), ["parent_id"])
    placed = placed.join(numbered.select(c("session_id").alias("parent_id"), "n"), "parent_id", "left")
    orphans = number_children(joined.filter(c("__has").isNull()).drop("__has"), [])
    total = numbered.agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(1)).cast("long").alias("n"))
    orphans = orphans.crossJoin(F.broadcast(total))  # one row
    depth0 = numbered.withColumns({"child_n": F.lit(None).cast("long"), "depth": F.lit(0), "label": F.concat(F.lit("Session "), c("n").cast("string"))})
    depth1 = placed.unionByName(orphans.select(*placed.columns)).withColumns({
        "depth": F.lit(1), "label": F.concat(F.lit("Sub Agent "), c("child_n").cast("string"))})
    return depth0.unionByName(depth1.select(*depth0.columns))


def global_numbers(rows: DataFrame, order: str, tie: str, name: str) -> DataFrame:
    """Number all rows by ``(order, tie)`` without one global window.

    Rows are dealt to sampled ranges of ``(order, tie)``, so neither a burst of equal clocks nor one clock far
    off fills a single range; they are numbered inside their range, and the sizes of the ranges before are added.
    """
    return _numbered(_ranged(rows, [], order, tie), [], "__range", order, tie, name)


def number_children(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number the children of one parent by first activity; a parent with many is split over several ranges."""
    return _numbered(_ranged(rows, keys, "first_ms", "session_id"), keys, "__range", "first_ms", "session_id", "child_n")


def _ranged(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Rows with the number of their range, written so that it stays the same whenever it is read."""
    return materialize(rows.repartitionByRange(*keys, order, tie).withColumn("__range", F.spark_partition_id()))


def _numbered(d: DataFrame, keys: list[str], piece: str, order: str, tie: str, name: str) -> DataFrame:
    from pyspark.sql import Window as W

    cell = [*keys, piece]
    sizes = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    sizes = sizes.select(*cell, F.coalesce(F.sum("__n").over(
        whole.orderBy(piece).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    here = F.row_number().over(W.partitionBy(*cell).orderBy(order, tie))
    return d.withColumn("__here", here).join(sizes, cell).withColumn(
        name, (c("__base") + c("__here")).cast("long")).drop("__here", "__base", piece)


def work_spans(lines: DataFrame, groups) -> DataFrame:
    """Work and wait intervals of each session from its user, turn and other marks.

    Marks are first reduced to one per (session, millisecond, kind). A user mark after
    anything else opens work; a turn closes it and opens waiting.
    """
    from sessionledger.operators.grouping import Run
    from sessionledger.operators.sessionize import TURN, USER_KINDS

    rank = F.when(c("kind").isin(USER_KINDS), 0).when(c("kind") == TURN, 2).otherwise(1)
    marks = lines.filter(c("agent_ms").isNotNull()).select("session_id", (c("agent_ms") * 3 + rank).alias("mark")).distinct()
    d = groups.running(marks, {"__prev": Run("adjacent", c("mark")), "__next": Run("adjacent", c("mark"), "after")})
    rank, ms = c("mark") % 3, F.floor(c("mark") / 3).cast("long")
    edge = (
        F.when(rank == 2, "T")
        .when(c("__prev").isNull(), "U").when((rank == 0) & (c("__prev") % 3 != 0), "U"))
    d = d.select("session_id", "mark", ms.alias("ms"), edge.alias("edge"), c("__next").isNull().alias("__last"), c("__prev").isNull().alias("__first"), rank.alias("rank"))
    first_turn = d.filter(c("__first") & (c("rank") == 2)).select("session_id", (c("mark") - 1).alias("mark"), "ms", F.lit("U").alias("edge"))
    edges = d.filter(c("edge").isNotNull()).select("session_id", "mark", "ms", "edge").unionByName(first_turn)
    ends = d.groupBy("session_id").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    e = groups.running(edges, {"__to": Run("adjacent", F.struct("ms", "edge"), "after")}).join(ends, "session_id")
    kind = F.when((c("edge") == "U") & ((c("__to.edge") == "T") | c("__to").isNull()), "work").when(
        (c("edge") == "T") & ((c("__to.edge") == "U") | c("__to").isNull()), "wait")
    spans = e.withColumns({"kind": kind, "end_ms": F.coalesce(c("__to.ms"), c("last_ms"))}).filter(
        c("kind").isNotNull() & (c("end_ms") > c("ms"))).select("session_id", c("ms").alias("start_ms"), "end_ms", "kind")
    bare = ends.join(spans.select("session_id").distinct(), "session_id", "left_anti").select(
        "session_id", c("first_ms").alias("start_ms"), c("last_ms").alias("end_ms"), F.lit("work").alias("kind"))
    return spans.unionByName(bare)


def clip_spans(spans: DataFrame, sessions: DataFrame, start_ms: Column, end_ms: Column) -> DataFrame:
    """Spans cut to a window; a session without any left gets its clipped life as work."""
    cut = spans.withColumns({"start_ms": F.greatest("start_ms", start_ms), "end_ms": F.least("end_ms", end_ms)}).filter(
        c("end_ms") > c("start_ms"))
    bare = sessions.join(cut.select("session_id").distinct(), "session_id", "left_anti").filter(
        c("clip_last_ms") > c("clip_first_ms")).select(
        "session_id", c("clip_first_ms").alias("start_ms"), c("clip_last_ms").alias("end_ms"), F.lit("work").alias("kind"))
    return cut.join(sessions.select("session_id"), "session_id", "left_semi").unionByName(bare)


def zoom_sessions(listed: DataFrame, spans: DataFrame, start_ms: Column, end_ms: Column, groups) -> DataFrame:
    """Sessions shown in a zoom window: hits, their parents, and the list neighbours of both.

    ``listed`` has ``list_no`` (display position) and one constant grouping column. Without
    any hit everything is shown.
    """
    from sessionledger.operators.grouping import Run

    listed = materialize(listed)
    own = (c("first_ms") < end_ms) & (c("last_ms") > start_ms)
    by_span = spans.filter((c("start_ms") < end_ms) & (c("end_ms") > start_ms)).select("session_id").distinct()
    hits = listed.filter(own).select("session_id", "parent_id").unionByName(
        listed.join(by_span, "session_id", "left_semi").select("session_id", "parent_id")).distinct()
    ids = hits.select("session_id").unionByName(hits.filter(c("parent_id").isNotNull()).select(c("parent_id").alias("session_id"))).distinct()
    d = listed.join(ids.withColumn("__hit", F.lit(1)), "session_id", "left").fillna(0, ["__hit"])
    d = groups.running(d, {"__up": Run("adjacent", c("__hit")), "__down": Run("adjacent", c("__hit"), "after")})
    d = groups.totals(d, {"__any": _total("max", "__hit")})
    return d.filter((c("__hit") == 1) | (c("__up") == 1) | (c("__down") == 1) | (c("__any") == 0)).drop("__hit", "__up", "__down", "__any")


def _total(fn: str, col: str):
    from sessionledger.operators.grouping import Total

    return Total(fn, c(col))


def with_children(sessions: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked sessions together with their children; a picked child stays alone."""
    main = sessions.join(picked, "session_id", "left_semi")
    parents = main.filter(F.coalesce("session_kind", F.lit("main")) != "subagent").select(c("session_id").alias("parent_id"))
    return main.select("session_id").unionByName(
        sessions.join(parents, "parent_id", "left_semi").select("session_id")).distinct()


def group_bounds(first_ms: Column, last_ms: Column, start_ms: Column, end_ms: Column, min_span_ms: int = 300_000) -> Column:
    """struct(lo, hi): bounds padded by a tenth (45 s at least), at least five minutes, inside the period."""
    pad = F.greatest(F.lit(45_000), F.floor((last_ms - first_ms) * 0.1)).cast("long")
    span = F.least(F.greatest(F.lit(min_span_ms), end_ms - start_ms), F.greatest(F.lit(min_span_ms), last_ms - first_ms + 2 * pad))
    lo = first_ms - pad
    late = lo + span > end_ms
    lo1, hi1 = F.when(late, end_ms - span).otherwise(lo), F.when(late, end_ms).otherwise(lo + span)
    early = lo1 < start_ms
    return F.struct(F.when(early, start_ms).otherwise(lo1).alias("lo_ms"),
                    F.when(early, F.least(end_ms, start_ms + span)).otherwise(hi1).alias("hi_ms"))


def list_sessions(sessions: DataFrame) -> DataFrame:
    """All sessions with what orders the list: active ones first, then by ``recency_ms``, newest first."""
    return sessions.withColumn("recency_ms", F.coalesce("active_ms", "mtime_ms"))


def latest_session(sessions: DataFrame, scope: list[str]) -> DataFrame:
    """The session to follow per scope: active before inactive, newest first, never a sub-agent."""
    d = sessions.filter(F.coalesce("session_kind", F.lit("main")) != "subagent")
    rank = F.struct("active", F.coalesce("active_ms", "mtime_ms"), "session_id")
    return d.groupBy(*scope).agg(F.max_by("session_id", rank).alias("session_id"))


def cache_health(rounds: DataFrame, stale_ms: int = 600_000) -> DataFrame:
    """miss / stale / warm per session from its rounds."""
    a = rounds.groupBy("session_id").agg(F.bool_or("miss").alias("__miss"), F.max_by("idle_gap_ms", "round_no").alias("newest_idle_ms"))
    return a.select("session_id", "newest_idle_ms", F.when(c("__miss"), "miss").when(c("newest_idle_ms") >= stale_ms, "stale").otherwise("warm").alias("health"))


def pressure(context: Column, window: Column) -> Column:
    """struct: share of the context window in percent, past the price tier, past 80 percent."""
    known = context.isNotNull() & (window > 0)
    return F.when(known, F.struct(F.least(F.lit(100.0), context / window * 100).alias("pct"), (context >= 200_000).alias("is_tier"),
                                  (context / window >= 0.8).alias("is_hot")))


def session_bill(turns: DataFrame, rounds: DataFrame, recaps: DataFrame, edges: DataFrame) -> DataFrame:
    """Official and estimated bills per session; what is left after the children's bills."""
    off = turns.groupBy("session_id").agg(F.sum("official_usd").alias("official_usd"), F.sum(F.coalesce("ticks", F.lit(0))).alias("official_ticks"), F.count(F.lit(1)).alias("turns"))
    est = rounds.select("session_id", c("api_usd").alias("usd")).unionByName(recaps.select("session_id", c("cost_usd").alias("usd")))
    est = est.groupBy("session_id").agg(F.sum("usd").alias("estimate_usd"))
    kids = edges.filter(c("parent_id").isNotNull()).join(off, "session_id").groupBy(c("parent_id").alias("session_id")).agg(
        F.sum("official_usd").alias("children_usd"), F.count(F.lit(1)).alias("children"))
    d = off.join(est, "session_id", "left").join(kids, "session_id", "left").fillna(0.0, ["estimate_usd", "children_usd"]).fillna(0, ["children"])
    return d.withColumn("parent_only_usd", F.greatest(c("official_usd") - c("children_usd"), F.lit(0.0)))
