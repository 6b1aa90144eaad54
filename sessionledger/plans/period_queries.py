"""Calendar windows, bucket spines and period roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.operators import period as o
from sessionledger.plans import binding as b
from sessionledger.plans.pricing_queries import priced
from sessionledger.plans.registry import query

c = F.col
SUMS_SQL = f"""CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_cached), 0) AS BIGINT) AS tokens_cached,
  CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, CAST(coalesce(sum(tokens_reason), 0) AS BIGINT) AS tokens_reason,
  CAST(coalesce(sum(tokens_in + tokens_cached + tokens_out), 0) AS BIGINT) AS tokens_all,
  {b.r6('coalesce(sum(cost_in_usd), 0)')} AS cost_in_usd, {b.r6('coalesce(sum(cost_cached_usd), 0)')} AS cost_cached_usd,
  {b.r6('coalesce(sum(cost_out_usd), 0)')} AS cost_out_usd, {b.r6('coalesce(sum(cost_reason_usd), 0)')} AS cost_reason_usd,
  {b.r6('CASE WHEN coalesce(sum(official_usd), 0) <> 0 THEN sum(official_usd) ELSE coalesce(sum(cost_in_usd + cost_cached_usd + cost_out_usd), 0) END')} AS official_usd, count(official_usd) AS turns"""
b.VIEWS["v_billed"] = "SELECT * FROM v_priced WHERE session_id % 5 <> 4"


def windows(spark, sf, period):
    """One row per period window in which anything happened."""
    days = b.table(spark, sf, "events").select(b.ms(F.date_trunc("day", c("ts"))).alias("d")).distinct()
    return days.select(o.period_window(c("d"), period).alias("w")).select("w.start_ms", "w.end_ms").distinct()


def billed(spark, sf):
    """Priced turns without sub-agent sessions: those are inside their parent's bill."""
    return priced(spark, sf).filter(c("session_id") % 5 != 4)


@query("hourly_priced_buckets", "S2 J6 A4 A5 C3 F2 F3 F4 J7", f"""
WITH w AS (SELECT DISTINCT epoch_ms(date_trunc('day', ts)) AS start_ms FROM events),
spine AS (SELECT unnest(range(start_ms, start_ms + 86400000, 3600000)) AS bucket_ms FROM w)
SELECT strftime(make_timestamp(bucket_ms * 1000), '%Y-%m-%dT%H') AS bucket_key, bucket_ms, {SUMS_SQL}
FROM spine LEFT JOIN v_billed v ON v.event_ms // 3600000 * 3600000 = bucket_ms GROUP BY bucket_ms""")
def hourly_priced_buckets(spark, sf):
    d = o.bucket_usage(billed(spark, sf), windows(spark, sf, "daily"), "daily", "hour")
    return d.drop("start_ms", "end_ms", "bucket_end_ms", "bucket_label")


@query("month_day_buckets", "A5 C3 J7", f"""
WITH w AS (SELECT DISTINCT epoch_ms(date_trunc('month', ts)) AS start_ms,
    epoch_ms(date_trunc('month', ts) + INTERVAL 1 MONTH) AS end_ms FROM events),
spine AS (SELECT start_ms, unnest(range(start_ms, end_ms, 86400000)) AS bucket_ms FROM w)
SELECT strftime(make_timestamp(bucket_ms * 1000), '%Y-%m-%d') AS bucket_key, bucket_ms, {SUMS_SQL}
FROM spine LEFT JOIN v_billed v ON v.event_ms // 86400000 * 86400000 = bucket_ms GROUP BY bucket_ms""")
def month_day_buckets(spark, sf):
    d = o.bucket_usage(billed(spark, sf), windows(spark, sf, "monthly"), "monthly", "day")
    return d.drop("start_ms", "end_ms", "bucket_end_ms", "bucket_label")


def _spine_sql(trunc, step, key, label):
    return f"""
WITH w AS (SELECT DISTINCT epoch_ms(date_trunc('{trunc}', ts)) AS start_ms,
    epoch_ms(date_trunc('{trunc}', ts) + INTERVAL 1 {trunc.upper()}) AS end_ms FROM events),
spine AS (SELECT start_ms, end_ms, unnest(range(start_ms, end_ms, {step})) AS bucket_ms FROM w)
SELECT start_ms, end_ms, bucket_ms, bucket_ms + {step} AS bucket_end_ms, strftime(t, '{key}') AS bucket_key, {label} AS bucket_label
FROM (SELECT *, make_timestamp(bucket_ms * 1000) AS t FROM spine)"""


@query("quarter_hour_spine", "C3 C2", _spine_sql("day", 900000, "%Y-%m-%dT%H:%M", "strftime(t, '%H:%M')"))
def quarter_hour_spine(spark, sf):
    return o.bucket_spine(windows(spark, sf, "daily"), "daily", "15 min")


@query("week_hour_spine", "C3", _spine_sql(
    "week", 3600000, "%Y-%m-%dT%H", "CASE WHEN hour(t) = 0 THEN strftime(t, '%a %Hh') ELSE strftime(t, '%Hh') END"))
def week_hour_spine(spark, sf):
    return o.bucket_spine(windows(spark, sf, "weekly"), "weekly", "hourly")


@query("month_day_spine", "C3", _spine_sql("month", 86400000, "%Y-%m-%d", "strftime(t, '%a %d')"))
def month_day_spine(spark, sf):
    return o.bucket_spine(windows(spark, sf, "monthly"), "monthly", None)


@query("clipped_week_buckets", "C3 J7 A4", f"""
WITH w AS (SELECT DISTINCT date_trunc('month', ts) AS s, date_trunc('month', ts) + INTERVAL 1 MONTH AS e FROM events),
spine AS (SELECT s, e, unnest(range(date_trunc('week', s), e, INTERVAL 7 DAY)) AS w0 FROM w),
clipped AS (SELECT w0, greatest(w0, s) AS lo, least(w0 + INTERVAL 7 DAY, e) AS hi FROM spine)
SELECT 'W' || strftime(w0, '%G-%V') AS bucket_key, strftime(lo, '%d %b') || '–' || strftime(hi - INTERVAL 1 DAY, '%d %b') AS bucket_label,
  epoch_ms(lo) AS bucket_ms, epoch_ms(hi) AS bucket_end_ms, {SUMS_SQL}
FROM clipped LEFT JOIN v_billed v ON v.event_ms >= epoch_ms(lo) AND v.event_ms < epoch_ms(hi) GROUP BY w0, lo, hi""")
def clipped_week_buckets(spark, sf):
    return o.bucket_usage(billed(spark, sf), windows(spark, sf, "monthly"), "monthly", "week").drop("start_ms", "end_ms")


@query("period_windows", "C1", """
WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS t FROM events)
SELECT epoch_ms(t) AS now_ms, period, epoch_ms(s) AS start_ms, epoch_ms(e) AS end_ms, label FROM (
  SELECT t, 'daily' AS period, t - INTERVAL 1 DAY AS s, t AS e, strftime(t - INTERVAL 1 DAY, '%a %d %b %Y') AS label FROM d
  UNION ALL SELECT t, 'weekly', date_trunc('week', t), date_trunc('week', t) + INTERVAL 7 DAY,
    strftime(date_trunc('week', t), '%d %b') || ' – ' || strftime(date_trunc('week', t) + INTERVAL 6 DAY, '%d %b %Y') FROM d
  UNION ALL SELECT t, 'monthly', date_trunc('month', t) - INTERVAL 1 MONTH, date_trunc('month', t),
    strftime(date_trunc('month', t) - INTERVAL 1 MONTH, '%B %Y') FROM d)""")
def period_windows(spark, sf):
    d = b.table(spark, sf, "events").select(b.ms(F.date_trunc("day", c("ts"))).alias("now_ms")).distinct()
    out = None
    for period, off in (("daily", -1), ("weekly", 0), ("monthly", -1)):
        x = d.select("now_ms", F.lit(period).alias("period"), o.period_window(c("now_ms"), period, off).alias("w"))
        out = x if out is None else out.unionByName(x)
    return out.select("now_ms", "period", "w.*")


@query("totals_buckets_sessions", "A5 F3", f"""
WITH t AS (SELECT *, event_ms // 86400000 * 86400000 AS bucket_ms, session_id % 5 <> 4 AS billed FROM v_priced)
SELECT level, bucket_ms, session_id, tokens_in, tokens_cached, tokens_out, tokens_reason, tokens_all, cost_in_usd, cost_cached_usd,
  cost_out_usd, cost_reason_usd, official_usd, turns
FROM (SELECT CASE WHEN grouping(session_id) = 0 THEN 'session' WHEN grouping(bucket_ms) = 0 THEN 'bucket' ELSE 'total' END AS level,
    billed, bucket_ms, session_id, {SUMS_SQL} FROM t GROUP BY GROUPING SETS ((billed), (billed, bucket_ms), (billed, session_id)))
WHERE billed OR level = 'session'""")
def totals_buckets_sessions(spark, sf):
    t = priced(spark, sf).withColumn("billed", c("session_id") % 5 != 4)
    return o.usage_levels(t, (F.floor(c("event_ms") / o.DAY_MS) * o.DAY_MS).cast("long"))
