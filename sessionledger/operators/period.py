"""Calendar windows, bucket spines and usage roll-ups.

Clocks are epoch milliseconds. Windows use one fixed UTC offset (``offset_ms``), so a day
is always 24 hours long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions.pricing import gold

c = F.col
DAY_MS = 86_400_000
STEP_MS = {"15m": 900_000, "hour": 3_600_000, "day": DAY_MS}
# Grains offered per period (first = default) and accepted spellings.
GRAINS = {"daily": ("hour", "15m"), "weekly": ("day", "hour"), "monthly": ("day", "week")}
SPELLINGS = {"15": "15m", "15m": "15m", "m15": "15m", "hour": "hour", "hourly": "hour", "hr": "hour",
             "day": "day", "daily": "day", "week": "week", "weekly": "week"}

TOKEN_SUMS = ["tokens_in", "tokens_cached", "tokens_out", "tokens_reason"]
COST_SUMS = ["cost_in_usd", "cost_cached_usd", "cost_out_usd", "cost_reason_usd"]


def normalize_grain(period: str, grain: str | None) -> str:
    """Accepted grain of a period; unknown or disallowed ones fall back to the default."""
    offered = GRAINS.get(period, ("hour",))
    g = SPELLINGS.get((grain or "").strip().lower().replace(" ", "").replace("min", "m"), "")
    return g if g in offered else offered[0]


def as_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def local_day(ms: Column, offset_ms: int = 0) -> Column:
    return F.date_trunc("day", as_ts(ms + F.lit(offset_ms)))


def period_window(now_ms: Column, period: str, offset: int = 0, offset_ms: int = 0) -> Column:
    """struct(start_ms, end_ms, label): half-open window of the period ``offset`` steps away."""
    t = as_ts(now_ms + F.lit(offset_ms))
    if period == "weekly":
        start = F.date_trunc("week", t) + F.expr(f"make_interval(0, 0, {int(offset)})")
        end = start + F.expr("make_interval(0, 0, 1)")
        last = end - F.expr("make_interval(0, 0, 0, 1)")
        label = F.concat(F.date_format(start, "dd MMM"), F.lit(" – "), F.date_format(last, "dd MMM yyyy"))
    elif period == "monthly":
        start = F.date_trunc("month", t) + F.expr(f"make_interval(0, {int(offset)})")
        end = start + F.expr("make_interval(0, 1)")
        label = F.date_format(start, "MMMM yyyy")
    else:
        start = F.date_trunc("day", t) + F.expr(f"make_interval(0, 0, 0, {int(offset)})")
        end = start + F.expr("make_interval(0, 0, 0, 1)")
        label = F.date_format(start, "EEE dd MMM yyyy")
    return F.struct(
        (F.unix_millis(start) - offset_ms).alias("start_ms"), (F.unix_millis(end) - offset_ms).alias("end_ms"),
        label.alias("label"),
    )


def bucket_start(ms: Column, grain: str, window_start: Column, offset_ms: int = 0) -> Column:
    """Start of the bucket holding ``ms``. Weeks are clipped to the window they are shown in."""
    if grain == "week":
        monday = F.unix_millis(F.date_trunc("week", as_ts(ms + F.lit(offset_ms)))) - offset_ms
        return F.greatest(monday, window_start)
    step = STEP_MS[grain]
    return (F.floor((ms - window_start) / F.lit(step)) * step).cast("long") + window_start


def bucket_spine(windows: DataFrame, period: str, grain: str, offset_ms: int = 0) -> DataFrame:
    """All buckets of each window (``start_ms``, ``end_ms``), empty ones included."""
    grain = normalize_grain(period, grain)
    if grain == "week":
        first = F.unix_millis(F.date_trunc("week", as_ts(c("start_ms") + offset_ms))) - offset_ms
        raw = windows.withColumn("w0", F.explode(F.sequence(first, c("end_ms") - 1, F.lit(7 * DAY_MS).cast("long"))))
        d = raw.withColumns({
            "bucket_ms": F.greatest(c("w0"), c("start_ms")),
            "bucket_end_ms": F.least(c("w0") + 7 * DAY_MS, c("end_ms")),
        })
        monday, lo = as_ts(c("w0") + offset_ms), as_ts(c("bucket_ms") + offset_ms)
        last = as_ts(c("bucket_end_ms") + offset_ms - DAY_MS)
        key = F.concat(F.lit("W"), F.extract(F.lit("YEAROFWEEK"), monday).cast("string"), F.lit("-"),
                       F.lpad(F.extract(F.lit("WEEK"), monday).cast("string"), 2, "0"))
        label = F.concat(F.date_format(lo, "dd MMM"), F.lit("–"), F.date_format(last, "dd MMM"))
        return d.withColumns({"bucket_key": key, "bucket_label": label}).drop("w0")
    step = STEP_MS[grain]
    d = windows.withColumn("bucket_ms", F.explode(F.sequence(c("start_ms"), c("end_ms") - 1, F.lit(step).cast("long"))))
    d = d.withColumn("bucket_end_ms", c("bucket_ms") + step)
    t = as_ts(c("bucket_ms") + offset_ms)
    if grain == "15m":
        key, label = F.date_format(t, "yyyy-MM-dd'T'HH:mm"), F.date_format(t, "HH:mm")
    elif grain == "hour":
        key = F.date_format(t, "yyyy-MM-dd'T'HH")
        label = F.date_format(t, "HH'h'")
        if period == "weekly":
            label = F.when(F.hour(t) == 0, F.date_format(t, "EEE HH'h'")).otherwise(label)
    else:
        key, label = F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "EEE dd")
    return d.withColumns({"bucket_key": key, "bucket_label": label})


def usage_sums() -> list[Column]:
    """Accumulator of priced turns: token sums, cost sums, official bill, turn count."""
    return [
        *[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in TOKEN_SUMS],
        *[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in COST_SUMS],
        F.coalesce(F.sum("official_usd"), F.lit(0.0)).alias("official_usd"),
        F.count("official_usd").alias("turns"),
    ]


def rounded_usage(df: DataFrame) -> DataFrame:
    """Gold edge: 6 decimals; a zero official bill falls back to the sum of its parts."""
    parts = c("cost_in_usd") + c("cost_cached_usd") + c("cost_out_usd")
    tot = F.when(c("official_usd") != 0, c("official_usd")).otherwise(parts)
    return df.withColumn("official_usd", gold(tot)).withColumns({
        **{x: gold(c(x)) for x in COST_SUMS},
        "tokens_all": c("tokens_in") + c("tokens_cached") + c("tokens_out"),
    })


def bucket_usage(turns: DataFrame, windows: DataFrame, period: str, grain: str, offset_ms: int = 0) -> DataFrame:
    """Usage per bucket of each calendar window of the period, gap-filled.

    A turn's window is computed from its clock, so turns meet the buckets by equality and no window list
    is sent around.
    """
    grain = normalize_grain(period, grain)
    spine = bucket_spine(windows, period, grain, offset_ms)
    placed = turns.withColumn("start_ms", period_window(c("event_ms"), period, 0, offset_ms)["start_ms"])
    sums = placed.withColumn("bucket_ms", bucket_start(c("event_ms"), grain, c("start_ms"), offset_ms)).groupBy(
        "start_ms", "bucket_ms").agg(*usage_sums())
    filled = spine.join(sums, ["start_ms", "bucket_ms"], "left")
    return rounded_usage(filled.fillna(0, [*TOKEN_SUMS, "turns"]).fillna(0.0, [*COST_SUMS, "official_usd"]))


def usage_levels(turns: DataFrame, bucket: Column) -> DataFrame:
    """Totals, buckets and sessions in one pass.

    Totals and buckets only hold billed turns (sub-agent bills sit inside their parent's);
    the session level lists every session.
    """
    d = turns.withColumns({"bucket_ms": bucket, "billed": c("billed")})
    g = d.groupingSets(
        [[c("billed")], [c("billed"), c("bucket_ms")], [c("billed"), c("session_id")]],
        c("billed"), c("bucket_ms"), c("session_id"),
    ).agg(
        F.when(F.grouping("session_id") == 0, "session").when(F.grouping("bucket_ms") == 0, "bucket")
        .otherwise("total").alias("level"), *usage_sums(),
    )
    return rounded_usage(g.filter(c("billed") | (c("level") == "session")).drop("billed"))
