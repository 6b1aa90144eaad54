"""Exact allocation and usage reconstruction over the bound calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators import allocate as a
from sessionledger.operators import reconstruct as r
from sessionledger.operators.grouping import skew_safe
from sessionledger.plans import binding as b
from sessionledger.plans.registry import query

c = F.col
P = "PARTITION BY round_id"


def by_round(df, body, **kw):
    return skew_safe(df, ["round_id"], "call_no", body, **kw)


def split_sql(src: str, out: str, w: str, tgt: str, cond: str = "TRUE", part: str = P, order: str = "call_no") -> str:
    return f"""SELECT * EXCLUDE (w_, t_, s_, n_, share_, base_, given_, frac_, rank_),
  CAST(base_ + CASE WHEN w_ IS NOT NULL AND rank_ <= t_ - given_ THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM (
  SELECT *, row_number() OVER ({part} ORDER BY frac_ DESC, {order}) AS rank_ FROM (
  SELECT *, sum(base_) OVER ({part}) AS given_, CASE WHEN w_ IS NULL THEN -1 ELSE share_ - base_ END AS frac_ FROM (
  SELECT *, CAST(floor(share_) AS BIGINT) AS base_ FROM (
  SELECT *, CASE WHEN w_ IS NULL THEN 0.0 WHEN s_ > 0 THEN w_ / s_ * t_ ELSE floor(t_ / n_) END AS share_ FROM (
  SELECT *, sum(w_) OVER ({part}) AS s_, count(w_) OVER ({part}) AS n_ FROM (
  SELECT *, CASE WHEN {cond} THEN greatest(coalesce(CAST({w} AS DOUBLE), 0), 0) END AS w_, CAST(greatest(coalesce({tgt}, 0), 0) AS BIGINT) AS t_ FROM {src}))))))"""


@query("exact_split", "L1", f"SELECT round_id, call_no, x FROM ({split_sql('v_calls', 'x', 'CASE WHEN round_id % 10 = 0 THEN 0 ELSE weight END', 'off_in')})")
def exact_split(spark, sf):
    w = F.when(c("round_id") % 10 == 0, 0).otherwise(c("weight"))
    return by_round(b.v_calls(spark, sf), lambda d, g: a.split_exact(d, g, "x", w, c("off_in"))).select("round_id", "call_no", "x")


_HOT_LINES = "(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS call_no, 0 AS round_id, CAST(floor(WEIGHT) AS BIGINT) AS weight FROM lineitem)"


def hot_split_sql(weight: str, target: int) -> str:
    return f"SELECT round_id, call_no, x FROM ({split_sql(_HOT_LINES.replace('WEIGHT', weight), 'x', 'weight', str(target))})"


def hot_split(spark, sf, weight, target):
    """One group over the whole table, split by the blocked engine."""
    from sessionledger.operators.sessions import global_numbers

    d = b.table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tie"), F.floor(weight).cast("long").alias("weight"))
    d = global_numbers(d, "l_orderkey", "tie", "call_no").withColumn("round_id", F.lit(0))
    return by_round(d, lambda x, g: a.split_exact(x, g, "x", c("weight"), F.lit(target)), mode="blocked", block=4096).select("round_id", "call_no", "x")


@query("exact_split_of_a_hot_key", "L1", hot_split_sql("l_quantity", 1_000_003))
def exact_split_of_a_hot_key(spark, sf):
    return hot_split(spark, sf, c("l_quantity"), 1_000_003)


@query("exact_split_of_near_unique_weights", "L1", hot_split_sql("l_extendedprice * 100 + l_partkey", 7_000_003))
def exact_split_of_near_unique_weights(spark, sf):
    """Nearly every remainder is a value of its own: the cut is found by histograms."""
    return hot_split(spark, sf, c("l_extendedprice") * 100 + c("l_partkey"), 7_000_003)


@query("usd_fit", "L2", f"""
WITH x AS (SELECT *, sum(CAST(weight AS DOUBLE)) OVER ({P}) AS s FROM (SELECT *, off_in / 1000.0 AS tgt FROM v_calls)),
y AS (SELECT *, weight * tgt / s AS sc FROM x)
SELECT round_id, call_no, {b.r6(f'(sc + CASE WHEN row_number() OVER ({P} ORDER BY sc DESC, call_no) = 1 THEN tgt - sum(sc) OVER ({P}) ELSE 0 END)')} AS usd FROM y""")
def usd_fit(spark, sf):
    d = by_round(b.v_calls(spark, sf), lambda x, g: a.split_usd(x, g, "usd", c("weight").cast("double"), c("off_in") / 1000.0))
    return d.select("round_id", "call_no", p.gold(c("usd")).alias("usd"))


@query("rounded_split", "L3", f"""
WITH x AS (SELECT *, w_tool * 1.0 AS w, sum(w_tool) OVER ({P}) AS s, max(CASE WHEN w_tool > 0 THEN call_no END) OVER ({P}) AS last FROM v_calls),
y AS (SELECT *, CASE WHEN w_tool > 0 AND call_no IS DISTINCT FROM last THEN CAST(round_even(off_in * w_tool / s, 0) AS BIGINT) ELSE 0 END AS v FROM x)
SELECT round_id, call_no, CAST(CASE WHEN w_tool <= 0 OR off_in <= 0 THEN 0 WHEN call_no = last THEN greatest(0, off_in - sum(v) OVER ({P})) ELSE v END AS BIGINT) AS x FROM y""")
def rounded_split(spark, sf):
    return by_round(b.v_calls(spark, sf), lambda x, g: a.split_rounded(x, g, "x", c("w_tool"), c("off_in"))).select("round_id", "call_no", "x")


CAP = f"""SELECT * EXCLUDE (a_, room_, left_, later_), CAST(a_ + least(room_, greatest(left_ - later_, 0)) AS BIGINT) AS OUT FROM (
  SELECT *, coalesce(sum(room_) OVER ({P} ORDER BY call_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later_,
    sum(greatest(AMT - LIM, 0)) OVER ({P}) AS left_ FROM (SELECT *, least(AMT, LIM) AS a_, LIM - least(AMT, LIM) AS room_ FROM SRC))"""


def cap_sql(src, out, amt, lim):
    return CAP.replace("SRC", src).replace("OUT", out).replace("AMT", amt).replace("LIM", lim)


@query("capped_amounts", "L4", f"SELECT round_id, call_no, x FROM ({cap_sql('v_calls', 'x', 'w_enc', 'w_tool')})")
def capped_amounts(spark, sf):
    return by_round(b.v_calls(spark, sf), lambda x, g: a.cap_and_push(x, g, "x", c("w_enc"), c("w_tool"))).select("round_id", "call_no", "x")


# ---- reconstruction -------------------------------------------------------------------
def facts_sql(calls: str) -> str:
    """Twin of ``reconstruct.round_facts`` over any calls with the columns of the bound ones."""
    return f"""
  SELECT *, prior IS NULL OR prior <= 0 AS cold, reread IS NOT NULL AS missed, i = n AS is_last, user_unc AS user_i, coalesce(reread, 0) AS reread_i,
    greatest(off_in - least(off_cache, off_in), 0) AS off_unc,
    lag("end") OVER ({P} ORDER BY call_no) AS prev_end, lag(w_thought + w_enc + w_emit + w_message) OVER ({P} ORDER BY call_no) AS prev_out,
    lag(w_harness) OVER ({P} ORDER BY call_no) AS prev_h
  FROM (SELECT *, row_number() OVER ({P} ORDER BY call_no) AS i, count(*) OVER ({P}) AS n FROM ({calls}))"""


b.VIEWS["v_facts"] = facts_sql("""
    SELECT round_id, call_no, session_id, start, start + weight * 13 AS "end", w_thought, w_message, w_emit, w_enc, w_tool * 3 AS w_harness, off_in,
      off_in * (round_id % 100) // 100 AS off_cache, CASE WHEN round_id % 5 = 0 THEN 20 ELSE 100 + round_id % 700 END AS off_out,
      CASE WHEN round_id % 4 <> 0 THEN off_in // 3 END AS prior, CASE WHEN round_id % 7 = 0 THEN off_in // 5 END AS reread,
      round_id % 50 AS user_unc, round_id % 900 AS system_unc, CASE WHEN round_id % 3 = 0 THEN '4.6' ELSE '4.5' END AS family FROM v_calls""")


def recon_calls(spark, sf):
    k = c("round_id")
    return b.v_calls(spark, sf).select(
        "round_id", "call_no", "session_id", "start", (c("start") + c("weight") * 13).alias("end"), "w_thought", "w_message", "w_emit", "w_enc",
        (c("w_tool") * 3).alias("w_harness"), "off_in", F.floor(c("off_in") * (k % 100) / 100).cast("long").alias("off_cache"),
        F.when(k % 5 == 0, 20).otherwise(100 + k % 700).alias("off_out"), F.when(k % 4 != 0, F.floor(c("off_in") / 3).cast("long")).alias("prior"),
        F.when(k % 7 == 0, F.floor(c("off_in") / 5).cast("long")).alias("reread"), (k % 50).alias("user_unc"), (k % 900).alias("system_unc"),
        F.when(k % 3 == 0, "4.6").otherwise("4.5").alias("family"))


_paid_w = """CASE WHEN i > 1 THEN greatest(1, start - prev_end, prev_out + prev_h, w_harness) WHEN cold THEN greatest(1, user_i, w_harness)
  WHEN missed THEN greatest(1, reread_i + user_i, start) ELSE greatest(1, greatest(start - coalesce(prior, 0), 0), user_i, w_harness) END"""
_s1 = split_sql("v_facts", "input", "start", "off_in")
_s2 = split_sql(f"(SELECT *, {_paid_w} AS pw FROM ({_s1}))", "paid0", "pw", "off_unc")
_s3 = cap_sql(f"({_s2})", "paid", "paid0", "input")
_s4 = split_sql(f"(SELECT *, greatest(off_in - off_unc, 0) AS pool, least(greatest(system_unc + user_i, 0), greatest(off_in - off_unc, 0)) AS open1 FROM ({_s3}))",
                "mid", 'greatest("end", 1)', "CASE WHEN n > 2 THEN pool - open1 ELSE 0 END", "i > 1 AND NOT is_last")
b.VIEWS["v_inputs"] = f"""
  SELECT * EXCLUDE (pool, open1, mid, pw, paid0, shown_, all_, c1_), CAST(CASE WHEN cold AND pool > 0 THEN greatest(pool - shown_, 0) ELSE all_ - shown_ END AS BIGINT) AS cache_omitted,
    CAST(CASE WHEN NOT cold AND prior > 0 AND NOT missed THEN least(prior, c1_) ELSE 0 END AS BIGINT) AS user_cache_share
  FROM (SELECT *, sum(cache) OVER ({P}) AS shown_, sum(input - paid) OVER ({P}) AS all_, first_value(cache) OVER ({P} ORDER BY call_no) AS c1_
    FROM (SELECT *, CAST(CASE WHEN cold AND pool > 0 THEN CASE WHEN n = 1 THEN pool WHEN n = 2 THEN CASE WHEN i = 1 THEN pool ELSE 0 END WHEN i = 1 THEN open1 ELSE mid END
        ELSE CASE WHEN is_last AND n > 1 THEN 0 ELSE input - paid END END AS BIGINT) AS cache FROM ({_s4})))"""


@query("call_inputs_and_cache", "L6 L7", "SELECT round_id, call_no, input, paid, cache, cache_omitted, user_cache_share FROM v_inputs")
def call_inputs_and_cache(spark, sf):
    d = by_round(recon_calls(spark, sf), lambda x, g: r.inputs_and_cache(r.round_facts(x, g), g))
    return d.select("round_id", "call_no", "input", "paid", "cache", "cache_omitted", "user_cache_share")


def down_sql(src, out, amt, need):
    return f"""SELECT * EXCLUDE (b_), CAST({amt} - least({amt}, greatest({need} - b_, 0)) AS BIGINT) AS {out} FROM (
      SELECT *, coalesce(sum({amt}) OVER ({P} ORDER BY {amt} DESC, call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_ FROM {src})"""


_o0 = f"SELECT *, sum(w_message + w_emit) OVER ({P}) AS fixed, sum(w_enc) OVER ({P}) AS encs, sum(w_thought) OVER ({P}) AS ths FROM v_inputs"
_o1 = split_sql(f"({_o0})", "bag", "w_message + w_emit", "CASE WHEN fixed > off_out THEN off_out ELSE 0 END")
_pair = """CASE WHEN w_message + w_emit > 0 THEN CAST(floor(w_message / (w_message + w_emit) * bag) + CASE
   WHEN bag - floor(w_message / (w_message + w_emit) * bag) - floor(w_emit / (w_message + w_emit) * bag) >= 2 THEN 1
   WHEN bag - floor(w_message / (w_message + w_emit) * bag) - floor(w_emit / (w_message + w_emit) * bag) = 1
     AND w_message / (w_message + w_emit) * bag - floor(w_message / (w_message + w_emit) * bag) >= w_emit / (w_message + w_emit) * bag - floor(w_emit / (w_message + w_emit) * bag) THEN 1 ELSE 0 END AS BIGINT)
   ELSE bag - bag // 2 END"""
_o2 = f"""SELECT *, CASE WHEN fixed > off_out THEN pm ELSE w_message END AS m0, CASE WHEN fixed > off_out THEN bag - pm ELSE w_emit END AS e0,
  CASE WHEN encs > 0 THEN w_enc WHEN ths > 0 THEN w_thought ELSE 1 END AS sc FROM (SELECT *, CASE WHEN bag > 0 THEN {_pair} ELSE 0 END AS pm FROM ({_o1}))"""
_o3 = split_sql(f"({_o2})", "r0", "sc", "greatest(off_out - fixed, 0)")
_o4 = down_sql(f"({_o3})", "r1", "r0", "ths")
_o5 = down_sql(f"(SELECT *, sum(r0) OVER ({P}) AS rs, sum(e0) OVER ({P}) AS es FROM ({_o4}))", "o_emit", "e0", "greatest(ths - rs, 0)")
_o6 = down_sql(f"({_o5})", "o_message", "m0", "greatest(ths - rs - es, 0)")
_o7 = split_sql(f"(SELECT *, sum(r1 + o_emit + o_message) OVER ({P}) AS got FROM ({_o6}))", "back", "sc", "off_out - got")
b.VIEWS["v_outputs"] = f"""SELECT * EXCLUDE (fixed, encs, ths, bag, pm, m0, e0, sc, r0, r1, rs, es, got, back), CASE WHEN off_out > 0 THEN w_thought ELSE 0 END AS o_thought, r1 + back AS o_reason,
   r1 + back + o_emit + o_message AS output FROM ({_o7})"""


@query("call_outputs", "L8", "SELECT round_id, call_no, o_thought, o_reason, o_emit, o_message, output FROM v_outputs")
def call_outputs(spark, sf):
    d = by_round(recon_calls(spark, sf), lambda x, g: r.outputs(r.inputs_and_cache(r.round_facts(x, g), g), g))
    return d.select("round_id", "call_no", "o_thought", "o_reason", "o_emit", "o_message", "output")


_h0 = f"""SELECT *, sum(out_in) OVER ({P}) AS outs, first_value(start) OVER ({P} ORDER BY call_no) AS start1
  FROM (SELECT *, CAST(CASE WHEN n > 1 AND NOT is_last THEN o_thought + o_reason + o_message + o_emit ELSE 0 END AS BIGINT) AS out_in FROM v_outputs)"""
_h1 = split_sql(f"({_h0})", "t1", "w_harness", "CASE WHEN NOT cold THEN greatest(off_unc - outs - user_i - reread_i, 0) ELSE 0 END")
_h2 = f"""SELECT *, sum(tw) OVER ({P}) AS ts, CASE WHEN user_i <= 0 AND NOT cold THEN CASE WHEN start1 > prior THEN start1 - prior ELSE 0 END ELSE user_i END AS user_reserved
  FROM (SELECT *, CASE WHEN sum(w_harness) OVER ({P}) <= 0 THEN 0 WHEN NOT cold THEN t1 ELSE w_harness END AS tw FROM ({_h1}))"""
_h3 = split_sql(f"({_h2})", "t2", "tw", "CASE WHEN NOT cold AND ts > 0 THEN greatest(greatest(off_unc - user_reserved - reread_i, 0) - outs, 0) ELSE 0 END")
b.VIEWS["v_harness"] = f"""SELECT * EXCLUDE (outs, start1, t1, tw, ts, t2), tools_in + out_in AS harness_in FROM (SELECT *, CAST(CASE WHEN cold THEN tw WHEN ts > 0 THEN t2 ELSE 0 END AS BIGINT) AS tools_in FROM ({_h3}))"""


@query("call_harness_in", "L9", "SELECT round_id, call_no, out_in, tools_in, harness_in, user_reserved FROM v_harness")
def call_harness_in(spark, sf):
    d = by_round(recon_calls(spark, sf), lambda x, g: r.harness_in(r.outputs(r.inputs_and_cache(r.round_facts(x, g), g), g), g))
    return d.select("round_id", "call_no", "out_in", "tools_in", "harness_in", "user_reserved")


def pos(x, rate):
    return f"CASE WHEN {x} > 0 THEN {x} * {rate} / 1e6 ELSE 0.0 END"


b.VIEWS["v_recon"] = f"""
  SELECT *, in_usd + cache_usd + out_usd AS call_usd, paid_usd + cache_usd + out_usd AS api_usd, CASE WHEN fit > 0 THEN th0 * out_usd / fit ELSE out_usd END AS thought_usd,
    CASE WHEN fit > 0 THEN re0 * out_usd / fit ELSE 0.0 END AS reason_usd, CASE WHEN fit > 0 THEN em0 * out_usd / fit ELSE 0.0 END AS emit_usd,
    CASE WHEN fit > 0 THEN ms0 * out_usd / fit ELSE 0.0 END AS message_usd
  FROM (SELECT *, th0 + re0 + em0 + ms0 AS fit FROM (
    SELECT h.*, r.tier, r.ri, {pos('harness_in', 'ri')} AS in_usd, {pos('paid', 'ri')} AS paid_usd, {pos('cache', 'rc')} AS cache_usd, {pos('output', 'ro')} AS out_usd,
      {pos('out_in', 'ri')} AS out_in_usd, {pos('o_thought', 'ro')} AS th0, {pos('o_reason', 'ro')} AS re0, {pos('o_emit', 'ro')} AS em0, {pos('o_message', 'ro')} AS ms0,
      greatest("end" - start, 0) AS growth_raw, CASE WHEN "end" - start > 0 THEN greatest("end" - start, output) ELSE output + w_harness END AS growth_est
    FROM (SELECT *, CASE WHEN start > 0 THEN start WHEN input > 0 THEN input ELSE 1 END AS tier_ctx FROM v_harness) h
    JOIN rate_card r ON r.family = h.family AND tier_ctx > r.lo AND tier_ctx <= r.hi))"""
_MONEY = ["in_usd", "paid_usd", "cache_usd", "out_usd", "thought_usd", "reason_usd", "emit_usd", "message_usd", "call_usd", "api_usd"]


def reconstructed(spark, sf):
    return by_round(recon_calls(spark, sf), r.reconstruct)


@query("priced_calls", "L10 L11 P16", f"SELECT round_id, call_no, tier, tier_ctx, growth_raw, growth_est, {', '.join(b.r8(x) + ' AS ' + x for x in _MONEY)} FROM v_recon")
def priced_calls(spark, sf):
    return reconstructed(spark, sf).select("round_id", "call_no", "tier", "tier_ctx", "growth_raw", "growth_est", *[p.gold(c(x), 8).alias(x) for x in _MONEY])


_SUMS = {"input_tokens": "input", "uncached_tokens": "paid", "cached_tokens": "cache", "output_tokens": "output", "harness_tokens": "harness_in", "tool_in_tokens": "tools_in",
         "out_in_tokens": "out_in", "out_to_harness_tokens": "o_emit", "out_to_user_tokens": "o_message", "reasoning_tokens": "o_reason", "thought_tokens": "o_thought"}
_USD = {"harness_usd": "in_usd", "paid_usd": "paid_usd", "cached_usd": "cache_usd", "output_usd": "out_usd", "out_to_harness_usd": "emit_usd", "out_to_user_usd": "message_usd",
        "reasoning_usd": "reason_usd", "thought_usd": "thought_usd", "api_usd": "api_usd", "out_in_usd": "out_in_usd"}
def breakdown_sql() -> str:
    return f"""SELECT round_id, any_value(session_id) AS session_id, any_value(family) AS family, count(*) AS calls, {', '.join(f'CAST(sum({v}) AS BIGINT) AS {k}' for k, v in _SUMS.items())},
  max(cache_omitted) AS cache_omitted, max(user_cache_share) AS user_cache_share, CAST(max(user_reserved) AS BIGINT) AS user_reserved, bool_or(cold) AS cold, bool_or(missed) AS missed, max(prior) AS prior,
  max(reread) AS reread, max(off_in) AS off_in, max(off_cache) AS off_cache, max(user_unc) AS user_unc, max(system_unc) AS system_unc, max("end") AS context_end, min(CASE WHEN i = 1 THEN start END) AS start0,
  max(CASE WHEN is_last THEN o_thought + o_reason + o_message END) AS answer, {', '.join(f'sum({v}) AS {k}' for k, v in _USD.items())} FROM v_recon GROUP BY round_id"""


b.VIEWS["v_breakdown"] = breakdown_sql()
_BCOLS = ["calls", *_SUMS, "cache_omitted", "user_cache_share", "user_reserved", "cold"]


def breakdown(spark, sf):
    d = reconstructed(spark, sf)
    facts = [
        F.first("session_id").alias("session_id"), F.first("family").alias("family"), F.bool_or("missed").alias("missed"), F.max("prior").alias("prior"), F.max("reread").alias("reread"),
        F.max("off_in").alias("off_in"), F.max("off_cache").alias("off_cache"), F.max("user_unc").alias("user_unc"), F.max("system_unc").alias("system_unc"),
        F.max("end").alias("context_end"), F.min(F.when(c("i") == 1, c("start"))).alias("start0"),
        F.max(F.when(c("is_last"), c("o_thought") + c("o_reason") + c("o_message"))).alias("answer")]
    return r.round_breakdown(d, ["round_id"], facts)


@query("round_breakdown", "A19", f"SELECT round_id, {', '.join(_BCOLS)}, {', '.join(b.r6(x) + ' AS ' + x for x in _USD)} FROM v_breakdown")
def round_breakdown(spark, sf):
    return r.round_breakdown(reconstructed(spark, sf), ["round_id"]).select("round_id", *_BCOLS, *[p.gold(c(x)).alias(x) for x in _USD])


@query("shown_call_windows", "W10", f"""
SELECT round_id, call_no, NOT (n = 1) AND is_last AS skip_context, CASE WHEN n = 1 THEN CASE WHEN cold THEN 0 ELSE start END WHEN is_last THEN NULL WHEN cold AND i = 1 THEN 0 ELSE ns END AS shown_start,
  CASE WHEN n = 1 THEN "end" WHEN is_last THEN NULL WHEN cold AND i = 1 THEN ns ELSE ne END AS shown_end,
  CASE WHEN n = 1 THEN greatest("end" - start, 0) WHEN is_last THEN 0 ELSE greatest(ns - CASE WHEN cold AND i = 1 THEN 0 ELSE start END, 0) END AS shown_growth
FROM (SELECT *, lead(start) OVER ({P} ORDER BY call_no) AS ns, lead("end") OVER ({P} ORDER BY call_no) AS ne FROM v_facts)""")
def shown_call_windows(spark, sf):
    def body(x, g):
        d = r.round_facts(x, g).withColumns({"raw_start": c("start"), "growth_raw": a.floor0(c("end") - c("start"))})
        return r.display_windows(d, g)

    return by_round(recon_calls(spark, sf), body).select("round_id", "call_no", "skip_context", "shown_start", "shown_end", "shown_growth")


@query("system_bucket", "L12", """
SELECT round_id, user_unc + harness_tokens AS tree_in, greatest(context_end - user_unc - harness_tokens - system_unc, 0) AS bucket,
  system_unc + greatest(context_end - user_unc - harness_tokens - system_unc, 0) AS system_in FROM v_breakdown""")
def system_bucket(spark, sf):
    d = breakdown(spark, sf).withColumns({"user_in": c("user_unc"), "calls_in": c("harness_tokens"), "history_tokens": c("system_unc")})
    return r.system_bucket(d).select("round_id", "tree_in", "bucket", "system_in")


@query("bootstrap_split", "L13 P41", f"""
WITH k AS (SELECT conv_id AS round_id, turn AS call_no, strlen(text) // 4 AS tokens, CASE turn % 6 WHEN 0 THEN 'system' WHEN 1 THEN 'user_info' WHEN 2 THEN 'mcp' WHEN 3 THEN 'reminders' WHEN 4 THEN 'other' ELSE 'user_prompt' END AS bucket,
  5000 + conv_id * 7 AS target FROM conversations),
s AS (SELECT *, bucket <> 'user_prompt' AS sys, greatest(1, sum(CASE WHEN bucket <> 'user_prompt' THEN tokens ELSE 0 END) OVER ({P})) AS sw, sum(CASE WHEN bucket <> 'user_prompt' THEN 0 ELSE tokens END) OVER ({P}) AS uw FROM k),
q AS (SELECT *, floor(sw / (sw + uw) * target) AS fa, floor(uw / (sw + uw) * target) AS fb FROM s),
t AS (SELECT *, CAST(fa + CASE WHEN target - fa - fb >= 2 THEN 1 WHEN target - fa - fb = 1 AND sw / (sw + uw) * target - fa >= uw / (sw + uw) * target - fb THEN 1 ELSE 0 END AS BIGINT) AS st FROM q)
SELECT round_id, call_no, bucket, CASE WHEN sys THEN part ELSE target - st END AS scaled FROM ({split_sql('t', 'part', 'tokens', 'st', 'sys')})""")
def bootstrap_split(spark, sf):
    i = c("turn") % 6
    kind = F.when(i == 0, "system").when(i == 1, "user_info").when(i == 2, "mcp").when(i == 3, "reminders").when(i == 4, "other").otherwise("user_prompt")
    d = b.table(spark, sf, "conversations").select(c("conv_id").alias("round_id"), c("turn").alias("call_no"), F.floor(F.octet_length("text") / 4).cast("long").alias("tokens"),
                                                   kind.alias("bucket"), (5000 + c("conv_id") * 7).alias("target"))
    return by_round(d, r.bootstrap_split).select("round_id", "call_no", "bucket", "scaled")


b.VIEWS["v_prompts"] = f"""
  SELECT v.*, CASE WHEN cold THEN 0 WHEN user_cache_share > 0 THEN user_cache_share ELSE greatest(coalesce(prior, 0), 0) END AS user_cached,
    CASE WHEN cold THEN {pos('system_unc', 'ri')} ELSE 0.0 END AS system_usd, {pos('user_unc', 'ri')} AS user_usd,
    (CASE WHEN cold THEN 0 WHEN user_cache_share > 0 THEN user_cache_share ELSE greatest(coalesce(prior, 0), 0) END) * rc / 1e6 AS user_cached_usd,
    coalesce(reread, 0) * ri / 1e6 AS reread_usd
  FROM (SELECT *, greatest(coalesce(start0, 1), 1) AS pctx FROM v_breakdown) v JOIN rate_card r ON r.family = v.family AND pctx > r.lo AND pctx <= r.hi"""


def prompts(spark, sf):
    d = breakdown(spark, sf).withColumns({"is_first": c("cold"), "system_in": c("system_unc"), "user_in": c("user_unc"), "tier_ctx": F.greatest(F.coalesce("start0", F.lit(1)), F.lit(1)), "reread_in": c("reread")})
    d = r.price_prompts(d)
    return d.withColumn("reread_usd", p.price_tokens("input", F.coalesce("reread", F.lit(0)), c("family"), c("tier_ctx")))


@query("priced_prompts", "L14", f"SELECT round_id, user_cached, {b.r8('system_usd')} AS system_usd, {b.r8('user_usd')} AS user_usd, {b.r8('user_cached_usd')} AS user_cached_usd FROM v_prompts")
def priced_prompts(spark, sf):
    return prompts(spark, sf).select("round_id", "user_cached", *[p.gold(c(x), 8).alias(x) for x in ("system_usd", "user_usd", "user_cached_usd")])


@query("round_bills", "L15", f"""
SELECT round_id, coalesce(reread, 0) + user_unc + harness_tokens AS tree_in_tokens, {b.r6('tree')} AS tree_in_usd,
  {b.r6('CASE WHEN cold THEN tree + cached_usd + output_usd ELSE api_usd END')} AS total_usd, {b.r6('CASE WHEN cold THEN system_usd + tree + cached_usd + output_usd ELSE api_usd END')} AS api_total_usd
FROM (SELECT *, reread_usd + user_usd + harness_usd AS tree FROM v_prompts)""")
def round_bills(spark, sf):
    return r.round_tree(prompts(spark, sf)).select("round_id", "tree_in_tokens", *[p.gold(c(x)).alias(x) for x in ("tree_in_usd", "total_usd", "api_total_usd")])


@query("previous_answers", "L16", """
SELECT round_id, answer_in, coalesce(fits AND NOT missed, false) AS from_user_pool, CASE WHEN fits THEN u - answer_in ELSE u END AS prompt_in, missed AND answer_in > 0 AS absorbed
FROM (SELECT *, u > 0 AND u >= answer_in AND answer_in > 0 AS fits FROM (SELECT *, user_unc * 10 AS u, lag(answer) OVER (PARTITION BY session_id ORDER BY round_id) AS answer_in FROM v_breakdown))""")
def previous_answers(spark, sf):
    from sessionledger.session import materialize

    d = materialize(breakdown(spark, sf).withColumn("user_in", c("user_unc") * 10))
    d = skew_safe(d, ["session_id"], "round_id", r.previous_answer)
    return d.select("round_id", "answer_in", "from_user_pool", "prompt_in", "absorbed")


# Tools of a call: as many as the last digit of its weight says.
b.VIEWS["v_call_tools"] = """
  SELECT round_id, call_no, tool_no, ['read_file', 'grep', 'write'][1 + (tool_no + round_id) % 3] AS name, (round_id * 7 + call_no * 13 + tool_no * 31) % 90 AS request_w,
    (round_id * 3 + call_no * 17 + tool_no * 11) % 120 AS result_w, 'c' || round_id || '-' || call_no || '-' || tool_no AS tool_call_id
  FROM (SELECT round_id, call_no, unnest(range(1, 1 + weight % 4)) AS tool_no FROM v_calls)"""


def call_tools(spark, sf):
    d = b.v_calls(spark, sf).filter(c("weight") % 4 > 0).select("round_id", "call_no", F.explode(F.sequence(F.lit(1).cast("long"), c("weight") % 4)).alias("tool_no"))
    names = F.array(F.lit("read_file"), F.lit("grep"), F.lit("write"))
    return d.withColumns({
        "name": F.get(names, ((c("tool_no") + c("round_id")) % 3).cast("int")), "request_w": (c("round_id") * 7 + c("call_no") * 13 + c("tool_no") * 31) % 90,
        "result_w": (c("round_id") * 3 + c("call_no") * 17 + c("tool_no") * 11) % 120,
        "tool_call_id": F.concat(F.lit("c"), c("round_id").cast("string"), F.lit("-"), c("call_no").cast("string"), F.lit("-"), c("tool_no").cast("string"))})


PT = "PARTITION BY round_id, call_no"
_n1 = split_sql("(SELECT t.*, o_emit, emit_usd, tools_in, ri FROM v_call_tools t JOIN v_recon USING (round_id, call_no))", "request", "request_w", "o_emit", part=PT, order="tool_no")
_n2 = split_sql(f"({_n1})", "result", "result_w", "tools_in", part=PT, order="tool_no")
b.VIEWS["v_nodes"] = f"""
  SELECT round_id, call_no, 0 AS tool_no, NULL AS name, kind, tokens, usd FROM (
    SELECT round_id, call_no, unnest([{{'kind': 'thought', 'tokens': o_thought, 'usd': thought_usd}}, {{'kind': 'reasoning', 'tokens': o_reason, 'usd': reason_usd}},
      {{'kind': 'message', 'tokens': o_message, 'usd': message_usd}}, {{'kind': 'llm_to_in', 'tokens': out_in, 'usd': out_in_usd}}], recursive := true) FROM v_recon) WHERE tokens > 0 OR usd > 0
  UNION ALL SELECT round_id, call_no, tool_no, name, 'tool_request', request, CASE WHEN o_emit > 0 THEN emit_usd * (request / o_emit) ELSE 0.0 END FROM ({_n2})
  UNION ALL SELECT round_id, call_no, tool_no, name, 'tool', result, CASE WHEN result > 0 THEN result * ri / 1e6 ELSE 0.0 END FROM ({_n2})"""


def nodes(spark, sf):
    def body(x, g):
        full = r.reconstruct(x, g)
        return r.call_nodes(full, call_tools(spark, sf), ["round_id", "call_no"], g.sub("call_no").reorder("tool_no"))

    return by_round(recon_calls(spark, sf), body)


@query("call_nodes", "L17 L18", f"SELECT round_id, call_no, tool_no, name, kind, tokens, {b.r8('usd')} AS usd FROM v_nodes")
def call_nodes(spark, sf):
    return nodes(spark, sf).select("round_id", "call_no", "tool_no", "name", "kind", "tokens", p.gold(c("usd"), 8).alias("usd"))


@query("tool_pool_shares", "L3 L18", f"""
WITH x AS (SELECT *, result_w AS content, request_w AS grown, (round_id % 9) * 5 AS late FROM v_call_tools),
w AS (SELECT *, CASE WHEN content < 48 AND grown > greatest(content * 3, 32) THEN grown WHEN content > 0 THEN content ELSE grown END AS raw_w FROM x),
s AS (SELECT *, sum(raw_w) OVER ({PT}) AS signal FROM w),
v AS (SELECT *, CASE WHEN signal > 0 THEN raw_w ELSE 1 END AS ww, signal + late AS pool FROM s),
l AS (SELECT *, sum(ww) OVER ({PT}) AS sw, max(CASE WHEN ww > 0 THEN tool_no END) OVER ({PT}) AS last FROM v),
y AS (SELECT *, CASE WHEN pool > 0 AND ww > 0 AND tool_no IS DISTINCT FROM last THEN CAST(round_even(pool * ww / sw, 0) AS BIGINT) ELSE 0 END AS sh FROM l)
SELECT round_id, call_no, tool_no, raw_w, CAST(CASE WHEN pool <= 0 OR ww <= 0 THEN 0 WHEN tool_no = last THEN greatest(pool - sum(sh) OVER ({PT}), 0) ELSE sh END AS BIGINT) AS pool_share FROM y""")
def tool_pool_shares(spark, sf):
    d = call_tools(spark, sf).withColumns({"ch_result_tokens": F.lit(0), "result_tokens": c("result_w"), "tool_delta": c("request_w"), "late_delta": (c("round_id") % 9) * 5})
    out = skew_safe(d, ["round_id", "call_no"], "tool_no", r.tool_pool)
    return out.select("round_id", "call_no", "tool_no", "raw_w", "pool_share")


@query("unaccounted_growth", "L18", """
SELECT round_id, call_no, w_thought + w_emit + w_message + w_harness AS parts_sum, "end" - start - (w_thought + w_emit + w_message + w_harness) AS unaccounted FROM v_facts""")
def unaccounted_growth(spark, sf):
    return r.unaccounted(recon_calls(spark, sf)).select("round_id", "call_no", "parts_sum", "unaccounted")


@query("tool_summaries", "A16", """
SELECT round_id, call_no, string_agg(label, ' · ' ORDER BY first) AS summary FROM (
  SELECT round_id, call_no, CASE WHEN count(*) > 1 THEN name || ' x' || count(*) ELSE name END AS label, min(tool_no) AS first FROM v_call_tools GROUP BY round_id, call_no, name) GROUP BY ALL""")
def tool_summaries(spark, sf):
    return r.tool_summary(call_tools(spark, sf), ["round_id", "call_no"])


@query("call_weights", "L5", """
SELECT c.round_id, call_no, CASE WHEN w_thought % 2 = 0 AND w_thought > 0 THEN w_thought ELSE w_enc * 3 // 4 END AS w_thought,
  CASE WHEN coalesce(q, 0) > 0 THEN q WHEN weight * 60 < 2000 AND weight > 0 THEN weight * 60 ELSE 0 END AS w_emit,
  CASE WHEN w_tool % 3 = 0 AND w_tool > 0 THEN w_tool WHEN coalesce(gr, 0) > 0 THEN gr ELSE coalesce(rs, 0) END AS w_harness, coalesce(tool_count, 0) AS tool_count
FROM v_calls c LEFT JOIN (SELECT round_id, call_no, CAST(sum(CASE WHEN request_w % 2 = 0 AND request_w > 0 THEN request_w ELSE request_w * 5 // 4 END) AS BIGINT) AS q,
    CAST(sum(CASE WHEN result_w > 0 THEN result_w ELSE request_w * 9 // 4 END) AS BIGINT) AS rs, CAST(sum(CASE WHEN tool_no = 2 THEN 40 ELSE 0 END) AS BIGINT) AS gr, count(*) AS tool_count
  FROM v_call_tools GROUP BY ALL) USING (round_id, call_no)""")
def call_weights(spark, sf):
    t = call_tools(spark, sf).withColumns({
        "ch_result_tokens": F.lit(0), "result_tokens": c("result_w"), "ch_result_chars": F.lit(0), "result_chars": c("request_w") * 9,
        "arg_tokens": F.when(c("request_w") % 2 == 0, c("request_w")), "arg_chars": c("request_w") * 5, "tool_delta": F.when(c("tool_no") == 2, 40).otherwise(0)})
    d = b.v_calls(spark, sf).select(
        "round_id", "call_no", F.when(c("w_thought") % 2 == 0, c("w_thought")).alias("thought_tokens"), (c("w_enc") * 3).alias("thought_chars"), F.lit(0).alias("enc_tokens"),
        F.lit(0).alias("enc_chars"), F.lit(0).alias("message_tokens"), F.lit(0).alias("message_chars"), (c("weight") * 60).alias("emit_delta"), F.when(c("w_tool") % 3 == 0, c("w_tool")).alias("harness_pool"))
    return r.call_weights(d, t, ["round_id", "call_no"]).select("round_id", "call_no", "w_thought", "w_emit", "w_harness", "tool_count")


@query("history_tool_results", "J2", """
WITH h AS (SELECT session_id, 'call-' || session_id || '-' || (idx % 5) AS tool_call_id, max(strlen(text) // 4) AS tok, arg_max(length(text), strlen(text) // 4) AS ch FROM v_history_old GROUP BY ALL)
SELECT t.session_id, round_no, call_no, tool_no, CASE WHEN tok > 0 THEN tok ELSE updates END AS result_tokens, CASE WHEN ch > 0 THEN ch ELSE updates * 4 END AS result_chars FROM v_tools t LEFT JOIN h USING (session_id, tool_call_id)""")
def history_tool_results(spark, sf):
    from sessionledger.operators import sessionize as s

    h = b.v_history(spark, sf, "old").select("session_id", "idx", F.concat(F.lit("call-"), c("session_id").cast("string"), F.lit("-"), (c("idx") % 5).cast("string")).alias("tool_call_id"),
                                             F.floor(F.octet_length("text") / 4).cast("long").alias("content_tokens"), F.length("text").cast("long").alias("content_chars"))
    t = s.tool_rollup(s.by_session(b.v_updates(spark, sf), s.sessionized)).withColumns({"result_tokens": c("updates"), "result_chars": c("updates") * 4})
    return r.stamp_history_results(t, h).select("session_id", "round_no", "call_no", "tool_no", "result_tokens", "result_chars")


@query("reasoning_on_calls", "J3", """
WITH k AS (SELECT session_id, line_no, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n, count(*) OVER (PARTITION BY session_id) AS calls FROM v_call_sum),
h AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n, strlen(text) // 4 AS tok, length(text) AS ch FROM v_history_old),
m AS (SELECT h.session_id, least(h.n, z.calls) AS n, CAST(sum(tok) AS BIGINT) AS tok, CAST(sum(ch) AS BIGINT) AS ch FROM h JOIN (SELECT DISTINCT session_id, calls FROM k) z USING (session_id) GROUP BY ALL)
SELECT k.session_id, line_no, coalesce(tok, 0) AS enc_tokens, coalesce(ch, 0) AS enc_chars FROM k LEFT JOIN m USING (session_id, n)""")
def reasoning_on_calls(spark, sf):
    from sessionledger.plans.sessionize_queries import calls

    rec = b.v_history(spark, sf, "old").select("session_id", "idx", F.floor(F.octet_length("text") / 4).cast("long").alias("encrypted_tokens"), F.length("text").cast("long").alias("encrypted_chars"))
    k = calls(spark, sf).select("session_id", "line_no")
    return skew_safe(k, ["session_id"], "line_no", lambda x, g: r.stamp_reasoning(x, rec, g, g.reorder("idx")))
