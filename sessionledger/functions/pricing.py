"""Rate card, tiers and list-price arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS_PER_USD = 10_000_000_000
TIER_LIMIT = 200_000
DEFAULT_FAMILY = "4.5"

# USD per million tokens by model family and prompt-size tier.
# (family, id patterns, tier, low bound exclusive, high bound inclusive, input, cached, output)
RATES = [
    ("4.6", ("4.6", "4-6"), "low", -1, TIER_LIMIT, 2.0, 0.5, 6.0),
    ("4.6", ("4.6", "4-6"), "high", TIER_LIMIT, 2**62, 4.0, 1.0, 12.0),
    ("4.5", ("4.5", "4-5"), "low", -1, TIER_LIMIT, 2.0, 0.3, 6.0),
    ("4.5", ("4.5", "4-5"), "high", TIER_LIMIT, 2**62, 4.0, 0.6, 12.0),
]
FAMILIES = list(dict.fromkeys((f, p) for f, p, *_ in RATES))


def rate_card(spark: SparkSession) -> DataFrame:
    """The rate card as a table: four rows, so it is always safe to broadcast."""
    return spark.createDataFrame(
        [(f, t, lo, hi, i, c, o) for f, _, t, lo, hi, i, c, o in RATES],
        "family string, tier string, lo_ctx long, hi_ctx long, "
        "rate_input double, rate_cached double, rate_output double",
    )


def non_negative(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0))


def price_family(model_id: Column) -> Column:
    """Model id to price family; NULL when no family matches."""
    s = F.translate(F.lower(F.trim(model_id)), "_ ", "--")
    out = F.lit(None).cast("string")
    for family, patterns in reversed(FAMILIES):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | s.contains(p)
        out = F.when(hit, F.lit(family)).otherwise(out)
    return out


def family_or_default(*candidates: Column) -> Column:
    known = [f for f, _ in FAMILIES]
    picks = [F.when(c.isin(known), c) for c in candidates]
    return F.coalesce(*picks, F.lit(DEFAULT_FAMILY))


def gold(usd: Column, digits: int = 6) -> Column:
    """Round dollars for output, halves up.

    List prices are multiples of 1e-7 and official bills of 1e-10 dollars, so sums often sit on
    a rounding tie give or take binary noise; a nudge below both units settles it.
    """
    return F.round(usd + F.lit(3.7e-11), digits)


def ticks_to_usd(ticks: Column) -> Column:
    return F.when(ticks < 0, F.lit(None).cast("double")).otherwise(ticks / F.lit(float(TICKS_PER_USD)))


def usd_to_ticks(usd: Column) -> Column:
    return F.rint(usd * F.lit(float(TICKS_PER_USD))).cast("long")


def tier_context(peak: Column, input_tokens: Column, calls: Column) -> Column:
    """Prompt size that selects the tier: observed peak, average prompt, or the input."""
    inp = non_negative(input_tokens)
    n = F.coalesce(calls.cast("long"), F.lit(0))
    avg = F.greatest(F.lit(1).cast("long"), F.floor(inp / n).cast("long"))
    return F.coalesce(F.when(peak > 0, peak.cast("long")), F.when((n > 1) & (inp > 0), avg), inp)


def tier_method(peak: Column, input_tokens: Column, calls: Column) -> Column:
    inp, n = non_negative(input_tokens), F.coalesce(calls.cast("long"), F.lit(0))
    return (
        F.when(peak > 0, "peak_meta_total_tokens")
        .when((n > 1) & (inp > 0), "input_div_model_calls").otherwise("input_tokens")
    )


def call_tier_context(fallback: Column, *prompt_sizes: Column) -> Column:
    """First positive prompt size of a call (own start first), else the fallback, at least 1."""
    picks = [F.when(c > 0, c.cast("long")) for c in prompt_sizes]
    floor = F.greatest(F.lit(1).cast("long"), F.coalesce(fallback.cast("long"), F.lit(1).cast("long")))
    return F.coalesce(*picks, floor)


def tier_name(context: Column) -> Column:
    return F.when(context > TIER_LIMIT, "high").otherwise("low")


def unit_rate(kind: str, family: Column, context: Column) -> Column:
    """USD per million tokens for ``kind`` in (input, cached, output)."""
    slot = {"input": 5, "cached": 6, "output": 7}[kind]
    out = None
    for row in RATES:
        cond = (family == row[0]) & (context > row[3]) & (context <= row[4])
        out = F.when(cond, F.lit(row[slot])) if out is None else out.when(cond, F.lit(row[slot]))
    return out


def unit_rates(family: Column, context: Column) -> Column:
    """All rates of :func:`unit_rate` as one struct, chosen once."""
    out = None
    for row in RATES:
        cond = (family == row[0]) & (context > row[3]) & (context <= row[4])
        rates = F.struct(F.lit(row[5]).alias("input"), F.lit(row[6]).alias("cached"), F.lit(row[7]).alias("output"))
        out = F.when(cond, rates) if out is None else out.when(cond, rates)
    return out


def price_tokens(kind: str, tokens: Column, family: Column, context: Column) -> Column:
    """Dollars for a token count; 0 for counts that are not positive."""
    return F.when(tokens > 0, tokens * unit_rate(kind, family, context) / F.lit(1_000_000.0)).otherwise(F.lit(0.0))


def join_rates(df: DataFrame, family: str = "family", context: str = "tier_ctx") -> DataFrame:
    """Attach the rate row of each (family, context)."""
    card = rate_card(df.sparkSession).withColumnRenamed("family", "__fam")
    cond = (
        (F.col(family) == F.col("__fam"))
        & (F.col(context) > F.col("lo_ctx")) & (F.col(context) <= F.col("hi_ctx"))
    )
    return df.join(F.broadcast(card), cond, "left").drop("__fam", "lo_ctx", "hi_ctx")


def list_cost(df: DataFrame, input_tokens: str, cached: str, output: str) -> DataFrame:
    """Clamp the cache to the input and price In, Cached and Out at the joined rates.

    Reasoning tokens are part of the output count and are never billed on top.
    """
    inp, out = non_negative(F.col(input_tokens)), non_negative(F.col(output))
    c = F.least(non_negative(F.col(cached)), inp)
    million = F.lit(1_000_000.0)
    return df.withColumns({
        "uncached_tokens": inp - c, "cached_clamped": c, "output_billed": out,
        "list_in_usd": (inp - c) * F.col("rate_input") / million,
        "list_cached_usd": c * F.col("rate_cached") / million,
        "list_out_usd": out * F.col("rate_output") / million,
    }).withColumn("list_usd", F.col("list_in_usd") + F.col("list_cached_usd") + F.col("list_out_usd"))


def price_turns(df: DataFrame) -> DataFrame:
    """Price each turn from its official counters.

    Needs ``input, cached, output, reasoning, calls, ticks, model``. Adds the token and cost
    columns of a priced turn; parts are rescaled so that they add up to the official bill
    whenever one is stamped.
    """
    # Counters of a turn are sums over its calls, so the tier follows the average prompt.
    inp, n = non_negative(F.col("input")), F.coalesce(F.col("calls").cast("long"), F.lit(0))
    ctx = F.when(n > 1, F.floor(inp / n).cast("long")).otherwise(inp)
    d = df.withColumns({"family": family_or_default(price_family(F.col("model"))), "tier_ctx": ctx})
    d = list_cost(join_rates(d), "input", "cached", "output")
    official = F.when(F.coalesce(F.col("ticks"), F.lit(0)) != 0, ticks_to_usd(F.col("ticks")))
    d = d.withColumn("official_stamp", official)
    fit = (F.col("official_stamp") > 0) & (F.col("list_usd") > 0)
    scale = F.when(fit, F.col("official_stamp") / F.col("list_usd")).otherwise(F.lit(1.0))
    reason = F.when(F.col("output_billed") > 0,
                    F.least(non_negative(F.col("reasoning")), F.col("output_billed"))).otherwise(F.lit(0).cast("long"))
    d = d.withColumns({
        "tokens_in": F.col("uncached_tokens"), "tokens_cached": F.col("cached_clamped"),
        "tokens_out": F.col("output_billed"), "tokens_reason": reason,
        "cost_in_usd": F.col("list_in_usd") * scale, "cost_cached_usd": F.col("list_cached_usd") * scale,
        "cost_out_usd": F.col("list_out_usd") * scale,
        "estimate_usd": F.when(fit, F.col("official_stamp")).otherwise(F.col("list_usd")),
        "official_usd": F.coalesce(F.col("official_stamp"), F.when(fit, F.col("official_stamp")).otherwise(F.col("list_usd"))),
    })
    d = d.withColumn("cost_reason_usd", F.when(
        F.col("tokens_reason") > 0,
        F.col("cost_out_usd") * (F.col("tokens_reason") / F.col("tokens_out"))).otherwise(F.lit(0.0)))
    return d.drop("uncached_tokens", "cached_clamped", "output_billed", "list_in_usd", "list_cached_usd",
                  "list_out_usd", "rate_input", "rate_cached", "rate_output", "official_stamp")


def has_usage() -> Column:
    """A turn counts when it has any tokens or an official bill."""
    c = F.col
    return (c("tokens_in") > 0) | (c("tokens_cached") > 0) | (c("tokens_out") > 0) | (c("official_usd") > 0)


def official_usage_sums() -> list[Column]:
    """The official counters that are summed per session."""
    return [F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in USAGE_COUNTERS]


USAGE_COUNTERS = ["input", "output", "reasoning", "cached", "total", "ticks", "api_ms", "calls"]


def throughput(tokens: Column, api_ms: Column) -> Column:
    return F.when(api_ms > 0, F.round(tokens / (api_ms / 1000.0), 3))


def usd_per_second(usd: Column, api_ms: Column) -> Column:
    return F.when(api_ms > 0, F.round(usd / (api_ms / 1000.0), 6))


def usd_per_million(usd: Column, total_tokens: Column) -> Column:
    return F.when(total_tokens != 0, F.round(usd / total_tokens * 1_000_000, 4))


def money(tokens_in: Column, tokens_cached: Column, tokens_out: Column,
          cost_in: Column, cost_cached: Column, cost_out: Column) -> Column:
    """The three token and three cost fields of one bill plus their total."""
    i, c, o = (F.coalesce(x, F.lit(0.0)) for x in (cost_in, cost_cached, cost_out))
    return F.struct(
        F.coalesce(tokens_in, F.lit(0)).alias("tokens_in"), F.coalesce(tokens_cached, F.lit(0)).alias("tokens_cached"),
        F.coalesce(tokens_out, F.lit(0)).alias("tokens_out"), i.alias("cost_in_usd"), c.alias("cost_cached_usd"),
        o.alias("cost_out_usd"), (i + c + o).alias("estimate_usd"),
    )
