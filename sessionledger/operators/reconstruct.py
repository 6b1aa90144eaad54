"""Give every model call its share of the round's official counters, and price it.

Input: one row per call with
  ``start, end`` (prompt size at stream start / end), weights ``w_thought, w_enc, w_emit,
  w_message, w_harness`` (token estimates), and the round's values repeated on each row:
  ``off_in, off_cache, off_out`` (official counters, NULL when unknown), ``prior`` (context
  carried in, NULL or 0 = cold), ``reread`` (context re-billed after a cache miss, NULL = no
  miss), ``user_unc, system_unc`` and ``family``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators.allocate import cap_and_push, fit_columns, floor0, round_pair, share_of_pair, split_each, split_exact, split_pair, take_down
from sessionledger.operators.grouping import Groups, Run, Total

# Fixed values of the rules: growth before a call's tools counts as its request text below this many tokens,
EMIT_GROWTH_BELOW = 2_000
# and a result thinner than this is weighed by the growth it caused, if that is so many times its size and no trifle.
THIN_RESULT, GROWN_TIMES, GROWN_AT_LEAST = 48, 3, 32
c = F.col


def long(x: Column) -> Column:
    return x.cast("long")


def tool_weights(tools: DataFrame) -> DataFrame:
    """Result and request weight of each tool: counted tokens first, else characters / 4."""
    from sessionledger.functions.text import tokens_of_chars

    def first(*cols: Column) -> Column:
        return F.coalesce(*[F.when(x > 0, long(x)) for x in cols])

    return tools.withColumns({
        "result_w": F.coalesce(first(c("ch_result_tokens"), c("result_tokens")), tokens_of_chars(first(c("ch_result_chars"), c("result_chars")))),
        "request_w": F.coalesce(first(c("arg_tokens")), tokens_of_chars(c("arg_chars"))),
    })


def call_weights(calls: DataFrame, tools: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of a call from its own measures and its tools."""
    from sessionledger.functions.text import tokens_of_chars

    t = tool_weights(tools).groupBy(*keys).agg(
        F.sum("request_w").alias("__req"), F.sum("result_w").alias("__res"), F.sum(floor0(c("tool_delta"))).alias("__grown"),
        F.count(F.lit(1)).alias("tool_count"))
    d = calls.join(t, keys, "left")

    def tok(tokens: str, chars: str) -> Column:
        return F.coalesce(F.when(c(tokens) > 0, long(c(tokens))), tokens_of_chars(c(chars)))

    emit = F.coalesce(F.when(c("__req") > 0, c("__req")), F.when((c("emit_delta") > 0) & (c("emit_delta") < EMIT_GROWTH_BELOW), c("emit_delta")), F.lit(0))
    pool = F.coalesce(F.when(c("harness_pool") > 0, c("harness_pool")), F.when(c("__grown") > 0, c("__grown")), c("__res"), F.lit(0))
    return d.withColumns({
        "w_thought": tok("thought_tokens", "thought_chars"), "w_enc": tok("enc_tokens", "enc_chars"),
        "w_message": tok("message_tokens", "message_chars"), "w_emit": long(emit), "w_harness": long(pool),
        "tool_count": F.coalesce("tool_count", F.lit(0)),
    }).drop("__req", "__res", "__grown")


def round_facts(calls: DataFrame, g: Groups) -> DataFrame:
    """Position of each call, its neighbours, and whether the round starts cold."""
    out = floor0(c("w_thought")) + floor0(c("w_enc")) + floor0(c("w_emit")) + floor0(c("w_message"))
    d = g.describe(calls.withColumn("__out", out), "i", {"n": Total("count", F.lit(1))}, {
        "prev_end": Run("adjacent", c("end")), "prev_out": Run("adjacent", c("__out")), "prev_h": Run("adjacent", c("w_harness"))})
    unc = F.when(c("off_cache").isNotNull(), floor0(c("off_in") - F.least("off_cache", "off_in"))).otherwise(c("off_in"))
    return d.drop("__out").withColumns({
        "cold": F.coalesce(c("prior") <= 0, F.lit(True)), "off_unc": unc, "missed": c("reread").isNotNull(),
        "is_last": c("i") == c("n"), "user_i": floor0(c("user_unc")), "reread_i": floor0(c("reread")),
    })


def inputs_and_cache(d: DataFrame, g: Groups) -> DataFrame:
    """Prompt size and paid part of every call; what is not paid came from the cache.

    The last of several calls is not read again, so its cached part is reported, not shown.
    """
    grown = floor0(c("start") - F.coalesce("prior", F.lit(0)))
    first = (
        F.when(c("cold"), F.greatest(F.lit(1), c("user_i"), c("w_harness")))
        .when(c("missed"), F.greatest(F.lit(1), c("reread_i") + c("user_i"), c("start")))
        .otherwise(F.greatest(F.lit(1), grown, c("user_i"), c("w_harness"))))
    later = F.greatest(F.lit(1), c("start") - c("prev_end"), c("prev_out") + c("prev_h"), c("w_harness"))
    pool = floor0(c("off_in") - c("off_unc"))
    opening = long(F.least(F.greatest(F.coalesce("system_unc", F.lit(0)) + c("user_i"), F.lit(0)), pool))
    d = d.withColumns({"__pw": F.when(c("i") == 1, first).otherwise(later), "__pool": pool, "__open": opening})
    d = d.drop("prev_end", "prev_out", "prev_h")
    middle = (c("i") > 1) & ~c("is_last")
    d = split_each(d, g, {
        "__in": (c("start"), c("off_in"), None),  # evenly, if no call has a size
        "__paid": (c("__pw"), c("off_unc"), None),
        "__mid": (F.greatest(F.coalesce("end", F.lit(1)), F.lit(1)), F.when(c("n") > 2, c("__pool") - c("__open")).otherwise(0), middle)})
    d = d.withColumn("input", long(F.when(c("off_in").isNull(), floor0(c("start"))).otherwise(c("__in"))))
    d = cap_and_push(d, g, "paid", F.when(c("off_unc").isNull(), long(c("__pw"))).otherwise(c("__paid")), c("input"))
    d = d.withColumn("__cache", c("input") - c("paid"))
    shared = (
        F.when(c("n") == 1, c("__pool")).when(c("n") == 2, F.when(c("i") == 1, c("__pool")).otherwise(0))
        .when(c("i") == 1, c("__open")).otherwise(c("__mid")))
    plain = F.when(c("is_last") & (c("n") > 1), 0).otherwise(c("__cache"))
    d = d.withColumn("cache", long(F.when(c("cold") & (c("__pool") > 0), shared).otherwise(plain)))
    d = g.totals(d, {"__shown": Total("sum", c("cache")), "__all": Total("sum", c("__cache")), "cache_1": Total("first", c("cache"))})
    omitted = F.when(c("cold") & (c("__pool") > 0), floor0(c("__pool") - c("__shown"))).otherwise(c("__all") - c("__shown"))
    share = F.when(~c("cold") & (c("prior") > 0) & ~c("missed"), F.least("prior", "cache_1")).otherwise(0)
    return d.withColumns({"cache_omitted": long(omitted), "user_cache_share": long(share)}).drop(
        "__in", "__pw", "__paid", "__cache", "__pool", "__open", "__mid", "__shown", "__all", "cache_1")


def outputs(d: DataFrame, g: Groups) -> DataFrame:
    """Split the official output: message and tool requests as counted, the rest is reasoning.

    Thought text is part of the reasoning mass; it is shown next to it, never added.
    """
    d = d.withColumns({
        "o_thought": long(floor0(c("w_thought"))), "__msg": long(floor0(c("w_message"))), "__emit": long(floor0(c("w_emit"))),
        "__enc": floor0(c("w_enc"))})
    d = g.totals(d, {"__fixed": Total("sum", c("__msg") + c("__emit")), "__encs": Total("sum", c("__enc")), "__ths": Total("sum", c("o_thought"))})
    total = F.coalesce(floor0(c("off_out")) if False else F.when(c("off_out").isNotNull(), floor0(c("off_out"))),
                       F.greatest(c("__fixed") + c("__encs"), F.lit(1)))
    d = d.withColumn("out_total", long(total))
    over = c("__fixed") > c("out_total")
    pool = floor0(c("out_total") - F.least("__fixed", "out_total"))
    scale = F.when(c("__encs") > 0, c("__enc")).when(c("__ths") > 0, c("o_thought")).otherwise(F.lit(1))
    d = d.withColumn("__scale", scale)
    d = split_each(d, g, {"__bag": (c("__msg") + c("__emit"), F.when(over, c("out_total")).otherwise(0), None), "__r": (c("__scale"), pool, None)})
    # Thought mass: taken off the largest reasoning shares, then handed back by weight.
    need = F.when(c("out_total") > 0, c("__ths")).otherwise(0)
    # The bag's pair comes in two steps with a window between: the code of one step would be too long for the JVM to compile.
    share, other = share_of_pair(c("__msg"), c("__emit"), c("__bag"))
    d = d.withColumns({"__need": need, "__fa": share, "__fb": other})
    d = take_down(d, g, "__r1", c("__r"), c("__need"), {"__rs": Total("sum", c("__r"))})
    msg = round_pair(c("__fa"), c("__fb"), c("__bag"))
    d = d.withColumn("__m", F.when(over, F.when(c("__bag") > 0, msg).otherwise(0)).otherwise(c("__msg"))).drop("__fa", "__fb")
    d = d.withColumn("__e", F.when(over, c("__bag") - c("__m")).otherwise(c("__emit")))
    d = take_down(d, g, "o_emit", c("__e"), floor0(c("__need") - c("__rs")), {"__es": Total("sum", c("__e"))})
    d = take_down(d, g, "o_message", c("__m"), floor0(c("__need") - c("__rs") - c("__es")))
    d = split_each(d, g, {"__back": (c("__scale"), F.when(c("out_total") > 0, c("out_total") - c("__got")).otherwise(0), None)},
                   {"__got": Total("sum", c("__r1") + c("o_emit") + c("o_message"))})
    d = d.withColumns({"o_reason": c("__r1") + c("__back"), "o_thought": F.when(c("out_total") > 0, c("o_thought")).otherwise(0)})
    return d.withColumn("output", c("o_reason") + c("o_emit") + c("o_message")).drop(
        "__msg", "__emit", "__enc", "__fixed", "__encs", "__ths", "__bag", "__m", "__e", "__scale", "__poolr", "__r", "__need",
        "__r1", "__rs", "__es", "__got", "__back")


def harness_in(d: DataFrame, g: Groups) -> DataFrame:
    """What a call's answer and tool results add to the next prompt.

    The answer of every call but the last is read again in full; tool results share what the
    official uncached input leaves after the answers, the user's text and a re-read.
    """
    again = F.when((c("n") > 1) & ~c("is_last"), c("o_thought") + c("o_reason") + c("o_message") + c("o_emit")).otherwise(0)
    d = d.withColumn("out_in", long(again))
    warm = ~c("cold") & c("off_unc").isNotNull()
    room = floor0(c("off_unc") - c("__outs") - c("user_i") - F.when(c("missed"), c("reread_i")).otherwise(0))
    d = split_each(d.withColumns({"__h": floor0(c("w_harness")), "__warm": warm}), g, {"__t1": (c("__h"), F.when(c("__warm"), room).otherwise(0), None)}, {
        "__outs": Total("sum", c("out_in")), "__hs": Total("sum", c("__h")), "start_1": Total("first", c("start"))})
    first = F.when(c("__hs") <= 0, 0).when(c("__warm"), c("__t1")).otherwise(c("__h"))
    # Without a counted user text the growth before the first call stands in for it.
    grown = F.when((c("prior") > 0) & (c("start_1") > c("prior")), c("start_1") - c("prior")).otherwise(0)
    user = F.when((c("user_i") <= 0) & c("__warm"), grown).otherwise(c("user_i"))
    target = floor0(floor0(c("off_unc") - user - F.when(c("missed"), c("reread_i")).otherwise(0)) - c("__outs"))
    d = split_each(d.withColumns({"__tools": long(first), "user_reserved": long(user), "__target": target}), g, {
        "__t2": (c("__tools"), F.when(c("__warm") & (c("__ts") > 0), c("__target")).otherwise(0), None)}, {"__ts": Total("sum", c("__tools"))})
    tools = F.when(c("__warm"), F.when(c("__ts") > 0, c("__t2")).otherwise(0)).otherwise(c("__tools"))
    return d.withColumn("tools_in", long(tools)).withColumn("harness_in", c("out_in") + c("tools_in")).drop(
        "__h", "__outs", "__hs", "start_1", "__warm", "__t1", "__tools", "__ts", "__target", "__t2")


def price_calls(d: DataFrame) -> DataFrame:
    """Price every call at the tier of its own prompt."""
    ctx = p.call_tier_context(F.when(c("input") > 0, c("input")).otherwise(1), c("context_start") if "context_start" in d.columns else c("start"), c("start"), c("input"))
    d = d.withColumn("tier_ctx", ctx)
    d = d.withColumn("__rates", p.unit_rates(c("family"), c("tier_ctx")))

    def usd(kind: str, tokens: str) -> Column:
        return F.when(c(tokens) > 0, c(tokens) * c("__rates")[kind] / F.lit(1_000_000.0)).otherwise(0.0)

    d = d.withColumns({
        "in_usd": usd("input", "harness_in"), "paid_usd": usd("input", "paid"), "cache_usd": usd("cached", "cache"),
        "out_usd": usd("output", "output"), "out_in_usd": usd("input", "out_in"),
        **{f"__{x}": usd("output", x) for x in ("o_thought", "o_reason", "o_emit", "o_message")}})
    d = fit_columns(d, {"thought_usd": "__o_thought", "reason_usd": "__o_reason", "emit_usd": "__o_emit", "message_usd": "__o_message"}, "out_usd")
    keep = [x for x in d.columns if not x.startswith("__")]
    return d.select(
        *keep, (c("in_usd") + c("cache_usd") + c("out_usd")).alias("call_usd"),
        (c("paid_usd") + c("cache_usd") + c("out_usd")).alias("api_usd"), p.tier_name(c("tier_ctx")).alias("tier"))


def context_growth(d: DataFrame) -> DataFrame:
    """Window growth of a call: what the stream shows, at least the answer; else answer and tools."""
    raw = F.when(c("end") > 0, floor0(c("end") - c("start"))).otherwise(0)
    return d.withColumns({
        "growth_raw": long(raw),
        "growth_est": long(F.when(raw > 0, F.greatest(raw, c("output"))).otherwise(c("output") + floor0(c("w_harness"))))})


def reconstruct(calls: DataFrame, g: Groups) -> DataFrame:
    """All call-level columns. See the module text for the input."""
    d = harness_in(outputs(inputs_and_cache(round_facts(calls, g), g), g), g)
    return context_growth(price_calls(d))


def display_windows(calls: DataFrame, g: Groups) -> DataFrame:
    """Shown context per call: the prompt it leads to. The last call shows none, a cold first
    call starts at 0, a single call keeps its own window. Needs ``raw_start, end, n, i, cold``."""
    own_end = F.coalesce("end", "raw_start")
    d = g.running(calls.withColumn("own_end", own_end), {"__ns": Run("adjacent", c("raw_start"), "after"), "__ne": Run("adjacent", c("own_end"), "after")})
    single, last, opening = c("n") == 1, c("is_last"), c("cold") & (c("i") == 1)
    none = F.lit(None).cast("long")
    start = F.when(single, F.when(c("cold"), 0).otherwise(c("raw_start"))).when(last, none).when(opening, 0).otherwise(c("__ns"))
    end = F.when(single, c("own_end")).when(last, none).when(opening, c("__ns")).otherwise(F.coalesce("__ne", "__ns"))
    base = F.when(opening, 0).otherwise(c("raw_start"))
    growth = F.when(single, c("growth_raw")).when(last, 0).otherwise(floor0(c("__ns") - base))
    return d.withColumns({"skip_context": last & ~single, "shown_start": long(start), "shown_end": long(end), "shown_growth": long(growth)}).drop("__ns", "__ne")


def round_breakdown(calls: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Round totals of the reconstructed calls: In, Cached, Out and what they are made of.

    ``extra``: further aggregates to take in the same pass.
    """
    s = lambda x, n: F.sum(x).alias(n)
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), s("input", "input_tokens"), s("paid", "uncached_tokens"), s("cache", "cached_tokens"), s("output", "output_tokens"),
        s("harness_in", "harness_tokens"), s("tools_in", "tool_in_tokens"), s("out_in", "out_in_tokens"), s("o_emit", "out_to_harness_tokens"),
        s("o_message", "out_to_user_tokens"), s("o_reason", "reasoning_tokens"), s("o_thought", "thought_tokens"),
        F.max("cache_omitted").alias("cache_omitted"), F.max("user_cache_share").alias("user_cache_share"), F.max("user_reserved").alias("user_reserved"),
        s("in_usd", "harness_usd"), s("paid_usd", "paid_usd"), s("cache_usd", "cached_usd"), s("out_usd", "output_usd"), s("out_in_usd", "out_in_usd"),
        s("emit_usd", "out_to_harness_usd"), s("message_usd", "out_to_user_usd"), s("reason_usd", "reasoning_usd"), s("thought_usd", "thought_usd"),
        s("api_usd", "api_usd"), F.bool_or("cold").alias("cold"), *(extra or []))


def system_bucket(rounds: DataFrame) -> DataFrame:
    """What the first window holds besides history, user text and calls: tool schemas and glue.

    ``context_end, user_in, calls_in, history_tokens`` -> ``bucket``; System + tree = window.
    """
    tree = c("user_in") + c("calls_in")
    bucket = F.when(c("context_end") > 0, floor0(c("context_end") - tree - c("history_tokens"))).otherwise(0)
    return rounds.withColumns({"tree_in": long(tree), "bucket": long(bucket)}).withColumn("system_in", c("history_tokens") + c("bucket"))


def bootstrap_split(buckets: DataFrame, g: Groups) -> DataFrame:
    """Scale first-prompt buckets to the first context size: system against user, then system kinds.

    ``buckets``: ``bucket, tokens, target, kind_no`` per session.
    """
    from sessionledger.operators.bootstrap import SYSTEM_KINDS

    sys_row = c("bucket").isin(SYSTEM_KINDS)
    d = g.totals(buckets, {"__sys": Total("sum", F.when(sys_row, c("tokens")).otherwise(0)), "__usr": Total("sum", F.when(sys_row, 0).otherwise(c("tokens")))})
    sys_t, usr_t = split_pair(F.greatest(c("__sys"), F.lit(1)), c("__usr"), c("target"))
    d = d.withColumns({"system_total": sys_t, "user_total": usr_t})
    d = split_exact(d, g, "__part", c("tokens"), c("system_total"), sys_row)
    return d.withColumn("scaled", F.when(sys_row, c("__part")).otherwise(c("user_total"))).drop("__sys", "__usr", "__part")


def price_prompts(rounds: DataFrame) -> DataFrame:
    """Price the system card and the user row: all In on the first round, later carried context
    as Cached. Needs ``is_first, system_in, user_in, prior, user_cache_share, tier_ctx, family``."""
    fam, ctx = c("family"), F.greatest(c("tier_ctx"), F.lit(1))
    cached = F.when(c("is_first"), 0).when(c("user_cache_share") > 0, c("user_cache_share")).otherwise(floor0(c("prior")))
    d = rounds.withColumn("user_cached", long(cached))
    return d.withColumns({
        "system_usd": F.when(c("is_first"), p.price_tokens("input", c("system_in"), fam, ctx)).otherwise(0.0),
        "user_usd": p.price_tokens("input", c("user_in"), fam, ctx), "user_cached_usd": p.price_tokens("cached", c("user_cached"), fam, ctx)})


def round_tree(rounds: DataFrame) -> DataFrame:
    """Final round bill: In = re-read + user + calls. A cold round shows its total without the
    system card and keeps the full bill apart."""
    d = rounds.withColumns({
        "tree_in_tokens": F.coalesce("reread_in", F.lit(0)) + c("user_in") + c("harness_tokens"),
        "tree_in_usd": F.coalesce("reread_usd", F.lit(0.0)) + c("user_usd") + c("harness_usd")})
    shown = c("tree_in_usd") + c("cached_usd") + c("output_usd")
    return d.withColumns({
        "total_usd": F.when(c("cold"), shown).otherwise(c("api_usd")),
        "api_total_usd": F.when(c("cold"), c("system_usd") + shown).otherwise(c("api_usd"))})


def previous_answer(rounds: DataFrame, g: Groups) -> DataFrame:
    """Split the user row into the previous answer read again and the new prompt.

    ``answer`` (thought + billed reasoning + message of the last call) is peeled off the user
    row of the next round only if it fits and was not re-billed by a cache miss.
    """
    d = g.running(rounds, {"answer_in": Run("adjacent", c("answer"))})
    fits = (c("user_in") > 0) & (c("user_in") >= c("answer_in")) & (c("answer_in") > 0)
    return d.withColumns({
        "from_user_pool": F.coalesce(fits & ~c("missed"), F.lit(False)),
        "prompt_in": long(F.when(fits, c("user_in") - c("answer_in")).otherwise(c("user_in"))),
        "absorbed": c("missed") & (c("answer_in") > 0)})


def call_nodes(calls: DataFrame, tools: DataFrame, keys: list[str], g: Groups) -> DataFrame:
    """Push call prices down to the lines of a call: thought, reasoning, message, one request and
    one result per tool, and the answer that is read again.

    ``tools``: ``keys + tool_no, name, request_w, result_w``. Order follows ``rank, tool_no``.
    """
    def node(kind: str, rank: int, tokens: Column, usd: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), long(tokens).alias("tokens"), usd.alias("usd"))

    own = F.array(
        node("thought", 0, c("o_thought"), c("thought_usd")), node("reasoning", 1, c("o_reason"), c("reason_usd")),
        node("message", 2, c("o_message"), c("message_usd")), node("llm_to_in", 4, c("out_in"), c("out_in_usd")))
    flat = calls.select(*keys, F.explode(own).alias("x")).select(
        *keys, F.lit(0).cast("long").alias("tool_no"), F.lit(None).cast("string").alias("name"), "x.*").filter((c("tokens") > 0) | (c("usd") > 0))
    t = tools.join(calls.select(*keys, "o_emit", "emit_usd", "tools_in", "tier_ctx", "family"), keys)
    t = split_exact(t, g, "request", c("request_w"), c("o_emit"))
    t = split_exact(t, g, "result", c("result_w"), c("tools_in"))
    t = t.withColumns({
        "request_usd": F.when(c("o_emit") > 0, c("emit_usd") * (c("request") / c("o_emit"))).otherwise(0.0),
        "result_usd": p.price_tokens("input", c("result"), c("family"), c("tier_ctx"))})
    lines = F.array(node("tool_request", 3, c("request"), c("request_usd")), node("tool", 5, c("result"), c("result_usd")))
    return flat.unionByName(t.select(*keys, "tool_no", "name", F.explode(lines).alias("x")).select(*keys, "tool_no", "name", "x.*"))


def tool_pool(tools: DataFrame, g: Groups) -> DataFrame:
    """Context growth of a call's tools, late growth included, split by what each result holds."""
    from sessionledger.operators.allocate import split_rounded

    content = floor0(F.coalesce(F.when(c("ch_result_tokens") > 0, c("ch_result_tokens")), c("result_tokens")))
    grown = floor0(c("tool_delta"))
    weight = F.when((content < THIN_RESULT) & (grown > F.greatest(content * GROWN_TIMES, F.lit(GROWN_AT_LEAST))), grown).when(content > 0, content).otherwise(grown)
    d = g.totals(tools.withColumn("raw_w", weight), {"__signal": Total("sum", c("raw_w"))})
    pool = c("__signal") + floor0(c("late_delta"))
    w = F.when(c("__signal") > 0, c("raw_w")).otherwise(F.lit(1))
    return split_rounded(d, g, "pool_share", w, pool).drop("__signal")


def unaccounted(calls: DataFrame) -> DataFrame:
    """Window growth that no line of the call explains."""
    parts = c("w_thought") + c("w_emit") + c("w_message") + c("w_harness")
    return calls.withColumns({"parts_sum": long(parts), "unaccounted": long(c("end") - c("start") - parts)})


def tool_summary(tools: DataFrame, keys: list[str]) -> DataFrame:
    """``read_file x2 · grep`` per call, names in first-seen order."""
    a = tools.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.min("tool_no").alias("first"))
    label = F.when(c("n") > 1, F.concat(c("name"), F.lit(" x"), c("n").cast("string"))).otherwise(c("name"))
    # Different names only: the list is as long as the tool set, not as the call.
    listed = F.array_sort(F.collect_list(F.struct("first", label.alias("label"))))
    return a.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["label"]), " · ").alias("summary"))


def stamp_history_results(tools: DataFrame, results: DataFrame) -> DataFrame:
    """History sizes of tool results win over stream sizes when there are any; of a tool's largest records the earliest counts."""
    largest = F.when(c("content_tokens").isNotNull(), F.struct("content_tokens", -c("idx")))
    best = results.filter(c("tool_call_id").isNotNull()).groupBy("session_id", "tool_call_id").agg(
        F.max("content_tokens").alias("ch_result_tokens"), F.max_by("content_chars", largest).alias("ch_result_chars"))
    d = tools.join(best, ["session_id", "tool_call_id"], "left")
    return d.withColumns({
        "result_tokens": F.when(c("ch_result_tokens") > 0, c("ch_result_tokens")).otherwise(c("result_tokens")),
        "result_chars": F.when(c("ch_result_chars") > 0, c("ch_result_chars")).otherwise(c("result_chars"))})


def stamp_reasoning(calls: DataFrame, records: DataFrame, g: Groups, rg: Groups) -> DataFrame:
    """Pair reasoning records with calls in order; surplus records go to the last call.

    ``calls`` ordered by ``g``, ``records`` by ``rg``, both per session.
    """
    d = g.totals(g.number(calls, "__n"), {"__calls": Total("count", F.lit(1))})
    sizes = d.groupBy("session_id").agg(F.max("__calls").alias("__calls"))
    r = rg.number(records, "__n").join(sizes, "session_id")
    r = r.withColumn("__n", F.least("__n", "__calls")).groupBy("session_id", "__n").agg(
        F.sum("encrypted_tokens").alias("enc_tokens"), F.sum("encrypted_chars").alias("enc_chars"))
    return d.drop("__calls").join(r, ["session_id", "__n"], "left").drop("__n").fillna(0, ["enc_tokens", "enc_chars"])
