"""Cache misses, compactions and recaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions import pricing as p
from sessionledger.operators.allocate import floor0, split_rounded
from sessionledger.operators.grouping import Groups, Run

c = F.col
IDLE_MS = 20 * 60 * 1000


def part(prior: Column, share: float) -> Column:
    """Thresholds are whole tokens."""
    return F.floor(prior * F.lit(share))


def detect_miss(rounds: DataFrame) -> DataFrame:
    """Classify rounds whose carried context was billed again as input.

    Needs ``completed, is_first, off_in, off_cache, prior, context_end, start0, idle_gap_ms``.
    Adds ``miss_kind`` (NULL = no miss), ``off_unc, growth, reread``.
    """
    prior = c("prior")
    unc = floor0(c("off_in") - F.least(F.coalesce("off_cache", F.lit(0)), c("off_in")))
    d = rounds.withColumns({"off_unc": unc, "growth": floor0(F.coalesce("context_end", "prior") - prior)})
    d = d.withColumn("__extra", floor0(c("off_unc") - c("growth")))
    usable = (c("completed") & ~c("is_first") & (c("off_in") > 0) & (prior >= 1000)
              & F.coalesce(c("start0") >= part(prior, 0.5), F.lit(True)))
    holds = F.coalesce(c("start0") >= part(prior, 0.85), F.lit(False))
    extra, un, gr = c("__extra"), c("off_unc"), c("growth")
    kind = (
        F.when((F.coalesce("off_cache", F.lit(0)) < part(prior, 0.15)) & (un >= part(prior, 0.5)), "classic_cache_miss")
        .when((un >= part(prior, 0.85)) & (gr < part(prior, 0.15)) & holds, "full_context_reread")
        .when(holds & (extra >= part(prior, 0.7)) & (un >= part(prior, 0.7)) & (gr < part(prior, 0.4)), "first_call_reread")
        .when((c("idle_gap_ms") >= IDLE_MS) & (extra >= part(prior, 0.5)) & (gr < part(prior, 0.3)) & (c("start0") >= part(prior, 0.5)), "idle_context_reread"))
    d = d.withColumn("miss_kind", F.when(usable, kind))
    return d.withColumn("reread", F.when(c("miss_kind").isNotNull(), F.least(prior, extra).cast("long"))).drop("__extra")


def reattribute(rounds: DataFrame) -> DataFrame:
    """After a miss: the re-read mass, the new user text and what is left for the harness.

    Needs :func:`detect_miss` columns and ``user_new`` (counted new text), ``user_chars``.
    """
    grown = F.when(c("start0") > c("prior"), c("start0") - c("prior")).otherwise(0)
    new = F.greatest(floor0(c("user_new")), grown)
    by_chars = F.when(c("user_chars") > 0, F.greatest(F.lit(1), F.floor(c("user_chars") / 4))).otherwise(0)
    new = F.when(new > 0, new).otherwise(by_chars)
    d = rounds.filter(c("miss_kind").isNotNull()).withColumn("reread_in", F.least("reread", "off_unc"))
    d = d.withColumn("user_in", F.least(new, floor0(c("off_unc") - c("reread_in"))).cast("long"))
    return d.withColumns({
        "harness_in": floor0(c("off_unc") - c("reread_in") - c("user_in")).cast("long"), "user_cached": F.lit(0).cast("long"),
        "tree_in": (c("reread_in") + c("user_in") + floor0(c("off_unc") - c("reread_in") - c("user_in"))).cast("long")})


def resplit_harness(calls: DataFrame, g: Groups) -> DataFrame:
    """Share the allowed harness input of a missed round over its calls by what they had."""
    return split_rounded(calls, g, "harness_new", c("harness_old"), c("harness_allowed"))


def compaction_cards(events: DataFrame) -> DataFrame:
    """Bill of a compaction: the whole window read once (cached, or input after a miss) plus the
    compressed history it wrote.

    Needs ``tokens_before, tokens_after, prev_missed, reload_tokens, family``.
    """
    before, after = floor0(c("tokens_before")), floor0(c("tokens_after"))
    fam = c("family")
    peak = F.greatest(before, F.lit(1))
    out = F.when(after > 0, F.greatest(F.lit(1), after - floor0(c("reload_tokens")))).otherwise(0)
    d = events.withColumns({
        "pre_in_tokens": F.when(c("prev_missed"), before).otherwise(0).cast("long"),
        "pre_cached_tokens": F.when(c("prev_missed"), 0).otherwise(before).cast("long"), "out_tokens": out.cast("long"),
        "tokens_removed": floor0(c("tokens_before") - c("tokens_after")).cast("long")})
    d = d.withColumns({
        "pre_in_usd": p.price_tokens("input", c("pre_in_tokens"), fam, peak),
        "pre_cached_usd": p.price_tokens("cached", c("pre_cached_tokens"), fam, peak),
        "out_usd": p.price_tokens("output", c("out_tokens"), fam, F.greatest(after, peak))})
    return d.withColumn("cost_usd", c("pre_in_usd") + c("pre_cached_usd") + c("out_usd"))


def deferred_reload(first_calls: DataFrame) -> DataFrame:
    """Tokens the first call after a compaction pays to load tools and system text again.

    Needs ``emit_delta, arg_tokens, caused_in, tool_in`` of that call, and uses ``residual_in``, input that no tool or answer
    explains, where it is given: such input is the reload. They move from the call to the compaction.
    """
    arg = floor0(c("arg_tokens"))
    big = c("emit_delta") > F.greatest(arg, F.lit(1)) * 3
    raw = F.when(big, floor0(c("emit_delta") - arg)).otherwise(floor0(c("caused_in") - c("tool_in")))
    if "residual_in" in first_calls.columns:
        raw = F.when(c("residual_in") > 0, c("residual_in")).otherwise(raw)
    reload = F.when(c("caused_in") > 0, F.least(raw, c("caused_in"))).otherwise(raw)
    return first_calls.withColumn("reload_tokens", reload.cast("long")).withColumn(
        "call_in_left", floor0(c("caused_in") - c("reload_tokens")).cast("long"))


def reprice_after_reload(first_calls: DataFrame) -> DataFrame:
    """Dollars of a :func:`deferred_reload`: the reload at the tier of the new window, the call without it at the tier of its own prompt.

    Needs ``paid, input, cache_usd, out_usd, family`` of the call and ``tokens_before, tokens_after`` of the compaction.
    """
    after = F.coalesce(*[F.when(c(x) > 0, c(x)) for x in ("tokens_after", "tokens_before")], F.lit(1))
    peak = F.coalesce(F.when(c("input") > 0, c("input")), after)
    d = first_calls.withColumns({"reload_usd": p.price_tokens("input", c("reload_tokens"), c("family"), after), "paid_left": floor0(c("paid") - c("reload_tokens")).cast("long")})
    d = d.withColumns({"in_usd_left": p.price_tokens("input", c("call_in_left"), c("family"), peak), "paid_usd_left": p.price_tokens("input", c("paid_left"), c("family"), peak)})
    return d.withColumn("call_usd_left", c("in_usd_left") + c("cache_usd") + c("out_usd"))


def context_as_of(lines: DataFrame, g: Groups) -> DataFrame:
    """Context size in force at each line: the last one seen, or what a compaction left."""
    from sessionledger.operators.sessionize import CALL_KINDS, COMPACT

    size = F.when(c("kind").isin(CALL_KINDS), c("context_tokens")).when(c("kind") == COMPACT, c("tokens_after"))
    return g.running(lines, {"context_now": Run("last", size)})


def recap_cards(recaps: DataFrame) -> DataFrame:
    """Bill of a recap made on a fork: context as Cached, prompt as In, summary as Out.

    Needs ``context_now, prompt_tokens, out_tokens, family``. The session itself does not grow.
    """
    ctx, prompt = floor0(c("context_now")), floor0(c("prompt_tokens"))
    peak = F.greatest(ctx + prompt, F.lit(1))
    d = recaps.withColumns({
        "prompt_usd": p.price_tokens("input", prompt, c("family"), peak), "cached_usd": p.price_tokens("cached", ctx, c("family"), peak),
        "out_usd": p.price_tokens("output", c("out_tokens"), c("family"), peak)})
    return d.withColumn("cost_usd", c("prompt_usd") + c("cached_usd") + c("out_usd"))


def match_requests(recaps: DataFrame, requests: DataFrame, head: int = 80) -> DataFrame:
    """Recap to its newest request file of the session: one summary is a prefix of the other, whole texts.

    Texts of ``head`` characters and more meet by their first ``head`` ones and are then compared in full;
    a shorter one meets the prefixes of its own length. ``head`` is a matter of speed alone.
    """
    r = recaps.select("session_id", "line_no", F.trim("summary").alias("a")).filter(F.length("a") > 0)
    q = requests.select("session_id", "request_id", "mtime", F.trim("summary").alias("b")).filter(F.length("b") > 0)
    lengths = F.sequence(F.lit(1), F.lit(head - 1))

    def long_key(x: str) -> Column:
        return F.substring(x, 1, head)

    def prefixes(x: str) -> Column:
        return F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length(x)), lambda n: F.substr(c(x), F.lit(1), n)))

    def newest(side: DataFrame, *more: str) -> DataFrame:
        """Only the newest request per key can win, so copies never multiply."""
        return side.groupBy("session_id", "k", *more).agg(F.max(F.struct("mtime", "request_id")).alias("__q"))

    long_a, long_b = r.filter(F.length("a") >= head), q.filter(F.length("b") >= head)

    found = [
        long_a.withColumn("k", long_key("a")).join(newest(long_b.withColumn("k", long_key("b")), "b"), ["session_id", "k"]).filter(F.startswith("a", "b") | F.startswith("b", "a")),
        r.filter(F.length("a") < head).withColumn("k", c("a")).join(newest(q.withColumn("k", prefixes("b"))), ["session_id", "k"]),
        r.withColumn("k", prefixes("a")).join(newest(q.filter(F.length("b") < head).withColumn("k", c("b"))), ["session_id", "k"])]
    cols = ["session_id", "line_no", "__q"]
    hits = found[0].select(*cols).unionByName(found[1].select(*cols)).unionByName(found[2].select(*cols))
    return hits.groupBy("session_id", "line_no").agg(F.max("__q").alias("__q")).select("session_id", "line_no", "__q.request_id")


def attach_cards(lines: DataFrame, g: Groups) -> DataFrame:
    """Side events with the round they follow and the round they precede or interrupt."""
    from sessionledger.operators.sessionize import COMPACT, RECAP, ROUND_KINDS, assign_rounds

    gr = g.sub("round_no")
    d = gr.running(assign_rounds(lines, g), {
        "__before": Run("count", F.when(c("kind").isin(ROUND_KINDS), 1)), "__after": Run("count", F.when(c("kind").isin(ROUND_KINDS), 1), "after")})
    mid = c("__before") > 0
    return d.filter(c("kind").isin(COMPACT, RECAP)).withColumns({
        "mid_round": mid, "after_round": F.when(c("round_no") > 1, c("round_no") - 1),
        "before_round": F.when(~mid & (c("__after") > 0), c("round_no")), "in_round": F.when(mid, c("round_no"))}).drop("__before", "__after", "round_no")


def trigger_order(cards: DataFrame) -> DataFrame:
    """Side events of a session, newest first; an unknown clock counts as 0."""
    return cards.orderBy("session_id", F.coalesce("agent_ms", F.lit(0)).desc(), "line_no")
