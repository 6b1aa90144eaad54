"""Taking sub-agent bills out of the parent turn that waited for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionledger.functions.pricing import USAGE_COUNTERS
from sessionledger.operators.allocate import floor0
from sessionledger.operators.grouping import Groups, Run

c = F.col


def first_waits(waits: DataFrame) -> DataFrame:
    """The first wait of a session for each child: replayed afterwards, it takes the whole bill."""
    return waits.groupBy("session_id", "child_id").agg(F.min_by(F.struct("round_no", "line_no"), "line_no").alias("__w")).select(
        "session_id", "child_id", "__w.round_no", "__w.line_no")


def increments(waits: DataFrame, g: Groups) -> DataFrame:
    """Live variant: each wait sees the child's lifetime counters so far and takes what is new.

    ``waits`` carries the counters; ``g`` groups by (session, child) in line order.
    """
    d = g.running(waits, {f"__{x}": Run("adjacent", c(x)) for x in USAGE_COUNTERS})
    return d.withColumns({x: floor0(c(x) - F.coalesce(f"__{x}", F.lit(0))) for x in USAGE_COUNTERS}).drop(*[f"__{x}" for x in USAGE_COUNTERS])


def peel_rounds(rounds: DataFrame, taken: DataFrame) -> DataFrame:
    """Round counters without their children's. ``taken``: counters per (session, round, child);
    children with neither input nor calls change nothing."""
    real = taken.filter((c("input") > 0) | (c("calls") > 0))
    per_round = real.groupBy("session_id", "round_no").agg(
        *[F.sum(x).alias(f"__{x}") for x in USAGE_COUNTERS], F.count(F.lit(1)).alias("children"))
    d = rounds.join(per_round, ["session_id", "round_no"], "left")
    return d.withColumns({
        **{x: floor0(F.coalesce(x, F.lit(0)) - F.coalesce(f"__{x}", F.lit(0))).cast("long") for x in USAGE_COUNTERS},
        "children": F.coalesce("children", F.lit(0))}).drop(*[f"__{x}" for x in USAGE_COUNTERS])


def place_cards(waits: DataFrame, children: DataFrame, last_calls: DataFrame, g: Groups) -> DataFrame:
    """One card per child and round: after the call that collected it, else on the last call.

    ``waits``: ``session_id, round_no, call_no, line_no, child_id``; ``children``: the children of
    each round; ``g`` groups by (session, round) and is ordered by ``line_no``.
    """
    keys = ["session_id", "round_no", "child_id"]
    seen = waits.groupBy(*keys).agg(F.min("call_no").alias("__call"), F.min("line_no").alias("__line"))
    d = children.join(seen, keys, "left").join(last_calls, ["session_id", "round_no"])
    d = d.withColumns({"call_no": F.coalesce("__call", "last_call"), "waited": c("__call").isNotNull(),
                       "line_no": F.coalesce("__line", c("first_line") + F.lit(1 << 40))})
    return g.number(d, "n").withColumn("label", F.concat(F.lit("Sub Agent "), c("n").cast("string"))).drop("__call", "__line", "last_call", "first_line")


def distinct_children(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Ids in first-seen order."""
    return mentions.groupBy(*keys, "child_id").agg(F.min("line_no").alias("first_line"))
