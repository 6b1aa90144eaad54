"""Splitting official totals over rows so that the parts add up exactly.

All functions work inside the groups of a grouping engine and keep the row order given by
its order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.operators.grouping import Groups, Run, Total

c = F.col


def floor0(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))


def with_only(d: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of the input plus the new ones; helper columns go in the same step."""
    return d.select(*[x for x in keep if x not in new], *[e.alias(n) for n, e in new.items()])


def split_exact(df: DataFrame, g: Groups, out: str, weight: Column, target: Column, only: Column | None = None) -> DataFrame:
    """Largest-remainder split of an integer by weights.

    Without any weight the target is split evenly. Leftover units go to the largest
    fractions, ties to earlier rows. ``only`` limits the split to some rows of the group;
    the others get 0.
    """
    return split_each(df, g, {out: (weight, target, only)})


def split_each(df: DataFrame, g: Groups, splits: dict[str, tuple[Column, Column, Column | None]], totals: dict[str, Total] | None = None) -> DataFrame:
    """Several splits of :func:`split_exact` (``weight, target, only``) that do not build on each other; they share their sums.

    ``totals`` are taken in the same step and added; targets may use them.
    """
    d = df.withColumns({f"__al_w_{out}": F.when(F.lit(True) if only is None else only, floor0(weight.cast("double"))) for out, (weight, _, only) in splits.items()})
    sums = {k: v for out in splits for k, v in {f"__al_sum_{out}": Total("sum", c(f"__al_w_{out}")), f"__al_rows_{out}": Total("count", c(f"__al_w_{out}"))}.items()}
    d = g.totals(d, {**(totals or {}), **sums})
    d = d.withColumns({f"__al_t_{out}": floor0(target).cast("long") for out, (_, target, _) in splits.items()})
    parts = []
    for out in splits:
        w, tgt, total = c(f"__al_w_{out}"), c(f"__al_t_{out}"), c(f"__al_sum_{out}")
        even = F.floor(tgt / c(f"__al_rows_{out}")).cast("double")
        share = F.when(w.isNull(), 0.0).when(total > 0, w / total * tgt).otherwise(even)
        base = F.floor(share).cast("long")
        parts += [tgt, base.alias(out), F.when(w.isNull(), -1.0).otherwise(share - base).alias(f"__al_frac_{out}"), F.when(w.isNotNull(), 1).otherwise(0).alias(f"__al_one_{out}")]
    d = d.select(*[x for x in df.columns if x not in splits], *(totals or {}), *parts)
    for out in splits:
        d = g.take_largest(d, "__al_extra", c(f"__al_frac_{out}"), c(f"__al_one_{out}"), c(f"__al_t_{out}") - c("__al_given"), {"__al_given": Total("sum", c(out))})
        gone = ("__al_extra", "__al_given", f"__al_t_{out}", f"__al_frac_{out}", f"__al_one_{out}")
        d = with_only(d, [x for x in d.columns if x not in gone], {out: (c(out) + c("__al_extra")).cast("long")})
    return d


def split_pair(first: Column, second: Column, target: Column) -> tuple[Column, Column]:
    """The same split for two parts held in two columns of one row."""
    t = floor0(target).cast("long")
    one = round_pair(*share_of_pair(first, second, t), t)
    return one, (t - one).cast("long")


def share_of_pair(first: Column, second: Column, target: Column) -> tuple[Column, Column]:
    """Exact shares of both parts, NULL if neither weighs anything."""
    a, b = floor0(first.cast("double")), floor0(second.cast("double"))
    return F.when(a + b > 0, a / (a + b) * target), F.when(a + b > 0, b / (a + b) * target)


def round_pair(first: Column, second: Column, target: Column) -> Column:
    """Whole part of the first of two shares of ``target``; what is left goes to the larger fraction, or half and half without shares."""
    fa, fb = F.floor(first), F.floor(second)
    left = target - fa - fb
    a_first = (first - fa) >= (second - fb)
    return F.when(first.isNotNull(), fa + F.when((left >= 2) | ((left == 1) & a_first), 1).otherwise(0)).otherwise(target - F.floor(target / 2)).cast("long")


def split_usd(df: DataFrame, g: Groups, out: str, part: Column, target: Column) -> DataFrame:
    """Scale dollar parts to a target; binary drift goes to the largest part."""
    d = g.totals(df.withColumn("__al_p", part), {"__al_s": Total("sum", c("__al_p"))})
    scaled = F.when(target <= 0, 0.0).when(c("__al_s") > 0, c("__al_p") * target / c("__al_s"))
    d = g.number(d, "__al_no").withColumn("__al_x", F.coalesce(scaled, F.when(c("__al_no") == 1, target).otherwise(0.0)))
    d = g.take_largest(d, "__al_first", c("__al_x"), F.lit(1), F.lit(1), {"__al_sx": Total("sum", c("__al_x"))})
    drift = target - c("__al_sx")
    fix = (c("__al_first") == 1) & (target > 0) & (c("__al_s") > 0) & (F.abs(drift) > 1e-12)
    return with_only(d, df.columns, {out: c("__al_x") + F.when(fix, drift).otherwise(0.0)})


def fit_columns(df: DataFrame, parts: dict[str, str], target: str) -> DataFrame:
    """Scale a few dollar columns of one row to a target column; drift on the first largest.

    ``parts`` maps result names to the columns they are scaled from.
    """
    s = sum((c(x) for x in parts.values()), F.lit(0.0))
    d = df.withColumn("__al_s", s)
    t = c(target)
    d = d.withColumns({
        n: F.when(t <= 0, 0.0).when(c("__al_s") > 0, c(x) * t / c("__al_s")).otherwise(t if k == 0 else F.lit(0.0))
        for k, (n, x) in enumerate(parts.items())})
    names = list(parts)
    d = d.withColumns({"__al_top": F.greatest(*names), "__al_drift": F.when(
        (t > 0) & (c("__al_s") > 0), t - sum((c(n) for n in names), F.lit(0.0))).otherwise(0.0)})
    first = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        first = F.when(c(n) == c("__al_top"), F.lit(i)).otherwise(first)
    # the drift of each row goes to one of its parts; NULL: none is worth it
    d = d.withColumn("__al_first", F.when(F.abs("__al_drift") > 1e-12, first))
    fixed = {n: c(n) + F.when(c("__al_first") == i, c("__al_drift")).otherwise(0.0) for i, n in enumerate(names)}
    return with_only(d, [*df.columns, *[n for n in names if n not in df.columns]], fixed)


def split_rounded(df: DataFrame, g: Groups, out: str, weight: Column, pool: Column) -> DataFrame:
    """Rounded shares; the last row with a weight takes what is left."""
    d = df.withColumns({"__al_w": floor0(weight), "__al_pool": pool})
    order = c(g.order)
    d = g.totals(d, {"__al_s": Total("sum", c("__al_w")), "__al_last": Total("max", F.when(c("__al_w") > 0, order))})
    share = F.when((c("__al_pool") > 0) & (c("__al_w") > 0), F.rint(c("__al_pool") * c("__al_w") / c("__al_s"))).otherwise(0).cast("long")
    is_last = order == c("__al_last")
    d = d.withColumn("__al_x", F.when(F.coalesce(is_last, F.lit(False)), 0).otherwise(share))
    d = g.totals(d, {"__al_others": Total("sum", c("__al_x"))})
    rest = floor0(c("__al_pool") - c("__al_others"))
    val = F.when((c("__al_pool") <= 0) | (c("__al_w") <= 0), 0).when(is_last, rest).otherwise(floor0(c("__al_x")))
    return with_only(d, df.columns, {out: val.cast("long")})


def cap_and_push(df: DataFrame, g: Groups, out: str, amount: Column, limit: Column) -> DataFrame:
    """Cap amounts at a limit per row; the overflow fills the latest rows with room."""
    d = df.withColumns({"__al_a": F.least(amount, limit), "__al_over": F.greatest(amount - limit, F.lit(0)), "__al_room": limit - F.least(amount, limit)})
    d = g.describe(d, "__al_no", {"__al_left": Total("sum", c("__al_over")), "__al_rooms": Total("sum", c("__al_room"))}, {"__al_upto": Run("sum", c("__al_room"), "upto")})
    take = F.least(c("__al_room"), floor0(c("__al_left") - (c("__al_rooms") - c("__al_upto"))))
    return with_only(d, df.columns, {out: (c("__al_a") + take).cast("long")})


def take_down(df: DataFrame, g: Groups, out: str, amount: Column, need: Column, totals: dict[str, Total] | None = None) -> DataFrame:
    """Take ``need`` (one value per group) off the largest amounts first; ``totals`` are taken in the same step and added."""
    d = g.take_largest(df.withColumns({"__al_a": amount, "__al_need": need}), "__al_take", c("__al_a"), c("__al_a"), c("__al_need"), totals)
    return with_only(d, [*df.columns, *(totals or {})], {out: (c("__al_a") - c("__al_take")).cast("long")})
