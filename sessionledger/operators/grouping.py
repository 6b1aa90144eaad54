"""Ordered computations inside groups, safe for groups of any size.

Two interchangeable engines share one small API (``running``, ``totals``,
``number``, ``take_largest``):

* :class:`PlainGroups` uses native windows partitioned by the group key. All windows
  of one key share a single shuffle, but one group is one task.
* :class:`BlockedGroups` cuts each group into blocks of its integer order column.
  Rows are only ever windowed inside ``(key, block)``; what a block needs from the
  blocks before (or after) it comes from a table with one row per block. No task
  sees more than one block of rows, whatever the size of the group.

:func:`skew_safe` picks the engine per group: groups above ``hot_rows`` go through the
blocked engine, everything else through native windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionledger.session import materialize

HOT_ROWS = 2_000_000
BLOCK_ROWS = 262_144
TASK_ROWS = 131_072  # rows of one task in long chains of windows, whose sorts are all held at once; with fewer, compiling the chain costs more than running it
BINS = 1_024  # ranges that a value range is cut into at a time

_BLOCK = "__block"


@dataclass(frozen=True)
class Run:
    """One running value. ``side``: before, upto (inclusive), after, from (inclusive).

    With ``reset`` (max or min, before or upto) the value starts anew at every row for which it holds, that row included.
    """

    fn: str  # sum, count, max, min, last, adjacent
    expr: Column
    side: str = "before"
    reset: Column | None = None

    @property
    def forward(self) -> bool:
        return self.side in ("before", "upto")


@dataclass(frozen=True)
class Total:
    """One value per group, repeated on every row of the group."""

    fn: str  # sum, count, max, min, first, last
    expr: Column


def _frame(keys: list[str], order: Column, run: Run):
    w = W.partitionBy(*keys).orderBy(order.asc() if run.forward else order.desc())
    stop = -1 if run.side in ("before", "after") else 0
    return w.rowsBetween(W.unboundedPreceding, stop)


def _whole(w):
    """The whole group as a frame of an ordered window: totals then share the operator with what needs the order."""
    return w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _over(run: Run, frame) -> Column:
    if run.fn == "last":
        return F.last(run.expr, ignorenulls=True).over(frame)
    return getattr(F, run.fn)(run.expr).over(frame)


def _since_reset(df: DataFrame, keys: list[str], order: Column, name: str, r: Run) -> DataFrame:
    """``name``: the running value since the last reset; ``__since``: the number of resets up to the row."""
    seen = F.count(F.when(r.reset, 1)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumns({"__since": seen, "__since_v": r.expr})
    return d.withColumn(name, _over(Run(r.fn, F.col("__since_v"), r.side), _frame([*keys, "__since"], order, r))).drop("__since_v")


def _zero(fn: str, c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) if fn in ("sum", "count") else c


def _agg(fn: str, expr: Column, order: Column) -> Column:
    if fn == "last":
        return F.max_by(expr, F.when(expr.isNotNull(), order))
    if fn == "first":
        return F.min_by(expr, F.when(expr.isNotNull(), order))
    return getattr(F, fn)(expr)


class PlainGroups:
    """Native windows over ``keys`` ordered by ``order``."""

    def __init__(self, keys: Iterable[str], order: str):
        self.keys = list(keys)
        self.order = order

    def sub(self, *keys: str) -> PlainGroups:
        """The same engine on finer groups; the shuffle of the coarser key is reused."""
        return PlainGroups([*self.keys, *keys], self.order)

    def reorder(self, order: str, block: int | None = None) -> PlainGroups:
        """The same groups ordered by another integer column."""
        return PlainGroups(self.keys, order)

    def running(self, df: DataFrame, runs: Mapping[str, Run]) -> DataFrame:
        cols = {}
        since = {n: r for n, r in runs.items() if r.reset is not None}
        for name, r in runs.items():
            if name in since:
                continue
            if r.fn == "adjacent":
                w = W.partitionBy(*self.keys).orderBy(self.order)
                cols[name] = (F.lag if r.forward else F.lead)(r.expr, 1).over(w)
            else:
                cols[name] = _zero(r.fn, _over(r, _frame(self.keys, F.col(self.order), r)))
        out = df.withColumns(cols) if cols else df
        for name, r in since.items():
            out = _since_reset(out, self.keys, F.col(self.order), name, r).drop("__since")
        return out

    def totals(self, df: DataFrame, totals: Mapping[str, Total]) -> DataFrame:
        w = W.partitionBy(*self.keys)
        o = F.col(self.order)
        return df.withColumns({n: _zero(t.fn, _agg(t.fn, t.expr, o).over(w)) for n, t in totals.items()})

    def number(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*self.keys).orderBy(self.order)).cast("long"))

    def describe(self, df: DataFrame, number: str, totals: Mapping[str, Total], runs: Mapping[str, Run]) -> DataFrame:
        """:meth:`number`, :meth:`totals` and ``runs`` (neighbours, or values before or up to a row) in one step."""
        w, o = W.partitionBy(*self.keys), F.col(self.order)
        return df.withColumns({
            number: F.row_number().over(w.orderBy(self.order)).cast("long"),
            **{n: _zero(t.fn, _agg(t.fn, t.expr, o).over(_whole(w.orderBy(self.order)))) for n, t in totals.items()},
            **{n: (F.lag if r.forward else F.lead)(r.expr, 1).over(w.orderBy(self.order)) if r.fn == "adjacent" else _zero(r.fn, _over(r, _frame(self.keys, o, r))) for n, r in runs.items()}})

    def take_largest(self, df: DataFrame, out: str, value: Column, weight: Column, target: Column, totals: Mapping[str, Total] | None = None) -> DataFrame:
        """``out``: what is taken of each row's ``weight`` (0 or more) when ``target``, one number per group, is taken from the rows
        in order of ``value`` descending, ties by the order column. ``target`` may use ``totals``, which are added too."""
        o = F.col(self.order)
        d = df.withColumns({"__tk_v": value, "__tk_w": weight})
        w = W.partitionBy(*self.keys).orderBy(F.col("__tk_v").desc(), o)
        before = F.sum("__tk_w").over(w.rowsBetween(W.unboundedPreceding, -1))
        d = d.withColumns({**{n: _zero(t.fn, _agg(t.fn, t.expr, o).over(_whole(w))) for n, t in (totals or {}).items()}, "__tk_before": F.coalesce(before, F.lit(0))})
        return d.withColumn(out, F.least("__tk_w", F.greatest(target - F.col("__tk_before"), F.lit(0)))).drop("__tk_v", "__tk_w", "__tk_before")


class BlockedGroups:
    """The same results with every window confined to ``(keys, block of order)``."""

    def __init__(self, keys: Iterable[str], order: str, block: int = BLOCK_ROWS):
        self.keys = list(keys)
        self.order = order
        self.block = int(block)

    def sub(self, *keys: str) -> BlockedGroups:
        return BlockedGroups([*self.keys, *keys], self.order, self.block)

    def reorder(self, order: str, block: int | None = None) -> BlockedGroups:
        return BlockedGroups(self.keys, order, block or self.block)

    def _tag(self, df: DataFrame) -> DataFrame:
        """Rows with their block, written to the shared scratch folder.

        Every step reads its input twice (rows and block sums). Without the cut, chained steps
        would double the plan each time.
        """
        return materialize(df.withColumn(_BLOCK, F.floor(F.col(self.order) / F.lit(self.block)).cast("long")))

    def running(self, df: DataFrame, runs: Mapping[str, Run]) -> DataFrame:
        plain = {}
        unwrap = {}
        for n, r in runs.items():
            if r.reset is not None:
                df = self._since(df, n, r)
                continue
            if r.fn == "adjacent":
                plain[n] = Run("last", F.struct(r.expr.alias("v")), r.side)
                unwrap[n] = F.col(n)["v"]
            else:
                plain[n] = r
        if not plain:
            return df
        tagged = self._tag(df)
        keys = [*self.keys, _BLOCK]
        o = F.col(self.order)
        local = tagged.withColumns({n: _over(r, _frame(keys, o, r)) for n, r in plain.items()})
        per_block = tagged.groupBy(*keys).agg(*[
            _agg("first" if r.fn == "last" and not r.forward else r.fn, r.expr, o).alias(f"__c_{n}")
            for n, r in plain.items()
        ])
        carry = per_block.select(*keys, *[
            _over(
                Run("sum" if r.fn == "count" else r.fn, F.col(f"__c_{n}"), "before" if r.forward else "after"),
                _frame(self.keys, F.col(_BLOCK), Run("sum", o, "before" if r.forward else "after")),
            ).alias(f"__p_{n}")
            for n, r in plain.items()
        ])
        joined = local.join(carry, keys)
        merged = {}
        for n, r in plain.items():
            here, prior = F.col(n), F.col(f"__p_{n}")
            if r.fn in ("sum", "count"):
                merged[n] = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
            elif r.fn == "last":
                merged[n] = F.coalesce(here, prior)
            else:
                merged[n] = (F.greatest if r.fn == "max" else F.least)(here, prior)
        out = joined.withColumns(merged).drop(_BLOCK, *[f"__p_{n}" for n in plain])
        return out.withColumns(unwrap) if unwrap else out

    def _since(self, df: DataFrame, name: str, r: Run) -> DataFrame:
        """A running value with resets. A block is summed up as (has a reset, value since its last one); two neighbours
        combine to the right one if that has a reset, else to the value of both, so blocks are carried like rows."""
        keys, o, fn = [*self.keys, _BLOCK], F.col(self.order), getattr(F, r.fn)
        tagged = self._tag(df.withColumns({"__since_r": r.reset, "__since_x": r.expr}))
        local = _since_reset(tagged, keys, o, name, Run(r.fn, F.col("__since_x"), r.side, F.col("__since_r")))
        ends = local.groupBy(*keys, "__since").agg(fn("__since_x").alias("__v"))
        blocks = ends.groupBy(*keys).agg(F.max("__since").alias("__cuts"), F.max_by("__v", "__since").alias("__v"))
        tail = _since_reset(blocks, self.keys, F.col(_BLOCK), "__tail", Run(r.fn, F.col("__v"), "upto", F.col("__cuts") > 0))
        carry = tail.select(*keys, F.lag("__tail").over(W.partitionBy(*self.keys).orderBy(_BLOCK)).alias("__carry"))
        both = (F.greatest if r.fn == "max" else F.least)(F.col(name), F.col("__carry"))
        return local.join(carry, keys).withColumn(name, F.when(F.col("__since") == 0, both).otherwise(F.col(name))).drop(_BLOCK, "__since", "__since_r", "__since_x", "__carry")

    def totals(self, df: DataFrame, totals: Mapping[str, Total]) -> DataFrame:
        tagged = self._tag(df)
        keys = [*self.keys, _BLOCK]
        o = F.col(self.order)
        per_block = tagged.groupBy(*keys).agg(*[_agg(t.fn, t.expr, o).alias(n) for n, t in totals.items()])
        w = W.partitionBy(*self.keys)
        whole = per_block.select(*keys, *[
            _zero(t.fn, _agg("sum" if t.fn == "count" else t.fn, F.col(n), F.col(_BLOCK)).over(w)).alias(n)
            for n, t in totals.items()
        ])
        return tagged.join(whole, keys).drop(_BLOCK)

    def describe(self, df: DataFrame, number: str, totals: Mapping[str, Total], runs: Mapping[str, Run]) -> DataFrame:
        return self.running(self.totals(self.number(df, number), totals), runs)

    def number(self, df: DataFrame, name: str) -> DataFrame:
        return self.running(df, {name: Run("count", F.lit(1), "upto")})

    def take_largest(self, df: DataFrame, out: str, value: Column, weight: Column, target: Column, totals: Mapping[str, Total] | None = None) -> DataFrame:
        """As in native windows, but by selection: no task sorts a group or its distinct values.

        A histogram of ``BINS`` ranges per group tells in which range the target is reached; that range is cut into ``BINS``
        again, until it holds one value or no more rows than a block. Rows above it give all, rows below it nothing,
        and only rows in it are put in order, equal values by blocks of the order column.
        """
        keys, v, w = self.keys, F.col("__tk_v"), F.col("__tk_w")
        d = self.totals(df, totals) if totals else df
        rows = materialize(d.withColumns({"__tk_v": value.cast("double"), "__tk_w": weight, "__tk_t": target}))
        narrow = rows.select(*keys, v, w, "__tk_t").filter(w > 0)
        cut = narrow.groupBy(*keys).agg(F.max("__tk_t").alias("__t"), F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__all"))
        # where there is not more than the target, all is taken: the cut lies below every row
        short = F.col("__all") <= F.col("__t")
        none = F.lit(float("-inf"))
        cut = materialize(cut.select(*keys, "__t", F.when(short, none).otherwise(F.col("__lo")).alias("__lo"), F.when(short, none).otherwise(F.col("__hi")).alias("__hi"),
                                     F.when(short, 0).otherwise(F.col("__n")).cast("long").alias("__n"), F.lit(0).cast("long").alias("__above")))
        wide = (F.col("__n") > self.block) & (F.col("__lo") < F.col("__hi"))
        while not (todo := cut.filter(wide)).isEmpty():
            place = F.least(F.floor((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BINS), F.lit(BINS - 1))
            inside = narrow.drop("__tk_t").join(todo, keys).filter((v >= F.col("__lo")) & (v <= F.col("__hi")))
            bins = inside.groupBy(*keys, "__t", "__above", place.alias("__bin")).agg(
                F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__sum"))
            # a group has BINS rows here at most
            over = F.coalesce(F.sum("__sum").over(W.partitionBy(*keys).orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            bins = bins.withColumn("__above", F.col("__above") + over)
            hit = bins.filter((F.col("__above") < F.col("__t")) & (F.col("__above") + F.col("__sum") >= F.col("__t")))
            cut = materialize(cut.filter(~wide).unionByName(hit.select(*cut.columns)))
        marked = rows.join(cut, keys, "left")
        inside = (w > 0) & (v >= F.col("__lo")) & (v <= F.col("__hi")) & (F.col("__t") > 0)
        helpers = ["__tk_v", "__tk_w", "__tk_t", "__t", "__lo", "__hi", "__n", "__above"]
        certain = marked.filter(~F.coalesce(inside, F.lit(False)))
        certain = certain.withColumn(out, F.when((w > 0) & (v > F.col("__hi")) & (F.col("__t") > 0), w).otherwise(F.lit(0))).drop(*helpers)
        open_rows = materialize(marked.filter(inside))
        few = open_rows.filter(F.col("__n") <= self.block)
        order = W.partitionBy(*keys).orderBy(v.desc(), F.col(self.order)).rowsBetween(W.unboundedPreceding, -1)
        parts = [few.withColumn("__tk_before", F.coalesce(F.sum(w).over(order), F.lit(0)))]
        equal = open_rows.filter(F.col("__n") > self.block)
        if not equal.isEmpty():
            parts.append(self.running(equal, {"__tk_before": Run("sum", w)}))
        taken = [x.withColumn(out, F.least(w, F.greatest(F.col("__t") - F.col("__above") - F.col("__tk_before"), F.lit(0)))).drop("__tk_before", *helpers) for x in parts]
        for x in taken:
            certain = certain.unionByName(x)
        return certain


Groups = PlainGroups | BlockedGroups


def by_rows(df: DataFrame, keys: Iterable[str], rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` into as many partitions as its ``rows`` ask for.

    Without it the number follows from the size of the shuffled bytes, and a task holds many times those in its sorts. Windows and
    joins on ``keys`` reuse the distribution.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys holding more than ``hot_rows`` rows: at most ``rows / hot_rows`` of them."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") > F.lit(hot_rows)).select(*keys)
    )


def whole_and_largest(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Number of rows, of all groups and of the largest one."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    row = sizes.agg(F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.max("__rows"), F.lit(0))).first()
    return row[0], row[1]


def skew_safe(
    df: DataFrame,
    keys: Iterable[str],
    order: str,
    body: Callable[[DataFrame, Groups], DataFrame],
    *,
    hot_rows: int = HOT_ROWS,
    block: int = BLOCK_ROWS,
    mode: str = "probe",
    deal: bool = False,
) -> DataFrame:
    """Run ``body`` with native windows on ordinary groups and blocked ones on hot groups.

    ``mode``: ``probe`` counts rows per key first and leaves the hot branch out of the
    plan when there is none (call it on stored tables: the count reads only the keys there,
    but would run the whole lineage of a derived frame); ``lazy`` always plans both branches (no action is run);
    ``blocked`` / ``plain`` force one engine. The broadcast list of hot keys is bounded
    by ``rows / hot_rows``. With ``deal`` (and ``probe``) the rows are dealt by :func:`by_rows` first.
    """
    keys = list(keys)
    plain, blocked = PlainGroups(keys, order), BlockedGroups(keys, order, block)
    if mode == "plain":
        return body(df, plain)
    if mode == "blocked":
        return body(df, blocked)
    hot = hot_groups(df, keys, hot_rows)
    if mode == "probe":
        rows, largest = whole_and_largest(df, keys)
        dealt = by_rows(df, keys, rows) if deal else df
        if largest <= hot_rows:
            return body(dealt, plain)
    cold_rows = df.join(F.broadcast(hot), keys, "left_anti")
    hot_part = df.join(F.broadcast(hot), keys, "left_semi")
    return body(cold_rows, plain).unionByName(body(hot_part, blocked))
