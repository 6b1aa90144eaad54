"""Shards that all show the corpus mixture: proportional stratified interleaving.

Rows are shuffled inside each source by a seeded hash. The r-th of a source's n rows stands at the
fraction (r + u) / n, with u in [0, 1) drawn once per source, so a source's rows are evenly spread over
[0, 1). Sorting everything by that fraction interleaves the sources in proportion, and equal cuts of
the sorted order give shards whose row counts differ by one at most. A shard's rows of one source differ from
its proportion by a row or two, and by a few more where there are very many tiny sources.

No group is ordered in one task: a rank is a row number inside a block of a source's hash range plus
the rows of the blocks before it, and the position in the whole order is counted the same way. The
number of blocks grows with the rows; u keeps thousands of one-row sources from meeting at one place.

Nulls: a null source is a source of its own; a null text has no bytes (size 1, checksum 0); a null id
is hashed as such. Repeated rows are placed as rows of their own. Columns named
``shard`` or ``slot`` are replaced, others pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.llm.common import blocks_for, hash60
from sessionledger.session import materialize

SPAN = 1 << 60


def interleave(rows: DataFrame, n_shards: int, source: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``rows`` should be narrow (ids and measures, not texts): it is written once and shuffled twice.
    ``keys`` name the columns that tell rows apart; rows equal in all of them are interchangeable.
    An empty table gives an empty result.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    given = {n: f"c{i}" for i, n in enumerate(names)}  # own names cannot clash with the columns below
    stored = materialize(rows.select(
        *(F.col(f"`{n}`").alias(c) for n, c in given.items()),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-")).alias("stratum"),
        hash60(F.lit(seed), *(F.col(f"`{k}`") for k in keys)).alias("h")))
    n = stored.count()
    b = blocks_for(n)
    cut = F.floor(F.col("h") / F.lit(float(SPAN)) * b).cast("long")
    tie = [F.col(given[k]) for k in keys]

    ranged = stored.withColumn("block", cut)
    sizes = ranged.groupBy("stratum", "block").agg(F.count("*").alias("m"))
    before = Window.partitionBy("stratum").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    sizes = sizes.select("stratum", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"), F.sum("m").over(whole).alias("total"))
    inside = Window.partitionBy("stratum", "block").orderBy("h", *tie)
    ranked = ranged.withColumn("r", F.row_number().over(inside) - 1).join(sizes, ["stratum", "block"])
    shift = hash60(F.lit(seed), F.col("stratum")) / F.lit(float(SPAN))
    placed = ranked.withColumn("at", (F.col("r") + F.col("ahead") + shift) / F.col("total")).drop("block", "ahead", "total", "r")

    placed = materialize(placed.withColumn("block", F.least(F.floor(F.col("at") * b), F.lit(b - 1)).cast("long")))
    sums = placed.groupBy("block").agg(F.count("*").alias("m"))
    # one row per BLOCK_ROWS rows of input, so a single ordered task is enough
    sums = sums.select("block", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("block").orderBy("at", "stratum", "h", *tie)
    pos = placed.withColumn("r", F.row_number().over(order) - 1).join(sums, "block").withColumn("pos", F.col("r") + F.col("ahead"))
    cuts = pos.withColumn("shard", F.expr(f"pos * {n_shards} div {max(n, 1)}"))
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return cuts.select(*(F.col(c).alias(name) for name, c in given.items()), F.col("shard").cast("int").alias("shard"), (F.col("pos") - first).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, each file sorted by slot. ``key`` must be unique."""
    (docs.join(placed.select(key, "shard", "slot"), key)
     .repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
