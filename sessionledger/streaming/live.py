"""The live half: the same answers while sessions are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionledger.functions.pricing import tier_name

c = F.col
POLL = "500 milliseconds"


def once_per_line(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of a line; ``event_ts`` carries the watermark."""
    return lines.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["session_id", "source_file", "line_no"])


def bucket_stream(turns: DataFrame, length: str, slide: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """Usage per time bucket; a bucket is final once the watermark has passed it.

    With ``slide`` the windows overlap. ``delay`` None: the input has its watermark already.
    """
    from sessionledger.operators.period import usage_sums

    w = F.window("event_ts", length, slide) if slide else F.window("event_ts", length)
    marked = turns.withWatermark("event_ts", delay) if delay else turns
    d = marked.groupBy(w.alias("w")).agg(*usage_sums())
    return d.select(F.unix_millis("w.start").alias("bucket_ms"), *[x for x in d.columns if x != "w"])


def activity_windows(lines: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Periods of activity of a session, closed by a gap: a line exactly ``gap`` after the one before begins the next period.

    Spark's session windows still join lines at exactly their gap, so theirs is one microsecond (the unit of its clock) shorter.
    """
    w = F.session_window("event_ts", f"{gap} -1 microsecond").alias("w")
    d = lines.withWatermark("event_ts", delay).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("lines"))
    end = c("w.end") + F.expr("INTERVAL 1 MICROSECOND")
    return d.select("session_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis(end).alias("end_ms"), "lines")


def gauges(lines: DataFrame) -> DataFrame:
    """Latest state per session from the stream: context, last kind, prompt, tier. Gauge files are not joined here."""
    at = c("line_no")
    d = lines.groupBy("session_id").agg(
        F.max_by("context_tokens", F.when(c("context_tokens").isNotNull(), at)).alias("context_stream"), F.max_by("kind", at).alias("last_kind"),
        F.max_by("prompt_id", F.when(c("prompt_id").isNotNull(), at)).alias("prompt_id"), F.max("line_no").alias("line_no"))
    return d.withColumn("tier", tier_name(F.coalesce("context_stream", F.lit(0))))


def history_watch(snapshots: DataFrame, store: str, checkpoint: str):
    """Diff every snapshot of a history against the one before it; writes ``<store>/diffs``.

    ``snapshots``: fingerprint rows with ``snapshot_id``. Snapshots of one micro-batch are compared with their
    neighbours, the first of them with the last one known. A batch stores the newest snapshots of its own
    sessions only; running it again replaces what it wrote.
    """
    from pyspark.sql import Window as W

    from sessionledger.operators.historydiff import diff_summary

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        heads = batch.select("session_id", "snapshot_id").distinct()
        ids = heads.select("session_id").distinct()
        known = None
        if batch_id > 0:
            versions = spark.read.parquet(f"{store}/known").filter(c("v") < batch_id).join(ids, "session_id", "left_semi")
            last = versions.groupBy("session_id").agg(F.max("v").alias("v"))
            known = versions.join(last, ["session_id", "v"], "left_semi").drop("v")
            heads = heads.unionByName(known.select("session_id", "snapshot_id").distinct())
        order = W.partitionBy("session_id").orderBy("snapshot_id")
        pairs = heads.distinct().withColumn("before", F.lag("snapshot_id").over(order)).filter(c("before").isNotNull())
        rows = batch if known is None else batch.unionByName(known.select(batch.columns))

        def side(which: str) -> DataFrame:
            pair = pairs.select(c("session_id").alias("__s"), c(which).alias("__at"), F.struct("session_id", "snapshot_id").alias("__pair"))
            d = rows.join(pair, (c("session_id") == c("__s")) & (c("snapshot_id") == c("__at")))
            return d.withColumn("session_id", c("__pair")).drop("__s", "__at", "__pair", "snapshot_id")

        diffs = diff_summary(side("before"), side("snapshot_id")).withColumns({"snapshot_id": c("session_id.snapshot_id"), "session_id": c("session_id.session_id")})
        diffs.write.mode("overwrite").parquet(f"{store}/diffs/batch={batch_id}")
        newest = batch.groupBy("session_id").agg(F.max("snapshot_id").alias("snapshot_id"))
        batch.join(newest, ["session_id", "snapshot_id"], "left_semi").write.mode("overwrite").parquet(f"{store}/known/v={batch_id}")

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_parents(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Streamed rows of children carry the session they are billed under (stream-static join)."""
    e = edges.select("session_id", "parent_id")
    return rows.join(e, "session_id", "left").withColumn("billed_session", F.coalesce("parent_id", "session_id"))


def with_found_parents(bills: DataFrame, edges: DataFrame, within: str) -> DataFrame:
    """``bills`` (``child_id, event_ts, ..``) with the ``parent_id`` of an edge (``child_id, parent_id, event_ts``) that comes before or after them.

    A bill waits in the state until an edge of its child shows up, at most for the time ``within`` around it; a bill that
    found none is given out without a parent once the watermark says that none can come. An edge that is repeated counts once.
    """
    left = bills.withColumnRenamed("event_ts", "bill_ts").withWatermark("bill_ts", within)
    right = edges.select(c("child_id").alias("__child"), "parent_id", c("event_ts").alias("edge_ts")).withWatermark("edge_ts", within).dropDuplicatesWithinWatermark(["__child", "parent_id"])
    near = c("edge_ts").between(c("bill_ts") - F.expr(f"INTERVAL {within}"), c("bill_ts") + F.expr(f"INTERVAL {within}"))
    return left.join(right, (c("child_id") == c("__child")) & near, "left_outer").drop("__child", "edge_ts")


def run_to_table(stream: DataFrame, path: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Drain what is there and return the result table; in update mode the newest row of every ``keys``.

    A batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    w = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = w.format("parquet").option("path", f"{path}/data").start()
    else:
        def step(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

        q = w.foreachBatch(step).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data")
    cols = [x for x in rows.columns if x != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")


def read_chunks(spark: SparkSession, root: str, max_bytes: str = "1500000") -> DataFrame:
    """Immutable chunk files of JSON lines as a stream; the session is the folder of the file."""
    d = spark.readStream.option("recursiveFileLookup", "true").option("maxBytesPerTrigger", max_bytes).text(root)
    return d.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("session_id"), F.col("_metadata.file_path").alias("source_file"), "value")
