"""Sinks, incremental recomputation and SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
VERSION = 1


def write_events(events: DataFrame, path: str) -> None:
    """Normalised events, one partition per day."""
    d = events.withColumn("event_date", F.to_date(F.timestamp_millis("agent_ms")))
    d.write.mode("overwrite").partitionBy("event_date").parquet(path)


def session_summaries(events: DataFrame) -> DataFrame:
    """One JSON document per session: line count, counts by kind, first and last clock."""
    k = events.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("agent_ms").alias("lo"), F.max("agent_ms").alias("hi"))
    listed = F.array_sort(F.collect_list(F.struct((-c("n")).alias("o"), "kind", "n")))  # as many as kinds
    a = k.groupBy("session_id").agg(F.sum("n").alias("event_count"), F.min("lo").alias("first_ms"), F.max("hi").alias("last_ms"), listed.alias("k"))
    doc = F.to_json(F.struct("session_id", "event_count", "first_ms", "last_ms", F.transform("k", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("counts_by_kind")))
    return a.select("session_id", doc.alias("summary"))


def changed(current: DataFrame, manifest: DataFrame | None, version: int = VERSION) -> DataFrame:
    """Sessions whose files are new or have another size or time than in the manifest.

    ``current``: ``session_id, size, mtime``. A manifest of another version counts as empty.
    """
    if manifest is None:
        return current
    same = manifest.filter(c("version") == version).select("session_id", "size", "mtime")
    return current.join(same, ["session_id", "size", "mtime"], "left_anti")


def refresh(current: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, batch: str, buckets: int = 64, version: int = VERSION) -> DataFrame:
    """Recompute changed sessions only and return the result of all live sessions.

    Every refresh writes one batch of results and, when they are there, one of the manifest; readers take
    the newest batch of each session. Repeating a refresh under its batch id replaces that batch alone, so a
    failed one leaves the old state and a retry gives no row twice.
    """
    spark = current.sparkSession
    known = read_manifest(spark, path)
    todo = changed(current, known, version)
    result = compute(todo.select("session_id"))
    _write_batch(result.withColumn("batch", F.lit(batch)), f"{path}/results")
    _write_batch(todo.withColumns({"version": F.lit(version), "batch": F.lit(batch)}), f"{path}/manifest")
    return live_results(spark, path, current)


def _write_batch(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        m = spark.read.option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # first refresh: nothing there yet
            return None
        raise
    m = m.withColumn("batch", c("batch").cast("string"))
    return m.groupBy("session_id").agg(F.max_by(F.struct("size", "mtime", "version", "batch"), "batch").alias("m")).select("session_id", "m.*")


def live_results(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """Newest result rows of every session that still exists."""
    newest = read_manifest(spark, path).select("session_id", "batch")
    r = spark.read.parquet(f"{path}/results").withColumn("batch", c("batch").cast("string"))
    return r.join(newest, ["session_id", "batch"], "left_semi").join(current.select("session_id"), "session_id", "left_semi").drop("batch")


def register_views(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Make tables available to SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
