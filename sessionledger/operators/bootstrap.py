"""The first prompt of a session: what it is made of and how its tokens are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
SYSTEM_KINDS = ["system", "user_info", "reminders", "mcp", "other"]


def before_first(records: DataFrame, stop: Column) -> DataFrame:
    """Records of a session before the first one that satisfies ``stop``."""
    cut = records.filter(stop).groupBy("session_id").agg(F.min("idx").alias("__cut"))
    d = records.join(cut, "session_id", "left")
    return d.filter(c("__cut").isNull() | (c("idx") < c("__cut"))).drop("__cut")


def bucket_sums(records: DataFrame) -> DataFrame:
    """Messages, characters, token weight and first preview per bucket."""
    return records.filter(c("bucket").isNotNull()).groupBy("session_id", "bucket").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"),
        F.min_by("preview", "idx").alias("preview"))


def fold_other(buckets: DataFrame, is_subagent: Column) -> DataFrame:
    """A sub-agent's unlabelled first message is its prompt, not system text."""
    d = buckets.withColumn("bucket", F.when(is_subagent & (c("bucket") == "other"), "user_prompt").otherwise(c("bucket")))
    return d.groupBy("session_id", "bucket").agg(
        F.sum("messages").alias("messages"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"),
        F.first("preview").alias("preview"))
