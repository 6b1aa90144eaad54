"""What a rewrite did to a conversation history.

Snapshots are fingerprint rows ``session_id, idx, type, key, hash, chars, preview, compact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions.text import is_compact_glue
from sessionledger.operators.grouping import skew_safe
from sessionledger.session import materialize

c = F.col


def snapshot_kind(n: Column, m: Column, prefix: Column, last_user: Column) -> Column:
    """unchanged, append, tail, truncate or mutate from sizes, common prefix and last user row."""
    shorter = (m < n) & (prefix == m)
    return (
        F.when((prefix == n) & (m == n), "unchanged").when((prefix == n) & (m > n), "append")
        .when(shorter & (prefix > last_user), "tail").when(shorter, "truncate").when(prefix > last_user, "tail").otherwise("mutate"))


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per session: sizes, common prefix, kind and the index where a cache breaks."""
    j = old.select("session_id", "idx", c("hash").alias("ho"), c("type").alias("to")).join(
        new.select("session_id", "idx", c("hash").alias("hn")), ["session_id", "idx"], "full")
    a = j.groupBy("session_id").agg(
        F.count("ho").alias("old_n"), F.count("hn").alias("new_n"),
        F.min(F.when(~c("ho").eqNullSafe(c("hn")), c("idx"))).alias("__break"),
        F.coalesce(F.max(F.when(c("to") == "user", c("idx"))), F.lit(-1)).alias("last_user"))
    a = a.withColumn("prefix", F.coalesce("__break", "old_n")).drop("__break")
    a = a.withColumn("kind", snapshot_kind(c("old_n"), c("new_n"), c("prefix"), c("last_user")))
    return a.withColumn("cache_break_index", F.when(~c("kind").isin("unchanged", "append"), c("prefix")))


def common_prefix(old: DataFrame, new: DataFrame, compared: DataFrame) -> DataFrame:
    """Rows both snapshots share below the first difference."""
    cut = compared.select("session_id", "prefix")

    def head(x: DataFrame) -> DataFrame:
        return x.join(cut, "session_id").filter(c("idx") < c("prefix")).select("session_id", "idx", "hash")

    return head(old).intersect(head(new))


def align_changes(old: DataFrame, new: DataFrame, compared: DataFrame) -> DataFrame:
    """Edits, inserts and deletes behind the common prefix.

    A row is matched by identity key and occurrence; a row without such a partner is matched
    by position when the old row there has no key; what is left was inserted or deleted.
    """
    cut = compared.filter(c("kind") != "unchanged").select("session_id", "prefix")
    fields = ["type", "key", "hash", "chars", "preview", "compact"]

    def rest(x: DataFrame, p: str) -> DataFrame:
        d = x.join(cut, "session_id").filter(c("idx") >= c("prefix")).select("session_id", "idx", *fields)
        keyed = d.withColumn("__k", F.coalesce(F.nullif("key", F.lit("")), F.concat(F.lit("#"), c("idx").cast("string"))))
        # The changed tail only: written once, read by the size probe and the numbering.
        d = skew_safe(materialize(keyed), ["session_id", "__k"], "idx", lambda y, g: g.number(y, "__occ")).drop("__k")
        return d.select("session_id", c("idx").alias(f"{p}idx"), "__occ", *[c(x).alias(f"{p}{x}") for x in fields])

    o, n = rest(old, "o_"), rest(new, "n_")
    has_o = F.coalesce(c("o_key"), F.lit("")) != ""
    has_n = F.coalesce(c("n_key"), F.lit("")) != ""
    by_key = o.filter(has_o).withColumn("__key", c("o_key")).join(
        n.filter(has_n).withColumn("__key", c("n_key")), ["session_id", "__key", "__occ"], "full").drop("__key", "__occ")
    matched = by_key.filter(c("o_idx").isNotNull() & c("n_idx").isNotNull())
    lone_new = by_key.filter(c("o_idx").isNull()).select(*[x for x in n.columns if x != "__occ"]).unionByName(n.filter(~has_n).drop("__occ"))
    by_place = o.filter(~has_o).drop("__occ").withColumn("__at", c("o_idx")).join(lone_new.withColumn("__at", c("n_idx")), ["session_id", "__at"], "full").drop("__at")
    lone_old = by_key.filter(c("n_idx").isNull())
    d = matched.unionByName(by_place).unionByName(lone_old)
    op = F.when(c("o_idx").isNull(), "insert").when(c("n_idx").isNull(), "delete").when(c("o_hash") != c("n_hash"), "edit")
    d = d.withColumn("op", op).filter(c("op").isNotNull())
    return d.select(
        "session_id", "op", F.coalesce("o_idx", "n_idx").alias("idx"), F.coalesce("n_type", "o_type").alias("type"),
        F.when(c("op") == "delete", c("o_key")).otherwise(c("n_key")).alias("key"),
        c("o_chars").alias("old_chars"), c("n_chars").alias("new_chars"), c("o_preview").alias("old_preview"), c("n_preview").alias("new_preview"),
        c("o_hash").alias("old_hash"), c("n_hash").alias("new_hash"), (F.coalesce("n_compact", F.lit(False)) | F.coalesce("o_compact", F.lit(False))).alias("compact"))


def numbered_changes(changes: DataFrame) -> DataFrame:
    """The change list of a snapshot, numbered by index, then operation."""
    d = changes.withColumn("__pos", c("idx") * 3 + F.when(c("op") == "delete", 0).when(c("op") == "edit", 1).otherwise(2))
    d = skew_safe(materialize(d), ["session_id"], "__pos", lambda y, g: g.number(y, "change_no"))
    return d.drop("__pos")


def new_glue(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compaction records that were not in the old snapshot."""
    return new.filter("compact").join(old.select("session_id", "hash").distinct(), ["session_id", "hash"], "left_anti")


def diff_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Kind, counts of changes, and whether the rewrite looks like a compaction."""
    compared = materialize(compare_snapshots(old, new))
    ch = align_changes(old, new, compared)
    blob = F.concat_ws(" ", "new_preview", "old_preview", "key")
    sums = ch.groupBy("session_id").agg(
        F.count_if(c("op") == "insert").alias("inserted"), F.count_if(c("op") == "delete").alias("removed"), F.count_if(c("op") == "edit").alias("changed"),
        F.bool_or(is_compact_glue(blob)).alias("__glue"), F.bool_or("compact").alias("__record"))
    glue = new_glue(old, new).groupBy("session_id").agg(F.count(F.lit(1)).alias("__new"))
    d = compared.join(sums, "session_id", "left").join(glue, "session_id", "left").fillna(0, ["inserted", "removed", "changed"])
    quiet = c("kind").isin("unchanged", "append")
    why = F.when(quiet, F.lit(None).cast("string")).when(c("__new") > 0, "compact glue").when(c("__glue"), "compact glue in diff").when(c("__record"), "compact record")
    return d.withColumns({
        "added": F.when(c("kind") == "append", F.greatest(c("new_n") - c("old_n"), F.lit(0))).otherwise(c("inserted")),
        "compact_why": why, "from_compact": why.isNotNull()}).drop("inserted", "__glue", "__record", "__new", "last_user")


def watch_counters(diffs: DataFrame) -> DataFrame:
    """Counts per kind and session; mutations are what can break a cache."""
    kinds = ["append", "mutate", "tail", "truncate"]
    a = diffs.groupBy("session_id").pivot("kind", kinds).count().fillna(0, kinds)
    return a.withColumn("mutations", c("mutate") + c("truncate"))
