"""Chat-history records: identity, fingerprint, first-prompt buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions import text as t
from sessionledger.functions.logline import get, message_text, parts_of

c = F.col


def record_type(v: str = "j") -> Column:
    return F.coalesce(F.nullif(get(v, "$.type"), F.lit("")), F.nullif(get(v, "$.role"), F.lit("")), F.lit("?"))


def record_key(kind: Column, v: str = "j") -> Column:
    """What a record is, independent of what it says; NULL when it has no identity."""
    tid = F.coalesce(F.nullif(get(v, "$.tool_call_id"), F.lit("")), F.nullif(get(v, "$.toolCallId"), F.lit("")))
    rid = F.nullif(get(v, "$.id"), F.lit(""))
    prompt = get(v, "$.prompt_index")
    calls = F.array_compact(F.transform(
        parts_of(F.try_variant_get(c(v), "$.tool_calls", "variant")), lambda x: F.nullif(F.try_variant_get(x, "$.id", "string"), F.lit(""))))
    return (
        F.when((kind == "reasoning") & rid.isNotNull(), F.concat(F.lit("reasoning:"), rid))
        .when((kind == "tool_result") & tid.isNotNull(), F.concat(F.lit("tool_result:"), tid))
        .when((kind == "user") & prompt.isNotNull(), F.concat(F.lit("user:"), prompt))
        .when(kind == "system", F.lit("system"))
        .when((kind == "assistant") & (F.size(calls) > 0), F.concat(F.lit("assistant:"), F.array_join(calls, ",")))
    )


def payload_hash(kind: Column, content: Column, v: str = "j") -> Column:
    """16 hex digits over everything a rewrite could change."""
    def raw(path: str) -> Column:
        return F.to_json(F.try_variant_get(c(v), path, "variant"))

    payload = F.to_json(F.struct(
        content.alias("content"), F.coalesce(F.length(get(v, "$.encrypted_content")), F.lit(0)).alias("enc_len"),
        raw("$.prompt_index").alias("prompt_index"), raw("$.status").alias("status"), raw("$.summary").alias("summary"),
        raw("$.synthetic_reason").alias("synthetic_reason"),
        F.coalesce(get(v, "$.tool_call_id"), get(v, "$.toolCallId")).alias("tool_call_id"),
        raw("$.tool_calls").alias("tool_calls"), kind.alias("type")))
    return F.substring(F.sha2(payload, 256), 1, 16)


def fingerprints(records: DataFrame, preview: int = 160) -> DataFrame:
    """One fingerprint per history record. Needs ``session_id, snapshot_id, idx, j``."""
    kind, content = record_type(), message_text(F.try_variant_get(c("j"), "$.content", "variant"), "\n")
    summary = message_text(F.try_variant_get(c("j"), "$.summary", "variant"), "\n")
    d = records.withColumns({"type": kind, "__content": content})
    shown = F.when(F.length("__content") > 0, c("__content")).otherwise(summary)
    reason = get("j", "$.synthetic_reason")
    return d.select(
        "session_id", "snapshot_id", "idx", "type", record_key(c("type")).alias("key"),
        payload_hash(c("type"), c("__content")).alias("hash"),
        (t.char_count(c("__content")) + t.char_count(get("j", "$.encrypted_content"))).alias("chars"),
        t.preview_collapsed(shown, preview).alias("preview"), t.is_compact_glue(shown, reason).alias("compact"),
        reason.alias("synthetic_reason"))


def first_prompt_bucket(role: Column, text: Column, reason: Column) -> Column:
    """Where a message before the first reasoning record counts; NULL when it does not."""
    low = F.lower(text)
    lead = F.regexp_replace(text, f"^[{t.SPACES}]+", "")
    reminder = F.coalesce(reason == "system_reminder", F.lit(False)) | lead.startswith("<system-reminder>")
    by_reminder = F.when(low.contains("skills are available"), "reminders").when(low.contains("mcp server"), "mcp").otherwise("reminders")
    return (
        F.when(role == "system", "system")
        .when(role.isin("reasoning", "assistant", "tool_result", "function_call"), F.lit(None).cast("string"))
        .when(text.contains("<user_info>"), "user_info").when(reminder, by_reminder)
        .when(t.is_compact_glue(text), F.lit(None).cast("string"))
        .when(text.contains("<user_query>") | text.contains("<skill_information>"), "user_prompt").otherwise("other")
    )


def tagged(text: Column, tag: str) -> Column:
    """``<tag> … </tag>`` with its tags, or NULL."""
    return F.nullif(F.regexp_extract(text, rf"(?is)(<{tag}>.*?</{tag}>)", 1), F.lit(""))


def query_share(text: Column, full_chars: Column) -> Column:
    """Characters of a first prompt that belong to the user's query; the rest is skill text.

    The whole message is divided in the ratio of the two tagged blocks' tokens.
    """
    q, s = tagged(text, "user_query"), tagged(text, "skill_information")
    qt, st = t.tokens_of_text(q), t.tokens_of_text(s)
    qc, sc = t.char_count(q), t.char_count(s)
    return (
        F.when(qt + st > 0, F.rint(full_chars * qt / (qt + st)))
        .when(qc + sc > 0, F.rint(full_chars * qc / (qc + sc))).otherwise(full_chars).cast("long")
    )


def reasoning_sizes(v: str = "j") -> Column:
    """struct of encrypted and summary sizes of a reasoning record."""
    enc = get(v, "$.encrypted_content")
    summary = message_text(F.try_variant_get(c(v), "$.summary", "variant"))
    return F.struct(
        t.char_count(enc).alias("encrypted_chars"), t.tokens_of_text(enc).alias("encrypted_tokens"),
        t.char_count(summary).alias("summary_chars"), t.tokens_of_text(summary).alias("summary_tokens"), summary.alias("summary_text"))


def recap_prompt(messages: Column) -> Column:
    """Last user or system message of a recap request that carries the reminder (array of variants)."""
    def field(m: Column, k: str) -> Column:
        return F.try_variant_get(m, f"$.{k}", "string")

    def body(m: Column) -> Column:
        return message_text(F.try_variant_get(m, "$.content", "variant"), "\n")

    def fits(m: Column) -> Column:
        role = F.lower(F.coalesce(field(m, "type"), field(m, "role"), F.lit("")))
        low = F.lower(body(m))
        hit = low.contains("recap") | low.contains("system-reminder") | low.contains("returning from idle")
        return role.isin("user", "system") & hit

    hits = F.filter(messages, fits)
    return F.when(F.size(hits) > 0, body(F.element_at(hits, -1))).otherwise(F.lit(""))


def last_recap_prompt(messages: DataFrame) -> DataFrame:
    """The same choice over message rows (``session_id, idx, type, text``)."""
    low = F.lower("text")
    fits = F.lower("type").isin("user", "system") & (low.contains("recap") | low.contains("system-reminder") | low.contains("returning from idle"))
    return messages.groupBy("session_id").agg(F.coalesce(F.max_by("text", F.when(fits, c("idx"))), F.lit("")).alias("prompt"))


def drop_mid_write(records: DataFrame) -> DataFrame:
    """Leave out snapshots whose last line does not parse; other bad lines are skipped.

    Needs ``session_id, snapshot_id, line_no, j`` with NULL ``j`` for bad lines.
    """
    keys = ["session_id", "snapshot_id"]
    torn = records.groupBy(*keys).agg(F.max_by(c("j").isNull(), "line_no").alias("__torn")).filter("__torn").select(*keys)
    return records.join(torn, keys, "left_anti").filter(c("j").isNotNull())
