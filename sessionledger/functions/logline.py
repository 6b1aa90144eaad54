"""JSON log lines to flat columns.

A line is parsed once into a variant; every column is a path into it. Lines that do not
parse stay as rows of kind ``parse_error`` with the head of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.functions import text as t

c = F.col
# Names inside the log format.
TOOL_META = "x.ai/tool"
SPAWN_HINTS = ("spawn_subagent", "get_command_or_subagent_output")
ID_KEYS = ("modelId", "model_id", "current_model_id", "primaryModelId")


def get(v: str, path: str, dtype: str = "string") -> Column:
    return F.try_variant_get(c(v), path, dtype)


def parts_of(v: Column) -> Column:
    """Array of variants when ``v`` is a JSON array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def number(v: Column, dtype: str = "bigint") -> Column:
    """A JSON number; text that merely looks like one is not a number."""
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(numeric, F.try_variant_get(v, "$", dtype))


def text_of(v: Column) -> Column:
    """Text of a stream payload: a plain string or the text of one object."""
    return F.coalesce(F.when(is_text(v), F.try_variant_get(v, "$", "string")),
                      F.try_variant_get(v, "$.text", "string"), F.lit(""))


def part_text(p: Column) -> Column:
    """Text of one element of a content list."""
    return F.coalesce(F.when(is_text(p), F.try_variant_get(p, "$", "string")),
                      F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.content", "string"))


def message_text(v: Column, separator: str = "") -> Column:
    """Text of a history message: a string, a list of parts, or the JSON itself.

    The first prompt joins parts without a separator, fingerprints join them with newlines;
    only fingerprints keep the JSON of parts that hold no text.
    """
    fallback = F.lit("") if separator == "" else None

    def one(p: Column) -> Column:
        whole = F.to_json(p) if fallback is None else F.when(F.schema_of_variant(p).startswith("OBJECT"), F.lit("")).otherwise(
            F.try_variant_get(p, "$", "string"))
        return F.coalesce(part_text(p), whole, F.lit(""))

    listed = F.array_join(F.transform(parts_of(v), one), separator)
    void = v.isNull() | (F.schema_of_variant(v) == "VOID")
    return F.when(void, F.lit("")).when(is_text(v), F.try_variant_get(v, "$", "string")).otherwise(
        F.coalesce(listed, F.to_json(v)))


def mentions(value: Column, *needles: str) -> Column:
    """Cheap text test to run before a line is parsed."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | value.contains(n)
    return hit


def _struct(*fields: tuple[str, str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{ty}" for n, ty in fields) + ">"


# (column, camel-case name, snake-case name)
USAGE = [
    ("input", "inputTokens", "input_tokens"), ("output", "outputTokens", "output_tokens"),
    ("reasoning", "reasoningTokens", "reasoning_tokens"), ("cached", "cachedReadTokens", "cached_read_tokens"),
    ("total", "totalTokens", "total_tokens"), ("ticks", "costUsdTicks", "cost_usd_ticks"),
    ("api_ms", "apiDurationMs", "api_duration_ms"), ("calls", "modelCalls", "model_calls"),
    ("num_turns", "numTurns", "num_turns"),
]
HINTS = [*[(k, "string") for k in ID_KEYS], ("modelUsage", "map<string,variant>"), ("modelsUsed", "array<string>")]
STAMPS = [(k, "bigint") for k in ("agentTimestampMs", "streamStartMs", "turnStartMs", "totalTokens", "chunkId")]
TEXTS = [(k, "string") for k in ("promptId", "eventId", "updateType")]
META = [*STAMPS, *TEXTS, *HINTS]
LINE_SCHEMA = _struct(
    ("_bad", "string"), ("timestamp", "double"), ("method", "string"), *HINTS,
    ("params", _struct(
        ("sessionId", "string"), *HINTS, ("_meta", _struct(*META)),
        ("update", _struct(
            *[(k, "string") for k in ("sessionUpdate", "toolCallId", "title", "kind", "status", "stop_reason", "event_name", "prompt_id", "summary")],
            ("content", "variant"), ("rawInput", "variant"), ("rawOutput", "variant"), ("tokens_before", "bigint"), ("tokens_after", "bigint"),
            ("auto", "boolean"), *HINTS,
            ("runs", "array<struct<name:string,status:struct<elapsed_ms:bigint>>>"),
            ("_meta", _struct(*META, (TOOL_META, _struct(("name", "string"), ("input", "variant"))))),
            ("usage", _struct(*[(n, "bigint") for _, a, b in USAGE for n in (a, b)], *HINTS, ("model_usage", "map<string,variant>"))),
        )),
    )),
)


def compute_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column through a generator, so that the optimizer cannot copy its
    expression into every column derived from it."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``j``, the parsed line as a struct, and ``bad``; blank lines are dropped."""
    d = lines.withColumn("value", t.strip(c("value"))).filter(F.length("value") > 0)
    d = compute_once(d, "j", F.from_json("value", LINE_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    # A field of another type also marks the record; only text that is no JSON at all is bad.
    return d.withColumn("bad", c("j._bad").isNotNull() & F.try_parse_json("value").isNull())


def normalize(lines: DataFrame, preview: int = 120) -> DataFrame:
    """One flat event per log line; a fixed set of columns, NULL where a line has no value."""
    d = parse_lines(lines)
    keep = [x for x in d.columns if x not in ("value", "j", "bad")]
    p, u = "j.params._meta", "j.params.update"
    um = f"{u}._meta"

    def meta(key: str) -> Column:
        return F.coalesce(c(f"{p}.{key}"), c(f"{um}.{key}"))

    usage = c(f"{u}.usage")
    d = d.select(
        *keep,
        F.when(c("bad"), "parse_error").otherwise(F.nullif(c(f"{u}.sessionUpdate"), F.lit(""))).alias("kind"),
        F.when(c("bad"), c("value")).alias("raw_line"),
        c("j.method").alias("method"), c("j.params.sessionId").alias("log_session_id"), c(f"{p}.eventId").alias("event_id"),
        F.coalesce(meta("promptId"), c(f"{u}.prompt_id")).alias("prompt_id"), c("j.timestamp").alias("file_timestamp"),
        meta("agentTimestampMs").alias("agent_ms"), meta("streamStartMs").alias("stream_ms"),
        meta("turnStartMs").alias("turn_ms"), meta("totalTokens").alias("context_tokens"),
        t.epoch_of(c("j.timestamp"), c(f"{p}.agentTimestampMs"), c(f"{um}.agentTimestampMs")).alias("epoch"),
        c(f"{p}.chunkId").alias("chunk_id"), c(f"{p}.updateType").alias("update_type"), c(f"{um}.modelId").alias("model_id"),
        text_of(c(f"{u}.content")).alias("text"), c(f"{u}.content").alias("content"),
        c(f"{u}.rawInput").alias("raw_input"), c(f"{u}.rawOutput").alias("raw_output"),
        c(um)[TOOL_META]["input"].alias("meta_input"), c(um)[TOOL_META]["name"].alias("tool_meta_name"),
        c(f"{u}.toolCallId").alias("tool_call_id"), c(f"{u}.title").alias("title"),
        c(f"{u}.kind").alias("tool_kind"), c(f"{u}.status").alias("status"), c(f"{u}.stop_reason").alias("stop_reason"),
        c(f"{u}.event_name").alias("event_name"),
        F.aggregate(c(f"{u}.runs"), F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["status"]["elapsed_ms"], F.lit(0))).alias("hook_elapsed_ms"),
        c(f"{u}.tokens_before").alias("tokens_before"), c(f"{u}.tokens_after").alias("tokens_after"), c(f"{u}.summary").alias("summary"),
        *[F.coalesce(usage[a], usage[s]).alias(n) for n, a, s in USAGE],
        F.get(F.map_keys(F.coalesce(usage["modelUsage"], usage["model_usage"])), F.lit(0)).alias("model"),
    ).filter(c("kind").isNotNull())
    return d.withColumns({
        "ms_since_stream": c("agent_ms") - c("stream_ms"), "ms_since_turn": c("agent_ms") - c("turn_ms"),
        "char_count": t.char_count(c("text")), "line_count": t.line_count(c("text")),
        "text_preview": F.when(F.length("text") > 0, t.preview_counted(c("text"), preview)),
    })


def may_name_model(value: Column) -> Column:
    """Text test: only such lines can name a model."""
    return mentions(value, *ID_KEYS, "modelUsage", "modelsUsed")


def model_hints(j: str = "j") -> Column:
    """Model ids named in a parsed line's known places, in order of appearance."""
    none = F.array().cast("array<string>")
    out = []
    for place in ("", ".params", ".params.update", ".params.update._meta", ".params.update.usage", ".params._meta"):
        at = f"{j}{place}"
        out.append(F.array(*[t.nonempty(c(f"{at}.{k}")) for k in ID_KEYS]))
        out.append(F.coalesce(F.map_keys(c(f"{at}.modelUsage")), none))
        out.append(F.coalesce(c(f"{at}.modelsUsed"), none))
    return F.array_distinct(F.array_compact(F.concat(*out)))


def model_per_session(hints: DataFrame) -> DataFrame:
    """Family of each session: the first hint, in source order, that names a priced family.

    ``hints``: ``session_id, source_rank, line_no, ids``. History counts its last 40 lines,
    updates their first 40 and last 20.
    """
    from sessionledger.functions.pricing import price_family

    e = hints.select("session_id", "source_rank", "line_no", F.posexplode("ids").alias("pos", "model_id"))
    e = e.withColumn("family", price_family(c("model_id")))
    return e.groupBy("session_id").agg(
        F.min_by("family", F.when(c("family").isNotNull(), F.struct("source_rank", "line_no", "pos"))).alias("family"),
        F.min_by("model_id", F.struct("source_rank", "line_no", "pos")).alias("first_id"),
    ).withColumn("assumed", c("family").isNull())
