"""Session folders: finding them and reading their files.

Layout: ``<root>/…/<session>/…``, any number of folders above the session, with ``updates.jsonl``,
``events.jsonl``, ``chat_history.jsonl``, ``signals.json``, ``summary.json``,
``recap_requests/*.json`` and ``tool_definitions.json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionledger.functions.logline import LINE_SCHEMA, parse_lines  # noqa: F401
from sessionledger.functions.text import strip

c = F.col
# Fields of the gauge and header files.
GAUGE_FIELDS = ["contextTokensUsed", "contextWindowTokens", "avgTimeToFirstTokenMs", "avgResponseTimeMs", "itlP50Ms", "itlP99Ms", "itlMeanMs",
                "totalChunkCount", "toolCallCount", "turnCount", "sessionDurationSeconds", "modelsUsed", "primaryModelId", "toolsUsed"]
GAUGE_LISTS = {"modelsUsed", "toolsUsed"}
GAUGES = "struct<" + ",".join(f"{g}:{'array<string>' if g in GAUGE_LISTS else 'string' if g == 'primaryModelId' else 'double'}" for g in GAUGE_FIELDS) + ">"
_HEAD = ["session_summary", "generated_title", "last_turn_summary", "session_kind", "agent_name", "parent_session_id", "parent_id", "created_at", "last_active_at", "updated_at"]
HEADER = "struct<" + ",".join(f"{h}:string" for h in _HEAD) + ",info:struct<cwd:string,parent_session_id:string,parent_id:string,session_kind:string>>"


def _folder(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Texts of all small files called ``name`` below ``root``, in one scan."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return r.text(root, wholetext=True).select("value", c("_metadata.file_path").alias("path")).withColumn("session_id", _folder("path"))


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that have a log, in folders of any depth: id, path, size and time, without reading the logs."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "updates.jsonl").load(root)
    return d.select(_folder("path").alias("session_id"), "path", c("length").alias("size"), c("modificationTime").alias("mtime"))


def histories_to_watch(spark: SparkSession, root: str) -> DataFrame:
    """Folders with a history, whether or not they have a log yet."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{chat_history,updates}.jsonl").load(root)
    folder = F.regexp_replace("path", "/[^/]+$", "")
    return d.groupBy(folder.alias("folder")).agg(F.bool_or(c("path").endswith("chat_history.jsonl")).alias("has_history"),
                                                 F.bool_or(c("path").endswith("updates.jsonl")).alias("has_log")).filter("has_history")


def read_log(spark: SparkSession, root: str, name: str = "updates.jsonl", complete: bool = False) -> DataFrame:
    """``session_id, source_file, line_no, value`` of all logs below ``root``, line numbers from 1 inside a file.

    Files are read by split, however large they are: a line's number is its place in its split plus the lines of the splits before,
    which are counted first (one row per split). With ``complete`` a last line that is not yet ended by a line feed is left out: it
    is there when a file's lines, each with a line feed, are longer than the file.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("lineSep", "\n").text(root)
    d = r.select("value", c("_metadata.file_path").alias("source_file"), c("_metadata.file_block_start").alias("__start"), c("_metadata.file_size").alias("__size"), F.monotonically_increasing_id().alias("__id"))
    split = ["source_file", "__start"]
    counts = d.groupBy(*split).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"), F.sum(F.octet_length("value") + 1).alias("__bytes"), F.max("__size").alias("__size"))
    file, before = W.partitionBy("source_file"), W.partitionBy("source_file").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*split, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"), F.sum("__n").over(file).alias("__lines"), (F.sum("__bytes").over(file) > c("__size")).alias("__open"))
    d = d.drop("__size").join(counts, split).withColumn("line_no", c("__id") - c("__first") + c("__ahead") + 1)
    if complete:
        d = d.filter(~(c("__open") & (c("line_no") == c("__lines"))))
    return d.select(_folder("source_file").alias("session_id"), "source_file", "line_no", "value")


def tail_log(spark: SparkSession, root: str, store: str, batch: int, name: str = "updates.jsonl") -> DataFrame:
    """Complete lines that no batch before ``batch`` has given; what this one gives is noted in ``store``.

    A batch that is run again gives its lines again. A line that is still being written waits for its line feed.
    """
    from sessionledger.session import materialize

    d = read_log(spark, root, name, complete=True)
    if batch > 0:
        known = spark.read.parquet(f"{store}/batch=*").groupBy("source_file").agg(F.max(F.when(c("batch") < batch, c("lines"))).alias("__known"))
        d = d.join(known, "source_file", "left").filter(c("line_no") > F.coalesce("__known", F.lit(0)))
    d = materialize(d.select("session_id", "source_file", "line_no", "value"))
    d.groupBy("source_file").agg(F.max("line_no").alias("lines")).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{store}/batch={batch:09d}")
    return d


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """Splittable landing zone: JSON lines wrapped with ``session_id`` and ``line_no``."""
    return spark.read.schema("session_id string, source_file string, line_no long, value string").json(path)


def _json(value: Column, schema: str) -> Column:
    return F.from_json(F.regexp_replace(value, "^\ufeff", ""), schema)


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """Session headers; a byte-order mark is tolerated, a file that is no JSON gives an empty header."""
    d = _files(spark, root, "summary.json")
    kind = F.coalesce(F.nullif(F.lower(F.trim("h.session_kind")), F.lit("")), F.lower("h.info.session_kind"))
    return d.select("session_id", _json(c("value"), HEADER).alias("h")).select("session_id", "h.*", kind.alias("kind"))


def read_gauges(spark: SparkSession, root: str) -> DataFrame:
    """Gauge files cut to the fields in use, lists in full."""
    return _files(spark, root, "signals.json").select("session_id", _json(c("value"), GAUGES).alias("g")).select("session_id", "g.*")


def read_lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """Lifecycle events: phase changes, first token, turn and tool completion, with model, turn number and outcome."""
    d = read_log(spark, root, "events.jsonl").filter(F.length(strip(c("value"))) > 0)
    e = F.from_json("value", "struct<type:string,phase:string,ts:string,duration_ms:long,tool_name:string,model_id:string,turn_number:long,outcome:string>")
    return d.select("session_id", "line_no", e.alias("e")).select("session_id", "line_no", c("e.type").alias("kind"), "e.phase", "e.ts", "e.duration_ms", "e.tool_name", "e.model_id", "e.turn_number", "e.outcome").filter(c("kind").isNotNull())


def read_recap_requests(spark: SparkSession, root: str) -> DataFrame:
    """Recap request files of all sessions, with their time."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    d = r.select("value", c("_metadata.file_path").alias("path"), c("_metadata.file_modification_time").alias("mtime")).filter(c("path").contains("/recap_requests/"))
    d = d.select(F.element_at(F.split("path", "/"), -3).alias("session_id"), F.regexp_extract("path", "([^/]+)[.]json$", 1).alias("stem"), "mtime", F.try_parse_json("value").alias("j"))
    return d.select("session_id", F.coalesce(F.try_variant_get("j", "$.request_id", "string"), c("stem")).alias("request_id"), "mtime",
                    F.coalesce(F.try_variant_get("j", "$.summary", "string"), F.try_variant_get("j", "$.raw_response", "string")).alias("summary"),
                    F.try_variant_get("j", "$.chat_history", "array<variant>").alias("chat_history"))


def tool_definitions(sessions: DataFrame, overrides: DataFrame, conf_tokens: int | None = None, default_count: int = 25) -> DataFrame:
    """Size of the tool schemas per session: the session's file, else the setting, else nothing known.

    ``overrides`` are the rows of :func:`read_tool_definitions`.
    """
    d = sessions.join(overrides.withColumn("__file", F.lit(True)), "session_id", "left")
    return d.withColumns({
        "tool_tokens": F.coalesce(F.when(c("tokens") < 0, 0).otherwise(c("tokens")), F.lit(conf_tokens), F.lit(0)), "tool_count": F.coalesce(F.when(c("count") < 0, 0).otherwise(c("count")), F.lit(default_count)),
        "tool_source": F.when(c("__file"), "file").when(F.lit(conf_tokens is not None), "conf").otherwise("default")}).drop("tokens", "count", "__file")


def read_tool_definitions(spark: SparkSession, root: str) -> DataFrame:
    """``session_id, tokens, count`` of the sessions that have a readable ``tool_definitions.json``."""
    d = _files(spark, root, "tool_definitions.json").select("session_id", _json(c("value"), "struct<tokens:long,count:long>").alias("j"))
    return d.filter(c("j.tokens").isNotNull() | c("j.count").isNotNull()).select("session_id", "j.tokens", "j.count")
