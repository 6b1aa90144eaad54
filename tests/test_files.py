"""Session folders, growing files and history snapshots on disk."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from sessionledger.functions import history as h
from sessionledger.functions import tools as tl
from sessionledger.operators import historydiff as hd
from sessionledger.operators import period as per
from sessionledger.operators import sessions as so
from sessionledger.operators.grouping import PlainGroups
from sessionledger.sources import files, store
from sessionledger.streaming import live

c = F.col


def put(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)
    return path


def test_discovery_and_headers(spark, tmp_path):
    root = str(tmp_path)
    put(root, "s1/updates.jsonl", '{"a":1}\n\nbroken\n')
    put(root, "ws/s2/updates.jsonl", "{}\n")
    put(root, "ws/deep/s3/updates.jsonl", "{}\n")
    put(root, "ws/s4/chat_history.jsonl", "{}\n")
    put(root, "s1/summary.json", "\ufeff" + json.dumps({"session_summary": "Best", "generated_title": "Other", "session_kind": " SubAgent "}))
    assert {r.session_id for r in files.session_files(spark, root).collect()} == {"s1", "s2", "s3"}
    assert {os.path.basename(r.folder) for r in files.histories_to_watch(spark, root).collect()} == {"s4"}
    head = files.read_headers(spark, root).first()
    assert (head.session_summary, head.kind) == ("Best", "subagent")
    lines = {r.line_no: r.value for r in files.read_log(spark, root).filter("session_id = 's1'").collect()}
    assert lines[1] == '{"a":1}' and lines[3] == "broken"
    put(root, "s1/signals.json", json.dumps({"contextTokensUsed": 5, "toolsUsed": ["t"] * 60, "junk": 1}))
    g = files.read_gauges(spark, root).first()
    assert g.contextTokensUsed == 5 and len(g.toolsUsed) == 60
    put(root, "s1/recap_requests/r1.json", json.dumps({"summary": "done", "chat_history": [{"type": "user", "content": "write a recap"}]}))
    q = files.read_recap_requests(spark, root).withColumn("prompt", h.recap_prompt(c("chat_history"))).first()
    assert (q.request_id, q.summary, q.prompt) == ("r1", "done", "write a recap")
    put(root, "s1/events.jsonl", '{"type":"turn_ended","duration_ms":12,"model_id":"m-4.6","turn_number":3,"outcome":"cancelled"}\n\nno json\n')
    e = files.read_lifecycle(spark, root).first()
    assert (e.duration_ms, e.model_id, e.turn_number, e.outcome) == (12, "m-4.6", 3, "cancelled")


def test_logs_of_many_splits(spark, tmp_path):
    """Line numbers of files cut into many splits, lines longer than a split and small files packed together."""
    root = str(tmp_path)
    texts = {"s1": [f"line {i} " + "x" * (i * 37 % 211) for i in range(300)], "ws/s2": ["é" * 900, "", "", "end\r"], "s3": ["only"], "a/b/c/s4": [""] * 5}
    for rel, lines in texts.items():
        put(root, f"{rel}/updates.jsonl", "\n".join(lines) + "\n")
    put(root, "s5/updates.jsonl", "")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for limit in ("128", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            spark.conf.set("spark.sql.files.openCostInBytes", "16")
            d = files.read_log(spark, root)
            whole = spark.read.option("recursiveFileLookup", "true").text(root)
            assert limit != "128" or whole.select("_metadata.file_block_start").distinct().count() > 20
            got = {}
            for r in d.collect():
                got.setdefault(r.session_id, {})[r.line_no] = r.value
            assert got == {rel.split("/")[-1]: dict(enumerate(lines, 1)) for rel, lines in texts.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tail(spark, tmp_path):
    """New lines once each; a line in the middle of being written waits; a batch can be repeated."""
    root, store_at = str(tmp_path / "logs"), str(tmp_path / "store")

    def tail(batch):
        return sorted((r.session_id, r.line_no, r.value) for r in files.tail_log(spark, root, store_at, batch).collect())

    put(root, "s1/updates.jsonl", "one\ntwo\npart")
    assert tail(0) == [("s1", 1, "one"), ("s1", 2, "two")]
    put(root, "s1/updates.jsonl", "ial\nnext\n")
    put(root, "s2/updates.jsonl", "é\n\n")
    want = [("s1", 3, "partial"), ("s1", 4, "next"), ("s2", 1, "é"), ("s2", 2, "")]
    assert tail(1) == want and tail(1) == want
    assert tail(2) == []
    put(root, "s2/updates.jsonl", "last")
    assert tail(3) == [] and ("s2", 3, "last") in {(r.session_id, r.line_no, r.value) for r in files.read_log(spark, root).collect()}


def prints(spark, texts, snapshot=0):
    rows = [(1, snapshot, i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "session_id long, snapshot_id long, idx long, raw string").withColumn("j", F.try_parse_json("raw"))
    return h.fingerprints(d).drop("snapshot_id")


def rec(kind, text, **kw):
    return json.dumps({"type": kind, "content": text, **kw})


def test_history_kinds(spark):
    base = [rec("system", "s"), rec("user", "u", prompt_index=0), rec("assistant", "a"), rec("tool_result", "r", tool_call_id="t")]
    cases = {
        "append": (base, [*base, rec("assistant", "b")], None), "tail": (base, [*base[:2], rec("assistant", "A"), base[3]], 2),
        "mutate": (base, [base[0], rec("user", "x", prompt_index=0), *base[2:]], 1), "truncate": ([*base, rec("user", "v", prompt_index=1)], base[:3], 3), "unchanged": (base, base, None)}
    for kind, (old, new, broken) in cases.items():
        d = hd.diff_summary(prints(spark, old), prints(spark, new)).first()
        assert (d.kind, d.cache_break_index) == (kind, broken), kind
    glued = [base[0], rec("user", "This session is being continued", synthetic_reason="compaction"), *base[2:]]
    d = hd.diff_summary(prints(spark, base), prints(spark, glued)).first()
    assert d.kind == "mutate" and d.from_compact and d.compact_why == "compact glue"


def test_history_watch(spark, tmp_path):
    store, src = str(tmp_path / "store"), str(tmp_path / "in")
    for i, texts in enumerate(([rec("system", "s")], [rec("system", "s"), rec("user", "u", prompt_index=0)])):
        prints(spark, texts).withColumn("snapshot_id", F.lit(i)).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        live.history_watch(s, store, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{store}/diffs").first().kind == "append"


def test_history_watch_compares_neighbours(spark, tmp_path):
    """Snapshots that arrive together are diffed one by one; a session without news keeps its last one."""
    store, src = str(tmp_path / "store"), str(tmp_path / "in")
    one, two = [rec("system", "s"), rec("user", "u", prompt_index=0)], [rec("system", "new"), rec("user", "u", prompt_index=0)]
    three = [*two, rec("user", "more", prompt_index=1)]

    def put_batch(*shots):
        rows = [prints(spark, texts).withColumn("snapshot_id", F.lit(i)).withColumn("session_id", F.lit(s).cast("long")) for s, i, texts in shots]
        for r in rows[1:]:
            rows[0] = rows[0].unionByName(r)
        rows[0].coalesce(1).write.mode("append").parquet(src)
        live.history_watch(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination()

    put_batch((1, 0, one), (2, 0, one))
    put_batch((1, 1, two), (1, 2, three))
    put_batch((2, 1, one), (1, 3, three))
    got = {(r.session_id, r.snapshot_id): r.kind for r in spark.read.parquet(f"{store}/diffs").collect()}
    assert got == {(1, 1): "mutate", (1, 2): "append", (1, 3): "unchanged", (2, 1): "unchanged"}


def test_sources_without_caps(spark, tmp_path):
    root = str(tmp_path)
    for i in range(90):
        put(root, f"s1/recap_requests/r{i}.json", json.dumps({"summary": f"done {i}"}))
    assert files.read_recap_requests(spark, root).count() == 90
    put(root, "s1/signals.json", json.dumps({"avgTimeToFirstTokenMs": 7, "totalChunkCount": 3, "itlMeanMs": 2}))
    g = files.read_gauges(spark, root).first()
    assert (g.avgTimeToFirstTokenMs, g.totalChunkCount, g.itlMeanMs) == (7, 3, 2)
    put(root, "s1/tool_definitions.json", json.dumps({"tokens": 70}))
    put(root, "s2/tool_definitions.json", "no json")

    got = {r.session_id: (r.tool_tokens, r.tool_count, r.tool_source) for r in files.tool_definitions(spark.createDataFrame([("s1",), ("s2",)], "session_id string"), files.read_tool_definitions(spark, root), 55).collect()}
    assert got == {"s1": (70, 25, "file"), "s2": (55, 25, "conf")}


def test_refresh_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "r")
    cur = spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "session_id long, size long, mtime long")
    more = spark.createDataFrame([(1, 11, 0), (2, 20, 0)], "session_id long, size long, mtime long")
    for now, batch in ((cur, "1"), (more, "2"), (more, "2")):
        out = store.refresh(now, lambda ids: ids.withColumn("x", F.lit(1)), path, batch)
        assert sorted(r.session_id for r in out.collect()) == [1, 2]
    # a batch whose manifest was lost with the driver
    store._write_batch(more.select("session_id").withColumns({"x": F.lit(9), "batch": F.lit("3")}), f"{path}/results")
    third = spark.createDataFrame([(1, 12, 0), (2, 21, 0)], "session_id long, size long, mtime long")
    assert sorted((r.session_id, r.x) for r in store.refresh(third, lambda ids: ids.withColumn("x", F.lit(2)), path, "3").collect()) == [(1, 2), (2, 2)]


def test_spans_and_order(spark):
    t0 = 1_700_000_000_000
    rows = [(1, 1, "user_message_chunk", t0), (1, 2, "turn_completed", t0 + 2_400_000), (1, 3, "user_message", t0 + 18_000_000), (1, 4, "turn_completed", t0 + 21_600_000), (2, 1, "tool_call", t0)]
    d = spark.createDataFrame(rows, "session_id long, line_no long, kind string, agent_ms long")
    spans = sorted(tuple(r) for r in so.work_spans(d, PlainGroups(["session_id"], "mark")).collect())
    assert [x[3] for x in spans if x[0] == 1] == ["work", "wait", "work"]
    assert [x for x in spans if x[0] == 2] == [(2, t0, t0, "work")]
    s = spark.createDataFrame([("p", None, None, 1), ("c", "subagent", "p", 2), ("z", None, None, 9), ("o", "subagent", "gone", 3)], "session_id string, session_kind string, parent_id string, first_ms long")
    got = {r.session_id: (r.label, r.depth) for r in so.session_order(s).collect()}
    assert got == {"p": ("Session 1", 0), "c": ("Sub Agent 1", 1), "z": ("Session 2", 0), "o": ("Sub Agent 1", 1)}


def test_periods(spark):
    now = int(dt.datetime(2026, 8, 14, 15, 30, tzinfo=dt.timezone.utc).timestamp() * 1000)
    one = spark.range(1).select(*[per.period_window(F.lit(now), p, o).alias(f"{p}{abs(o)}") for p, o in (("daily", 0), ("weekly", 0), ("monthly", 0), ("monthly", -1))]).first()
    day = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).strftime("%m-%d")
    assert [(day(x.start_ms), day(x.end_ms)) for x in one] == [("08-14", "08-15"), ("08-10", "08-17"), ("08-01", "09-01"), ("07-01", "08-01")]
    assert [per.normalize_grain(p, g) for p, g in (("daily", "15 min"), ("daily", "week"), ("weekly", None), ("monthly", "Weekly"))] == ["15m", "hour", "day", "week"]
    for p, g, n in (("daily", "15m", 96), ("daily", "hour", 24), ("monthly", "day", 31), ("weekly", "hour", 168), ("weekly", "day", 7)):
        w = spark.range(1).select(per.period_window(F.lit(now), p).alias("w")).select("w.start_ms", "w.end_ms")
        assert per.bucket_spine(w, p, g).count() == n


def test_result_size_counts_the_body_only(spark):
    body = "hello from grep"
    v = F.try_parse_json(F.lit(json.dumps([{"type": "content", "text": body}])))
    d = spark.range(1).select(v.alias("content"), F.try_parse_json(F.lit('{"type":"x"}')).alias("raw"))
    r = d.select(tl.result_sizes(c("content"), c("raw")).alias("s")).select("s.*").first()
    assert (r.chars, r.tokens, r.lines) == (len(body), len(body) // 4, 1)


def test_numbers_of_a_burst(spark):
    """Nearly all rows share one clock and one clock is far off."""
    rows = [(5, i) for i in range(500)] + [(10**15, 1), (1, 7), (5, 900)]
    d = spark.createDataFrame(rows, "at long, tie long")
    got = {(r.at, r.tie): r.n for r in so.global_numbers(d, "at", "tie", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(rows))}
