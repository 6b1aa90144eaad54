"""Queries against their SQL twins on small tables that are written like larger ones: folders of several files, odd rows."""

import datetime

import pytest

import compare
from __spark_entry__ import catalogue

START = datetime.datetime(2024, 1, 10)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, minutes, user, kind, value, k):
    return i, START + datetime.timedelta(minutes=minutes), user, kind, value, f'{{"k": {k}}}'


@pytest.fixture(scope="module")
def duck():
    import duckdb

    def connect(sf, *tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
        return con

    return connect


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("events"))
    kinds = ["purchase", "view", "click", "error", "signup", "view"]
    rows = [event(i, 37 * i, 1 + i % 7, kinds[i % 6], 3.5 * (i % 90), i % 100) for i in range(600)]
    rows += [event(600, 1_500, 11, "purchase", 0.0, 8), event(601, 1_510, 11, "purchase", 0.0, 5)]  # turns without any usage
    # a phase without a stream start: both lines have k % 13 = 0
    rows += [event(602, 1_520, 12, "view", 30.0, 13), event(603, 1_560, 12, "view", 90.0, 13)]
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(f"{sf}/events.parquet")
    return sf


@pytest.mark.parametrize("name", ["activity_windows", "hourly_priced_buckets", "month_day_buckets", "clipped_week_buckets", "totals_buckets_sessions", "session_bills",
                                  "window_sessions", "streamed_hour_buckets", "sliding_windows", "priced_turns", "stream_phases"])
def test_events(spark, duck, events, name):
    assert compare.check(spark, duck(events, "events"), events, catalogue()[name])[1] == "ok"


def test_the_earliest_of_equally_large_results_counts(spark, duck, events, tmp_path):
    sf = str(tmp_path)
    spark.read.parquet(f"{events}/events.parquet").write.parquet(f"{sf}/events.parquet")
    lengths = [41, 43, 42, 40, 12]  # the first four have 10 tokens each
    turns = [(conv, 5 * i + t, "user", "x" * (n + t)) for conv in range(1, 8) for i, n in enumerate(lengths) for t in range(5)]
    texts = spark.createDataFrame([(v, t, r, x[:43] if len(x) > 40 else x) for v, t, r, x in turns], "conv_id long, turn long, role string, text string")
    texts.orderBy("conv_id", "turn").coalesce(1).write.parquet(f"{sf}/conversations.parquet")
    q = catalogue()["history_tool_results"]
    assert compare.check(spark, duck(sf, "events", "conversations"), sf, q)[1] == "ok"
    first = q.plan(spark, sf).filter("result_tokens = 10").groupBy().agg({"result_chars": "min"}).first()[0]
    assert first == 41


def test_a_line_exactly_the_gap_later_begins_the_next_period(spark, duck, tmp_path):
    sf = str(tmp_path)
    rows = [event(i, minutes, user, "view", 1.0, 1) for i, (user, minutes) in enumerate([(1, 0), (1, 120), (2, 0), (2, 119), (3, 0), (3, 121), (4, 0), (4, 120), (4, 130), (4, 250)])]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{sf}/events.parquet")
    q = catalogue()["activity_windows"]
    assert compare.check(spark, duck(sf, "events"), sf, q)[1] == "ok"
    assert [r.lines for r in q.plan(spark, sf).filter("session_id < 5").orderBy("session_id", "start_ms").collect()] == [1, 1, 2, 1, 1, 1, 2, 1]
