"""The blocked engine must give what native windows and plain Python give."""

import random

import pytest
from pyspark.sql import functions as F

from sessionledger.operators import allocate as a
from sessionledger.operators import grouping
from sessionledger.operators import sessionize as s
from sessionledger.operators.grouping import BlockedGroups, PlainGroups, Run, Total, skew_safe

c = F.col


def frame(spark, n=300, groups=3, seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(groups) if i % 3 else 0, i, rnd.choice([None, *range(6)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g long, o long, v long")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_running_values_and_totals_agree(spark):
    rows, df = frame(spark)
    runs = {"before": Run("sum", c("v")), "upto": Run("max", c("v"), "upto"), "prev": Run("adjacent", c("v")), "next": Run("adjacent", c("v"), "after"),
            "known": Run("last", c("v")), "left": Run("count", F.lit(1), "from"), "later": Run("last", c("v"), "after"), "low": Run("min", c("v"), "from")}
    totals = {"t": Total("sum", c("v")), "f": Total("first", c("v")), "l": Total("last", c("v"))}
    out = []
    for g in (PlainGroups(["g"], "o"), BlockedGroups(["g"], "o", 17)):
        d = g.number(g.totals(g.running(df, runs), totals), "no")
        out.append(table(d.select(*sorted(d.columns))))
    assert out[0] == out[1]
    mine = sorted(r for r in rows if r[0] == 0)
    want = {}
    acc = 0
    for g, o, v in mine:
        want[o] = acc
        acc += v or 0
    got = {r.o: r.before for r in BlockedGroups(["g"], "o", 17).running(df, runs).filter("g = 0").collect()}
    assert got == want


def test_skew_safe_splits_hot_groups(spark):
    _, df = frame(spark)

    def body(d, g):
        return a.split_exact(d, g, "x", c("v"), F.lit(1000))

    plain = table(skew_safe(df, ["g"], "o", body, mode="plain"))
    for mode in ("probe", "lazy"):
        assert table(skew_safe(df, ["g"], "o", body, hot_rows=80, block=19, mode=mode)) == plain
    sums = {}
    for g, _, _, x in plain:
        sums[g] = sums.get(g, 0) + x
    assert set(sums.values()) == {1000}


def test_sessionize_blocked_equals_plain(spark):
    rnd = random.Random(3)
    kinds = ["user_message_chunk", *s.CALL_KINDS, s.TURN, s.COMPACT]
    rows = [(i % 2, i, rnd.choice(kinds), rnd.choice([None, rnd.randrange(100, 900)]), rnd.choice([None, 1, 2, 3]), f"c{rnd.randrange(3)}", rnd.randrange(50))
            for i in range(160)]
    df = spark.createDataFrame(rows, "session_id long, line_no long, kind string, context_tokens long, stream_ms long, tool_call_id string, tokens_after long")
    cols = ["session_id", "line_no", "round_no", "call_no", "baseline", "cursor", "emit_delta", "tool_delta", "owner_no"]
    one = table(s.by_session(df, s.sessionized, mode="plain").select(*cols).fillna(-1))
    two = table(s.by_session(df, s.sessionized, mode="blocked", block=23).select(*cols).fillna(-1))
    assert one == two


@pytest.mark.parametrize("block,spread", [(1, 1 << 40), (9, 4), (30, 1), (10_000, 1 << 40)])
def test_take_largest(spark, monkeypatch, block, spread):
    """Selection gives what a sort gives: equal values, near-unique ones, values close together, weights of 0, targets beyond all."""
    monkeypatch.setattr(grouping, "BINS", 4)
    r = random.Random(spread)
    rows = [(g, o, r.randrange(spread) * r.choice([1e-12, 1.0]), r.choice([0, 1, 1, 5]), t) for g, t in enumerate([0, 1, 37, 90, 10_000]) for o in r.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "g long, o long, v double, w long, t long")
    want, left = {}, dict(enumerate([0, 1, 37, 90, 10_000]))
    for g, o, _, w, _ in sorted(rows, key=lambda x: (x[0], -x[2], x[1])):
        want[g, o] = min(w, left[g])
        left[g] -= want[g, o]
    for engine in (PlainGroups(["g"], "o"), BlockedGroups(["g"], "o", block)):
        d = engine.take_largest(df, "x", c("v"), c("w"), c("t") + 0 * c("n"), {"n": Total("count", c("v"))})
        assert sorted(d.columns) == sorted([*df.columns, "x", "n"])
        assert {(x.g, x.o): x.x for x in d.collect()} == want
