"""The stateful session stream, fed batch by batch, against both batch engines on the same lines."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sessionledger.operators import anomaly as an
from sessionledger.operators import sessionize as s
from sessionledger.operators.grouping import BlockedGroups, PlainGroups, Run
from sessionledger.streaming import rounds

c = F.col
SCHEMA = "session_id long, line_no long, kind string, context_tokens long, stream_ms long, agent_ms long, chars long, tokens_after long, tool_call_id string"


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Many(Value):
    def appendValue(self, v):
        self.v = [*(self.v or []), v]


class Table:
    def __init__(self):
        self.d = {}

    def updateValue(self, k, v):
        self.d[k] = v

    def getValue(self, k):
        return self.d[k]

    def containsKey(self, k):
        return k in self.d

    def clear(self):
        self.d.clear()


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *a):
        return Value()

    def getMapState(self, *a):
        return Table()

    def getListState(self, *a):
        return Many()

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def listTimers(self):
        return iter(list(self.timers))


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1_000


def lines(seed, n=260):
    r = random.Random(seed)
    kinds = [*s.CALL_KINDS, "user_message_chunk", s.TURN, s.TURN, s.COMPACT, s.COMPACT, s.RECAP]
    return [(session, i * 3, r.choice(kinds), r.choice([None, r.randrange(1, 900)]), r.choice([None, i // 7]), 1_000 + i * 10, r.randrange(50),
             r.choice([None, r.randrange(1, 1_200)]), r.choice([None, "a", "b", ""])) for session in (1, 2) for i in range(n)]


def streamed(rows, cuts, repeat=False):
    """All rows of the stream by kind and key, as they are after the last batch."""
    out = {"round": {}, "tool": {}, "card": {}}
    keys = {"round": ("round_no",), "tool": ("round_no", "call_no", "tool_no"), "card": ("line_no",)}
    for session in {r[0] for r in rows}:
        machine = rounds.Session()
        machine.init(Handle())
        own = [Row(**dict(zip(rounds.LINE, (r[0], r[1], r[2], *r[3:])))) for r in rows if r[0] == session]
        for a, b in zip([0, *cuts], [*cuts, len(own)]):
            batch = own[max(0, a - 5 * repeat):b]
            random.Random(a).shuffle(batch)
            for row in machine.handleInputRows((session,), iter(batch), Clock()):
                for what in out:
                    if row[what] is not None:
                        out[what][(session, *(row[what][k] for k in keys[what]))] = row[what].asDict()
    return out


def batch(df, g):
    def by_key(d, *keys):
        return {(r.session_id, *(r[k] for k in keys)): {k: v for k, v in r.asDict().items() if k != "session_id"} for r in d.collect()}

    d = s.cache_baselines(s.assign_calls(s.assign_rounds(df, g), g), g)
    done = s.idle_gaps(s.round_rollup(d), g.reorder("round_no"))
    tools = s.tool_rollup(s.sessionized(df, g))
    cards = an.attach_cards(df, g).select("session_id", *rounds.CARD)
    return {"round": by_key(done.select("session_id", *rounds.ROUND), "round_no"), "tool": by_key(tools.select("session_id", *rounds.TOOL), "round_no", "call_no", "tool_no"),
            "card": by_key(cards, "line_no")}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, seed):
    rows = lines(seed)
    df = spark.createDataFrame(rows, SCHEMA).cache()
    want = batch(df, PlainGroups(["session_id"], "line_no"))
    assert all(want.values()) and sum(x["mid_round"] for x in want["card"].values()) > 20
    for cuts in ([], [1, 90, 91, 200], list(range(10, 260, 10))):
        got = streamed(rows, cuts)
        for what in want:
            assert got[what] == want[what], (what, cuts)
    assert streamed(rows, [40, 41, 150], repeat=True) == streamed(rows, [])


def test_state_calls_do_not_grow_with_lines(monkeypatch):
    """A call of the state is a message to another process: their number follows sessions and batches, not lines."""
    calls = []
    for kind in (Value, Many, Table):
        for name in ("exists", "get", "update", "clear", "appendValue", "updateValue", "getValue", "containsKey"):
            if hasattr(kind, name):
                monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name): (calls.append(1), f(self, *a))[1])
    made = []
    for n in (260, 2_600):
        calls.clear()
        streamed(lines(4, n), [n // 2])
        made.append(len(calls))
    assert made[1] < 2 * made[0]


def test_blocked_engine_agrees(spark):
    """Blocks of a few lines: compactions inside rounds fall before, on and behind their edges."""
    df = spark.createDataFrame(lines(3, 120), SCHEMA).cache()
    assert batch(df, BlockedGroups(["session_id"], "line_no", 50)) == batch(df, PlainGroups(["session_id"], "line_no"))


@pytest.mark.parametrize("block,side", [(1, "upto"), (7, "before"), (40, "upto"), (1_000, "before")])
def test_running_value_with_resets(spark, block, side):
    r = random.Random(block)
    rows = [(k, i, r.choice([None, r.randrange(100)]), r.random() < 0.08) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, o long, v long, cut boolean")
    runs = {"x": Run("max", c("v"), side, reset=c("cut")), "n": Run("count", c("v"))}
    want = {}
    for k in range(3):
        best = None
        for key, o, v, cut in rows:
            if key == k:
                best = None if cut else best
                before, best = best, max((x for x in (best, v) if x is not None), default=None)
                want[k, o] = before if side == "before" else best
    for g in (PlainGroups(["k"], "o"), BlockedGroups(["k"], "o", block)):
        d = g.running(df, runs)
        assert sorted(d.columns) == sorted([*df.columns, "x", "n"])
        assert {(r.k, r.o): r.x for r in d.collect()} == want


def test_mid_round_compaction_by_hand(spark):
    """The close raises a round that was compacted inside to its peak; without a peak the compacted size counts."""
    rows = [(1, 1, "user_message_chunk", None, None, 1, 4, None, None), (1, 2, s.COMPACT, None, None, 2, 0, 70, None), (1, 3, s.TURN, None, None, 3, 0, None, None),
            (1, 4, "agent_thought_chunk", 50, 9, 4, 4, None, None), (1, 5, s.COMPACT, None, None, 5, 0, 20, None), (1, 6, "agent_message_chunk", None, 10, 6, 4, None, None),
            (1, 7, s.TURN, None, None, 7, 0, None, None), (1, 8, s.COMPACT, None, None, 8, 0, 30, None), (1, 9, "user_message_chunk", None, None, 9, 4, None, None),
            (1, 10, s.COMPACT, None, None, 10, 0, 25, None)]
    g = PlainGroups(["session_id"], "line_no")
    df = spark.createDataFrame(rows, SCHEMA)
    d = s.cache_baselines(s.assign_calls(s.assign_rounds(df, g), g), g)
    got = {r.round_no: (r.baseline, r.context_start, r.context_peak, r.context_end, r.context_delta) for r in s.round_rollup(d).collect()}
    assert got == {1: (None, None, None, 70, None), 2: (70, 70, 70, 70, -50), 3: (30, 30, 30, 25, -5)}
    starts = {r.line_no: r.call_start for r in s.context_cursor(d, g).collect()}
    assert starts == {4: 50, 6: 20}


def test_idle_sessions_leave(spark):
    machine = rounds.Session(idle_ms=500)
    handle = Handle()
    machine.init(handle)
    line = Row(**dict(zip(rounds.LINE, (1, 1, "tool_call", 5, 1, 1, 1, None, "a"))))
    list(machine.handleInputRows((1,), iter([line]), Clock()))
    list(machine.handleInputRows((1,), iter([line]), Clock()))
    assert handle.timers == [1_500] and machine.open.exists() and machine.tools.d
    assert list(machine.handleExpiredTimer((1,), Clock(), None)) == []
    assert not machine.open.exists() and not machine.tools.d
