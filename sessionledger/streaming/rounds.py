"""Rounds, tools and side events of sessions that are still being written, equal to the batch operators on the same lines.

One stateful operator per session. Its state: a value for the open round and call (counters and sizes, never texts), a
map of the tools of the open call, a map from tool ids to them, and a list of side events that wait for a next round. A line moves the
state as in ``sessionize`` and ``anomaly.attach_cards``: a compaction between two rounds resets the baseline, one inside
a round moves the round's context, a turn closes the round and hands its end on.

A micro-batch holds a session's next lines, in any order; how many is bounded by the trigger (``maxFilesPerTrigger`` or
``maxBytesPerTrigger``). Lines must reach the stream in order of ``line_no`` from batch to batch. A line that was seen already, or comes behind
a later one, is dropped, so repeated delivery changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionledger.operators.sessionize import CALL_KINDS, COMPACT, RECAP, ROUND_KINDS, STREAM_KINDS, TOOL_KINDS, TURN

c = F.col
LINE = ["session_id", "line_no", "kind", "context_tokens", "stream_ms", "agent_ms", "chars", "tokens_after", "tool_call_id"]

ROUND = {
    "round_no": "long", "line_no": "long", "started_ms": "long", "completed_ms": "long", "baseline": "long", "user_chars": "long", "chunks": "long", "tool_calls": "long",
    "call_count": "long", "completed": "boolean", "context_start": "long", "context_peak": "long", "context_delta": "long", "context_end": "long", "idle_gap_ms": "long"}
TOOL = {"round_no": "long", "call_no": "long", "tool_no": "long", "line_no": "long", "tool_call_id": "string", "tool_delta": "long", "updates": "long"}
CARD = {"line_no": "long", "kind": "string", "mid_round": "boolean", "after_round": "long", "before_round": "long", "in_round": "long"}

# The open round, then the open call.
STATE = {
    "last_line": "long", "round_no": "long", "known": "long", "prev_end_ms": "long", "active": "boolean", "line_no": "long", "started_ms": "long", "baseline": "long", "user_chars": "long",
    "chunks": "long", "tool_calls": "long", "call_count": "long", "stream_ms": "long", "first_ctx": "long", "max_ctx": "long", "moved": "long",
    "call_start": "long", "call_max": "long", "tools": "long", "declared": "long", "tool_phase": "boolean", "phase_max": "long"}
NEW_ROUND = {
    "active": False, "line_no": None, "started_ms": None, "baseline": None, "user_chars": 0, "chunks": 0, "tool_calls": 0, "call_count": 0, "stream_ms": None, "first_ctx": None,
    "max_ctx": None, "moved": None, "call_start": None, "call_max": None, "tools": 0, "declared": 0, "tool_phase": False, "phase_max": None}
NEW_CALL = {"call_max": None, "tools": 0, "declared": 0, "tool_phase": False, "phase_max": None}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


ROWS = ", ".join(["session_id long", *(f"{name} struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>" for name, fields in (("round", ROUND), ("tool", TOOL), ("card", CARD)))])


def _most(*values: int | None) -> int | None:
    return max((v for v in values if v is not None), default=None)


def _first(*values: int | None) -> int | None:
    return next((v for v in values if v is not None), None)


class Session(StatefulProcessor):
    """Lines of one session in, changed rounds, tools and side events out."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _ddl(STATE))
        self.tools = handle.getMapState("tools", "tool_no long", _ddl(TOOL))
        self.by_id = handle.getMapState("by_id", "tool_call_id string", "tool_no long")
        self.waiting = handle.getListState("waiting", _ddl(CARD))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        st = dict(zip(STATE, self.open.get())) if self.open.exists() else {"last_line": None, "round_no": 1, "known": None, "prev_end_ms": None, **NEW_ROUND}
        out = Changes(key[0], self)
        self.held = Held(self, st["declared"] > 0)
        for line in sorted(rows, key=lambda r: r["line_no"]):
            if st["last_line"] is None or line["line_no"] > st["last_line"]:
                st["last_line"] = line["line_no"]
                yield from self.step(st, line, out)
        if st["active"]:
            out.rounds[st["round_no"]] = self.round(st, None)
        yield from out.closed()
        yield from out.side_events()
        self.held.write()
        self.open.update(tuple(st[f] for f in STATE))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """An idle session leaves the state."""
        for state in (self.open, self.tools, self.by_id, self.waiting):
            state.clear()
        yield from ()

    def round(self, st: dict, completed_ms: int | None) -> Row:
        start = _first(st["baseline"], st["first_ctx"])
        peak = _most(start, st["max_ctx"])
        at = _first(st["moved"], start)
        gap = max(0, st["started_ms"] - st["prev_end_ms"]) if st["started_ms"] is not None and st["prev_end_ms"] is not None else 0
        ended = completed_ms is not None
        return Row(**{n: st.get(n) for n in ROUND} | {
            "completed_ms": completed_ms, "completed": ended, "context_start": start, "context_peak": peak, "context_delta": None if start is None else at - start,
            "context_end": _most(peak, st["moved"]) if ended else at, "idle_gap_ms": gap})

    def step(self, st: dict, line: Row, out: Changes) -> Iterator[Row]:
        kind, ctx = line["kind"], line["context_tokens"]
        if kind in (COMPACT, RECAP):
            no = st["round_no"]
            card = {"line_no": line["line_no"], "kind": kind, "mid_round": st["active"], "after_round": no - 1 if no > 1 else None, "before_round": None, "in_round": no if st["active"] else None}
            out.cards[card["line_no"]] = card
            if not st["active"]:
                self.held.wait(tuple(card[n] for n in CARD))
            if kind == COMPACT:
                if not st["active"]:
                    st["known"] = line["tokens_after"]
                elif line["tokens_after"] is not None:
                    st["moved"] = line["tokens_after"]
            return
        if kind not in ROUND_KINDS:
            return
        if not st["active"]:
            st.update(active=True, line_no=line["line_no"], started_ms=line["agent_ms"], baseline=st["known"])
            # the side events before this round know it now
            out.cards.update({x[0]: dict(zip(CARD, x)) | {"before_round": st["round_no"]} for x in self.held.waited()})
        if kind == "user_message_chunk":
            st["user_chars"] += line["chars"] or 0
        elif kind in CALL_KINDS:
            self.call_line(st, line, ctx, out)
        elif kind == TURN:
            st["known"] = _most(st["known"], st["moved"])
            out.rounds[st["round_no"]] = self.round(st, line["agent_ms"])
            st.update(round_no=st["round_no"] + 1, prev_end_ms=line["agent_ms"], **NEW_ROUND)
            self.held.forget()
            if len(out) > 1_000:  # closed rounds and their tools leave at once
                yield from out.closed()

    def call_line(self, st: dict, line: Row, ctx: int | None, out: Changes) -> None:
        kind, stream = line["kind"], line["stream_ms"]
        if not st["call_count"] or (stream is not None and stream != st["stream_ms"]):
            st.update(call_count=st["call_count"] + 1, call_start=_first(ctx, st["moved"], st["baseline"]), **NEW_CALL)
            self.held.forget()
        st["chunks"] += kind in STREAM_KINDS
        st["tool_calls"] += kind == "tool_call"
        phase = False
        if kind in TOOL_KINDS:
            declares = kind == "tool_call" or not st["tools"]
            cursor = st["phase_max"] if st["tool_phase"] else _most(st["call_start"], st["call_max"])
            grown = max(0, ctx - cursor) if ctx is not None and cursor is not None else 0
            phase = declares and ctx is not None and not st["tool_phase"]
            st["tools"] += 1
            self.tool_line(st, line, declares, grown, out)
        if ctx is not None:
            st["phase_max"] = _most(st["phase_max"], ctx) if st["tool_phase"] or phase else None
            st["call_max"], st["max_ctx"] = _most(st["call_max"], ctx), _most(st["max_ctx"], ctx)
            st["first_ctx"] = _first(st["first_ctx"], ctx)
            st["moved"], st["known"] = ctx, _most(st["known"], ctx)
        st["tool_phase"] = st["tool_phase"] or phase
        if stream is not None:
            st["stream_ms"] = stream

    def tool_line(self, st: dict, line: Row, declares: bool, grown: int, out: Changes) -> None:
        name = line["tool_call_id"]
        if declares:
            st["declared"] += 1
            own = st["declared"]
            tool = (st["round_no"], st["call_count"], own, line["line_no"], name, 0, 0)
            if name is not None:
                self.held.by_id[name] = own
        else:
            own = self.held.number(name) or st["declared"]
            tool = self.held.tool(own)
            tool = (*tool[:5], tool[5] + grown, tool[6] + 1)
        self.held.tools[own] = tool
        out.tools[tool[:3]] = tool


class Held:
    """What a micro-batch has seen of a session's maps and list. The state is asked for what an earlier batch left, and written
    once at the end: a call of it costs more than a line, so their number must not grow with the lines."""

    def __init__(self, owner: Session, stored: bool):
        self.owner, self.stored = owner, stored  # whether the maps hold tools of the open call
        self.tools: dict[int, tuple] = {}
        self.by_id: dict[str, int] = {}
        self.waiting: list[tuple] = []
        self.asked = False  # whether the list was emptied by this batch

    def number(self, name: str | None) -> int | None:
        if name is not None and name not in self.by_id and self.stored and self.owner.by_id.containsKey((name,)):
            self.by_id[name] = self.owner.by_id.getValue((name,))[0]
        return self.by_id.get(name)

    def tool(self, own: int) -> tuple:
        return self.tools[own] if own in self.tools else self.owner.tools.getValue((own,))

    def forget(self) -> None:
        if self.stored:
            self.owner.tools.clear()
            self.owner.by_id.clear()
            self.stored = False
        self.tools.clear()
        self.by_id.clear()

    def wait(self, card: tuple) -> None:
        self.waiting.append(card)

    def waited(self) -> list[tuple]:
        before: list[tuple] = []
        if not self.asked:
            self.asked = True
            if self.owner.waiting.exists():
                before = [tuple(x) for x in self.owner.waiting.get()]
                self.owner.waiting.clear()
        now, self.waiting = before + self.waiting, []
        return now

    def write(self) -> None:
        for own, tool in self.tools.items():
            self.owner.tools.updateValue((own,), tool)
        for name, own in self.by_id.items():
            self.owner.by_id.updateValue((name,), (own,))
        for card in self.waiting:
            self.owner.waiting.appendValue(card)


class Changes:
    """What a micro-batch changed of one session; each row leaves once, as it is at last."""

    def __init__(self, session_id: int, owner: Session):
        self.session_id, self.owner = session_id, owner
        self.rounds: dict[int, Row] = {}
        self.tools: dict[tuple, tuple] = {}
        self.cards: dict[int, dict] = {}

    def __len__(self) -> int:
        return len(self.rounds) + len(self.tools)

    def closed(self) -> Iterator[Row]:
        for r in self.rounds.values():
            yield Row(session_id=self.session_id, round=r, tool=None, card=None)
        for t in self.tools.values():
            yield Row(session_id=self.session_id, round=None, tool=Row(**dict(zip(TOOL, t))), card=None)
        self.rounds.clear()
        self.tools.clear()

    def side_events(self) -> Iterator[Row]:
        for x in self.cards.values():
            yield Row(session_id=self.session_id, round=None, tool=None, card=Row(**x))


def session_stream(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``session_id`` with one of ``round, tool, card``: every changed row, in update mode.

    Needs the RocksDB state store (:func:`with_rocks`). With ``idle_ms`` sessions without a line for so long leave the
    state, for queries that run on; a query that drains what is there needs none.
    """
    return lines.select(*LINE).groupBy("session_id").transformWithState(Session(idle_ms), ROWS, "update", "processingTime" if idle_ms else "none")


def part(rows: DataFrame, name: str) -> DataFrame:
    """The rounds, tools or side events (``round``, ``tool``, ``card``) of :func:`session_stream`."""
    return rows.filter(c(name).isNotNull()).select("session_id", f"{name}.*")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark) -> None:
    """State of several variables is kept in RocksDB, beside the heap, and copied to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
