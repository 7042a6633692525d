"""State that streams carry from batch to batch: transcript headers, cards of sessions, injections.

Each rule is a plain function from a state and one event to effects, which knows nothing of
streams; a processor keeps the state of its key in Spark's state store, so that a restart
goes on from the checkpoint. The state store has to be RocksDB's
(``spark.sql.streaming.stateStore.providerClass``); ``batch`` applies a rule to a table.
Events of a key are taken in the order of (at, seq) within a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Open cards and pending prompts of a session; sessions of an owner; injections of a session.
MAX_OPEN, MAX_PENDING, MAX_SESSIONS, MAX_INJECTIONS = 3, 20, 1000, 4
#: Prompts recorded into a card that isn't saved meanwhile, after which a reminder is due.
STALE_AFTER = 8


# -- transcript headers

HEADER = "session string, cwd string, side boolean"


class Headers(StatefulProcessor):
    """The last header of each file, for the lines after it in whatever batch they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.header = handle.getValueState("header", HEADER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("offset", kind="stable")  # the stretches of one file in one batch
        held = tuple(self.header.get()) if self.header.exists() else None
        before = held
        out = []
        for offset, value, known, session, cwd, side in lines[["offset", "value", "known", "session", "cwd", "side"]].itertuples(index=False, name=None):
            if known and (offset >= 0 or held is None):
                # a header read again from the file's beginning tells nothing new to a file whose header is known
                held = (session, cwd, bool(side))
            out.append((key[0], offset, value, held is not None, *(held or (None, None, None))))
        if held != before:
            self.header.update(held)
        yield pd.DataFrame(out, columns=["path", "offset", "value", "known", "session", "cwd", "side"])

    def close(self) -> None:
        pass


def carry_headers(lines: DataFrame) -> DataFrame:
    """(path, offset, value, known, session, cwd, side) of a stream of lines, with the header that each line's own file last had, in this batch or an earlier one."""
    schema = f"path string, offset long, value string, known boolean, {HEADER}"
    return lines.groupBy("path").transformWithStateInPandas(Headers(), schema, "append", "none")


# -- cards of sessions


@dataclass
class Session:
    """What one session has open and what it said before it opened anything."""

    open: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)
    listed: bool = False
    quiet: int = 0
    stale_noted: bool = False

    def opened(self, title: str) -> None:
        """The newest open card; the oldest goes where there are too many."""
        self.open = [t for t in self.open if t != title][-(MAX_OPEN - 1) :] + [title]
        self.listed, self.quiet, self.stale_noted = True, 0, False


SESSION = "open array<string>, pending array<string>, listed boolean, quiet int, stale_noted boolean"
EFFECT = "at timestamp, seq long, effect string, title string, messages array<string>"


def card_event(s: Session, kind: str, title: str | None, message: str | None) -> list[tuple[str, str | None, list[str]]]:
    """The effects (effect, title, messages) of one event: record (messages go into a card's log), list (cards are to be shown), stale (a reminder is due), missing (a close of what isn't open)."""
    title, message = (title or "").strip(), (message or "").strip()
    if kind == "prompt":
        if not message or message.startswith("/"):
            return []
        if not s.open:
            s.pending = (s.pending + [message])[-MAX_PENDING:]
            first, s.listed = not s.listed, True
            return [("list", None, [message])] if first else []
        s.listed = True
        s.quiet += 1
        stale = s.quiet >= STALE_AFTER and not s.stale_noted
        s.stale_noted |= stale
        return [("record", s.open[-1], [message]), *([("stale", s.open[-1], [])] if stale else [])]
    if kind == "get":
        # the request that picked the task up; earlier ones may be other work
        last, s.pending = s.pending[-1:], []
        s.opened(title)
        return [("record", title, last)] if last else []
    if kind == "save":
        held, s.pending = s.pending, []
        s.opened(title)
        return [("record", title, held)] if held else []
    if kind in ("done", "close"):
        missing = kind == "close" and title not in s.open
        s.open = [t for t in s.open if t != title]
        if kind == "close":
            s.pending = []
        return [("missing", title, [])] if missing else []
    if kind == "clear":
        s.open, s.pending, s.listed, s.quiet, s.stale_noted = [], [], False, 0, False
    return []


class CardSessions(StatefulProcessor):
    """The sessions of each owner; beyond the limit, the one that was used longest ago goes, and with a time to live idle ones do."""

    def __init__(self, ttl_ms: int | None = None, most: int = MAX_SESSIONS) -> None:
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session string", SESSION, self.ttl_ms)
        self.used = handle.getMapState("used", "session string", "turn long", self.ttl_ms)
        self.turn = handle.getValueState("turn", "turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        turn = self.turn.get()[0] if self.turn.exists() else 0
        touched: dict[str, Session] = {}
        used = {k[0]: v[0] for k, v in self.used.iterator()} if self.used.exists() else {}  # ``most`` sessions at most
        out = []
        for at, seq, session, kind, title, message in events[["at", "seq", "session", "kind", "title", "message"]].itertuples(index=False, name=None):
            if session not in used and len(used) >= self.most:
                oldest = min(used, key=used.get)
                del used[oldest]
                touched.pop(oldest, None)
                for state in (self.sessions, self.used):
                    if state.containsKey((oldest,)):
                        state.removeKey((oldest,))
            if session not in touched:
                held = self.sessions.getValue((session,)) if session in used and self.sessions.containsKey((session,)) else None
                touched[session] = Session(list(held[0]), list(held[1]), *held[2:]) if held else Session()
            turn += 1
            used[session] = turn
            out += [(key[0], session, at, seq, effect, name, said) for effect, name, said in card_event(touched[session], kind, title, message)]
        for session, state in touched.items():
            self.sessions.updateValue((session,), tuple(asdict(state).values()))
            self.used.updateValue((session,), (used[session],))
        self.turn.update((turn,))
        yield pd.DataFrame(out, columns=["owner", "session", "at", "seq", "effect", "title", "messages"])

    def close(self) -> None:
        pass


def card_effects(events: DataFrame, ttl_ms: int | None = None, most: int = MAX_SESSIONS) -> DataFrame:
    """(owner, session, at, seq, effect, title, messages) of a stream of events (owner, session, at, seq, kind, title, message)."""
    mode = "processingTime" if ttl_ms else "none"
    return events.groupBy("owner").transformWithStateInPandas(CardSessions(ttl_ms, most), f"owner string, session string, {EFFECT}", "append", mode)


# -- injections


@dataclass
class Injections:
    """A session's last query, and how often something was injected."""

    last: str | None = None
    made: int = 0


def injection_event(s: Injections, kind: str, query: str | None, found: bool) -> bool:
    """Whether something is injected at this event: not for the query just asked, not beyond the limit, and only where something was found. A start forgets all."""
    if kind == "start":
        s.last, s.made = None, 0
        return False
    if not query or query == s.last:
        return False
    s.last = query
    if s.made >= MAX_INJECTIONS or not found:
        return False
    s.made += 1
    return True


class InjectionSessions(StatefulProcessor):
    """The injections of each session; a session without events for the given time is forgotten by a timer."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "name string", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        get = lambda name: self.state.getValue((name,))[0] if self.state.containsKey((name,)) else None
        held = Injections(get("last"), int(get("made") or 0))
        columns = events[["at", "seq", "kind", "query", "found"]].itertuples(index=False, name=None)
        out = [(key[0], at, seq, query) for at, seq, kind, query, found in columns if injection_event(held, kind, query, bool(found))]
        self.state.updateValue(("last",), (held.last,))
        self.state.updateValue(("made",), (str(held.made),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(events["at"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session", "at", "seq", "query"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["session", "at", "seq", "query"])

    def close(self) -> None:
        pass


def injections(prompts: DataFrame, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """(session, at, seq, query) of the prompts at which something is injected, of a stream (session, at, seq, kind, query, found); events later than ``late`` are dropped."""
    return prompts.withWatermark("at", late).groupBy("session").transformWithStateInPandas(InjectionSessions(idle_ms), "session string, at timestamp, seq long, query string", "append", "eventTime")


# -- tables


def batch(events: DataFrame, key: str, start: Callable[[], Any], rule: Callable[[Any, dict], list[tuple]], schema: str) -> DataFrame:
    """A rule over a table of events, each key's in the order of (at, seq): key and effects. ``rule`` gets the state and one event."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by key: a state is held for one key at a time, however many events it has
        now, state = None, None
        for part in rows:
            out = []
            for event in part.to_dict("records"):
                if state is None or event[key] != now:
                    now, state = event[key], start()
                out += [(now, *effect) for effect in rule(state, event)]
            yield pd.DataFrame(out, columns=names)

    return events.repartition(key).sortWithinPartitions(key, "at", "seq").mapInPandas(run, schema)
