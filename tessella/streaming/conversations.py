"""Sessions as keyed state of a stream: a sticky anchor, what was asked last, a bounded history, expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..settings import SETTINGS
from .events import run_to_table

#: What a turn does to its session. A message only adds to the history.
ACTIONS = ("set", "clear", "reset", "message")
TURNS = "session string, seq long, ts timestamp, action string, value string, kind string, role string, text string"
OUT = "session string, seq long, opened long, anchor string, last_kind string, history int, newest string"
STATE = "opened long, anchor string, last_kind string, seen long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """One row for each turn: the session's state after it.

    A value state has when the session was opened, its anchor, the last kind asked for and when it was last seen; a list
    state the last turns of its history. A timer at the end of the time to live drops both; a turn that comes later than
    that, before the timer has fired, opens the session anew as well. set puts an anchor (a blank one changes nothing),
    clear takes it away, reset forgets everything. A kind is inherited by turns without one. Turns of a session are taken
    by time, then by seq, within a batch.
    """

    def __init__(self, ttl_seconds: int, turns: int):
        self.ttl, self.turns = ttl_seconds * 1000, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)
        self.history = handle.getListState("history", "role string, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        opened, anchor, kind, seen = known if known is not None else (None, "", "", None)
        past = [tuple(h) for h in self.history.get()] if known is not None else []
        for r in sorted(rows, key=lambda r: (r.us, r.seq)):
            now = r.ms
            if seen is None or now - seen > self.ttl or r.action == "reset":
                opened, anchor, kind, past = r.seq, "", "", []
            seen = now
            if r.action == "clear":
                anchor = ""
            elif r.action == "set" and (r.value or "").strip():
                anchor = r.value.strip()
            kind = r.kind or kind
            if r.action == "message" and (r.text or "").strip():
                past = [*past, (r.role, r.text.strip())][-self.turns :]
            yield Row(session=key[0], seq=r.seq, opened=opened, anchor=anchor, last_kind=kind, history=len(past), newest=past[-1][1] if past else "")
        self.state.update((opened, anchor, kind, seen))
        self.history.put(past) if past else self.history.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(seen + self.ttl + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        self.history.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_turns(turns: DataFrame, *, ttl_seconds: int | None = None, history: int | None = None, delay: str = "1 hour") -> DataFrame:
    """The state after every turn of a stream of turns (see TURNS); a blank session is private to its turn.

    The state store has to be RocksDB (PROVIDER). Turns behind the watermark are dropped by the timers of their session
    alone: the operator itself takes late turns of a session that is still open.
    """
    ttl = 3600 * SETTINGS.session_ttl_hours if ttl_seconds is None else ttl_seconds
    name = F.when(F.trim(F.coalesce("session", F.lit(""))) == "", F.concat(F.lit("anon-"), F.col("seq").cast("string"))).otherwise(F.trim("session"))
    times = {"us": F.unix_micros("ts"), "ms": F.unix_millis("ts")}
    keyed = turns.withColumn("session", name).withColumns(times).withWatermark("ts", delay).groupBy("session")
    return keyed.transformWithState(Sessions(ttl, SETTINGS.history_turns if history is None else history), OUT, "Append", "EventTime")


def run_sessions(stream: DataFrame, name: str = "sessions") -> DataFrame:
    """Run session_turns() over what is there now, its state in RocksDB, and read its rows."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, PROVIDER)
    try:
        return run_to_table(stream, name)
    finally:
        conf.set(key, before) if before else conf.unset(key)
