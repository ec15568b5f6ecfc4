"""Keyed state with expiry: transformWithState processors over rows in the order of their times.

`InOrder` keeps the rows of a key in list state until the watermark has passed them, then hands them on by time (ties: as they
compare), so results don't depend on how rows fall into batches as long as none is later than the watermark's delay. Timers
wake a key when its next row or its expiry is due. State of a key without rows or expiry is empty. Rows come with columns
key, ts and the processor's own; a row later than the watermark is dropped by Spark, one without a time goes nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state needs this store; queries that start inside get it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def micros(ts) -> int:
    """Whole microseconds since 1970, as state keeps times."""
    return pd.Timestamp(ts).value // 1000


def when(at: int) -> datetime:
    """The time behind microseconds; naive, in UTC as sessions run."""
    return datetime(1970, 1, 1, tzinfo=UTC).replace(tzinfo=None) + timedelta(microseconds=at)


class Value:
    """A value state that is read at most once a call and written at its end, as each use of the state itself is a round trip."""

    def __init__(self, state):
        self.state = state

    def begin(self) -> None:
        self.known = self.changed = False

    def get(self) -> tuple | None:
        if not self.known:
            self.now, self.known = self.state.get(), True
        return self.now

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, now: tuple | None) -> None:
        self.now, self.known, self.changed = now, True, True

    def clear(self) -> None:
        self.update(None)

    def end(self) -> None:
        if self.changed:
            self.state.clear() if self.now is None else self.state.update(self.now)


class Values:
    """The same for a list state."""

    def __init__(self, state):
        self.state = state

    def begin(self) -> None:
        self.replaced, self.new = False, []

    def get(self) -> list[tuple]:
        return [*([] if self.replaced else self.state.get()), *self.new]

    def appendValue(self, value: tuple) -> None:
        self.new.append(value)

    def put(self, values: list[tuple]) -> None:
        self.replaced, self.new = True, list(values)

    def clear(self) -> None:
        self.put([])

    def end(self) -> None:
        if self.new:
            (self.state.put if self.replaced else self.state.appendList)(self.new)
        elif self.replaced:
            self.state.clear()


class InOrder(StatefulProcessor):
    """What is common: `row` sees a key's rows in order, `expired` is called when the time that `due` names has passed."""

    #: Columns of a row beside key and ts, and their kinds; columns of the results.
    columns: tuple[str, ...] = ()
    kinds: str = ""
    output: tuple[str, ...] = ()

    def init(self, handle) -> None:
        self.handle, self.own = handle, []
        self.pending = handle.getListState("pending", f"ts long, {self.kinds}")
        self.open()

    def value(self, name: str, kinds: str) -> Value:
        self.own.append(Value(self.handle.getValueState(name, kinds)))
        return self.own[-1]

    def values(self, name: str, kinds: str) -> Values:
        self.own.append(Values(self.handle.getListState(name, kinds)))
        return self.own[-1]

    def open(self) -> None:
        """Asks for the processor's own state."""

    def row(self, ts: int, values: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        """When the key's state expires."""
        raise NotImplementedError

    def expired(self, at: int) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for some in rows:
            some = some[some["ts"].notna()]
            for ts, *values in zip(some["ts"], *(some[c] for c in self.columns), strict=True):
                fresh.append((micros(ts), *(None if pd.isna(v) else v for v in values)))
        return self._advance(key, timerValues, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues)

    def _advance(self, key, timers, fresh=()) -> Iterator[pd.DataFrame]:
        now, out = timers.getCurrentWatermarkInMs() * 1000, []
        for state in self.own:
            state.begin()
        held = sorted([*(tuple(r) for r in self.pending.get()), *fresh], key=lambda r: (r[0], tuple(map(str, r[1:]))))
        ready = [r for r in held if r[0] <= now]
        if not ready and fresh:
            self.pending.appendList(fresh)
        if ready:
            self.pending.put(held[len(ready) :]) if len(ready) < len(held) else self.pending.clear()
        for ts, *values in ready:
            while (at := self.due()) is not None and at <= ts:
                out += self.expired(at)
            out += self.row(ts, tuple(values))
        while (at := self.due()) is not None and at <= now:
            out += self.expired(at)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        waits = [x for x in (self.due(), held[len(ready)][0] if len(ready) < len(held) else None) if x is not None]
        if waits:
            self.handle.registerTimer(-(-min(waits) // 1000))
        for state in self.own:
            state.end()
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=["key", *self.output])

    def close(self) -> None:
        pass


class Presence(InOrder):
    """The last value of a key, kept for a time to live after it was set. A row for each stretch of presence when it ends."""

    columns, kinds = ("value",), "value string"
    output = ("since", "last", "expires", "sets", "value")

    def __init__(self, ttl: timedelta):
        self.ttl = int(ttl.total_seconds() * 1_000_000)

    def open(self) -> None:
        self.held = self.value("held", "since long, last long, sets long, value string")

    def due(self) -> int | None:
        return self.held.get()[1] + self.ttl if self.held.exists() else None

    def row(self, ts: int, values: tuple) -> Iterator[tuple]:
        since, sets = (lambda h: (h[0], h[2]))(self.held.get()) if self.held.exists() else (ts, 0)
        self.held.update((since, ts, sets + 1, values[0]))
        return iter(())

    def expired(self, at: int) -> Iterator[tuple]:
        since, last, sets, value = self.held.get()
        self.held.clear()
        yield when(since), when(last), when(at), sets, value


class Conversation(InOrder):
    """A conversation ends when no turn has come for a time to live; its turns, kept in list state, come out as one row."""

    columns, kinds = ("turn", "role", "text"), "turn long, role string, text string"
    output = ("ended", "turns", "first_role", "last_role", "chars")

    def __init__(self, ttl: timedelta):
        self.ttl = int(ttl.total_seconds() * 1_000_000)

    def open(self) -> None:
        self.turns = self.values("turns", f"ts long, {self.kinds}")
        self.last = self.value("last", "at long")

    def due(self) -> int | None:
        return self.last.get()[0] + self.ttl if self.last.exists() else None

    def row(self, ts: int, values: tuple) -> Iterator[tuple]:
        self.turns.appendValue((ts, *values))
        self.last.update((ts,))
        return iter(())

    def expired(self, at: int) -> Iterator[tuple]:
        turns = sorted((tuple(t) for t in self.turns.get()), key=lambda t: (t[0], t[1] or 0))
        self.turns.clear()
        self.last.clear()
        yield when(at), len(turns), turns[0][2], turns[-1][2], sum(len(t[3] or "") for t in turns)


class Escalation(InOrder):
    """`least` alerts of a key within a window escalate it; for `hold` it stays escalated and takes further alerts in, then
    the state expires and a row tells of it. Alerts that led to an escalation, or were taken in, don't count again."""

    columns, kinds = ("alert",), "alert string"
    output = ("escalated_at", "deescalate_at", "taken_in")

    def __init__(self, least: int, window: timedelta, hold: timedelta):
        self.least, self.window, self.hold = least, int(window.total_seconds() * 1_000_000), int(hold.total_seconds() * 1_000_000)

    def open(self) -> None:
        self.recent = self.values("recent", "ts long")
        self.now = self.value("now", "at long, taken long")

    def due(self) -> int | None:
        return self.now.get()[0] + self.hold if self.now.exists() else None

    def row(self, ts: int, values: tuple) -> Iterator[tuple]:
        if self.now.exists():
            at, taken = self.now.get()
            self.now.update((at, taken + 1))
            return iter(())
        kept = [r[0] for r in self.recent.get() if r[0] >= ts - self.window] + [ts]
        if len(kept) >= self.least:
            self.recent.clear()
            self.now.update((ts, 0))
        else:
            self.recent.put([(x,) for x in kept])
        return iter(())

    def expired(self, at: int) -> Iterator[tuple]:
        started, taken = self.now.get()
        self.now.clear()
        yield when(started), when(at), taken


def _run(rows: DataFrame, processor: InOrder, delay: str, kinds: str) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {kinds}", "Append", "EventTime")


def presence(rows: DataFrame, key: str, value: str, ts: str, ttl: timedelta, delay: str) -> DataFrame:
    """(key, since, last, expires, sets, value) of each stretch in which a key's value was alive."""
    own = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("string").alias("value"))
    return _run(own, Presence(ttl), delay, "since timestamp, last timestamp, expires timestamp, sets long, value string")


def conversation_ends(rows: DataFrame, key: str, turn: str, role: str, text: str, ts: str, ttl: timedelta, delay: str) -> DataFrame:
    """(key, ended, turns, first_role, last_role, chars) of each conversation that has come to rest."""
    own = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return _run(own, Conversation(ttl), delay, "ended timestamp, turns long, first_role string, last_role string, chars long")


def escalations(rows: DataFrame, key: str, alert: str, ts: str, least: int, window: timedelta, hold: timedelta, delay: str) -> DataFrame:
    """(key, escalated_at, deescalate_at, taken_in) of each escalation that has expired."""
    own = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(alert).cast("string").alias("alert"))
    return _run(own, Escalation(least, window, hold), delay, "escalated_at timestamp, deescalate_at timestamp, taken_in long")
