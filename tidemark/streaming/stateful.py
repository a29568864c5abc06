"""Streams with keyed state: rows wait until the watermark has passed them and are answered in order.

Rows may arrive out of order.  Each row of a key waits in list state; a timer at the latest time of a batch
fires when the watermark is beyond it, and then all rows before that time are put in order of (time, id) and
answered, so answers are those of the sorted log.  Rows that arrive when the
watermark has passed them already are dropped before they reach any state, as in windowed
counts, and Spark tells their number (numRowsDroppedByWatermark).  Rows after the
last watermark are answered when a later row moves it.

The waiting rows of a batch are packed into one row of state.  Keys are dealt into buckets, so that a group has many rows for each call; state must be kept in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of people in each project or stretch of time.
BUCKETS = 16


class InOrder(StatefulProcessor):
    """Hands the rows of a key to answer() once no earlier row can come."""

    #: Columns that wait in state, and their types; `t` (microseconds) and `event_id` give the order.
    waiting = "t long, event_id long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = {n: np.dtype({"long": "int64", "boolean": "bool"}[k]) for n, k in (c.split() for c in self.waiting.split(", "))}
        self.wait = handle.getListState("waiting", packed_schema(self.kinds))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat([r[list(self.kinds)] for r in rows])
        self.wait.appendValue(packed(got, self.kinds))
        self.handle.registerTimer(int(got.t.max()) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = unpacked(self.wait.get(), self.kinds)
        due = rows.t < until * 1000
        rest = rows[~due]
        if due.any():
            if len(rest):
                self.wait.put([packed(rest, self.kinds)])
            else:
                self.wait.clear()
            out = self.answer(rows[due].sort_values(["t", "event_id"], ignore_index=True))
            if len(out):
                yield out
        self.forget(key, until if len(rest) else max(until, timerValues.getCurrentWatermarkInMs()))

    def answer(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self, key, until: int) -> None:
        """Drops what rows after `until` (milliseconds) can't ask for."""


def packed_schema(kinds: dict[str, np.dtype]) -> str:
    return ", ".join(f"{n} binary" for n in kinds)


def packed(rows: pd.DataFrame, kinds: dict[str, np.dtype]) -> tuple[bytes, ...]:
    """The columns of some rows as one row of state: a call for all of them instead of one for each."""
    return tuple(rows[n].to_numpy(k).tobytes() for n, k in kinds.items())


def unpacked(held: Iterator[tuple[bytes, ...]], kinds: dict[str, np.dtype]) -> pd.DataFrame:
    every = list(held)
    return pd.DataFrame({n: np.concatenate([np.empty(0, k), *[np.frombuffer(x[i], k) for x in every]]) for i, (n, k) in enumerate(kinds.items())})


#: A time before all times, and people from which on all state of a key is read at once.
NEVER, MANY = -(1 << 62), 64


class _Contributors(InOrder):
    """Of each person of a project: since when it is known there, and when it was last seen."""

    waiting = "t long, event_id long, person long, other long, is_comment boolean, merged boolean"

    def __init__(self, window: int | None) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.people = handle.getMapState("people", "person long", "seen long, known long")

    def held(self, who: np.ndarray) -> np.ndarray:
        """(seen, known) of people, in two rows."""
        if len(who) > MANY:
            told = {p[0]: tuple(was) for p, was in self.people.iterator()} if self.people.exists() else {}
        else:
            told = {p: tuple(self.people.getValue((p,))) for p in who.tolist() if self.people.containsKey((p,))}
        return np.array([told.get(p, (NEVER, NEVER)) for p in who.tolist()], np.int64).T

    def answer(self, rows: pd.DataFrame) -> pd.DataFrame:
        who, code = np.unique(rows.person.to_numpy(np.int64), return_inverse=True)
        rows = rows.iloc[np.argsort(code, kind="stable")]  # by person, in order
        code, t, own = np.sort(code), rows.t.to_numpy(np.int64), ~rows.is_comment.to_numpy(bool)
        first, last = np.searchsorted(code, np.arange(len(who))), np.searchsorted(code, np.arange(len(who)), "right") - 1
        was = self.held(who)

        def latest(mask: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The time of the latest row of the mask before each row, and of the last of each person."""
            at = np.maximum.accumulate(np.where(mask, np.arange(len(t)), -1))
            before = np.concatenate([[-1], at[:-1]])
            return np.where(before >= first[code], t[before], begin[code]), np.where(at[last] >= first, t[at[last]], begin)

        (seen, seen_now), (known, known_now) = latest(own, was[0]), latest(own & rows.merged.to_numpy(bool), was[1])
        since = NEVER + 1 if self.window is None else t - self.window + 1
        value = np.where(own, seen < since, (rows.person != rows.other).to_numpy(bool) & (known < since))
        now = np.array([seen_now, known_now])
        # without a window only whether there is a time matters, so a person is written at most twice
        changed = ((now > NEVER) & (was == NEVER) if self.window is None else now != was).any(0)
        for p, a, b in zip(who[changed].tolist(), seen_now[changed].tolist(), known_now[changed].tolist(), strict=True):
            self.people.updateValue((p,), (a, b))
        return pd.DataFrame({"event_id": rows.event_id.to_numpy(), "flag": np.where(own, "first_time", "external"), "value": value})

    def forget(self, key, until: int) -> None:
        if self.window is None:
            return
        seen = [(p, was[0]) for p, was in self.people.iterator()]
        over = until * 1000 - self.window
        for person, at in seen:
            if at <= over:
                self.people.removeKey(person)
        latest = max((at for _, at in seen if at > over), default=None)
        if latest is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer((latest + self.window) // 1000 + 1)


def contributor_flags(events: DataFrame, late: str, window: int | None = None) -> DataFrame:
    """(event_id, flag, value): whether the person's event is its first in the project, and whether the commenter is external.

    events has event_id, ts, project, person, commenter and merged.  A commenter is external that is not the
    person and has no earlier merged event in the project.  With a window (microseconds) only what lies
    within it before a row counts, and state is dropped when it is over; without one, a row of state stays for
    each person of a project.
    """
    seen = events.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    said = F.array(
        F.struct(F.col("person").alias("person"), F.col("commenter").alias("other"), F.lit(False).alias("is_comment")),
        F.struct(F.col("commenter").alias("person"), F.col("person").alias("other"), F.lit(True).alias("is_comment")),
    )
    rows = seen.select("ts", "t", "event_id", "project", "merged", F.explode(said).alias("x")).select("ts", "t", "event_id", "project", "merged", "x.*")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("person"), F.lit(BUCKETS)))
    return dealt.groupBy("project", "bucket").transformWithStateInPandas(_Contributors(window), "event_id long, flag string, value boolean", "Append", "EventTime")


class _EarlierCounts(InOrder):
    """The times of a stretch and of the one before, by person, until the stretch is over."""

    waiting = "t long, event_id long, person long, asked boolean"
    HELD = {"person": np.dtype("int64"), "t": np.dtype("int64")}

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", packed_schema(self.HELD))

    def answer(self, rows: pd.DataFrame) -> pd.DataFrame:
        # held times of a person come before those of rows, and each are in order
        every = pd.concat([unpacked(self.held.get(), self.HELD).assign(new=False), rows.assign(new=True)], ignore_index=True)
        who, code = np.unique(every.person.to_numpy(np.int64), return_inverse=True)
        every = every.iloc[np.lexsort((every.new, code))]
        code, t = np.sort(code), every.t.to_numpy(np.int64)
        # earlier by the window: times of all people on one line, each person's after all of those before
        low = int(t.min())
        line = (t - low) + code * (int(t.max()) - low + self.window + 1)
        n = np.arange(len(t)) - np.searchsorted(line, line - self.window, "right")
        told = every.new.to_numpy(bool) & (every.asked == True).to_numpy(bool)  # noqa: E712
        self.held.appendValue(packed(rows, self.HELD))
        return pd.DataFrame({"event_id": every.event_id.to_numpy()[told].astype(np.int64), "n": n[told]})

    def forget(self, key, until: int) -> None:
        over = (int(key[1]) + 1) * self.window // 1000 + 1
        if until >= over:
            self.held.clear()
        else:
            self.handle.registerTimer(over)


def earlier_counts(events: DataFrame, window: int, late: str) -> DataFrame:
    """(event_id, n): how many earlier events of the person lie within the window (microseconds).

    State is kept by bucket of people and stretch of one window; an event goes to its own
    stretch, where it is counted and answered, and to the next, where it is
    counted only.  A timer at the end of a stretch drops its state.
    """
    timed = events.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    stretch = F.floor(F.col("t") / window)
    dealt = timed.select("ts", "t", "event_id", F.col("user_id").alias("person"), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket"), F.posexplode(F.array(stretch, stretch + 1)).alias("more", "stretch"))
    return dealt.withColumn("asked", F.col("more") == 0).groupBy("bucket", "stretch").transformWithStateInPandas(_EarlierCounts(window), "event_id long, n long", "Append", "EventTime")


def merged_streams(orders: DataFrame, lines: DataFrame, late_orders: str, late_lines: str, bound: str) -> DataFrame:
    """(o_orderkey, l_linenumber, o_orderstatus, l_returnflag): orders with their lines shipped within `bound`, from two streams.

    Each stream has its own delay.  The bound on times lets Spark drop orders that no line
    can follow and lines whose order is gone; an order without any comes out alone,
    with nulls, when its time is over.
    """
    o, li = orders.withWatermark("ordered", late_orders), lines.withWatermark("shipped", late_lines)
    near = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("shipped") >= F.col("ordered")) & (F.col("shipped") <= F.col("ordered") + F.expr(f"INTERVAL {bound}"))
    return o.join(li, near, "leftOuter").select("o_orderkey", "l_linenumber", "o_orderstatus", "l_returnflag")
