"""Lockout of clients after repeated failures, over a table or a stream of events.

Rules per client, in event time: while blocked every event is refused and
nothing is counted. A failure adds an attempt; the ``max_attempts``-th starts a
block of ``base * 2^(strikes-1)`` seconds (doubling at most ten times), adds a
strike and clears the attempts. A success outside a block clears the record.
The record also lapses an hour after a plain failure and a day after a block.

Events are taken one by one in the order of their times, in microseconds. Events of one client and one instant have no order
of their own: equal ones are counted, and failures come before successes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# fixed values
MAX_ATTEMPTS = 5
BASE_SECONDS = 60
MAX_DOUBLINGS = 10
QUIET_SECONDS = 3600
KEEP_SECONDS = 86400

TICKS = 1_000_000  # event times count microseconds
MINUTE = 60 * TICKS
RELEASED_MINUTES = 1024  # minutes of a client folded at once
REPORT = ("ts timestamp, t_sec bigint, n_ok bigint, n_fail bigint, n_blocked bigint, locked boolean, "
          "attempts int, strikes int, retry_after bigint")
STATE = "attempts int, strikes int, blocked_until bigint, expires bigint"
FRESH = (0, 0, 0, 0)


@dataclass(frozen=True)
class LockoutRules:
    max_attempts: int = MAX_ATTEMPTS
    base_seconds: int = BASE_SECONDS

    def __post_init__(self):
        if self.max_attempts < 1 or self.base_seconds < 1:
            raise ValueError("max_attempts and base_seconds must be at least 1")


def step(state: tuple, t: int, n_ok: int, n_fail: int, rules: LockoutRules, ticks: int = 1) -> tuple[tuple, tuple]:
    """One instant of one client, ``ticks`` to the second; failures of an instant come before its successes."""
    attempts, strikes, blocked_until, expires = state
    if expires and t > expires:
        attempts, strikes, blocked_until, expires = FRESH
    if t < blocked_until:
        state = (attempts, strikes, blocked_until, expires)
        return state, (n_ok + n_fail, False, attempts, strikes, -((t - blocked_until) // ticks))
    if n_fail and attempts + n_fail >= rules.max_attempts:
        refused = n_fail - (rules.max_attempts - attempts) + 1 + n_ok
        block = rules.base_seconds * 2 ** min(strikes, MAX_DOUBLINGS)
        until = t + block * ticks
        state = (0, strikes + 1, until, until + KEEP_SECONDS * ticks)
        return state, (refused, True, 0, strikes + 1, block)
    if n_fail:
        attempts, blocked_until, expires = attempts + n_fail, 0, t + QUIET_SECONDS * ticks
    if n_ok:
        attempts, strikes, blocked_until, expires = FRESH
    return (attempts, strikes, blocked_until, expires), (0, False, attempts, strikes, 0)


def _instant(events: DataFrame) -> Column:
    """Time of an event in microseconds, from ``ts`` or else from whole seconds ``t_sec``."""
    if "ts" in events.columns:
        return F.unix_micros(F.col("ts").cast("timestamp"))
    return F.col("t_sec").cast("bigint") * TICKS


def _fold(client, state: tuple, instants: list[tuple], rules: LockoutRules) -> tuple[tuple, pd.DataFrame]:
    """Reports of one client's instants ``t, n_ok, n_fail`` in order, and the state after them."""
    out = []
    for t, ok, fail in instants:
        state, report = step(state, t, ok, fail, rules, TICKS)
        out.append((client, t, t // TICKS, ok, fail, *report))
    frame = pd.DataFrame(out, columns=_COLUMNS)
    frame["ts"] = pd.to_datetime(frame["ts"], unit="us")  # UTC
    return state, frame


def per_instant(events: DataFrame) -> DataFrame:
    """``client, t, n_ok, n_fail``: the events counted per client and microsecond, combined before the shuffle."""
    return events.select("client", "outcome", _instant(events).alias("t")).groupBy("client", "t").agg(
        F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(~F.col("outcome").eqNullSafe("ok")).alias("n_fail"))


def detect_lockouts(events: DataFrame, rules: LockoutRules = LockoutRules()) -> DataFrame:
    """A row per client and instant of ``client, ts`` (or whole seconds ``t_sec``) ``, outcome`` (ok or fail).

    A client's events are an ordered fold: one task streams through them and keeps four numbers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, FRESH
        for frame in frames:
            for c, own in frame.groupby("client", sort=False, dropna=False):
                if c != client:
                    client, state = c, FRESH
                state, report = _fold(c, state, list(zip(*(own[n].tolist() for n in ("t", "n_ok", "n_fail")))), rules)
                yield report

    ordered = per_instant(events.filter(F.col("client").isNotNull())).repartition("client").sortWithinPartitions("client", "t")
    return ordered.mapInPandas(run, _schema(events))


_COLUMNS = ["client", *[c.split()[0] for c in REPORT.split(", ")]]


def _schema(events: DataFrame) -> str:
    return f"client {events.schema['client'].dataType.simpleString()}, {REPORT}"


class _InOrder(StatefulProcessor):
    """Keeps the events of a client until the watermark has passed their minute, then folds them in order.

    The state holds one entry for each minute with waiting events and a timer for the end of the first of them. A timer that
    fires releases all minutes behind the watermark, a chunk at a time, and sets one for the first that is left. One more
    timer clears a record that has lapsed.
    """

    def __init__(self, rules: LockoutRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", STATE)
        self.waiting = handle.getMapState("waiting", "minute bigint", "t array<bigint>, n_ok array<bigint>, n_fail array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[tuple]] = {}
        for frame in rows:
            for event in zip(*(frame[n].tolist() for n in ("t", "n_ok", "n_fail"))):
                new.setdefault(event[0] // MINUTE, []).append(event)
        for minute, events in new.items():
            held = self.waiting.getValue((minute,))
            if held is not None:
                events = [*zip(*held), *events]
            self.waiting.updateValue((minute,), tuple(map(list, zip(*events))))
        if new:
            self._wake_after(min(new))
        return iter(())

    def _wake_after(self, minute: int) -> None:
        self.handle.registerTimer((minute + 1) * MINUTE // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # no event of an earlier time can come
        minutes = sorted(k[0] for k in self.waiting.keys())
        n_due = sum((minute + 1) * MINUTE <= passed for minute in minutes)
        record = tuple(self.record.get()) if self.record.exists() else FRESH
        if n_due:
            for at in range(0, n_due, RELEASED_MINUTES):
                instants: dict[int, tuple[int, int]] = {}
                for minute in minutes[at:min(at + RELEASED_MINUTES, n_due)]:
                    for t, ok, fail in zip(*self.waiting.getValue((minute,))):
                        had = instants.get(t, (0, 0))
                        instants[t] = (had[0] + ok, had[1] + fail)
                    self.waiting.removeKey((minute,))
                record, report = _fold(key[0], record, [(t, *n) for t, n in sorted(instants.items())], self.rules)
                yield report
            if n_due < len(minutes):
                self._wake_after(minutes[n_due])
            if record != FRESH:
                self.record.update(record)
                self.handle.registerTimer(record[3] // 1000 + 1)
            else:
                self.record.clear()
        elif record != FRESH and record[3] < passed:
            self.record.clear()

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal events of a batch counted, so that a busy client's events are fewer before the shuffle."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by(["client", "t"]).aggregate([("n_ok", "sum"), ("n_fail", "sum")])
            yield from sums.rename_columns({"n_ok_sum": "n_ok", "n_fail_sum": "n_fail"}).select(batch.schema.names).to_batches()


def lockout_stream(events: DataFrame, rules: LockoutRules = LockoutRules(), lateness: str = "10 minutes") -> DataFrame:
    """The same report from a stream, in whatever order its events arrive.

    An event is reported once the watermark (the latest time seen, less ``lateness``) has passed its minute, so every report
    takes all earlier events into account; later ones than that are dropped by Spark. What is waiting when a stream
    ends stays in its state until the watermark moves on. Needs the RocksDB state store, which this call sets for
    the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = events.schema["client"].dataType.simpleString()
    ok = F.col("outcome").eqNullSafe("ok")
    marked = events.filter(F.col("client").isNotNull()).select(
        "client", _instant(events).alias("t"), ok.cast("bigint").alias("n_ok"), (~ok).cast("bigint").alias("n_fail"))
    counted = marked.mapInArrow(_counted, f"client {kind}, t bigint, n_ok bigint, n_fail bigint")
    timed = counted.withColumn("at", F.timestamp_micros("t")).withWatermark("at", lateness)
    return timed.groupBy("client").transformWithStateInPandas(
        _InOrder(rules), outputStructType=_schema(events), outputMode="append", timeMode="eventTime")


def lockout_summary(report: DataFrame) -> DataFrame:
    """Per client: events, refused events, lockouts and highest strike."""
    return report.groupBy("client").agg(
        F.sum(F.col("n_ok") + F.col("n_fail")).alias("events"), F.sum("n_blocked").alias("blocked"),
        F.count_if("locked").alias("lockouts"), F.max("strikes").alias("max_strikes"))
