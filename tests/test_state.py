from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.operators.traffic import latency_percentiles, open_windows, request_metrics, request_metrics_windowed
from tilewright.operators.versions import fold_versions
from tilewright.streaming import lockout
from tilewright.streaming.lockout import FRESH, LockoutRules, detect_lockouts, lockout_stream, step
from tilewright.streaming.runs import run_available, run_with_state

RULES = LockoutRules(3, 2)
START = 1_700_000_000


def replay(events, rules):
    """Sequential rules, one event at a time."""
    state, out = {}, []
    for client, t, ok in events:
        now, report = step(state.get(client, FRESH), t, int(ok), int(not ok), rules)
        state[client] = now
        out.append((client, t, *report))
    return out


def test_blocks_double():
    times = [0, 1, 2, 10, 11, 12, 20, 21, 22]
    reports = [r for r in replay([(1, START + t, False) for t in times], RULES)]
    assert [r[6] for r in reports if r[3]] == [2, 4, 8]
    assert [r[5] for r in reports if r[3]] == [1, 2, 3]


def test_nothing_counts_while_blocked():
    events = [(1, START + t, False) for t in (0, 1, 2)] + [(1, START + 3, True), (1, START + 3, False)]
    reports = replay(events, RULES)
    assert reports[3][2] == 1 and reports[3][5] == 1  # right key, still refused, strike kept


def test_records_lapse():
    quiet = [(1, START + t, False) for t in (0, 1, 2, 10)] + [(1, START + 10 + 3601, False)]
    assert replay(quiet, RULES)[-1][5] == 0  # an hour after a plain failure the strike is gone
    kept = [(1, START + t, False) for t in (0, 1, 2)] + [(1, START + 2 + 2 + 86400, False)]
    assert replay(kept, RULES)[-1][5] == 1
    gone = [(1, START + t, False) for t in (0, 1, 2)] + [(1, START + 2 + 2 + 86401, False)]
    assert replay(gone, RULES)[-1][5] == 0


def test_doubling_stops():
    state = (0, 30, 0, 0)
    assert step(state, START, 0, 3, RULES)[1][4] == 2 * 2**10


def test_batch_equals_replay_and_stream(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.choice([1, 1, 1, 2, 3]), START + i * rng.choice([1, 1, 2]), rng.random() < 0.15) for i in range(1500)]
    events = sorted({(c, t): (c, t, ok) for c, t, ok in events}.values(), key=lambda e: e[1])
    rows = [(c, t, "ok" if ok else "fail") for c, t, ok in events]
    frame = spark.createDataFrame(rows, "client bigint, t_sec bigint, outcome string")
    want = sorted(replay(events, LockoutRules(5, 60)))
    columns = ["client", "t_sec", "n_blocked", "locked", "attempts", "strikes", "retry_after"]
    assert sorted(map(tuple, detect_lockouts(frame).select(columns).collect())) == want
    # files out of order, seconds split over files, a client with most events
    rng.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = streamed(spark, tmp_path, frame.schema, LockoutRules())
    assert sorted(map(tuple, got.select(columns).collect())) == want


def streamed(spark, tmp_path, schema, rules):
    """The report of a stream over all files, closed by an event of client -1 long after all others."""
    last = spark.createDataFrame([(-1, START + 10**9, "ok")], "client bigint, t_sec bigint, outcome string")
    if "ts" in schema.names:
        last = last.select("client", F.timestamp_seconds("t_sec").alias("ts"), "outcome")
    last.write.mode("append").parquet(str(tmp_path / "events"))  # files are read in the order they were written
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    return run_available(lockout_stream(read, rules, "900000000 seconds"), "lockout-test")


class Handle:
    """State of one client in plain dictionaries, and the timers it sets."""

    def __init__(self):
        self.timers, self.entries, self.value = [], {}, []
        self.registerTimer = self.timers.append

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: bool(self.value), get=lambda: self.value[0], clear=self.value.clear,
                               update=lambda v: self.value.__setitem__(slice(None), [v]))

    def getMapState(self, name, key, value):
        return SimpleNamespace(getValue=self.entries.get, updateValue=self.entries.__setitem__, removeKey=self.entries.pop,
                               keys=lambda: iter(list(self.entries)), iterator=lambda: iter(list(self.entries.items())))


def test_one_timer_for_many_minutes(monkeypatch):
    """Waiting minutes need one timer, a release sets one for the first minute left, chunks of minutes go on from each other."""
    monkeypatch.setattr(lockout, "RELEASED_MINUTES", 7)
    handle, processor = Handle(), lockout._InOrder(RULES)
    processor.init(handle)
    minutes = [START // 60 + i for i in range(50)]
    rows = [(m * lockout.MINUTE, 0, 1) for m in reversed(minutes)]
    list(processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["t", "n_ok", "n_fail"])]), None))
    assert handle.timers == [(minutes[0] + 1) * 60_000]
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: minutes[40] * 60_000)
    found = pd.concat(processor.handleExpiredTimer((1,), at, None))
    assert handle.timers[1] == (minutes[40] + 1) * 60_000 and len(handle.timers) == 3  # and one for the record
    assert sorted(handle.entries) == [(m,) for m in minutes[40:]]
    want = replay([(1, m * 60, False) for m in minutes[:40]], RULES)
    assert found["t_sec"].tolist() == [r[1] for r in want] and found["strikes"].tolist() == [r[5] for r in want]


def test_order_within_a_second(spark, tmp_path):
    """A success between two failures of one second clears the first, in a table and in a stream."""
    times = [(0.1, "fail"), (0.2, "fail"), (0.3, "ok"), (0.4, "fail"), (0.5, "fail"), (0.6, "fail"), (0.7, "ok"), (2.59, "fail"), (2.61, "ok")]
    rows = [(1, START + t, outcome) for t, outcome in times]
    frame = spark.createDataFrame(rows, "client bigint, s double, outcome string").select(
        "client", F.timestamp_millis(F.round(F.col("s") * 1000).cast("bigint")).alias("ts"), "outcome")
    found = detect_lockouts(frame, RULES).orderBy("ts").collect()
    assert [(r.attempts, r.strikes, r.locked, r.n_blocked, r.retry_after) for r in found] == [
        (1, 0, False, 0, 0), (2, 0, False, 0, 0), (0, 0, False, 0, 0), (1, 0, False, 0, 0), (2, 0, False, 0, 0), (0, 1, True, 1, 2),
        (0, 1, False, 1, 2), (0, 1, False, 1, 1), (0, 0, False, 0, 0)]
    held = frame.collect()
    for part in (held[4:7], held[7:] + held[:1], held[1:4]):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    assert [tuple(r) for r in streamed(spark, tmp_path, frame.schema, RULES).orderBy("ts").collect()] == [tuple(r) for r in found]


def test_clients_may_be_text(spark):
    frame = spark.createDataFrame([("10.0.0.1", START, "fail")], "client string, t_sec bigint, outcome string")
    assert detect_lockouts(frame).first().client == "10.0.0.1"


def test_seconds_with_many_events(spark):
    frame = spark.createDataFrame([(1, START, "fail")] * 1000 + [(1, START + 1, "ok")] * 10,
                                  "client bigint, t_sec bigint, outcome string")
    rows = detect_lockouts(frame).orderBy("t_sec").collect()
    assert [(r.n_fail, r.n_blocked, r.locked) for r in rows] == [(1000, 996, True), (0, 10, False)]


@pytest.mark.parametrize("events, version", [
    ([], None), ([("bump", None)], "2"), ([("set", "42")], "42"), ([("set", "42"), ("bump", None)], "43"),
    ([("set", "v2.5"), ("bump", None)], "2"), ([("set", "7x"), ("bump", None), ("bump", None)], "9"),
    ([("set", "0"), ("bump", None)], "1"), ([("set", "0x"), ("bump", None)], "2"),
    ([("bump", None), ("set", "5"), ("bump", None), ("set", "2.5"), ("bump", None)], "3.5"),
])
def test_versions(spark, events, version):
    rows = [(i, " Layer ", op, v) for i, (op, v) in enumerate(events)]
    got = fold_versions(spark.createDataFrame(rows, "seq bigint, layer string, op string, v string")).collect()
    assert [tuple(r) for r in got] == ([] if version is None else [("layer", version)])


def test_metric_arithmetic(spark):
    rows = [("L1", 1.0)] * 80 + [("L2", 1.0)] * 10 + [("MISS", 50.0)] * 10
    m = request_metrics(spark.createDataFrame(rows, "source string, latency_ms double")).first()
    assert (m.l1_hit_ratio, m.l2_hit_ratio, m.overall_hit_ratio) == (0.8, 0.5, 0.9)
    assert (m.compute_avg_ms, m.compute_total_s) == (50.0, 0.5)
    empty = request_metrics(spark.createDataFrame([], "source string, latency_ms double")).first()
    assert (empty.overall_hit_ratio, empty.compute_avg_ms) == (0.0, 0.0)


def test_windows_of_a_stream_equal_the_table(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", random.Random(h * m).choice(["L1", "L2", "MISS"]), float(m))
            for h in range(24) for m in range(0, 60, 7)]
    frame = spark.createDataFrame(rows, "ts string, source string, latency_ms double").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "log"))
    closed = run_available(request_metrics_windowed(stream), "windows-test").collect()
    table = {r.window_start: r for r in request_metrics_windowed(frame).collect()}
    assert len(table) == 4 and len(closed) == 3  # the last window is still open
    assert all(table[r.window_start] == r for r in closed)
    again, state = run_with_state(request_metrics_windowed(stream), "windows-test")
    both = again.unionByName(open_windows(state)).collect()
    assert len(both) == 4 and {r.window_start: r for r in both} == table


def test_percentiles_by_nearest_rank(spark):
    rng = random.Random(7)
    values = [round(rng.expovariate(0.1), 3) for _ in range(501)] + [5.0] * 400
    frame = spark.createDataFrame([("a", v) for v in values], "source string, latency_ms double")
    got = {r.percent: r.value for r in latency_percentiles(frame, ["source"], [1, 50, 90, 99.9, 100]).collect()}
    ordered = sorted(values)
    import math
    assert got == {p: ordered[max(0, math.ceil(p / 100 * len(ordered)) - 1)] for p in (1, 50, 90, 99.9, 100)}


def test_percentiles_of_hard_values(spark):
    """Negative and tiny values, zeros of both signs, neighbours that differ in the last bit, null groups."""
    import math
    near = [1.0 + k * 2.0**-52 for k in range(40)]
    groups = {"a": near * 3, "b": [-5.0, -0.0, 0.0, 5e-324, 1e300, -1e-300, 7.0, 8.0, 1024.0, 1023.9999999999999], None: [2.0] * 9 + [4.0]}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan"))],
                                  "source string, latency_ms double")
    percents = [1, 10, 33, 50, 77, 90, 100]
    got = {(r.source, r.percent): r.value for r in latency_percentiles(frame, ["source"], percents).collect()}
    assert got == {(g, p): sorted(vs)[max(0, math.ceil(p / 100 * len(vs)) - 1)] for g, vs in groups.items() for p in percents}
    assert len(latency_percentiles(frame, [], [50]).collect()) == 1
