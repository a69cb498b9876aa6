"""Stateful streams against their batch forms: rows out of order, late rows, restarts, replays."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog
from plumbline.streaming import ordered
from plumbline.streaming.windows import throttle, ttl_counter


@pytest.fixture()
def rocks(spark):
    for key, value in ordered.ordered_conf().items():
        before = spark.conf.get(key)
        spark.conf.set(key, value)
        yield spark
        spark.conf.set(key, before)


def drained(stream, name, tmp_path, trigger=None):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(90)
    q.stop()


def fed(spark, batches: list[list[tuple]], schema: str, tmp_path):
    """A stream that brings each list as a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    import glob
    import os
    import time

    start = time.time() - 10_000
    for k, path in enumerate(sorted(glob.glob(str(tmp_path / "in" / "*" / "*.parquet")))):
        os.utime(path, (start + k, start + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_budget_decisions_equal_the_batch(rocks, tmp_path):
    """Requests of two days in shuffled micro-batches; what is beyond the watermark is told apart."""
    rng = random.Random(5)
    t0 = dt.datetime(2026, 1, 1, 20)
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(6 * 3600))) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(4)]  # ties
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for b in batches:
        rng.shuffle(b)
    for x, y in zip(batches[::2], batches[1::2], strict=False):  # rows that come a batch too early or too late, within the watermark
        x[0], y[0] = y[0], x[0]
    end = [[(9000 + k, t0 + dt.timedelta(days=4 * k + 4))] for k in range(3)]
    too_late = [(5000, t0 + dt.timedelta(minutes=1)), (5001, t0 + dt.timedelta(hours=5))]
    stream = fed(rocks, [*batches, end[0], end[1], too_late, end[2]], "event_id long, ts timestamp", tmp_path)
    drained(ordered.budget_decisions(stream, "ts", "event_id", 20, 90, late="6 hours"), "budget", tmp_path)
    got = rocks.table("budget")
    want = catalog.consume_budget(rocks.createDataFrame([*rows, *end[0], *end[1]], "event_id long, ts timestamp"), "ts", "event_id", 20, 90)
    columns = want.columns
    told = got.filter("not late").select(*columns)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    assert {r.event_id for r in got.filter("late").collect()} == {5000, 5001}
    assert {r.refused_by for r in told.collect()} == {None, "hour", "day"}


def test_throttle_decisions_equal_the_batch_in_any_order(rocks, tmp_path):
    rng = random.Random(8)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(k, 100 * j + i, t0 + dt.timedelta(seconds=17 * i), i % 13 != 12) for j, k in enumerate(("a", "b", "c")) for i in range(60)]
    rng.shuffle(rows)
    end = [[("z", 900, t0 + dt.timedelta(days=1), True)], [("z", 901, t0 + dt.timedelta(days=2), True)]]
    schema = "key string, event_id long, ts timestamp, failed boolean"
    stream = fed(rocks, [rows[:50], rows[50:120], rows[120:], *end], schema, tmp_path)
    drained(ordered.throttle_decisions(stream, late="1 hour"), "throttle", tmp_path)
    got = rocks.table("throttle").filter("not late and key <> 'z'").drop("late")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, throttle(rocks.createDataFrame(rows, schema)).collect()))


def until(q, done, seconds: float = 60.0) -> None:
    """Stops a query once its work is done: one with a time to live goes on without new rows."""
    import time

    end = time.time() + seconds
    while not done() and q.isActive and time.time() < end:
        time.sleep(0.3)
    q.stop()
    assert done()


def test_expiring_counters_survive_a_restart_and_leave_nothing(rocks, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f"k{i % 3}", i, t0 + dt.timedelta(seconds=7 * i)) for i in range(90)]
    schema = "key string, event_id long, ts timestamp"
    stream = fed(rocks, [rows[:30], rows[30:31], rows[31:90]], schema, tmp_path)
    read = lambda: rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out: list[tuple] = []
    write = lambda df: df.writeStream.foreachBatch(lambda b, k: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).start()
    until(write(ordered.ttl_counter_stream(stream, 60, grace=3_600)), lambda: len(out) == 90)
    more = [(f"k{i % 3}", i, t0 + dt.timedelta(seconds=7 * i)) for i in range(90, 120)]
    rocks.createDataFrame(more, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "900"))
    until(write(ordered.ttl_counter_stream(read(), 60, grace=3_600)), lambda: len(out) == 120)
    want = ttl_counter(rocks.createDataFrame(rows + more, schema), 60)
    assert sorted(out) == sorted(map(tuple, want.collect()))
    assert max(r.hits for r in want.collect()) > 2


def test_state_of_counters_goes_after_its_time_to_live(rocks, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    stream = fed(rocks, [[("a", 1, t0), ("b", 2, t0)]], "key string, event_id long, ts timestamp", tmp_path)
    rows: list[int] = []

    def state(q) -> bool:
        told = q.lastProgress
        if told and told["stateOperators"]:
            rows.append(told["stateOperators"][0]["numRowsTotal"])
        return bool(rows) and max(rows) > 0 and rows[-1] == 0

    q = ordered.ttl_counter_stream(stream, 1, grace=0).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    until(q, lambda: state(q))


def test_hourly_turns_are_written_once(spark, sf, tmp_path):
    """Ticks as a stream equal the turns one after another; a batch that is run again, whole or after a crash, changes nothing."""
    from plumbline.plans import proxies as px
    from plumbline.streaming import turns

    runs = px.runs(spark, sf)
    journeys = px.journeys(spark, sf)
    ticks = [(dt.datetime(2024, 1, 20 + k // 2, 3, 30 * (k % 2)), [] if k % 3 else [6, 18]) for k in range(4)]
    ledger = turns.Ledger(spark, str(tmp_path / "state"))
    turns.start(ledger, runs, journeys)
    stream = fed(spark, [ticks[:1], ticks[1:3], ticks[3:]], "at timestamp, failed array<long>", tmp_path)
    run = turns.turn(ledger)
    crashed: list[int] = []

    def once_broken(df, batch):
        if batch == 1 and not crashed:  # a run that wrote a table and died
            crashed.append(batch)
            runs.limit(1).write.parquet(str(tmp_path / "state" / "runs" / "v=1"))
            raise RuntimeError("lost")
        run(df, batch)

    start = lambda f: stream.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q = start(once_broken)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(120)
    assert start(once_broken).awaitTermination(120)
    want_runs, want = runs, journeys
    claimed = []
    for at, failed in ticks:
        done = catalog.tick(want_runs, want, F.lit(at).cast("timestamp"))
        due = [r.id for r in done["due"].collect()]
        claimed += [(i, at) for i in due if i not in failed]
        want_runs, want = done["runs"], catalog.release_claims(done["journeys"], done["due"].filter(F.col("id").isin(failed)).select("id"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    state = lambda: (rows(ledger.read("journeys"), "id", "last_scheduled_at"), rows(ledger.read("runs"), "request_id", "status"), rows(ledger.read("claims"), "id", "at"))
    before = state()
    assert before == (rows(want, "id", "last_scheduled_at"), rows(want_runs, "request_id", "status"), sorted(claimed, key=str))
    assert ledger.batches() == [-1, 0, 1, 2] and claimed
    run(spark.createDataFrame(ticks[3:], "at timestamp, failed array<long>"), 2)  # a batch that is run again
    assert state() == before
