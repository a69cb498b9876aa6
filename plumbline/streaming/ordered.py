"""Streams whose result depends on the order of events: rows wait for the watermark and are then judged in event time.

Per key the rows that came are state; a timer at the end of a slot of event time goes off when the
watermark has passed it, and the slot's rows are folded in order. So the result is that of the batch
operators, however rows arrive. A row that comes when its slot has been judged is late: it is told,
and counts for nothing. Needs the RocksDB state store (``ordered_conf``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions import text as tx
from plumbline.operators.catalog import FAILURES_TO_THROTTLE, RUNS_PER_DAY, RUNS_PER_HOUR, THROTTLE_SECONDS
from plumbline.streaming.windows import step

#: Microseconds of a slot: rows are judged this much at a time.
SLOT_US = 60_000_000


def ordered_conf() -> dict[str, str]:
    """Settings that state with timers needs."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class OrderedFold(StatefulProcessor):
    """Folds each key's rows (us, id, flag) in the order of us and id, once the watermark has passed their slot.

    ``fold`` takes the state (two longs and the time of the last row) and a row, and gives the new state and an output row. State goes
    when ``keep_us`` have passed since the key's last row in event time.
    """

    def __init__(self, fold: Callable[[tuple, int, int, bool], tuple[tuple, tuple]], names: list[str], keep_us: int):
        self.fold, self.names, self.keep_us = fold, names, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, id long, flag boolean")
        self.now = handle.getValueState("now", "a long, b long, last long")

    def _timer(self, ms: int) -> None:
        if ms not in set(self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        judged = timerValues.getCurrentWatermarkInMs() * 1_000 // SLOT_US * SLOT_US
        for pdf in rows:
            late = pdf["us"] < judged
            good = pdf[~late]
            if len(good):
                self.pending.appendList([(int(u), int(i), bool(f)) for u, i, f in zip(good["us"], good["id"], good["flag"], strict=True)])
                for slot in sorted({int(u) // SLOT_US for u in good["us"]}):
                    self._timer((slot + 1) * SLOT_US // 1_000)
            if late.any():
                out = pdf[late]
                yield pd.DataFrame({"key": key[0], "id": out["id"], "us": out["us"], "late": True, **dict.fromkeys(self.names, 0)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        rows = sorted(self.pending.get())
        due = [r for r in rows if r[0] < upto]
        state = self.now.get() if self.now.exists() else (0, 0, 0)
        out = []
        for us, id_, flag in due:
            (a, b), found = self.fold(state, us, id_, flag)
            state = (a, b, us)
            out.append((key[0], id_, us, False, *found))
        if due:
            rest = rows[len(due) :]
            self.pending.put(rest) if rest else self.pending.clear()
            self.now.update(state)
            self._timer((state[2] + self.keep_us) // 1_000 + 1)
        elif not rows and self.now.exists() and upto >= state[2] + self.keep_us:
            self.now.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "us", "late", *self.names])

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, fold, names: list[str], keep_us: int, late: str) -> DataFrame:
    """``rows`` (key string, id, at timestamp, flag) through an OrderedFold; rows count as late beyond ``late``."""
    marked = rows.withWatermark("at", late).select("key", "id", F.unix_micros("at").alias("us"), "flag")
    shape = "key string, id long, us long, late boolean, " + ", ".join(f"{n} long" for n in names)
    return marked.groupBy("key").transformWithStateInPandas(OrderedFold(fold, names, keep_us), shape, "Append", "EventTime")


def _budget(state: tuple, us: int, id_: int, flag: bool) -> tuple[tuple, tuple]:
    day_count, hour_count, last = state
    hour_count = hour_count + 1 if day_count and us // 3_600_000_000 == last // 3_600_000_000 else 1
    return (day_count + 1, hour_count), (hour_count, day_count + 1)


def budget_decisions(requests: DataFrame, ts: str, key: str, per_hour: int = RUNS_PER_HOUR, per_day: int = RUNS_PER_DAY, prefix: str = "runs", late: str = "10 minutes") -> DataFrame:
    """A stream's requests (key, ts) with their verdicts: the columns of ``consume_budget``, and ``late``.

    A UTC day is one key, as all its requests share one counter; its state is two counts and the rows
    that wait. Late requests are neither counted nor judged: their counts and verdict are NULL.
    """
    at = F.col(ts).cast("timestamp")
    rows = requests.select(F.date_format(at, "yyyyMMdd").alias("key"), F.col(key).cast("long").alias("id"), at.alias("at"), F.lit(True).alias("flag"))
    out = _folded(rows, _budget, ["hour_count", "day_count"], 86_400_000_000, late)
    moment = F.timestamp_micros("us")
    on_time: Callable[[Column], Column] = lambda c: F.when(~F.col("late"), c)
    over_day, over_hour = F.col("day_count") > per_day, F.col("hour_count") > per_hour
    window = on_time(F.when(over_day, "day").when(over_hour, "hour"))
    return out.select(
        F.col("id").alias(key),
        moment.alias(ts),
        on_time(F.col("hour_count").cast("int")).alias("hour_count"),
        on_time(F.col("day_count").cast("int")).alias("day_count"),
        window.alias("refused_by"),
        on_time(window.isNull()).alias("allowed"),
        on_time(F.when(over_day, tx.seconds_to_day(moment)).when(over_hour, tx.seconds_to_hour(moment))).alias("resets_in"),
        tx.hour_key(moment, prefix).alias("hour_key"),
        tx.day_key(moment, prefix).alias("day_key"),
        "late",
    )


def throttle_decisions(attempts: DataFrame, most: int = FAILURES_TO_THROTTLE, seconds: int = THROTTLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """A stream's attempts (key, event_id, ts, failed) as ``throttle`` judges them: (key, event_id, failures, throttled, late)."""

    def fold(state: tuple, us: int, id_: int, failed: bool) -> tuple[tuple, tuple]:
        now, failures, hit = step((state[0], state[1]), us, failed, most, seconds)
        return now, (failures, int(hit))

    rows = attempts.select("key", F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("failed").alias("flag"))
    out = _folded(rows, fold, ["failures", "throttled"], seconds * 1_000_000, late)
    judged = lambda c: F.when(~F.col("late"), c)
    return out.select("key", F.col("id").alias("event_id"), judged(F.col("failures").cast("int")).alias("failures"), judged(F.col("throttled") == 1).alias("throttled"), "late")


class ExpiringCounter(StatefulProcessor):
    """Counts hits of a key from its first one for ``seconds``; the state store forgets a key ``grace`` seconds later."""

    def __init__(self, seconds: int, grace: int):
        self.seconds, self.grace = seconds, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "first long, hits long", (self.seconds + self.grace) * 1_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, hits = self.now.get() if self.now.exists() else (0, 0)
        for pdf in rows:
            pdf = pdf.sort_values(["us", "event_id"])
            counts = []
            for us in pdf["us"]:
                if hits == 0 or us - first >= self.seconds * 1_000_000:
                    first, hits = int(us), 0
                hits += 1
                counts.append(hits)
            yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"], "hits": counts})
        self.now.update((first, hits))

    def close(self) -> None:
        pass


def ttl_counter_stream(hits: DataFrame, seconds: int, grace: int = 60) -> DataFrame:
    """``ttl_counter`` over a stream (key, event_id, ts) that brings each key's hits in order from batch to batch.

    A counter goes ``seconds`` after its first hit by the hits' own time. Its state has a time to
    live of ``grace`` seconds more, by the clock, so keys that are not met again leave nothing behind.
    """
    rows = hits.select("key", F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(ExpiringCounter(seconds, grace), "key string, event_id long, hits int", "Append", "ProcessingTime")
