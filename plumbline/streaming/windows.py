"""The throttle as a stream and in batch, counters that expire, and a stream of counts per hour for the budget.

A throttle window is anchored at a key's first failure and lasts THROTTLE_SECONDS; a success
clears it. Its state is three numbers per key, so the batch form is a per-key fold and the
streaming form a keyed state with a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.catalog import FAILURES_TO_THROTTLE, THROTTLE_SECONDS

_OUT = "key string, event_id long, failures int, throttled boolean"


def step(state: tuple[int, int], at: int, failed: bool, most: int = FAILURES_TO_THROTTLE, seconds: int = THROTTLE_SECONDS) -> tuple[tuple[int, int], int, bool]:
    """New (anchor, failures) of a key after an attempt, with the failures before it and whether it met a throttle."""
    anchor, failures = state
    if failures and at - anchor >= seconds * 1_000_000:
        anchor, failures = 0, 0
    throttled = failures >= most
    seen = failures
    if failed:
        anchor, failures = (at, 1) if failures == 0 else (anchor, failures + 1)
    elif not throttled:
        anchor, failures = 0, 0
    return (anchor, failures), seen, throttled


def throttle(attempts: DataFrame, most: int = FAILURES_TO_THROTTLE, seconds: int = THROTTLE_SECONDS) -> DataFrame:
    """(key, event_id, failures, throttled) of attempts (key, event_id, ts, failed), in time order per key.

    Rows are dealt by key and sorted; a task streams through its keys with one key's state in hand,
    so a hot key costs time but no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (0, 0)
        for pdf in batches:
            failures, throttled = [], []
            for k, at, failed in zip(pdf["key"], pdf["us"], pdf["failed"], strict=True):
                if k != key:
                    key, state = k, (0, 0)
                state, n, hit = step(state, at, failed, most, seconds)
                failures.append(n)
                throttled.append(hit)
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "failures": failures, "throttled": throttled})

    rows = attempts.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "failed")
    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(run, _OUT)


def ttl_counter(hits: DataFrame, seconds: int) -> DataFrame:
    """(key, event_id, hits): the count a hit (key, event_id, ts) brings its key's counter to; a counter goes ``seconds`` after its first hit."""
    counted = throttle(hits.withColumn("failed", F.lit(True)), 2**31 - 1, seconds)
    return counted.select("key", "event_id", (F.col("failures") + 1).alias("hits"))


def throttle_stream(attempts: DataFrame, most: int = FAILURES_TO_THROTTLE, seconds: int = THROTTLE_SECONDS) -> DataFrame:
    """The throttle over a stream; a key's state goes after ``seconds`` without attempts."""

    def update(key, batches, state):
        now = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            pdf = pdf.sort_values(["us", "event_id"])
            failures, throttled = [], []
            for at, failed in zip(pdf["us"], pdf["failed"], strict=True):
                now, n, hit = step(now, int(at), bool(failed), most, seconds)
                failures.append(n)
                throttled.append(hit)
            yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"], "failures": failures, "throttled": throttled})
        state.update(now)
        state.setTimeoutDuration(seconds * 1000)

    rows = attempts.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "failed")
    return rows.groupBy("key").applyInPandasWithState(update, _OUT, "anchor long, failures int", "append", "ProcessingTimeTimeout")


def budget_stream(requests: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Requests per UTC hour as a stream: (window, n), late rows within the watermark counted."""
    return requests.withWatermark(ts, late).groupBy(F.window(ts, "1 hour")).agg(F.count("*").alias("n"))
