"""The history of findings over a journey's runs: spans of presence, what was fixed and what came back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.findings import finding_status
from plumbline.session import Workspace


def run_ordinals(runs: DataFrame, group: Sequence[str], created: str = "created_at", key: str = "request_id") -> DataFrame:
    """(group, request_id, n): each run's number in its group by creation, from 1.

    Rows are dealt by ranges of the whole order and counted per range, so the runs of one group may be
    many tasks; the window has a row per group and range.
    """
    ws = Workspace(runs.sparkSession, "ordinals")
    order = [*[F.asc_nulls_first(c) for c in group], F.asc_nulls_first(created), F.asc(key)]
    ranges = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs.select(*group, created, key).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = ws.save(rows.select(*group, key, F.spark_partition_id().alias("in_range"), F.monotonically_increasing_id().alias("at")), "rows")
    counts = rows.groupBy(*group, "in_range").agg(F.count("*").alias("n_rows"), F.min("at").alias("first_at"))
    before = F.sum("n_rows").over(Window.partitionBy(*group).orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("in_range").alias("of_range"), (F.coalesce(before, F.lit(0)) - F.col("first_at") + 1).alias("shift"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
    return rows.join(starts, [*same, F.col("in_range") == F.col("of_range")]).select(*group, key, (F.col("at") + F.col("shift")).alias("n"))


def finding_spans(runs: DataFrame, findings: DataFrame, group: Sequence[str], counts: Column, key: str = "request_id") -> DataFrame:
    """(group, finding_key, span, first_n, last_n, first_run, last_run, runs_seen, latest_n): the stretches of runs in which a finding is present.

    Gaps and islands over the runs that ``counts`` holds for, in the order of creation: a run that does
    not count (it failed, or walked another path) is no observation, so it neither ends a span nor
    starts one. ``findings`` have (request_id, finding_key); repeated ones count once. ``latest_n`` is the number of counted runs.
    """
    counted = run_ordinals(runs.filter(F.coalesce(counts, F.lit(False))), group, key=key)
    latest = counted.groupBy(*[F.col(c).alias(f"of_{c}") for c in group]).agg(F.max("n").alias("latest_n"))
    seen = findings.select(key, "finding_key").distinct().join(counted, key)
    place = F.row_number().over(Window.partitionBy(*group, "finding_key").orderBy("n"))
    islands = seen.withColumn("island", F.col("n") - place)
    ends = F.struct("n", key)
    spans = islands.groupBy(*group, "finding_key", "island").agg(F.min(ends).alias("first"), F.max(ends).alias("last"), F.count("*").alias("runs_seen"))
    spans = spans.withColumn("span", F.row_number().over(Window.partitionBy(*group, "finding_key").orderBy("first")))
    spans = spans.join(latest, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group])
    return spans.select(*group, "finding_key", "span", F.col("first.n").alias("first_n"), F.col("last.n").alias("last_n"), F.col(f"first.{key}").alias("first_run"), F.col(f"last.{key}").alias("last_run"), "runs_seen", "latest_n")


def finding_history(spans: DataFrame, triage: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, finding_key, first_run, last_run, spans, runs_seen, in_latest, status): a finding's life and its display status.

    In the latest counted run again after a gap it is Retest due, absent from it Fixed; ``triage``
    (group, finding_key, state) outranks both as in ``finding_status``. One span that reaches the latest run is Open.
    """
    life = spans.groupBy(*group, "finding_key").agg(
        F.min_by("first_run", "span").alias("first_run"),
        F.max_by("last_run", "span").alias("last_run"),
        F.max("span").cast("long").alias("spans"),
        F.sum("runs_seen").alias("runs_seen"),
        (F.max("last_n") == F.max("latest_n")).alias("in_latest"),
    )
    marks = triage.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("finding_key").alias("of_key"), "state")
    out = life.join(marks, [*[F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group], F.col("finding_key") == F.col("of_key")], "left")
    status = finding_status(F.col("in_latest"), F.col("state"), F.col("spans") > 1)
    return out.select(*group, "finding_key", "first_run", "last_run", "spans", "runs_seen", "in_latest", status.alias("status"))
