"""Runs: latest and previous per group, filtered lists, nesting of children, scores, gates, summaries.

Runs are ordered by creation time, newest first, then by id, largest first; every "latest" here is
one window over that order, which Spark prunes before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import findings as fx
from plumbline.functions.text import clamp_limit
from plumbline.session import dealt


def newest_first(created: str = "created_at", key: str = "request_id") -> list[Column]:
    return [F.desc_nulls_last(created), F.desc(key)]


def nth_per_group(runs: DataFrame, group: Sequence[str], n: int = 1, created: str = "created_at", key: str = "request_id") -> DataFrame:
    """The n-th newest run of every group: 1 the latest, 2 its baseline."""
    by = Window.partitionBy(*group).orderBy(*newest_first(created, key))
    return runs.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") == n).drop("_place")


def last_k_per_group(runs: DataFrame, group: Sequence[str], k: int, created: str = "created_at", key: str = "request_id") -> DataFrame:
    by = Window.partitionBy(*group).orderBy(*newest_first(created, key))
    return runs.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def with_baseline(runs: DataFrame, group: Sequence[str], created: str = "created_at", key: str = "request_id") -> DataFrame:
    """Every run with the id of the one before it in its group (whatever its status)."""
    by = Window.partitionBy(*group).orderBy(F.asc_nulls_first(created), F.asc(key))
    return runs.withColumn("baseline_id", F.lag(key).over(by))


def list_runs(runs: DataFrame, limit: float | None = None, created: str = "created_at", key: str = "request_id", **equal) -> DataFrame:
    """Newest runs with the given column values (None: any), a clamped number of them."""
    for column, value in equal.items():
        if value is not None:
            runs = runs.filter(F.col(column) == value)
    return runs.orderBy(*newest_first(created, key)).limit(clamp_limit(limit))


def latest_excluding(runs: DataFrame, journey_id, environment, exclude=None) -> DataFrame:
    """The latest run of a journey and environment, without one id."""
    runs = runs.filter((F.col("journey_id") == journey_id) & (F.col("environment") == environment))
    if exclude is not None:
        runs = runs.filter(F.col("request_id") != exclude)
    return runs.orderBy(*newest_first()).limit(1)


def hydrate(runs: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs with their pages and findings as arrays in position order; empty arrays without children.

    Children are counted first, so that there are as many tasks as their number asks for.
    """

    def nested(child: DataFrame, name: str) -> DataFrame:
        rest = [c for c in child.columns if c not in ("request_id", "position")]
        return child.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias(name))

    out = runs
    for child, name in ((pages, "pages"), (findings, "findings")):
        n = child.count()
        # Spark moves the semi join below the dealing of the children, so its other side is dealt as well
        kept = dealt(child, n, "request_id").join(dealt(runs.select("request_id"), n, "request_id"), "request_id", "left_semi")
        out = out.join(nested(kept, name), "request_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array()))
    return out


def run_scores(pages: DataFrame) -> DataFrame:
    """(request_id, passed, failed, needs_review, evidence_status, score): checks summed over a run's pages."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    out = pages.groupBy("request_id").agg(
        total("checks_passed").alias("passed"),
        total("checks_failed").alias("failed"),
        total("checks_incomplete").alias("needs_review"),
        worst_evidence(F.col("evidence_status")).alias("evidence_status"),
    )
    return out.withColumn("score", fx.score_of(F.col("passed"), F.col("failed"), F.col("evidence_status")))


def worst_evidence(status: Column) -> Column:
    """Aggregate: complete if there are pages and all are, else degraded."""
    return F.when(F.coalesce(F.bool_and(status == "complete"), F.lit(False)), "complete").otherwise("degraded")


def gate_summary(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(request_id, ci_status, execution_status, total, blocking, advisory) of every run.

    A run without full evidence is inconclusive and blocks nothing.
    """
    blocks = fx.gates(F.col("source"), F.col("severity"), F.col("conformance_level"))
    counts = findings.groupBy("request_id").agg(
        F.count("*").alias("total"),
        F.count_if(blocks).alias("blocking"),
        F.count_if(F.col("source") == "ai-advisory").alias("advisory"),
    )
    out = runs.select("request_id", "evidence_status").join(counts, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    full = F.coalesce(F.col("evidence_status") == "complete", F.lit(False))
    blocking = F.when(full, zero("blocking")).otherwise(F.lit(0).cast("long"))
    return out.select(
        "request_id",
        F.when(~full, "inconclusive").when(blocking > 0, "fail").otherwise("pass").alias("ci_status"),
        F.when(full, "complete").otherwise("degraded").alias("execution_status"),
        zero("total").alias("total"),
        blocking.alias("blocking"),
        zero("advisory").alias("advisory"),
    )


def run_summaries(runs: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per run: verdict, must and should counts, audited pages, slowest measured page, duration (0 is unmeasured)."""
    decided = fx.is_deterministic(F.col("source"))
    display = fx.display_severity(F.col("severity"))
    f = findings.groupBy("request_id").agg(
        F.count_if(decided & (display == "must")).alias("must_fix"),
        F.count_if(decided & (display == "should")).alias("should_fix"),
        F.bool_or(fx.is_unresolved(F.col("source"), F.col("severity"))).alias("unresolved"),
    )
    p = pages.groupBy("request_id").agg(F.count("*").alias("pages_audited"), F.max("duration_ms").alias("slowest_page_ms"))
    out = runs.join(f, "request_id", "left").join(p.withColumnRenamed("duration_ms", "_d"), "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "request_id",
        "journey_id",
        "environment",
        "created_at",
        fx.run_verdict(F.col("status"), F.col("ci_status"), F.col("unresolved")).alias("verdict"),
        "score",
        zero("must_fix").alias("must_fix"),
        zero("should_fix").alias("should_fix"),
        zero("pages_audited").alias("pages_audited"),
        "evidence_status",
        F.nullif("duration_ms", F.lit(0)).alias("duration_ms"),
        "slowest_page_ms",
        F.when(F.col("status") == "failed", F.col("failure_reason")).alias("failure_reason"),
    )


def severity_counts(findings: DataFrame, by: Sequence[str] = (), zeros: bool = False) -> DataFrame:
    """Findings by display severity: a row for each that occurs, or with ``zeros`` one row of five counts."""
    display = fx.display_severity(F.col("severity"))
    if zeros:
        return findings.groupBy(*by).agg(*[F.count_if(display == d).alias(d) for d in fx.DISPLAY_ORDER])
    counts = findings.groupBy(*by, display.alias("display")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", fx.display_rank(F.col("display")))


def source_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of findings: all, deterministic, advisory, critical."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "deterministic").alias("deterministic"),
        F.count_if(F.col("source") == "ai-advisory").alias("advisory"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )


def upper_median(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The element at floor(n / 2) of each group's sorted values (no interpolation); NULL without any.

    Rows are counted per value before the shuffle, and the running count over a group's distinct
    values finds the element, so a large group costs no more than its distinct values.
    """
    by = list(by)
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    known = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    group = Window.partitionBy(*by)
    upto = F.sum(known).over(group.orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*by, "_v", known.alias("_n"), upto.alias("_upto"), F.sum(known).over(group).cast("long").alias("n"))
    place = F.floor(F.col("n") / 2)
    middle = F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col("_v")))
    return placed.groupBy(*by, "n").agg(middle.alias("upper_median"))


def phase_headroom(runs: DataFrame, budget_ms: int = 300_000, usable_ms: int = 240_000) -> DataFrame:
    """Time left of the run budget, and the pages that would fit at the slowest page's pace (at least 1)."""
    return runs.select(
        "request_id",
        (F.lit(budget_ms) - F.col("duration_ms")).alias("headroom_ms"),
        F.greatest(F.lit(1), F.floor(F.lit(usable_ms) / F.nullif("slowest_page_ms", F.lit(0)))).cast("int").alias("suggested_pages"),
    )
