"""Regression diff of two finding sets by key: bags, so duplicates count (anti and semi joins, not EXCEPT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import findings as fx
from plumbline.functions.jsontext import canonical_json


def keyed(findings: DataFrame) -> DataFrame:
    """Deterministic findings with their key; advisory ones do not take part in a diff."""
    key = fx.finding_key(F.col("source"), F.col("code"), F.col("page_url"), F.col("selector"))
    return findings.filter(fx.is_deterministic(F.col("source"))).withColumn("finding_key", key)


def new_findings(current: DataFrame, baseline: DataFrame, on: Sequence[str] = ("finding_key",)) -> DataFrame:
    return current.join(baseline.select(*on).distinct(), list(on), "left_anti")


def resolved_findings(current: DataFrame, baseline: DataFrame, on: Sequence[str] = ("finding_key",)) -> DataFrame:
    return new_findings(baseline, current, on)


def unchanged_findings(current: DataFrame, baseline: DataFrame, on: Sequence[str] = ("finding_key",)) -> DataFrame:
    return current.join(baseline.select(*on).distinct(), list(on), "left_semi")


def _key_counts(current: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """Per group the counts of new, resolved and unchanged findings, and whether a new one is critical.

    One full pass of per-key counts replaces three joins.
    """
    critical = F.col("severity") == "critical"
    per = lambda df, p: df.groupBy(*by, "finding_key").agg(F.count("*").alias(f"{p}_n"), F.bool_or(critical).alias(f"{p}_critical"))
    both = per(current, "c").join(per(baseline, "b"), [*by, "finding_key"], "full_outer")
    is_new, gone = F.col("b_n").isNull(), F.col("c_n").isNull()
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return both.groupBy(*by).agg(
        total("c_n", is_new).alias("new_findings"),
        total("b_n", gone).alias("resolved_findings"),
        total("c_n", ~is_new & ~gone).alias("unchanged_findings"),
        F.coalesce(F.bool_or(is_new & F.col("c_critical")), F.lit(False)).alias("_critical"),
    )


def _status(critical: Column, fresh: Column) -> Column:
    """fail for a new critical finding, warn for any other new one, else none."""
    return F.when(critical, "fail").when(fresh > 0, "warn").otherwise("none")


def diff_status(current: DataFrame, baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group (or over all): status none / warn / fail and the counts of new, resolved and unchanged findings.

    Both sides carry ``finding_key``, ``severity`` and the grouping columns. Groups are those with a finding on either side.
    """
    out = _key_counts(current, baseline, list(by))
    return out.withColumn("status", _status(F.col("_critical"), F.col("new_findings"))).drop("_critical")


def regression_of_runs(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """(request_id, baseline_id, status, counts) of every pair of runs (request_id, baseline_id, comparable).

    ``findings`` are keyed ones. Runs that did not walk the same path are incomparable and have no
    counts; a pair without findings has status none. Only comparable pairs' findings are joined.
    """
    able = pairs.filter("comparable").select("request_id", "baseline_id")
    keyed_rows = findings.select("request_id", "finding_key", "severity")
    current = keyed_rows.join(able, "request_id").select("request_id", "finding_key", "severity")
    base = able.join(keyed_rows.withColumnRenamed("request_id", "baseline_id"), "baseline_id").select("request_id", "finding_key", "severity")
    counts = _key_counts(current, base, ["request_id"])
    out = pairs.select("request_id", "baseline_id", "comparable").join(counts, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = F.when(~F.col("comparable"), "incomparable").otherwise(_status(F.coalesce("_critical", F.lit(False)), F.coalesce("new_findings", F.lit(0))))
    return out.select("request_id", "baseline_id", status.alias("status"), *[zero(c) for c in ("new_findings", "resolved_findings", "unchanged_findings")])


def comparable(steps_a: Column, steps_b: Column, ruleset_a: Column, ruleset_b: Column) -> Column:
    """Whether two runs can be compared: both steps are JSON arrays with equal content, equal rulesets (NULL equals NULL)."""
    return F.coalesce(canonical_steps(steps_a) == canonical_steps(steps_b), F.lit(False)) & ruleset_a.eqNullSafe(ruleset_b)


def canonical_steps(steps: Column) -> Column:
    """A JSON array in canonical text (object keys in order at every depth), NULL for anything else."""
    return F.when(steps.rlike(r"^\s*\["), canonical_json(steps))
