"""Roll-ups of catalog and runs: portfolio, client detail, findings screen, reports, activity. One plan each, no per-journey queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import findings as fx
from plumbline.functions.text import clamp_limit
from plumbline.operators.runs import last_k_per_group, newest_first, nth_per_group, run_summaries

UNASSIGNED = "client-unassigned"


def listed_clients(clients: DataFrame) -> DataFrame:
    """Clients but the placeholder, by name."""
    return clients.filter(F.col("id") != UNASSIGNED).orderBy("name", "id")


def listed_journeys(journeys: DataFrame, client_id=None, include_archived: bool = False) -> DataFrame:
    if client_id is not None:
        journeys = journeys.filter(F.col("client_id") == client_id)
    return journeys if include_archived else journeys.filter(F.col("archived_at").isNull())


def run_refusal(target_url: Column, steps: Column) -> Column:
    """Why a journey cannot run (no target, no steps) or NULL; ``steps`` is JSON text."""
    items = F.from_json(steps, "array<string>")
    empty = ~F.coalesce(steps.rlike(r"^\s*\[") & (F.size(items) > 0), F.lit(False))
    return F.when(F.coalesce(target_url, F.lit("")) == "", "journey_not_runnable").when(empty, "journey_has_no_steps")


def newest_runs(runs: DataFrame, journeys: DataFrame, group: str = "journey_id") -> DataFrame:
    """The newest run of every journey, or client, among the live journeys.

    Runs are narrow, and all but one of a group go before the shuffle; whoever needs pages and
    findings joins them with these few.
    """
    live = listed_journeys(journeys).select(F.col("id").alias("journey_id"), "client_id")
    newest = nth_per_group(runs, ["journey_id"]).join(live, "journey_id")
    return newest if group == "journey_id" else nth_per_group(newest, [group])


def children_of(runs: DataFrame, children: DataFrame) -> DataFrame:
    """The pages or findings of some runs."""
    return children.join(runs.select("request_id"), "request_id", "left_semi")


def portfolio(clients: DataFrame, journeys: DataFrame, runs: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per client: journeys, newest run of its live journeys with verdict and counts, whether any run completed.

    The newest runs are found first, so only their pages and findings are summarised.
    """
    live = listed_journeys(journeys).select(F.col("id").alias("journey_id"), "client_id")
    counts = live.groupBy("client_id").agg(F.count("*").alias("journey_count"))
    done = runs.filter(F.col("status") == "complete").select("journey_id").distinct().join(live, "journey_id").select("client_id").distinct().withColumn("has_completed_run", F.lit(True))
    chosen = newest_runs(runs, journeys, "client_id")
    newest = run_summaries(chosen, children_of(chosen, pages), children_of(chosen, findings)).join(chosen.select("request_id", "client_id"), "request_id").drop("journey_id", "environment")
    out = clients.filter(F.col("id") != UNASSIGNED).select(F.col("id").alias("client_id"), "name")
    out = out.join(counts, "client_id", "left").join(done, "client_id", "left").join(newest, "client_id", "left")
    return out.withColumn("journey_count", F.coalesce("journey_count", F.lit(0))).withColumn("has_completed_run", F.coalesce("has_completed_run", F.lit(False)))


def client_journeys(journeys: DataFrame, runs: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Live journeys with refusal, schedule and the summary of their latest run (NULLs without one)."""
    chosen = newest_runs(runs, journeys)
    latest = run_summaries(chosen, children_of(chosen, pages), children_of(chosen, findings))
    live = listed_journeys(journeys).select(F.col("id").alias("journey_id"), "client_id", F.col("name").alias("journey_name"), run_refusal(F.col("target_url"), F.col("steps")).alias("run_refusal"), F.coalesce("schedule", F.lit("off")).alias("schedule"))
    return live.join(latest.drop("environment"), "journey_id", "left")


def setup_stage(has_completed: Column, journeys: Column, refusal: Column, last_run: Column, verdict: Column) -> Column:
    """done / site / steps / first-run / running / failed: where a client's set-up stands.

    ``refusal``, ``last_run`` and ``verdict`` are those of the first journey that can run, or of the first.
    """
    return (
        F.when(F.coalesce(has_completed, F.lit(False)), "done")
        .when(F.coalesce(journeys, F.lit(0)) == 0, "site")
        .when(refusal.isNotNull(), "steps")
        .when(last_run.isNull(), "first-run")
        .when(verdict == "scan", "running")
        .otherwise("failed")
    )


def setup_stages(clients: DataFrame, journeys: DataFrame, details: DataFrame, completed: DataFrame) -> DataFrame:
    """(client_id, stage): ``details`` from client_journeys, ``completed`` the client_ids with a finished run."""
    first = Window.partitionBy("client_id").orderBy(F.col("run_refusal").isNotNull(), "journey_id")
    chosen = details.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    counts = details.groupBy("client_id").agg(F.count("*").alias("_journeys"))
    out = clients.select(F.col("id").alias("client_id")).join(counts, "client_id", "left").join(chosen, "client_id", "left")
    out = out.join(completed.select("client_id").distinct().withColumn("_done", F.lit(True)), "client_id", "left")
    return out.select("client_id", setup_stage(F.col("_done"), F.col("_journeys"), F.col("run_refusal"), F.col("request_id"), F.col("verdict")).alias("stage"))


def finding_views(findings: DataFrame, triage: DataFrame, client_id: str = "client_id", baseline: DataFrame | None = None) -> DataFrame:
    """Findings with display severity, triage overlay by (client, key) and display status.

    With ``baseline`` (findings of the run before, advisory ones too) each tells whether its key was there: ``in_baseline``.
    """
    key = fx.finding_key(F.col("source"), F.col("code"), F.col("page_url"), F.col("selector"))
    rows = findings.withColumn("finding_key", key)
    marks = triage.select(client_id, "finding_key", F.col("state").alias("triage"), F.col("note").alias("triage_note"))
    out = rows.join(marks, [client_id, "finding_key"], "left")
    if baseline is not None:
        known = baseline.select(key.alias("finding_key")).distinct().withColumn("in_baseline", F.lit(True))
        out = out.join(known, "finding_key", "left").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))
    out = out.withColumn("display", fx.display_severity(F.col("severity")))
    return out.withColumn("finding_status", fx.finding_status(F.lit(True), F.col("triage")))


def preview_rows(pages: DataFrame) -> DataFrame:
    """What a preview shows of visited pages: URL, title and status, in the order of the visit; no scan, no accessibility tree."""
    return pages.select("request_id", "position", "url", "title", "status_code").orderBy("request_id", "position")


def page_findings(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with their findings by (request_id, url): pages without findings and findings without a page both stay.

    Duplicate pages of one URL repeat its findings. ``page_place`` is NULL for orphan findings.
    """
    left = pages.select("request_id", F.col("url").alias("page_url"), F.col("position").alias("page_place"), "evidence_status")
    out = left.join(findings.withColumnRenamed("position", "finding_place"), ["request_id", "page_url"], "full_outer")
    return out


def findings_by_page(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per page of a run with its findings as an array in their order; orphan findings' pages follow, without a place.

    Sorted by the page's place, unknown places last.
    """
    rows = page_findings(pages, findings)
    rest = [c for c in findings.columns if c not in ("request_id", "page_url", "position")]
    one = F.struct("finding_place", *rest)
    out = rows.groupBy("request_id", "page_url", "page_place").agg(F.first("evidence_status").alias("evidence_status"), F.array_sort(F.collect_list(F.when(F.col("finding_place").isNotNull(), one))).alias("findings"))
    return out.orderBy("request_id", F.asc_nulls_last("page_place"), "page_url")


def clean_pages(pages: DataFrame, findings: DataFrame) -> DataFrame:
    return pages.join(findings.select("request_id", F.col("page_url").alias("url")).distinct(), ["request_id", "url"], "left_anti")


def finding_order(code: str = "code") -> list[Column]:
    """Most severe first, then by code as readers sort it (Unicode collation), then by its letters."""
    return [fx.display_rank(fx.display_severity(F.col("severity"))).asc(), F.collate(F.col(code), "UNICODE").asc(), F.asc(code)]


def report_order() -> list[Column]:
    """Most severe first, each severity in the order of emission; severities without a place come last."""
    return [fx.display_rank(fx.lookup(F.col("severity"), fx.DISPLAY)).asc(), F.asc("position")]


def all_findings(scanned: DataFrame, advisory: DataFrame) -> DataFrame:
    """A run's findings: those of the scan, then the advisory ones, as a bag; columns that one side lacks are NULL."""
    return scanned.withColumn("part", F.lit(0)).unionByName(advisory.withColumn("part", F.lit(1)), allowMissingColumns=True)


def confident(advisory: DataFrame, least: float = fx.MIN_CONFIDENCE) -> DataFrame:
    """Advisory findings of enough confidence."""
    return advisory.filter(fx.passes_confidence(F.col("confidence"), least))


def reports_view(reports: DataFrame, runs: DataFrame, journeys: DataFrame, clients: DataFrame, k: int = 50) -> DataFrame:
    """Reports on the last k runs of each live journey, with their client, newest first. Older runs' reports drop out."""
    recent = last_k_per_group(runs, ["journey_id"], k).drop("place").withColumnRenamed("created_at", "run_created_at")
    live = listed_journeys(journeys).select(F.col("id").alias("journey_id"), "client_id")
    names = clients.filter(F.col("id") != UNASSIGNED).select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return reports.join(recent, "request_id").join(live, "journey_id").join(names, "client_id").orderBy(F.desc("created_at"), F.desc("id"))


def shared_report(reports: DataFrame, runs: DataFrame, journeys: DataFrame, clients: DataFrame, token: str) -> DataFrame:
    """The report behind a token that was not revoked, with its run and (if still there) journey and client."""
    row = reports.filter((F.col("share_token") == token) & F.col("revoked_at").isNull()).join(runs.withColumnRenamed("created_at", "run_created_at"), "request_id")
    row = row.join(journeys.select(F.col("id").alias("journey_id"), "client_id"), "journey_id", "left")
    row = row.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left")
    title = F.coalesce("title", F.concat(F.lit("Accessibility audit — "), F.coalesce("client_name", F.lit("report"))))
    return row.withColumn("title", title).withColumn("client_name", F.coalesce("client_name", F.lit("Unnamed client")))


def activity(events: DataFrame, clients: DataFrame, client_id=None, limit: float | None = None, default: int = 100) -> DataFrame:
    """Newest events with their client's name (NULL if it is gone); at most 200."""
    if client_id is not None:
        events = events.filter(F.col("client_id") == client_id)
    top = events.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(clamp_limit(limit, default, 200))
    return top.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left")
