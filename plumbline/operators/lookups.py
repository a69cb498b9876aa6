"""Lookups and listings of the catalog, crawl selections, counters and consistency checks.

Everything is a filter, a join or one grouping over whole tables; nothing loops over ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import urls as ux
from plumbline.operators.runs import last_k_per_group
from plumbline.operators.scans import failed_nodes
from plumbline.operators.steps import MAX_STEPS, MAX_TEXT
from plumbline.operators.views import listed_journeys

REPORT_RUNS = 100
MAX_INLINE_BYTES = 2_500_000
OPERATOR_COLUMNS = ["id", "email", "name", "session_epoch", "disabled_at", "created_at", "updated_at"]


# --- by key ---------------------------------------------------------------------------------


def by_key(table: DataFrame, value, key: str = "id") -> DataFrame:
    """The row with a key, no row if there is none; the filter reaches the scan."""
    return table.filter(F.col(key) == F.lit(value))


def operator_by_email(operators: DataFrame, email: str) -> DataFrame:
    """The operator with an address, whatever its case."""
    return operators.filter(F.lower("email") == F.lower(F.lit(email)))


def active_operators(operators: DataFrame) -> DataFrame:
    """Operators that are not disabled, without their password hashes, by name."""
    names = [c for c in OPERATOR_COLUMNS if c in operators.columns]
    return operators.filter(F.col("disabled_at").isNull()).select(*names).orderBy("name", "id")


def reports_of(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """Reports of the given runs, newest first; none for no runs."""
    return reports.join(requests.select("request_id").distinct(), "request_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id"))


def client_reports(reports: DataFrame, runs: DataFrame, journeys: DataFrame, client_id=None, k: int = REPORT_RUNS) -> DataFrame:
    """(client_id, all report columns) of reports on the last k runs of each live journey; of one client, or of all."""
    recent = last_k_per_group(runs.select("request_id", "journey_id", "created_at"), ["journey_id"], k).select("request_id", "journey_id")
    live = listed_journeys(journeys, client_id).select(F.col("id").alias("journey_id"), "client_id")
    return reports.join(recent.join(live, "journey_id").select("request_id", "client_id"), "request_id").select("client_id", *reports.columns)


def triage_of(triage: DataFrame, client_id) -> DataFrame:
    """A client's triage marks, last changed first."""
    return by_key(triage, client_id, "client_id").orderBy(F.desc("updated_at"), "finding_key")


def names_taken(wanted: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Wanted rows with ``duplicate``: whether an existing name is the same but for case and blanks at the ends."""
    same = lambda c: F.lower(F.trim(c))
    known = existing.select(same(F.col(name)).alias("_known")).distinct().withColumn("duplicate", F.lit(True))
    out = wanted.join(known, same(F.col(name)) == F.col("_known"), "left")
    return out.withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).drop("_known")


# --- crawl results --------------------------------------------------------------------------


def crawl_rows(pages: DataFrame, target: str = "target_url") -> DataFrame:
    """Crawled pages (site, url, depth, seq, target) with step_path and why they cannot be a step: other_host, too_long or NULL."""
    rows = pages.withColumn("step_path", ux.browser_step_path(F.col("url"), F.col(target)))
    return rows.withColumn("blocked_by", F.when(F.col("step_path").isNull(), "other_host").when(F.length("step_path") > MAX_TEXT, "too_long"))


def takeable_pages(rows: DataFrame, site: str = "site", most: int = MAX_STEPS) -> DataFrame:
    """What selecting every page of a site takes: its first pages that can be steps, shallowest first, then in crawl order."""
    order = Window.partitionBy(site).orderBy("depth", "seq")
    return rows.filter(F.col("blocked_by").isNull()).withColumn("display", F.row_number().over(order)).filter(F.col("display") <= most)


def chosen_steps(rows: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """The selected rows as steps, numbered in crawl order (not in that of the selection)."""
    order = Window.partitionBy(on[0]).orderBy("seq")
    return rows.join(selected.select(*on).distinct(), on, "left_semi").withColumn("step", F.row_number().over(order))


# --- counters and checks --------------------------------------------------------------------


def rule_counts(scan: Column) -> Column:
    """struct(passed, failed, incomplete): rules passed, nodes failed and undecided of a parsed scan."""
    return F.struct(F.coalesce("pass_count", F.lit(0)).alias("passed"), failed_nodes(scan["violations"]).alias("failed"), failed_nodes(scan["incomplete"]).alias("incomplete"))


def pass_nodes(passes: Column) -> Column:
    """Rules that passed in a JSON scan's list of passes; 0 for anything but a list."""
    items = F.from_json(passes, "array<variant>")
    return F.when(passes.rlike(r"^\s*\["), F.coalesce(F.size(items), F.lit(0))).otherwise(F.lit(0))


def slowest_or_zero(pages: DataFrame) -> DataFrame:
    """(request_id, slowest_ms) of the log line: unmeasured pages count as 0 here, unlike in run summaries."""
    return pages.groupBy("request_id").agg(F.max(F.coalesce("duration_ms", F.lit(0))).alias("slowest_ms"))


def timing_problems(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, pages_ms, untimed, scan_over_page, journey_short) of runs whose times contradict each other.

    ``runs`` has journey_ms, ``pages`` duration_ms and scan_ms.
    """
    sums = pages.groupBy("request_id").agg(
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("pages_ms"),
        F.count_if(F.col("scan_ms").isNull()).alias("untimed"),
        F.count_if(F.coalesce(F.col("scan_ms") > F.col("duration_ms"), F.lit(False))).alias("scan_over_page"),
    )
    out = runs.select("request_id", "journey_ms").join(sums, "request_id").withColumn("journey_short", F.coalesce(F.col("journey_ms") < F.col("pages_ms"), F.lit(False)))
    return out.filter((F.col("untimed") > 0) | (F.col("scan_over_page") > 0) | F.col("journey_short")).drop("journey_ms")


def degraded_count(settings: DataFrame) -> DataFrame:
    """(settings, degraded): how many settings there are, and how many are worse than they should be."""
    return settings.agg(F.count("*").alias("settings"), F.count_if(F.coalesce("degraded", F.lit(False))).alias("degraded"))


def inline_budget(pages: DataFrame, most: int = MAX_INLINE_BYTES, run: str = "request_id", size: str = "bytes") -> DataFrame:
    """Pages with ``inlined``: whether their picture fits the run's budget, NULL for pages without one.

    The last page comes first; one that does not fit is passed over and uses nothing. That is no
    running sum, so each run's sizes (a page cap bounds them) are folded in order.
    """
    sized = pages.filter(F.col(size).isNotNull()).groupBy(run).agg(F.sort_array(F.collect_list(F.struct("position", F.col(size).alias("size"))), asc=False).alias("pictures"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<int>").alias("kept"))
    fold = F.aggregate(
        "pictures",
        start,
        lambda a, p: F.when(a["spent"] + p["size"] <= most, F.struct((a["spent"] + p["size"]).alias("spent"), F.array_append(a["kept"], p["position"].cast("int")).alias("kept"))).otherwise(a),
    )
    kept = sized.select(F.col(run).alias("_run"), fold["kept"].alias("_kept"))
    out = pages.join(kept, F.col(run) == F.col("_run"), "left")
    return out.withColumn("inlined", F.when(F.col(size).isNotNull(), F.coalesce(F.array_contains("_kept", F.col("position").cast("int")), F.lit(False)))).drop("_run", "_kept")


# --- artifacts ------------------------------------------------------------------------------


def artifact_links(artifacts: Column, kinds: list[str]) -> Column:
    """Uploaded artifacts as a map: keys that end in Path end in Url; kinds without a file are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), artifacts[k].alias("value")) for k in kinds])
    present = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.transform_keys(present, lambda k, _: F.regexp_replace(k, "Path$", "Url"))


def artifact_flags(links: Column) -> Column:
    """struct(screenshot, dom, ax_tree): which artifacts there are; NULL without a map."""
    has = lambda k: F.map_contains_key(links, k)
    return F.when(links.isNotNull(), F.struct(has("screenshotUrl").alias("screenshot"), has("domSnapshotUrl").alias("dom"), has("axTreeUrl").alias("ax_tree")))


def artifact_of_page(runs: DataFrame, position: Column, kind: str) -> Column:
    """Of runs with ``pages`` (an array): why the artifact of the page at a position from 0 cannot be given, or its link."""
    page = F.when(position >= 0, F.try_element_at(F.col("pages"), (position + 1).cast("int")))
    link = F.try_element_at(page["artifacts"], F.lit(kind))
    return F.when(position.isNull() | (position < 0), "unknown_page").when(page.isNull(), "run_not_found").when(link.isNull(), "artifact_not_captured").otherwise(link)


def holds_artifacts(artifacts: Column) -> Column:
    """Whether a map of artifacts has any entry."""
    return F.coalesce(F.size(artifacts) > 0, F.lit(False))


def expired_blobs(listing: DataFrame, cutoff: Column) -> DataFrame:
    """Listed blobs (url, uploaded_at) from before the cutoff; a blob of unknown age stays."""
    return listing.filter(F.coalesce(F.col("uploaded_at") < cutoff, F.lit(False)))


def read_artifacts(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Wanted (path) with status ok and content, or pruned where the folder no longer has the file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")
    return wanted.select("path").join(found, "path", "left").withColumn("status", F.when(F.col("content").isNull(), "pruned").otherwise("ok"))
