"""Queries over the catalog: lookups, listings, writes as folds, crawl results, counters, artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import findings as fx
from plumbline.functions import text as tx
from plumbline.functions import urls as ux
from plumbline.operators import catalog, lookups, scans, views
from plumbline.operators import runs as ops
from plumbline.plans import proxies as px
from plumbline.sources.tables import read_table
from plumbline.streaming.windows import ttl_counter

Q: dict = {}
SQL: dict[str, str] = {}
_NOW = f"TIMESTAMP '{px.NOW}'"


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _now():
    return F.lit(px.NOW).cast("timestamp_ntz")


def _operators(spark, d):
    """Suppliers as operators: every fourth is disabled, addresses in mixed case."""
    key = F.col("s_suppkey")
    return read_table(spark, d, "supplier").select(
        F.concat(F.lit("op-"), key.cast("string")).alias("id"),
        F.concat("s_name", F.lit("@Example.ORG")).alias("email"),
        F.col("s_name").alias("name"),
        F.sha2(F.col("s_name"), 256).alias("password_hash"),
        (key % 3).cast("int").alias("session_epoch"),
        F.when(key % 4 == 0, _now()).alias("disabled_at"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-02").cast("timestamp_ntz").alias("updated_at"),
    )


_OPERATORS_SQL = f"""operators AS (SELECT 'op-' || s_suppkey AS id, s_name || '@Example.ORG' AS email, s_name AS name, sha256(s_name) AS password_hash, CAST(s_suppkey % 3 AS INTEGER) AS session_epoch,
  CASE WHEN s_suppkey % 4 = 0 THEN {_NOW} END AS disabled_at, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-02' AS updated_at, s_suppkey FROM supplier)"""


# --- lookups --------------------------------------------------------------------------------


@query(f"WITH {px.RUNS_SQL} SELECT request_id, journey_id, status, created_at FROM runs WHERE request_id = 7")
def run_lookup(spark, d):
    return lookups.by_key(px.runs(spark, d), 7, "request_id").select("request_id", "journey_id", "status", "created_at")


@query(f"""WITH {px.JOURNEYS_SQL}, {_OPERATORS_SQL}
SELECT 'client' AS kind, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'journey', CAST(id AS VARCHAR), name FROM journeys WHERE id = 11
UNION ALL SELECT 'operator', id, name FROM operators WHERE id = 'op-2' UNION ALL SELECT 'report', 'rep-' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey = 5""")
def catalog_lookups(spark, d):
    """A client, a journey (archived ones too), an operator and a report by their ids."""
    reports = read_table(spark, d, "orders").select(F.concat(F.lit("rep-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"))
    found = [("client", px.clients(spark, d), "3"), ("journey", px.journeys(spark, d), 11), ("operator", _operators(spark, d), "op-2"), ("report", reports, "rep-5")]
    one, *more = [lookups.by_key(t, i).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name") for kind, t, i in found]
    for t in more:
        one = one.unionByName(t)
    return one


@query(f"WITH {_OPERATORS_SQL} SELECT id, email, password_hash FROM operators WHERE s_suppkey = 3")
def operator_lookup(spark, d):
    return lookups.operator_by_email(_operators(spark, d), "supplier#000000003@EXAMPLE.org").select("id", "email", "password_hash")


@query(f"WITH {_OPERATORS_SQL} SELECT id, email, name, session_epoch, disabled_at, created_at, updated_at FROM operators WHERE s_suppkey % 4 <> 0")
def operators_listed(spark, d):
    return lookups.active_operators(_operators(spark, d))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey <> 7")
def clients_listed(spark, d):
    named = px.clients(spark, d).withColumn("id", F.when(F.col("id") == "7", views.UNASSIGNED).otherwise(F.col("id")))
    return views.listed_clients(named)


@query(f"WITH {px.JOURNEYS_SQL} SELECT client_id, count(*) AS every, count(*) FILTER (archived_at IS NULL) AS live FROM journeys GROUP BY 1")
def journeys_listed(spark, d):
    j = px.journeys(spark, d)
    every = views.listed_journeys(j, include_archived=True).groupBy("client_id").agg(F.count("*").alias("every"))
    live = views.listed_journeys(j).groupBy("client_id").agg(F.count("*").alias("live"))
    return every.join(live, "client_id", "left").withColumn("live", F.coalesce("live", F.lit(0)))


def _reports(spark, d):
    """A report on every third run, of which every seventh is revoked."""
    o = read_table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("rep-"), key.cast("string")).alias("id"),
        key.alias("request_id"),
        F.concat(F.lit("tok"), key.cast("string")).alias("share_token"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 2 == 0, F.concat(F.lit("Title "), key.cast("string"))).alias("title"),
        F.when(key % 7 == 0, _now()).alias("revoked_at"),
    )


_REPORTS_SQL = f"""reports AS (SELECT 'rep-' || o_orderkey AS id, o_orderkey AS request_id, 'tok' || o_orderkey AS share_token, o_orderdate AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 'Title ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN {_NOW} END AS revoked_at FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"WITH {_REPORTS_SQL}, {px.RUNS_SQL} SELECT id, request_id FROM reports WHERE request_id IN (SELECT request_id FROM runs WHERE status = 'failed')")
def reports_of_runs(spark, d):
    return lookups.reports_of(_reports(spark, d), px.runs(spark, d).filter("status = 'failed'")).select("id", "request_id")


@query(f"""WITH {_REPORTS_SQL}, {px.RUNS_SQL}, {px.JOURNEYS_SQL}, r AS (SELECT request_id, journey_id, row_number() OVER (PARTITION BY journey_id ORDER BY created_at DESC, request_id DESC) AS place FROM runs)
SELECT client_id, reports.id, reports.request_id FROM reports JOIN r ON r.request_id = reports.request_id JOIN live ON live.journey_id = r.journey_id WHERE place <= 4""")
def client_reports(spark, d):
    """Reports of every client, on the last four runs of each journey, so that the bound is met."""
    return lookups.client_reports(_reports(spark, d), px.runs(spark, d), px.journeys(spark, d), k=4).select("client_id", "id", "request_id")


@query(f"""WITH {_REPORTS_SQL}, {px.RUNS_SQL}, {px.JOURNEYS_SQL} SELECT reports.id, coalesce(n_name, 'Unnamed client') AS client_name, coalesce(title, 'Accessibility audit — ' || coalesce(n_name, 'report')) AS title, runs.created_at AS run_created_at
FROM reports JOIN runs ON runs.request_id = reports.request_id LEFT JOIN journeys ON journeys.id = runs.journey_id LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = journeys.client_id AND n_nationkey % 4 <> 0 WHERE share_token = 'tok33' AND revoked_at IS NULL""")
def shared_report(spark, d):
    found = views.shared_report(_reports(spark, d), px.runs(spark, d), px.journeys(spark, d), px.clients(spark, d).filter("int(id) % 4 <> 0"), "tok33")
    return found.select("id", "client_name", "title", "run_created_at")


@query("""SELECT 'k' || p_partkey AS finding_key, CASE p_partkey % 3 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'assigned' ELSE 'accepted-risk' END AS state FROM part WHERE p_partkey % 4 = 1""")
def client_triage(spark, d):
    key = F.col("p_partkey")
    state = F.when(key % 3 == 0, "dismissed").when(key % 3 == 1, "assigned").otherwise("accepted-risk")
    marks = read_table(spark, d, "part").select(F.concat(F.lit("c"), (key % 4).cast("string")).alias("client_id"), F.concat(F.lit("k"), key.cast("string")).alias("finding_key"), state.alias("state"), F.make_timestamp_ntz(F.lit(2024), F.lit(1), key % 28 + 1, F.lit(0), F.lit(0), F.lit(0)).alias("updated_at"))
    return lookups.triage_of(marks, "c1").select("finding_key", "state")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM supplier WHERE lower(s_name) = lower(replace(c_name, 'Customer', 'SUPPLIER'))) AS duplicate FROM customer")
def duplicate_names(spark, d):
    wanted = read_table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER")), F.lit(" ")).alias("name"))
    return lookups.names_taken(wanted, read_table(spark, d, "supplier").select(F.col("s_name").alias("name"))).select("c_custkey", "duplicate")


# --- sorts, unions, counters ----------------------------------------------------------------


@query(f"""WITH {px.FINDINGS_SQL}, r AS (SELECT request_id, position, lower(code) AS low, CASE WHEN position % 2 = 0 THEN upper(code) ELSE code END AS code,
  CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END AS rank FROM findings)
SELECT request_id, string_agg(code || '/' || position, ',' ORDER BY rank, low, code <> low, position) AS codes FROM r GROUP BY 1""")
def finding_lists(spark, d):
    """Findings of every run, most severe first, then by code as readers sort it: case counts last."""
    code = F.when(F.col("position") % 2 == 0, F.upper("code")).otherwise(F.col("code"))
    rows = px.findings(spark, d).withColumn("code", code)
    order = ops.Window.partitionBy("request_id").orderBy(*views.finding_order(), "position")
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("told", F.concat_ws("/", "code", F.col("position").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("at", "told")))
    return placed.groupBy("request_id").agg(F.array_join(F.transform(listed, lambda x: x["told"]), ",").alias("codes"))


@query(f"""WITH {px.FINDINGS_SQL}, r AS (SELECT request_id, position, CASE WHEN position % 5 = 0 THEN 'odd' ELSE severity END AS severity FROM findings)
SELECT request_id, position, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'needs-review' THEN 3 ELSE 5 END, position) AS INTEGER) AS place FROM r""")
def report_lists(spark, d):
    rows = px.findings(spark, d).withColumn("severity", F.when(F.col("position") % 5 == 0, "odd").otherwise(F.col("severity")))
    # runs repeat positions in this data; the order within one is free
    order = ops.Window.partitionBy("request_id").orderBy(*views.report_order())
    return rows.withColumn("place", F.row_number().over(order)).select("request_id", "position", "place")


@query(f"""WITH {px.FINDINGS_SQL} SELECT request_id, position, 0 AS part, selector, CAST(NULL AS DOUBLE) AS confidence FROM findings WHERE source = 'deterministic'
UNION ALL SELECT request_id, position, 1, NULL, (request_id % 10) / 10.0 FROM findings WHERE source = 'ai-advisory' AND (request_id % 10) / 10.0 >= 0.7""")
def findings_joined(spark, d):
    f = px.findings(spark, d)
    advisory = f.filter("source = 'ai-advisory'").select("request_id", "position", ((F.col("request_id") % 10) / 10).alias("confidence"))
    return views.all_findings(f.filter("source = 'deterministic'").select("request_id", "position", "selector"), views.confident(advisory))


@query(f"""WITH {px.RUNS_SQL}, {px.FINDINGS_SQL}, k AS (SELECT *, source || ':' || code || ':' || page_url || ':' || coalesce(selector, '') AS finding_key FROM findings),
old AS (SELECT DISTINCT finding_key FROM k JOIN runs ON runs.request_id = k.request_id WHERE created_at < TIMESTAMP '1993-01-15')
SELECT request_id, position, k.finding_key, old.finding_key IS NOT NULL AS in_baseline FROM k LEFT JOIN old ON old.finding_key = k.finding_key""")
def baseline_flags(spark, d):
    """All findings with whether one of the same key was found before a day."""
    f = px.findings(spark, d).withColumn("client_id", F.lit("c"))
    marks = f.limit(0).select("client_id", F.lit("").alias("finding_key"), F.lit("").alias("state"), F.lit("").alias("note"))
    before = f.join(px.runs(spark, d).filter(F.col("created_at") < F.lit("1993-01-15").cast("timestamp_ntz")).select("request_id"), "request_id", "left_semi")
    return views.finding_views(f, marks, baseline=before).select("request_id", "position", "finding_key", "in_baseline")


@query(f"""WITH {px.PAGES_SQL} SELECT request_id, max(coalesce(duration_ms, 0)) AS slowest_ms FROM pages_of_runs GROUP BY 1""")
def slowest_pages(spark, d):
    return lookups.slowest_or_zero(px.pages(spark, d))


@query(f"""WITH {px.PAGES_SQL}, s AS (SELECT request_id, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS pages_ms, count(*) FILTER (duration_ms IS NULL) AS untimed, count(*) FILTER (request_id % 5 = 0 AND duration_ms > 0) AS scan_over_page FROM pages_of_runs GROUP BY 1)
SELECT s.request_id, pages_ms, untimed, scan_over_page, o_totalprice < pages_ms * 500 AS journey_short FROM s JOIN orders ON o_orderkey = request_id WHERE untimed > 0 OR scan_over_page > 0 OR o_totalprice < pages_ms * 500""")
def run_timing(spark, d):
    """Runs whose times contradict each other; a price stands for the journey's time."""
    runs = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_totalprice") / 500).alias("journey_ms"))
    pages = px.pages(spark, d).withColumn("scan_ms", F.col("duration_ms") + F.when((F.col("request_id") % 5 == 0) & (F.col("duration_ms") > 0), 1).otherwise(0))
    return lookups.timing_problems(runs, pages)


@query("SELECT count(*) AS settings, count(*) FILTER (p_size % 3 = 0) AS degraded FROM part")
def settings_degraded(spark, d):
    return lookups.degraded_count(read_table(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False).alias("degraded")))


@query(f"""WITH {px.RUNS_SQL} SELECT count(*) FILTER (status = 'running' AND coalesce(started_at, created_at) < TIMESTAMP '1997-06-01' - INTERVAL 360 SECOND) AS rows_affected FROM runs""")
def sweep_count(spark, d):
    return catalog.tick(px.runs(spark, d), px.journeys(spark, d), F.lit("1997-06-01").cast("timestamp_ntz"))["closed"]


@query(f"""WITH {px.JOURNEYS_SQL}, due AS (SELECT id FROM journeys WHERE schedule <> 'off' AND archived_at IS NULL AND target_url IS NOT NULL AND steps <> '[]' AND coalesce(schedule_hour, 3) = 3
  AND (last_scheduled_at IS NULL OR last_scheduled_at < CASE WHEN schedule = 'weekly' THEN {_NOW} - INTERVAL 6 DAY ELSE {_NOW} - INTERVAL 23 HOUR END) ORDER BY last_scheduled_at NULLS FIRST, id LIMIT 3)
SELECT j.id, CASE WHEN due.id IS NULL THEN last_scheduled_at WHEN j.id % 2 = 0 THEN NULL ELSE {_NOW} END AS last_scheduled_at FROM journeys j LEFT JOIN due ON due.id = j.id""")
def scheduled_turn(spark, d):
    """Journeys after an hourly turn: three claimed, of which those with even ids could not be started and are free again."""
    turn = catalog.tick(px.runs(spark, d), px.journeys(spark, d), _now())
    return catalog.release_claims(turn["journeys"], turn["due"].filter("id % 2 = 0")).select("id", "last_scheduled_at")


@query(f"""WITH RECURSIVE {px.PAGES_SQL}, p AS (SELECT request_id, position, CASE WHEN position % 4 <> 0 THEN request_id % 7 * 100000 + position * 150000 + coalesce(duration_ms, 0) % 97 END AS bytes FROM (SELECT DISTINCT ON (request_id, position) * FROM pages_of_runs ORDER BY request_id, position, url, duration_ms)),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position DESC) AS i FROM p WHERE bytes IS NOT NULL),
w AS (SELECT request_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS position, CAST(0 AS BIGINT) AS spent, false AS fits FROM (SELECT DISTINCT request_id FROM o)
  UNION ALL SELECT o.request_id, o.i, CAST(o.position AS INTEGER), CAST(CASE WHEN spent + bytes <= 1200000 THEN spent + bytes ELSE spent END AS BIGINT), spent + bytes <= 1200000 FROM w JOIN o ON o.request_id = w.request_id AND o.i = w.i + 1)
SELECT p.request_id, p.position, fits AS inlined FROM p LEFT JOIN w ON w.request_id = p.request_id AND w.position = p.position""")
def inline_pictures(spark, d):
    """Which pictures of a run fit the budget, last page first; those that don't fit use nothing."""
    order = ops.Window.partitionBy("request_id", "position").orderBy("url", F.asc_nulls_last("duration_ms"))
    pages = px.pages(spark, d).withColumn("n", F.row_number().over(order)).filter("n = 1")
    size = F.when(F.col("position") % 4 != 0, F.col("request_id") % 7 * 100_000 + F.col("position") * 150_000 + F.coalesce("duration_ms", F.lit(0)) % 97)
    return lookups.inline_budget(pages.withColumn("bytes", size.cast("long")), 1_200_000).select("request_id", "position", "inlined")


@query("""SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS INTEGER) AS failed, CAST(page_id % 4 AS INTEGER) AS passed, CAST(0 AS INTEGER) AS incomplete FROM pages""")
def scan_counts(spark, d):
    """Nodes failed over all rules of a scan made from the page's paragraphs, and rules passed."""
    n = F.size(F.split("html", "<p>")) - 1
    nodes = F.array_join(F.array_repeat(F.lit('{"html":"<p>"}'), n), ",")
    half = F.concat(F.lit('{"violations":[{"id":"a","nodes":['), nodes, F.lit(']},{"id":"b"}],"incomplete":[{"id":"c","nodes":[]}]}'))
    passes = F.when(F.col("page_id") % 4 == 0, '{"n":1}').otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"id":"x"}'), (F.col("page_id") % 4).cast("int")), ","), F.lit("]")))
    rows = read_table(spark, d, "pages").select("page_id", scans.parse_scan(half).alias("scan"), lookups.pass_nodes(passes).alias("pass_count"))
    return rows.select("page_id", lookups.rule_counts(F.col("scan")).alias("c")).select("page_id", "c.failed", "c.passed", "c.incomplete")


# --- artifacts ------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size % 2 = 0 AS screenshot, p_size % 3 = 0 AS dom, p_size % 5 = 0 AS ax_tree, p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 AS filled, CASE WHEN p_size % 3 = 0 THEN 'd' || p_partkey END AS link,
  CASE WHEN p_partkey % 4 = 3 THEN 'unknown_page' WHEN p_partkey % 4 = 2 THEN 'run_not_found' WHEN p_size % 3 = 0 THEN 'd' || p_partkey ELSE 'artifact_not_captured' END AS answer FROM part""")
def artifact_maps(spark, d):
    """Uploaded artifacts of a page as a map, its flags, and what a request for one is answered."""
    key, size = F.col("p_partkey"), F.col("p_size")
    named = lambda letter, n: F.when(size % n == 0, F.concat(F.lit(letter), key.cast("string")))
    files = F.create_map(F.lit("screenshotPath"), named("s", 2), F.lit("domSnapshotPath"), named("d", 3), F.lit("axTreePath"), named("a", 5))
    links = lookups.artifact_links(files, ["screenshotPath", "domSnapshotPath", "axTreePath"])
    rows = read_table(spark, d, "part").select("p_partkey", links.alias("links"))
    rows = rows.withColumn("pages", F.array(F.struct(F.lit(None).cast("map<string,string>").alias("artifacts")), F.struct(F.col("links").alias("artifacts"))))
    position = F.when(key % 4 == 3, -1).when(key % 4 == 2, 9).otherwise(1)
    flags = lookups.artifact_flags(F.col("links"))
    return rows.select("p_partkey", flags["screenshot"].alias("screenshot"), flags["dom"].alias("dom"), flags["ax_tree"].alias("ax_tree"), lookups.holds_artifacts(F.col("links")).alias("filled"), F.try_element_at("links", F.lit("domSnapshotUrl")).alias("link"), lookups.artifact_of_page(rows, position, "domSnapshotUrl").alias("answer"))


@query("""SELECT o_orderpriority AS folder, count(*) AS scanned, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey % 9 <> 0) AS expired FROM orders GROUP BY 1""")
def expired_files(spark, d):
    listing = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("uploaded_at"))
    gone = lookups.expired_blobs(listing, F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("folder").agg(F.count("*").alias("expired"))
    return listing.groupBy("folder").agg(F.count("*").alias("scanned")).join(gone, "folder", "left").withColumn("expired", F.coalesce("expired", F.lit(0)))


# --- writes ---------------------------------------------------------------------------------


@query(f"""WITH {_OPERATORS_SQL}, fresh AS (SELECT 'new-' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name || '@Example.ORG') ELSE 'n' || s_suppkey || '@example.org' END AS email, 'Re ' || s_name AS name, 'h' || s_suppkey AS password_hash FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(o.id, f.id) AS id, coalesce(o.email, f.email) AS email, coalesce(f.name, o.name) AS name, coalesce(f.password_hash, o.password_hash) AS password_hash, coalesce(session_epoch, 0) AS session_epoch,
  CASE WHEN f.id IS NULL THEN disabled_at END AS disabled_at, coalesce(o.created_at, {_NOW}) AS created_at, CASE WHEN f.id IS NULL THEN o.updated_at ELSE {_NOW} END AS updated_at FROM operators o FULL JOIN fresh f ON lower(f.email) = lower(o.email)""")
def operators_saved(spark, d):
    key = F.col("s_suppkey")
    s = read_table(spark, d, "supplier").filter("s_suppkey % 3 = 0")
    email = F.when(key % 2 == 0, F.upper(F.concat("s_name", F.lit("@Example.ORG")))).otherwise(F.concat(F.lit("n"), key.cast("string"), F.lit("@example.org")))
    fresh = s.select(F.concat(F.lit("new-"), key.cast("string")).alias("id"), email.alias("email"), F.concat(F.lit("Re "), "s_name").alias("name"), F.concat(F.lit("h"), key.cast("string")).alias("password_hash"))
    return catalog.upsert_operators(_operators(spark, d), fresh, _now())


@query(f"""WITH {_OPERATORS_SQL} SELECT id, CAST(session_epoch + CASE WHEN s_suppkey % 5 IN (0, 1) THEN 1 ELSE 0 END AS INTEGER) AS session_epoch,
  CASE WHEN s_suppkey % 5 = 0 THEN {_NOW} WHEN s_suppkey % 5 = 1 THEN NULL ELSE disabled_at END AS disabled_at FROM operators""")
def operators_disabled(spark, d):
    o = _operators(spark, d)
    some = lambda k: read_table(spark, d, "supplier").filter(F.col("s_suppkey") % 5 == k).select(F.concat(F.lit("op-"), F.col("s_suppkey").cast("string")).alias("id"))
    out = catalog.set_disabled(catalog.set_disabled(o, some(0), _now()), some(1), _now(), disabled=False)
    return out.select("id", F.col("session_epoch").cast("int").alias("session_epoch"), "disabled_at")


@query(f"""WITH {px.JOURNEYS_SQL}, {_REPORTS_SQL} SELECT 'journey' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN id = 5 THEN '2024-01-20 03:30:00' ELSE archived_at END AS closed_at FROM journeys
UNION ALL SELECT 'report', id, CASE WHEN id = 'rep-3' OR revoked_at IS NOT NULL THEN '2024-01-20 03:30:00' END FROM reports
UNION ALL SELECT 'mark', 'k' || p_partkey, NULL FROM part WHERE p_partkey % 3 <> 0""")
def closed_rows(spark, d):
    """A journey archived, a report revoked, triage marks cleared."""
    told = lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("closed_at")
    journeys = catalog.archive_journey(px.journeys(spark, d), 5, _now()).select(F.lit("journey").alias("kind"), F.col("id").cast("string").alias("id"), told("archived_at"))
    reports = catalog.revoke_report(_reports(spark, d), "rep-3", _now()).select(F.lit("report").alias("kind"), "id", told("revoked_at"))
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("finding_key")
    part = read_table(spark, d, "part")
    marks = catalog.clear_triage(part.select(F.lit("c").alias("client_id"), key), part.filter("p_partkey % 3 = 0").select(F.lit("c").alias("client_id"), key))
    return journeys.unionByName(reports).unionByName(marks.select(F.lit("mark").alias("kind"), F.col("finding_key").alias("id"), F.lit(None).cast("string").alias("closed_at")))


@query("""WITH last AS (SELECT max(event_id) AS n FROM events WHERE event_type <> 'error') SELECT event_id AS id, event_type AS action FROM events WHERE event_type <> 'error'
UNION ALL SELECT n + row_number() OVER (ORDER BY ts, event_id), 'error' FROM events, last WHERE event_type = 'error'""")
def events_appended(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.struct("ts", "event_id").alias("created_at"))
    return catalog.append_events(e.filter("action <> 'error'"), e.filter("action = 'error'")).select("id", "action")


@query("""WITH old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS owner FROM customer WHERE c_custkey % 3 <> 0), fresh AS (SELECT c_custkey AS id, 'Re ' || c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'new' END AS owner FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(f.id, o.id) AS id, coalesce(f.name, o.name) AS name, coalesce(f.owner, o.owner) AS owner FROM fresh f FULL JOIN old o ON o.id = f.id""")
def clients_saved(spark, d):
    """Clients written again: the name is the new one, an owner stays where none is given."""
    c = read_table(spark, d, "customer")
    key = F.col("c_custkey")
    old = c.filter("c_custkey % 3 <> 0").select(key.alias("id"), F.col("c_name").alias("name"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("owner"))
    fresh = c.filter("c_custkey % 4 <> 0").select(key.alias("id"), F.concat(F.lit("Re "), "c_name").alias("name"), F.when(key % 5 == 0, "new").alias("owner"))
    return catalog.upsert_last(old, fresh, ["id"], fallback=["owner"])


# --- crawl ----------------------------------------------------------------------------------

#: Links of a page in the test graph: enough, and on enough levels, that every bound is met.
_FAN, _SITE_PAGES, _LINKS = 4, 12, 3


def _graph(spark, d):
    """Customers as pages with four links each; every seventh page cannot be read."""
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    n = c.count()
    to = F.expr(f"(src * 5 + position * position * 3 + position) % {n}")
    links = c.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(_FAN - 1)))).select("src", "position", to.alias("dst"))
    failed = c.filter("src % 7 = 3").select(F.col("src").alias("page"), F.lit("timeout").alias("message"))
    return catalog.crawl_pages(links, c.select(F.col("src").alias("site"), F.col("src").alias("page")), failed, max_pages=_SITE_PAGES, max_links=_LINKS, max_errors=2)


def _crawl_sql() -> str:
    """The crawl as a queue, level by level: per level the links in order, the first to each new page, and the bound on what may wait."""
    out = f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), links AS (SELECT c_custkey AS src, position, (c_custkey * 5 + position * position * 3 + position) % n AS dst FROM customer, n, range(0, {_LINKS}) r(position)),
l0 AS (SELECT c_custkey AS site, c_custkey AS page, 0 AS depth, CAST(0 AS BIGINT) AS seq, true AS followed, c_custkey % 7 = 3 AS bad FROM customer)"""
    seen = "SELECT * FROM l0"
    for k in (1, 2, 3):
        # the place of a link in its level; lost: failures among what was taken before the page that links
        out += f""",
s{k} AS ({seen}),
m{k} AS (SELECT l.site, x.dst AS page, l.seq AS origin, x.position, (SELECT count(*) FROM s{k} b WHERE b.site = l.site AND b.followed AND b.bad AND b.seq < l.seq) AS lost FROM l{k - 1} l JOIN links x ON x.src = l.page WHERE l.followed AND NOT l.bad AND NOT EXISTS (SELECT 1 FROM s{k} b WHERE b.site = l.site AND b.page = x.dst)),
f{k} AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY origin, position) AS i FROM (SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY origin, position) AS first FROM m{k}) WHERE first = 1),
t{k} AS (SELECT site, count(*) FILTER (followed) AS taken, max(seq) AS last FROM s{k} GROUP BY site),
w{k} AS (SELECT site, CAST(0 AS BIGINT) AS i, taken, false AS follows FROM t{k} UNION ALL SELECT f.site, f.i, CASE WHEN w.taken < {_SITE_PAGES} + f.lost THEN w.taken + 1 ELSE w.taken END, w.taken < {_SITE_PAGES} + f.lost FROM w{k} w JOIN f{k} f ON f.site = w.site AND f.i = w.i + 1),
l{k} AS (SELECT f.site, f.page, {k} AS depth, last + f.i AS seq, w.follows AS followed, f.page % 7 = 3 AS bad FROM f{k} f JOIN w{k} w ON w.site = f.site AND w.i = f.i JOIN t{k} t ON t.site = f.site)"""
        seen += f" UNION ALL SELECT * FROM l{k}"
    return out + f", every AS ({seen})"


@query(_crawl_sql() + " SELECT site, page, depth, CAST(row_number() OVER (PARTITION BY site ORDER BY seq) - 1 AS INTEGER) AS seq FROM every WHERE followed AND NOT bad")
def crawl_visits(spark, d):
    """Pages of every site's crawl in the order in which they are visited, within the bounds."""
    return _graph(spark, d)[0]


@query(_crawl_sql() + """ SELECT site, count(*) AS seen, CASE WHEN bool_or(NOT followed) THEN 'url-cap' END AS truncated, CAST(least(count(*) FILTER (followed AND bad), 2) AS INTEGER) AS listed,
  CAST(greatest(count(*) FILTER (followed AND bad) - 2, 0) AS INTEGER) AS errors_omitted FROM every GROUP BY site""")
def crawl_outcomes(spark, d):
    return _graph(spark, d)[1].select("site", "seen", "truncated", F.size("errors").alias("listed"), F.col("errors_omitted").cast("int").alias("errors_omitted"))


def _crawled(spark, d):
    """Pages of crawls, one row a page: sites by supplier, some pages on another host, some with very long paths."""
    p = read_table(spark, d, "part")
    key = F.col("p_partkey")
    host = F.when(key % 9 == 4, "other.test").otherwise("Site.test")
    path = F.when(key % 11 == 5, F.lit("x" * 600)).otherwise(key.cast("string"))
    return p.select((key % 3).alias("site"), F.concat(F.lit("https://"), host, F.lit("/"), path, F.lit("?k="), key.cast("string")).alias("url"), (F.col("p_size") % 4).alias("depth"), key.alias("seq"), F.lit("https://site.test/").alias("target_url"))


_CRAWLED_SQL = """crawled AS (SELECT p_partkey % 3 AS site, p_size % 4 AS depth, p_partkey AS seq, CASE WHEN p_partkey % 9 <> 4 THEN '/' || CASE WHEN p_partkey % 11 = 5 THEN repeat('x', 600) ELSE CAST(p_partkey AS VARCHAR) END || '?k=' || p_partkey END AS step_path FROM part),
marked AS (SELECT *, CASE WHEN step_path IS NULL THEN 'other_host' WHEN length(step_path) > 512 THEN 'too_long' END AS blocked_by FROM crawled)"""


@query(f"WITH {_CRAWLED_SQL} SELECT site, depth, seq, step_path, blocked_by FROM marked")
def crawl_screen(spark, d):
    return lookups.crawl_rows(_crawled(spark, d)).select("site", "depth", "seq", "step_path", "blocked_by")


@query(f"""WITH {_CRAWLED_SQL}, taken AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, seq) AS display FROM marked WHERE blocked_by IS NULL)
SELECT site, seq, CAST(display AS INTEGER) AS display, CAST(row_number() OVER (PARTITION BY site ORDER BY seq) AS INTEGER) AS step FROM taken WHERE display <= 50""")
def crawl_steps(spark, d):
    """What selecting every page takes, and the steps that come of it, in crawl order."""
    taken = lookups.takeable_pages(lookups.crawl_rows(_crawled(spark, d)))
    return lookups.chosen_steps(taken, taken.select("site", "seq"), ["site", "seq"]).select("site", "seq", "display", "step")


# --- functions without a query so far -------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '#' ELSE url END AS href, CASE page_id % 4 WHEN 0 THEN 'true true false' WHEN 1 THEN 'false false true' ELSE 'false false false' END AS able,
  lower(trim(regexp_replace('✓ ' || regexp_extract(url, '^https?://([^/.]*)', 1) || ' 42!', '[^A-Za-z ]', '', 'g'))) AS words, CASE WHEN length(regexp_extract(url, '^https?://([^/?#]*)', 1)) > 12 THEN substr(regexp_extract(url, '^https?://([^/?#]*)', 1), 1, 12) || '…' ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END AS host FROM pages""")
def screen_words(spark, d):
    url, k = F.col("url"), F.col("page_id")
    platform = F.when(k % 4 == 0, "react").when(k % 4 == 1, "wordpress").when(k % 4 == 2, "generic").otherwise("unknown")
    able = tx.capabilities(platform)
    told = F.concat(F.lit("✓ "), F.regexp_extract(url, r"^https?://([^/.]*)", 1), F.lit(" 42!"))
    odd = F.when(k % 3 == 0, F.concat(F.lit("javascript:"), url)).otherwise(url)
    return read_table(spark, d, "pages").select("page_id", ux.safe_href(odd).alias("href"), F.concat_ws(" ", *[able[f].cast("string") for f in ("spa_navigation", "component_source", "cms_template")]).alias("able"), tx.verdict_words(told).alias("words"), tx.host_words(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), 12).alias("host"))


@query("""WITH a AS (SELECT c_custkey, c_custkey % 8 AS k, (c_custkey * 7919) % 65536 // 256 AS one, (c_custkey * 7919) % 256 AS two FROM customer)
SELECT c_custkey, CASE WHEN k IN (0, 2, 4, 5, 7) THEN true WHEN k = 3 THEN false ELSE one IN (0, 10, 127) OR one >= 224 OR (one = 100 AND two BETWEEN 64 AND 127) OR (one = 169 AND two = 254)
  OR (one = 172 AND two BETWEEN 16 AND 31) OR (one = 192 AND two = 168) OR (one = 198 AND two IN (18, 19)) END AS blocked FROM a""")
def ipv6_blocklist(spark, d):
    """Addresses of version 6: local ones, and those that hold a version 4 address, whose ranges then decide."""
    k, low = F.col("c_custkey") % 8, F.col("c_custkey") * 7919 % 65536
    quad = F.concat_ws(".", F.shiftright(low, 8).cast("string"), (low % 256).cast("string"), F.lit("1"), F.lit("1"))
    hexa = F.lower(F.hex(low))
    kinds = [F.lit("::1"), F.concat(F.lit("::ffff:"), quad), F.concat(F.lit("fd00::"), hexa), F.concat(F.lit("2001:db8:"), hexa, F.lit("::1")), F.concat(F.lit("fe80::"), hexa, F.lit("%eth0")), F.lit("no address"), F.concat(F.lit("2002:"), hexa, F.lit(":101::1")), F.concat(F.lit("ff02::"), hexa)]
    address = F.element_at(F.array(*kinds), (k + 1).cast("int")).alias("address")
    # made before they are dealt out: a small file is one partition, and an address is named many times
    rows = read_table(spark, d, "customer").select("c_custkey", address).repartition("c_custkey")
    return rows.select("c_custkey", ux.blocked_address(F.col("address")).alias("blocked"))


@query("""SELECT o_orderpriority AS environment, array_to_string(list_sort(list_distinct(list(CASE o_orderstatus WHEN 'F' THEN 'login' WHEN 'O' THEN 'search' ELSE 'filter' END))), ',') AS actions FROM orders GROUP BY 1""")
def actions_used(spark, d):
    """Distinct actions over all runs' lists of actions, by environment."""
    action = fx.lookup(F.col("o_orderstatus"), {"F": "login", "O": "search"}, "filter")
    rows = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("environment"), F.array(action, action).alias("actions"))
    return catalog.distinct_actions(rows, "actions", ["environment"]).select("environment", F.array_join("actions", ",").alias("actions"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS anchor, 0 AS n FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN w.n > 0 AND e.us - w.anchor < 259200000000 THEN w.anchor ELSE e.us END, CASE WHEN w.n > 0 AND e.us - w.anchor < 259200000000 THEN w.n + 1 ELSE 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, n AS hits FROM w WHERE i > 0""")
def ttl_counts(spark, d):
    """Hits of every user, counted from the first one on until three days later the counter is gone."""
    e = read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    return ttl_counter(e, 259_200)


@query(f"""WITH {px.PAGES_SQL}, {px.FINDINGS_SQL}, p AS (SELECT DISTINCT ON (request_id, url) request_id, url, position FROM pages_of_runs ORDER BY request_id, url, position),
f AS (SELECT request_id, page_url, string_agg(code, ',' ORDER BY position, code) AS codes FROM findings GROUP BY 1, 2)
SELECT coalesce(p.request_id, f.request_id) AS request_id, coalesce(url, page_url) AS page_url, p.position AS page_place, coalesce(codes, '') AS codes FROM p FULL JOIN f ON f.request_id = p.request_id AND f.page_url = p.url""")
def findings_on_pages(spark, d):
    """Pages with their findings as a list, and after them the pages that only findings name."""
    first = ops.Window.partitionBy("request_id", "url").orderBy("position")
    pages = px.pages(spark, d).withColumn("n", F.row_number().over(first)).filter("n = 1")
    out = views.findings_by_page(pages, px.findings(spark, d).select("request_id", "page_url", "position", "code"))
    return out.select("request_id", "page_url", "page_place", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))

