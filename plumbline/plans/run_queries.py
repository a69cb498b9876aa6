"""Queries over runs: diffs, latest per group, scores, gates, summaries, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalog, diff, views
from plumbline.operators import runs as ops
from plumbline.plans import proxies as px

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = diff.keyed(px.event_findings(spark, d))
    pivot = F.lit(px.PIVOT).cast("timestamp_ntz")
    return rows.filter(F.col("ts") >= pivot), rows.filter(F.col("ts") < pivot)


@query(f"WITH {px.EVENTS_SQL} SELECT event_id, finding_key, severity FROM now_f WHERE finding_key NOT IN (SELECT finding_key FROM base_f)")
def diff_new(spark, d):
    now, base = _sides(spark, d)
    return diff.new_findings(now, base).select("event_id", "finding_key", "severity")


@query(f"WITH {px.EVENTS_SQL} SELECT event_id, finding_key, severity FROM base_f WHERE finding_key NOT IN (SELECT finding_key FROM now_f)")
def diff_resolved(spark, d):
    now, base = _sides(spark, d)
    return diff.resolved_findings(now, base).select("event_id", "finding_key", "severity")


@query(f"WITH {px.EVENTS_SQL} SELECT code, count(*) AS unchanged FROM now_f WHERE finding_key IN (SELECT finding_key FROM base_f) GROUP BY code")
def diff_unchanged(spark, d):
    now, base = _sides(spark, d)
    return diff.unchanged_findings(now, base).groupBy("code").agg(F.count("*").alias("unchanged"))


@query(f"""WITH {px.EVENTS_SQL},
fresh AS (SELECT code, severity FROM now_f WHERE finding_key NOT IN (SELECT finding_key FROM base_f)),
gone AS (SELECT code FROM base_f WHERE finding_key NOT IN (SELECT finding_key FROM now_f)),
kept AS (SELECT code FROM now_f WHERE finding_key IN (SELECT finding_key FROM base_f)),
codes AS (SELECT DISTINCT code FROM event_findings)
SELECT code, (SELECT count(*) FROM fresh f WHERE f.code = c.code) AS new_findings, (SELECT count(*) FROM gone f WHERE f.code = c.code) AS resolved_findings,
  (SELECT count(*) FROM kept f WHERE f.code = c.code) AS unchanged_findings,
  CASE WHEN EXISTS (SELECT 1 FROM fresh f WHERE f.code = c.code AND severity = 'critical') THEN 'fail'
    WHEN EXISTS (SELECT 1 FROM fresh f WHERE f.code = c.code) THEN 'warn' ELSE 'none' END AS status
FROM codes c""")
def diff_status(spark, d):
    now, base = _sides(spark, d)
    return diff.diff_status(now, base, ["code"])


@query(f"""WITH {px.RUNS_SQL}, {px.FINDINGS_SQL}, {px.INTENTS_SQL},
pairs AS (SELECT * FROM (SELECT request_id, lag(request_id) OVER (PARTITION BY journey_id, environment ORDER BY created_at, request_id) AS baseline_id FROM runs) WHERE baseline_id IS NOT NULL),
able AS (SELECT p.*, coalesce(a.form = b.form AND a.path = b.path, false) AND a.ruleset IS NOT DISTINCT FROM b.ruleset AS ok FROM pairs p JOIN intents a ON a.request_id = p.request_id JOIN intents b ON b.request_id = p.baseline_id),
k AS (SELECT request_id, 'deterministic:' || code || ':' || page_url || ':' || coalesce(selector, '') AS finding_key, severity FROM findings WHERE source = 'deterministic'),
fresh AS (SELECT p.request_id, count(*) AS n, bool_or(severity = 'critical') AS critical FROM able p JOIN k ON k.request_id = p.request_id WHERE ok AND NOT EXISTS (SELECT 1 FROM k b WHERE b.request_id = p.baseline_id AND b.finding_key = k.finding_key) GROUP BY 1),
kept AS (SELECT p.request_id, count(*) AS n FROM able p JOIN k ON k.request_id = p.request_id WHERE ok AND EXISTS (SELECT 1 FROM k b WHERE b.request_id = p.baseline_id AND b.finding_key = k.finding_key) GROUP BY 1),
gone AS (SELECT p.request_id, count(*) AS n FROM able p JOIN k ON k.request_id = p.baseline_id WHERE ok AND NOT EXISTS (SELECT 1 FROM k c WHERE c.request_id = p.request_id AND c.finding_key = k.finding_key) GROUP BY 1)
SELECT p.request_id, p.baseline_id, CASE WHEN NOT ok THEN 'incomparable' WHEN critical THEN 'fail' WHEN fresh.n > 0 THEN 'warn' ELSE 'none' END AS status,
  coalesce(fresh.n, 0) AS new_findings, coalesce(gone.n, 0) AS resolved_findings, coalesce(kept.n, 0) AS unchanged_findings
FROM able p LEFT JOIN fresh ON fresh.request_id = p.request_id LEFT JOIN kept ON kept.request_id = p.request_id LEFT JOIN gone ON gone.request_id = p.request_id""")
def regression_history(spark, d):
    """Every run against the one before it in its journey and environment, in one plan; runs that walked other steps are incomparable."""
    pairs = ops.with_baseline(px.runs(spark, d), ["journey_id", "environment"]).select("request_id", "baseline_id").filter("baseline_id is not null")
    intents = px.intents(spark, d)
    base = intents.select(F.col("request_id").alias("baseline_id"), F.col("steps").alias("old_steps"), F.col("ruleset").alias("old_ruleset"))
    pairs = pairs.join(intents, "request_id").join(base, "baseline_id")
    pairs = pairs.withColumn("comparable", diff.comparable(F.col("steps"), F.col("old_steps"), F.col("ruleset"), F.col("old_ruleset")))
    return diff.regression_of_runs(pairs, diff.keyed(px.findings(spark, d)))


def _nth_sql(n: int) -> str:
    return f"""WITH {px.RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY created_at DESC, request_id DESC) AS n FROM runs)
SELECT journey_id, request_id, created_at, status FROM r WHERE n = {n}"""


@query(_nth_sql(1))
def latest_per_group(spark, d):
    return ops.nth_per_group(px.runs(spark, d), ["journey_id"]).select("journey_id", "request_id", "created_at", "status")


@query(_nth_sql(2))
def previous_per_group(spark, d):
    return ops.nth_per_group(px.runs(spark, d), ["journey_id"], 2).select("journey_id", "request_id", "created_at", "status")


@query(f"""WITH {px.RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY created_at DESC, request_id DESC) AS place FROM runs)
SELECT journey_id, request_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def last_k_per_group(spark, d):
    return ops.last_k_per_group(px.runs(spark, d), ["journey_id"], 5).select("journey_id", "request_id", "place")


@query(f"WITH {px.RUNS_SQL} SELECT request_id, lag(request_id) OVER (PARTITION BY journey_id, environment ORDER BY created_at, request_id) AS baseline_id FROM runs")
def baseline_of_runs(spark, d):
    return ops.with_baseline(px.runs(spark, d), ["journey_id", "environment"]).select("request_id", "baseline_id")


@query(f"WITH {px.RUNS_SQL} SELECT request_id, journey_id, status, created_at FROM runs WHERE status = 'complete' AND environment = '1-URGENT' ORDER BY created_at DESC, request_id DESC LIMIT 20")
def list_filtered(spark, d):
    return ops.list_runs(px.runs(spark, d), status="complete", environment="1-URGENT", journey_id=None).select("request_id", "journey_id", "status", "created_at")


@query(f"WITH {px.RUNS_SQL} SELECT request_id, created_at FROM runs WHERE journey_id = 7 AND environment = '1-URGENT' AND request_id <> 0 ORDER BY created_at DESC, request_id DESC LIMIT 1")
def latest_excluding(spark, d):
    return ops.latest_excluding(px.runs(spark, d), 7, "1-URGENT", 0).select("request_id", "created_at")


@query(f"""WITH {px.RUNS_SQL}, {px.PAGES_SQL}, {px.FINDINGS_SQL},
p AS (SELECT request_id, string_agg(url, ',' ORDER BY position, url) AS pages, count(*) AS n_pages FROM pages_of_runs GROUP BY 1),
f AS (SELECT request_id, string_agg(code, ',' ORDER BY position, code) AS findings, count(*) AS n_findings FROM findings GROUP BY 1)
SELECT r.request_id, coalesce(pages, '') AS pages, coalesce(findings, '') AS findings, CAST(coalesce(n_pages, 0) AS INTEGER) AS n_pages, CAST(coalesce(n_findings, 0) AS INTEGER) AS n_findings
FROM runs r LEFT JOIN p ON p.request_id = r.request_id LEFT JOIN f ON f.request_id = r.request_id""")
def hydrate_nested(spark, d):
    nested = ops.hydrate(px.runs(spark, d), px.pages(spark, d).select("request_id", "position", "url"), px.findings(spark, d).select("request_id", "position", "code"))
    return nested.select(
        "request_id",
        F.array_join(F.transform("pages", lambda p: p["url"]), ",").alias("pages"),
        F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("findings"),
        F.size("pages").alias("n_pages"),
        F.size("findings").alias("n_findings"),
    )


@query(f"""WITH {px.PAGES_SQL}, s AS (
  SELECT request_id, CAST(sum(coalesce(checks_passed, 0)) AS BIGINT) AS passed, CAST(sum(coalesce(checks_failed, 0)) AS BIGINT) AS failed,
    CAST(sum(coalesce(checks_incomplete, 0)) AS BIGINT) AS needs_review, CASE WHEN bool_and(evidence_status = 'complete') THEN 'complete' ELSE 'degraded' END AS evidence_status
  FROM pages_of_runs GROUP BY 1)
SELECT *, CASE WHEN evidence_status = 'complete' AND passed + failed > 0 THEN
  CAST(CASE WHEN failed > 0 THEN least((200 * passed + passed + failed) // (2 * (passed + failed)), 99) ELSE (200 * passed + passed + failed) // (2 * (passed + failed)) END AS INTEGER) END AS score FROM s""")
def run_score(spark, d):
    return ops.run_scores(px.pages(spark, d))


@query(f"""WITH {px.RUNS_SQL}, {px.FINDINGS_SQL}, c AS (
  SELECT request_id, count(*) AS total, count(*) FILTER (source = 'deterministic' AND severity <> 'needs-review' AND conformance_level IN ('A', 'AA')) AS blocking,
    count(*) FILTER (source = 'ai-advisory') AS advisory FROM findings GROUP BY 1),
j AS (SELECT r.request_id, r.evidence_status = 'complete' AS ok, coalesce(total, 0) AS total, CASE WHEN r.evidence_status = 'complete' THEN coalesce(blocking, 0) ELSE 0 END AS blocking, coalesce(advisory, 0) AS advisory
  FROM runs r LEFT JOIN c ON c.request_id = r.request_id)
SELECT request_id, CASE WHEN NOT ok THEN 'inconclusive' WHEN blocking > 0 THEN 'fail' ELSE 'pass' END AS ci_status,
  CASE WHEN ok THEN 'complete' ELSE 'degraded' END AS execution_status, total, blocking, advisory FROM j""")
def gate_summary(spark, d):
    return ops.gate_summary(px.runs(spark, d), px.findings(spark, d))


SUMMARY_SQL = f"""{px.RUNS_SQL}, {px.FINDINGS_SQL}, {px.PAGES_SQL}, f AS (
  SELECT request_id, count(*) FILTER (source = 'deterministic' AND severity = 'critical') AS must_fix, count(*) FILTER (source = 'deterministic' AND severity = 'major') AS should_fix,
    bool_or(source = 'deterministic' AND severity IN ('major', 'needs-review')) AS unresolved FROM findings GROUP BY 1),
p AS (SELECT request_id, count(*) AS pages_audited, max(duration_ms) AS slowest_page_ms FROM pages_of_runs GROUP BY 1),
summaries AS (SELECT r.request_id, r.journey_id, r.environment, r.created_at,
  CASE WHEN status = 'running' THEN 'scan' WHEN status = 'failed' OR ci_status = 'inconclusive' THEN 'inconclusive' WHEN ci_status = 'fail' THEN 'fail' WHEN unresolved THEN 'risk' ELSE 'pass' END AS verdict,
  score, coalesce(must_fix, 0) AS must_fix, coalesce(should_fix, 0) AS should_fix, coalesce(pages_audited, 0) AS pages_audited, evidence_status,
  nullif(duration_ms, 0) AS duration_ms, slowest_page_ms, CASE WHEN status = 'failed' THEN failure_reason END AS failure_reason
  FROM runs r LEFT JOIN f ON f.request_id = r.request_id LEFT JOIN p ON p.request_id = r.request_id)"""


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_summaries(px.runs(spark, d), px.pages(spark, d), px.findings(spark, d))


@query(f"WITH {SUMMARY_SQL} SELECT * FROM summaries")
def run_summary(spark, d):
    return _summaries(spark, d)


@query(f"""WITH {SUMMARY_SQL} SELECT request_id, 300000 - duration_ms AS headroom_ms, greatest(1, CAST(240000 // nullif(slowest_page_ms, 0) AS INTEGER)) AS suggested_pages FROM summaries""")
def headroom(spark, d):
    return ops.phase_headroom(_summaries(spark, d))


@query(f"""WITH {px.EVENTS_SQL}, m AS (SELECT CASE severity WHEN 'critical' THEN 'must' WHEN 'major' THEN 'should' WHEN 'minor' THEN 'nice' WHEN 'needs-review' THEN 'review' ELSE 'advisory' END AS display FROM event_findings)
SELECT display, count(*) AS n, CAST(list_position(['must', 'should', 'nice', 'review', 'advisory'], display) - 1 AS INTEGER) AS place FROM m GROUP BY display""")
def severity_counts(spark, d):
    return ops.severity_counts(px.event_findings(spark, d))


@query(f"""WITH {px.FINDINGS_SQL} SELECT request_id, count(*) FILTER (severity = 'critical') AS must, count(*) FILTER (severity = 'major') AS should, count(*) FILTER (severity = 'minor') AS nice,
  count(*) FILTER (severity = 'needs-review') AS review, CAST(0 AS BIGINT) AS advisory FROM findings GROUP BY 1""")
def severity_pivot(spark, d):
    return ops.severity_counts(px.findings(spark, d), ["request_id"], zeros=True)


@query(f"""WITH {px.FINDINGS_SQL} SELECT code, count(*) AS total, count(*) FILTER (source = 'deterministic') AS deterministic, count(*) FILTER (source = 'ai-advisory') AS advisory,
  count(*) FILTER (severity = 'critical') AS critical FROM findings GROUP BY 1""")
def source_counts(spark, d):
    return ops.source_counts(px.findings(spark, d), ["code"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type, count(value) AS n FROM events GROUP BY 1)
SELECT c.event_type, n, r.value AS upper_median FROM c LEFT JOIN r ON r.event_type = c.event_type AND r.i = n // 2 + 1""")
def upper_median(spark, d):
    return ops.upper_median(px.read_table(spark, d, "events"), "value", ["event_type"])


@query(f"""WITH {SUMMARY_SQL}, {px.JOURNEYS_SQL}, c AS (SELECT client_id, count(*) AS journey_count FROM live GROUP BY 1),
done AS (SELECT DISTINCT client_id FROM live JOIN runs ON runs.journey_id = live.journey_id WHERE status = 'complete'),
n AS (SELECT s.*, l.client_id, row_number() OVER (PARTITION BY l.client_id ORDER BY s.created_at DESC, s.request_id DESC) AS i FROM summaries s JOIN live l ON l.journey_id = s.journey_id)
SELECT CAST(k.n_nationkey AS VARCHAR) AS client_id, k.n_name AS name, coalesce(journey_count, 0) AS journey_count, done.client_id IS NOT NULL AS has_completed_run,
  n.request_id, n.created_at, n.verdict, n.score, n.must_fix, n.should_fix, n.pages_audited, n.evidence_status, n.duration_ms, n.slowest_page_ms, n.failure_reason
FROM nation k LEFT JOIN c ON c.client_id = CAST(k.n_nationkey AS VARCHAR) LEFT JOIN done ON done.client_id = CAST(k.n_nationkey AS VARCHAR)
LEFT JOIN n ON n.client_id = CAST(k.n_nationkey AS VARCHAR) AND n.i = 1""")
def portfolio(spark, d):
    return views.portfolio(px.clients(spark, d), px.journeys(spark, d), px.runs(spark, d), px.pages(spark, d), px.findings(spark, d))


_CLIENT_SQL = f"""{SUMMARY_SQL}, {px.JOURNEYS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY created_at DESC, request_id DESC) AS i FROM summaries),
details AS (SELECT l.journey_id, l.client_id, l.name AS journey_name,
  CASE WHEN l.target_url IS NULL THEN 'journey_not_runnable' WHEN l.steps = '[]' THEN 'journey_has_no_steps' END AS run_refusal, coalesce(l.schedule, 'off') AS schedule,
  n.request_id, n.verdict, n.must_fix, n.should_fix FROM live l LEFT JOIN n ON n.journey_id = l.journey_id AND n.i = 1)"""


@query(f"WITH {_CLIENT_SQL} SELECT * FROM details")
def client_detail(spark, d):
    rows = views.client_journeys(px.journeys(spark, d), px.runs(spark, d), px.pages(spark, d), px.findings(spark, d))
    return rows.select("journey_id", "client_id", "journey_name", "run_refusal", "schedule", "request_id", "verdict", "must_fix", "should_fix")


@query(f"""WITH {_CLIENT_SQL}, done AS (SELECT DISTINCT live.journey_id FROM live JOIN runs ON runs.journey_id = live.journey_id WHERE status = 'complete')
SELECT CAST(j.id AS VARCHAR) AS client_id, CASE WHEN done.journey_id IS NOT NULL THEN 'done' WHEN d.journey_id IS NULL THEN 'site' WHEN run_refusal IS NOT NULL THEN 'steps'
  WHEN request_id IS NULL THEN 'first-run' WHEN verdict = 'scan' THEN 'running' ELSE 'failed' END AS stage
FROM journeys j LEFT JOIN details d ON d.journey_id = j.id LEFT JOIN done ON done.journey_id = j.id""")
def setup_stages(spark, d):
    """Every customer as a client with one journey, so that all stages are met."""
    journeys = px.journeys(spark, d).withColumn("client_id", F.col("id").cast("string"))
    details = views.client_journeys(journeys, px.runs(spark, d), px.pages(spark, d), px.findings(spark, d))
    live = views.listed_journeys(journeys).select(F.col("id").alias("journey_id"), "client_id")
    done = px.runs(spark, d).filter("status = 'complete'").join(live, "journey_id").select("client_id")
    return views.setup_stages(journeys.select(F.col("client_id").alias("id")), journeys, details, done)


@query(f"""WITH {px.RUNS_SQL}, {px.JOURNEYS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY created_at DESC, request_id DESC) AS place FROM runs)
SELECT 'rep-' || r.request_id AS id, r.request_id, l.client_id, n_name AS client_name, r.created_at AS run_created_at
FROM r JOIN live l ON l.journey_id = r.journey_id JOIN nation ON CAST(n_nationkey AS VARCHAR) = l.client_id WHERE place <= 5 AND r.request_id % 3 = 0""")
def reports_topk(spark, d):
    runs = px.runs(spark, d)
    reports = runs.filter("request_id % 3 = 0").select(F.concat(F.lit("rep-"), F.col("request_id").cast("string")).alias("id"), "request_id", "created_at")
    out = views.reports_view(reports, runs.select("request_id", "journey_id", "created_at"), px.journeys(spark, d), px.clients(spark, d), 5)
    return out.select("id", "request_id", "client_id", "client_name", "run_created_at")


@query("""SELECT event_id AS id, user_id AS client_id, event_type AS action, ts AS created_at, c_name AS client_name FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0""")
def activity_feed(spark, d):
    e = px.read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    c = px.read_table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return views.activity(e, c)


@query(f"""WITH {px.FINDINGS_SQL}, k AS (SELECT *, source || ':' || code || ':' || page_url || ':' || coalesce(selector, '') AS finding_key FROM findings),
t AS (SELECT p_partkey % 7 AS c, p_partkey % 5 AS p, min(p_partkey) AS pk FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2),
marks AS (SELECT 'deterministic:rule-' || c || ':/p/' || p || ':#s1' AS finding_key, CASE pk % 3 WHEN 1 THEN 'dismissed' ELSE 'assigned' END AS state FROM t)
SELECT request_id, position, k.finding_key, state AS triage, CASE WHEN state = 'dismissed' THEN 'Dismissed' WHEN state = 'assigned' THEN 'Assigned' ELSE 'Open' END AS finding_status,
  CASE severity WHEN 'critical' THEN 'must' WHEN 'major' THEN 'should' WHEN 'minor' THEN 'nice' ELSE 'review' END AS display
FROM k LEFT JOIN marks ON marks.finding_key = k.finding_key""")
def triage_overlay(spark, d):
    part = px.read_table(spark, d, "part").filter("p_partkey % 3 <> 0").groupBy((F.col("p_partkey") % 7).alias("c"), (F.col("p_partkey") % 5).alias("p")).agg(F.min("p_partkey").alias("pk"))
    key = F.concat(F.lit("deterministic:rule-"), F.col("c").cast("string"), F.lit(":/p/"), F.col("p").cast("string"), F.lit(":#s1"))
    marks = part.select(F.lit("c").alias("client_id"), key.alias("finding_key"), F.when(F.col("pk") % 3 == 1, "dismissed").otherwise("assigned").alias("state"), F.lit(None).cast("string").alias("note"))
    rows = views.finding_views(px.findings(spark, d).withColumn("client_id", F.lit("c")), marks)
    return rows.select("request_id", "position", "finding_key", "triage", "finding_status", "display")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_page, quality FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def page_findings_outer(spark, d):
    docs, labels = px.read_table(spark, d, "documents"), px.read_table(spark, d, "labels")
    pages = docs.filter("doc_id % 3 <> 0").select(F.lit(1).alias("request_id"), F.col("doc_id").cast("string").alias("url"), F.col("doc_id").alias("position"), F.lit("complete").alias("evidence_status"))
    found = labels.select(F.lit(1).alias("request_id"), F.col("doc_id").cast("string").alias("page_url"), F.col("doc_id").alias("position"), "quality")
    return views.page_findings(pages, found).select(F.col("page_url").cast("long").alias("doc_id"), F.col("page_place").isNotNull().alias("has_page"), "quality")


@query(f"WITH {px.PAGES_SQL}, {px.FINDINGS_SQL} SELECT request_id, position, url FROM pages_of_runs p WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.request_id = p.request_id AND f.page_url = p.url)")
def clean_pages(spark, d):
    return views.clean_pages(px.pages(spark, d), px.findings(spark, d)).select("request_id", "position", "url")


@query("SELECT DISTINCT l_partkey AS part_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def backfill_missing(spark, d):
    wanted = px.read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"))
    have = px.read_table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("part_id"))
    stored = catalog.insert_missing(have.withColumn("fresh", F.lit(False)), wanted.withColumn("fresh", F.lit(True)), "part_id")
    return stored.filter("fresh").select("part_id")


@query(f"""WITH {px.PAGES_SQL}, {px.RUNS_SQL}
SELECT p.request_id, p.position, CASE WHEN r.created_at < TIMESTAMP '1996-01-01' THEN '' ELSE p.url END AS shot FROM pages_of_runs p JOIN runs r ON r.request_id = p.request_id""")
def retention(spark, d):
    pages = px.pages(spark, d).select("request_id", "position", F.create_map(F.lit("screenshot"), "url").alias("artifacts"))
    out = catalog.clear_artifacts(pages, px.runs(spark, d), F.lit("1996-01-01").cast("timestamp_ntz"))
    return out.select("request_id", "position", F.coalesce(F.try_element_at("artifacts", F.lit("screenshot")), F.lit("")).alias("shot"))


@query(f"""WITH {px.RUNS_SQL}, s AS (SELECT *, status = 'running' AND coalesce(started_at, created_at) < TIMESTAMP '1997-06-01' - INTERVAL 360 SECOND AS stale FROM runs)
SELECT request_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'run_timed_out' ELSE failure_reason END AS failure_reason FROM s""")
def stale_sweep(spark, d):
    return catalog.reconcile_stale(px.runs(spark, d), F.lit("1997-06-01").cast("timestamp_ntz")).select("request_id", "status", "failure_reason")


@query(f"""WITH {px.JOURNEYS_SQL} SELECT id FROM journeys WHERE schedule <> 'off' AND archived_at IS NULL AND target_url IS NOT NULL AND steps <> '[]' AND coalesce(schedule_hour, 3) = 3
  AND (last_scheduled_at IS NULL OR last_scheduled_at < CASE WHEN schedule = 'weekly' THEN TIMESTAMP '{px.NOW}' - INTERVAL 6 DAY ELSE TIMESTAMP '{px.NOW}' - INTERVAL 23 HOUR END)
ORDER BY last_scheduled_at NULLS FIRST, id LIMIT 50""")
def due_set(spark, d):
    return catalog.due_journeys(px.journeys(spark, d), F.lit(px.NOW).cast("timestamp_ntz"), 50).select("id")


@query(f"""WITH {px.RUNS_SQL}, old AS (SELECT * FROM runs WHERE request_id % 3 <> 0), fresh AS (SELECT request_id, journey_id, 'complete' AS status, created_at + INTERVAL 1 DAY AS created_at,
    CASE WHEN request_id % 5 = 0 THEN 'new' END AS intent FROM runs WHERE request_id % 2 = 0)
SELECT coalesce(f.request_id, o.request_id) AS request_id, CASE WHEN f.request_id IS NOT NULL THEN f.status ELSE o.status END AS status,
  least(f.created_at, o.created_at) AS created_at, coalesce(f.intent, CASE WHEN o.request_id IS NOT NULL THEN 'old' END) AS intent
FROM fresh f FULL JOIN old o ON o.request_id = f.request_id""")
def upsert_fold(spark, d):
    r = px.runs(spark, d)
    stored = r.filter("request_id % 3 <> 0").select("request_id", "status", "created_at", F.lit("old").alias("intent"))
    fresh = r.filter("request_id % 2 = 0").select("request_id", F.lit("complete").alias("status"), (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"), F.when(F.col("request_id") % 5 == 0, "new").alias("intent"))
    return catalog.upsert_runs(stored, fresh)


@query(f"""WITH {px.FINDINGS_SQL}, parents AS (SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey % 4 = 0)
SELECT request_id, position, code FROM findings WHERE request_id NOT IN (SELECT request_id FROM parents)
UNION ALL SELECT request_id, position, 'again' FROM findings WHERE request_id IN (SELECT request_id FROM parents) AND position = 1""")
def children_replace(spark, d):
    f = px.findings(spark, d).select("request_id", "position", "code")
    parents = px.runs(spark, d).filter("request_id % 4 = 0")
    fresh = f.filter("request_id % 4 = 0 and position = 1").withColumn("code", F.lit("again"))
    return catalog.replace_children(f, fresh, parents)


_BUDGET_SQL = """WITH b AS (SELECT event_id, ts, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS hour_count,
  row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS day_count FROM events)
SELECT event_id, CAST(hour_count AS INTEGER) AS hour_count, CAST(day_count AS INTEGER) AS day_count, CASE WHEN day_count > {day} THEN 'day' WHEN hour_count > {hour} THEN 'hour' END AS refused_by,
  day_count <= {day} AND hour_count <= {hour} AS allowed,
  CASE WHEN day_count > {day} THEN CAST(86400 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS INTEGER) WHEN hour_count > {hour} THEN CAST(3600 - (minute(ts) * 60 + second(ts)) AS INTEGER) END AS resets_in,
  '{prefix}:hour:' || strftime(ts, '%Y%m%d%H') AS hour_key, '{prefix}:day:' || strftime(ts, '%Y%m%d') AS day_key FROM b"""


@query(_BUDGET_SQL.format(hour=20, day=100, prefix="runs"))
def run_budget(spark, d):
    return catalog.consume_budget(px.read_table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").drop("ts")


@query(_BUDGET_SQL.format(hour=40, day=200, prefix="previews"))
def preview_budget(spark, d):
    e = px.read_table(spark, d, "events").select("event_id", "ts")
    return catalog.consume_budget(e, "ts", "event_id", catalog.PREVIEWS_PER_HOUR, catalog.PREVIEWS_PER_DAY, "previews").drop("ts")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), edges AS (
  SELECT c_custkey AS src, (7 * c_custkey + 3) % n AS dst FROM customer, n UNION SELECT c_custkey, (11 * c_custkey + 5) % n FROM customer, n),
walk(site, page, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION SELECT site, dst, depth + 1 FROM walk JOIN edges ON src = page WHERE depth < 3)
SELECT site, page, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY site, page""")
def crawl_bfs(spark, d):
    c = px.read_table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    n = c.count()
    edges = c.withColumn("dst", (F.col("src") * 7 + 3) % n).union(c.withColumn("dst", (F.col("src") * 11 + 5) % n)).distinct()
    seeds = c.select(F.col("src").alias("site"), F.col("src").alias("page"))
    return catalog.crawl(edges, seeds)


@query("""SELECT 'runs: score_0_100' AS rule, count(*) FILTER (NOT (o_orderkey % 120 BETWEEN 0 AND 100)) AS violations FROM orders
UNION ALL SELECT 'runs: request_id_present', count(*) FILTER (o_orderkey IS NULL) FROM orders
UNION ALL SELECT 'findings: orphan', count(*) FROM lineitem WHERE l_orderkey % 50 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'events: duplicate', (SELECT count(*) FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) > 1))""")
def expectations(spark, d):
    o = px.read_table(spark, d, "orders")
    runs = catalog.violations(o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 120).alias("score")), catalog.run_rules())
    runs = runs.select(F.concat(F.lit("runs: "), "rule").alias("rule"), "violations")
    lost = catalog.orphans(px.read_table(spark, d, "lineitem").select("l_orderkey"), o.filter("o_orderkey % 50 <> 0"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("violations")).select(F.lit("findings: orphan").alias("rule"), "violations")
    twice = catalog.duplicate_keys(px.read_table(spark, d, "events"), ["user_id", "event_type"]).agg(F.count("*").alias("violations")).select(F.lit("events: duplicate").alias("rule"), "violations")
    return runs.union(lost).union(twice)
