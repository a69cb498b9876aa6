"""Audit-shaped views of the driver's tables, and the same views as SQL for the second engine.

The data has no audit tables, so orders stand for runs, line items for findings and pages,
customers for clients and journeys, events for activity and requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.findings import lookup
from plumbline.sources.tables import read_table

STATUS = {"F": "complete", "O": "running", "P": "failed"}
EVENT_SEVERITY = {"error": "critical", "purchase": "major", "click": "minor", "signup": "needs-review"}
PIVOT = "2024-01-16 00:00:00"
NOW = "2024-01-20 03:30:00"


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    status = lookup(F.col("o_orderstatus"), STATUS)
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("journey_id"),
        F.col("o_orderpriority").alias("environment"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, "fail").when(F.col("o_orderkey") % 7 == 0, "inconclusive").otherwise("pass").alias("ci_status"),
        F.when(F.col("o_orderkey") % 3 == 0, "degraded").otherwise("complete").alias("evidence_status"),
        (F.col("o_orderkey") % 101).cast("int").alias("score"),
        (F.col("o_orderkey") % 4 * 1000).cast("int").alias("duration_ms"),
        F.when(status == "failed", F.lit("audit_run_failed")).alias("failure_reason"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("started_at"),
    )


RUNS_SQL = """runs AS (
  SELECT o_orderkey AS request_id, o_custkey AS journey_id, o_orderpriority AS environment,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'fail' WHEN o_orderkey % 7 = 0 THEN 'inconclusive' ELSE 'pass' END AS ci_status,
    CASE WHEN o_orderkey % 3 = 0 THEN 'degraded' ELSE 'complete' END AS evidence_status,
    CAST(o_orderkey % 101 AS INTEGER) AS score, CAST(o_orderkey % 4 * 1000 AS INTEGER) AS duration_ms,
    CASE WHEN o_orderstatus = 'P' THEN 'audit_run_failed' END AS failure_reason,
    o_orderdate AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS started_at FROM orders)"""


def intents(spark: SparkSession, d: str) -> DataFrame:
    """What each run set out to walk: steps as JSON text, by the day of the order, with keys in either order, and a ruleset."""
    o = read_table(spark, d, "orders")
    key, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate").cast("string")
    one = F.concat(F.lit('[{"action":"open","at":{"path":"/d'), F.expr("string(dayofmonth(o_orderdate) % 2)"), F.lit('","tab":1}}]'))
    other = F.concat(F.lit('[ {"at" : {"tab":1, "path":"/d'), F.expr("string(dayofmonth(o_orderdate) % 2)"), F.lit('"},"action":"open"}]'))
    steps = F.when(key % 7 == 0, F.concat(F.lit('{"day":'), day, F.lit("}"))).when(key % 2 == 0, one).otherwise(other)
    return o.select(key.alias("request_id"), steps.alias("steps"), F.when(key % 5 != 0, F.lit("v2")).when(key % 10 == 0, F.lit("v1")).alias("ruleset"))


INTENTS_SQL = """intents AS (
  SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'array' END AS form, CAST(day(o_orderdate) % 2 AS VARCHAR) AS path,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'v2' WHEN o_orderkey % 10 = 0 THEN 'v1' END AS ruleset FROM orders)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "lineitem")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    return x.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("/p/"), (F.col("l_suppkey") % 5).cast("string")).alias("page_url"),
        F.concat(F.lit("rule-"), (F.col("l_partkey") % 7).cast("string")).alias("code"),
        F.when(F.col("l_quantity") < 6, "needs-review").otherwise(lookup(F.col("l_returnflag"), {"R": "critical", "A": "major"}, "minor")).alias("severity"),
        F.when(F.col("l_linenumber") == 7, "ai-advisory").otherwise("deterministic").alias("source"),
        F.when(tax <= 1, "A").when(tax <= 3, "AA").when(tax <= 5, "AAA").alias("conformance_level"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("#s"), F.col("l_linenumber").cast("string"))).alias("selector"),
    )


FINDINGS_SQL = """findings AS (
  SELECT l_orderkey AS request_id, l_linenumber AS position, '/p/' || (l_suppkey % 5) AS page_url, 'rule-' || (l_partkey % 7) AS code,
    CASE WHEN l_quantity < 6 THEN 'needs-review' WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' THEN 'major' ELSE 'minor' END AS severity,
    CASE WHEN l_linenumber = 7 THEN 'ai-advisory' ELSE 'deterministic' END AS source,
    CASE WHEN round(l_tax * 100) <= 1 THEN 'A' WHEN round(l_tax * 100) <= 3 THEN 'AA' WHEN round(l_tax * 100) <= 5 THEN 'AAA' END AS conformance_level,
    CASE WHEN l_linenumber % 3 <> 0 THEN '#s' || l_linenumber END AS selector FROM lineitem)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    count = lambda f: F.when(flag == f, F.col("l_quantity").cast("long"))
    return x.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("/p/"), (F.col("l_partkey") % 6).cast("string")).alias("url"),
        F.when(F.col("l_linestatus") == "F", "complete").otherwise("degraded").alias("evidence_status"),
        count("N").alias("checks_passed"),
        count("R").alias("checks_failed"),
        count("A").alias("checks_incomplete"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey") * 10).alias("duration_ms"),
    )


PAGES_SQL = """pages_of_runs AS (
  SELECT l_orderkey AS request_id, l_linenumber AS position, '/p/' || (l_partkey % 6) AS url,
    CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'degraded' END AS evidence_status,
    CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END AS checks_passed,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END AS checks_failed,
    CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END AS checks_incomplete,
    CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey * 10 END AS duration_ms FROM lineitem)"""


def clients(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))


def journeys(spark: SparkSession, d: str) -> DataFrame:
    """Customers as journeys of their nation's client; every eleventh is archived."""
    c = read_table(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.col("c_nationkey").cast("string").alias("client_id"),
        F.col("c_name").alias("name"),
        F.when(key % 13 != 0, F.concat(F.lit("https://site"), key.cast("string"), F.lit(".test/"))).alias("target_url"),
        F.when(key % 5 == 0, "[]").otherwise('[{"type":"goto","path":"/"}]').alias("steps"),
        F.when(key % 4 == 0, "off").when(key % 4 == 1, "weekly").when(key % 4 == 2, "daily").alias("schedule"),
        F.when(key % 3 == 0, F.lit(3)).when(key % 3 == 1, F.lit(4)).cast("int").alias("schedule_hour"),
        F.when(key % 6 != 0, F.expr(f"timestamp_ntz '{NOW}' - make_dt_interval(cast(c_custkey % 9 as int), cast(c_custkey % 24 as int), 0, 0)")).alias("last_scheduled_at"),
        F.when(key % 11 == 0, F.lit(NOW)).alias("archived_at"),
    )


JOURNEYS_SQL = f"""journeys AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS client_id, c_name AS name,
    CASE WHEN c_custkey % 13 <> 0 THEN 'https://site' || c_custkey || '.test/' END AS target_url,
    CASE WHEN c_custkey % 5 = 0 THEN '[]' ELSE '[{{"type":"goto","path":"/"}}]' END AS steps,
    CASE c_custkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'weekly' WHEN 2 THEN 'daily' END AS schedule,
    CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 END AS schedule_hour,
    CASE WHEN c_custkey % 6 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(CAST(24 * (c_custkey % 9) + c_custkey % 24 AS INTEGER)) END AS last_scheduled_at,
    CASE WHEN c_custkey % 11 = 0 THEN '{NOW}' END AS archived_at FROM customer),
live AS (SELECT id AS journey_id, client_id, name, target_url, steps, schedule FROM journeys WHERE archived_at IS NULL)"""


def event_findings(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        "event_id",
        "ts",
        F.lit("deterministic").alias("source"),
        F.col("event_type").alias("code"),
        F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("page_url"),
        F.lit(None).cast("string").alias("selector"),
        lookup(F.col("event_type"), EVENT_SEVERITY, "advisory").alias("severity"),
    )


EVENTS_SQL = """event_findings AS (
  SELECT event_id, ts, 'deterministic:' || event_type || ':' || user_id || '/' || (event_id % 7) || ':' AS finding_key, event_type AS code,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'click' THEN 'minor' WHEN 'signup' THEN 'needs-review' ELSE 'advisory' END AS severity FROM events),
now_f AS (SELECT * FROM event_findings WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'),
base_f AS (SELECT * FROM event_findings WHERE ts < TIMESTAMP '2024-01-16 00:00:00')"""
