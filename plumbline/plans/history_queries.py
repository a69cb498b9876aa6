"""Queries over the history of findings, checked writes, records and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.records import table_record
from plumbline.operators import catalog, expectations, history, views
from plumbline.plans import proxies as px

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


#: Runs of journeys with few distinct findings, so that they stay, go and come back; every seventh run does not count.
_LIFE_SQL = f"""{px.RUNS_SQL}, keyed AS (SELECT DISTINCT l_orderkey AS request_id, 'rule-' || (l_partkey % 3) || ':/p/' || (l_suppkey % 2) AS finding_key FROM lineitem),
counted AS (SELECT journey_id, request_id, row_number() OVER (PARTITION BY journey_id ORDER BY created_at NULLS FIRST, request_id) AS n FROM runs WHERE status <> 'failed' AND request_id % 7 <> 3),
seen AS (SELECT journey_id, finding_key, n, request_id, n - row_number() OVER (PARTITION BY journey_id, finding_key ORDER BY n) AS island FROM keyed JOIN counted USING (request_id)),
spans AS (SELECT journey_id, finding_key, min(n) AS first_n, max(n) AS last_n, arg_min(request_id, n) AS first_run, arg_max(request_id, n) AS last_run, count(*) AS runs_seen FROM seen GROUP BY journey_id, finding_key, island)"""


def _spans(spark, d):
    x = px.read_table(spark, d, "lineitem")
    key = F.concat(F.lit("rule-"), (F.col("l_partkey") % 3).cast("string"), F.lit(":/p/"), (F.col("l_suppkey") % 2).cast("string"))
    counts = (F.col("status") != "failed") & (F.col("request_id") % 7 != 3)
    return history.finding_spans(px.runs(spark, d), x.select(F.col("l_orderkey").alias("request_id"), key.alias("finding_key")), ["journey_id"], counts)


@query(f"""WITH {_LIFE_SQL} SELECT journey_id, finding_key, CAST(row_number() OVER (PARTITION BY journey_id, finding_key ORDER BY first_n) AS INTEGER) AS span, first_n, last_n, first_run, last_run, runs_seen,
  (SELECT max(n) FROM counted c WHERE c.journey_id = spans.journey_id) AS latest_n FROM spans""")
def finding_spans(spark, d):
    """Stretches of counted runs in which a journey's finding is present."""
    return _spans(spark, d)


@query(f"""WITH {_LIFE_SQL}, life AS (SELECT journey_id, finding_key, arg_min(first_run, first_n) AS first_run, arg_max(last_run, last_n) AS last_run, count(*) AS spans, CAST(sum(runs_seen) AS BIGINT) AS runs_seen, max(last_n) AS last_n FROM spans GROUP BY 1, 2),
told AS (SELECT life.*, last_n = (SELECT max(n) FROM counted c WHERE c.journey_id = life.journey_id) AS in_latest, CASE WHEN finding_key = 'rule-1:/p/0' THEN CASE journey_id % 3 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'assigned' END END AS state FROM life)
SELECT journey_id, finding_key, first_run, last_run, spans, runs_seen, in_latest, CASE WHEN state = 'dismissed' THEN 'Dismissed' WHEN NOT in_latest THEN 'Fixed' WHEN state = 'assigned' THEN 'Assigned' WHEN spans > 1 THEN 'Retest due' ELSE 'Open' END AS status FROM told""")
def finding_history(spark, d):
    """All five display statuses of findings, from all runs of their journeys."""
    c = px.read_table(spark, d, "customer").select(F.col("c_custkey").alias("journey_id"))
    state = F.when(F.col("journey_id") % 3 == 0, "dismissed").when(F.col("journey_id") % 3 == 1, "assigned")
    triage = c.select("journey_id", F.lit("rule-1:/p/0").alias("finding_key"), state.alias("state"))
    return history.finding_history(_spans(spark, d), triage, ["journey_id"])


#: Test input: a configuration a customer, with steps, triage, an audience and a request's body, each broken in some rows.
_BODY = "CASE c_custkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '{{\"journeyId\":\" \",\"environment\":\"test\"}}' WHEN 2 THEN 'x' WHEN 3 THEN '{{\"journeyId\":\"' || c_custkey || '\"}}' ELSE '{{\"journeyId\":\"' || c_custkey || '\",\"environment\":\"' || c_mktsegment || '\"}}' END"


def _checked(spark, d):
    c = px.read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition("c_custkey")  # a small file is one partition, and the work is by row
    key = F.col("c_custkey")
    step = F.concat(F.lit('{"action":"navigate","type":"goto","path":"/'), key.cast("string"), F.lit('"}'))
    steps = F.when(key % 5 == 0, step).when(key % 5 == 1, F.concat(F.lit("["), F.array_join(F.array_repeat(step, 51), ","), F.lit("]"))).when(key % 5 == 2, '[{"action":"fly"}]').otherwise(F.concat(F.lit("["), step, F.lit("]")))
    body = F.expr(_BODY.format())
    rows = c.select(
        "c_custkey",
        steps.alias("steps"),
        F.element_at(F.array(*[F.lit(x) for x in ("dismissed", "accepted-risk", "assigned", "gone")]), (key % 4 + 1).cast("int")).alias("state"),
        F.when(key % 3 == 0, " ").when(key % 3 == 1, F.col("c_name")).alias("note"),
        F.when(key % 2 == 0, F.col("c_name")).alias("assignee"),
        F.element_at(F.array(*[F.lit(x) for x in ("legal", "dev", "exec", "all")]), (F.floor(key / 4) % 4 + 1).cast("int")).alias("audience"),
        body.alias("body"),
    )
    rules = expectations.steps_rules() | catalog.triage_rules() | catalog.report_rules() | expectations.body_rules()
    return expectations.write_checked(rows, rules, "configurations")


_BROKEN_SQL = f"""c AS (SELECT *, {_BODY.format()} AS body FROM customer),
b AS (SELECT c_custkey, [CASE WHEN c_custkey % 5 = 0 THEN 'steps_shape' END, CASE WHEN c_custkey % 5 = 1 THEN 'steps_caps' END, CASE WHEN c_custkey % 5 < 3 THEN 'steps_valid' END, CASE WHEN c_custkey % 4 = 3 THEN 'state' END,
  CASE WHEN c_custkey % 4 < 2 AND c_custkey % 3 <> 1 THEN 'note_when_closed' END, CASE WHEN c_custkey % 4 = 2 AND c_custkey % 2 <> 0 THEN 'assignee_when_assigned' END, CASE WHEN (c_custkey // 4) % 4 = 3 THEN 'audience' END, NULL,
  CASE WHEN NOT coalesce(json_valid(body) AND starts_with(body, '{{'), false) THEN 'body_object' END, CASE WHEN NOT json_valid(body) OR trim(coalesce(body ->> '$.journeyId', '')) = '' THEN 'body_journey' END, CASE WHEN NOT json_valid(body) OR coalesce(body ->> '$.environment', '') = '' THEN 'body_environment' END] AS marks FROM c),
r AS (SELECT c_custkey, list_filter(marks, lambda x: x IS NOT NULL) AS broken FROM b)"""


@query(f"""WITH {_BROKEN_SQL}, t AS (SELECT unnest(broken) AS rule FROM r), names AS (SELECT unnest(['steps_shape', 'steps_caps', 'steps_valid', 'state', 'note_when_closed', 'assignee_when_assigned', 'audience', 'body_size', 'body_object', 'body_journey', 'body_environment']) AS rule)
SELECT rule, (SELECT count(*) FROM t WHERE t.rule = names.rule) AS violations FROM names UNION ALL SELECT 'rows', count(*) FROM r""")
def checked_writes(spark, d):
    """Violations per rule as the write counted them, and the rows written."""
    counts = _checked(spark, d)[2]
    return spark.createDataFrame(list(counts.items()), "rule string, violations long")


@query(f"WITH {_BROKEN_SQL} SELECT c_custkey, array_to_string(broken, ',') AS broken FROM r WHERE len(broken) > 0")
def quarantined_rows(spark, d):
    """Rows that a checked write held back, with the rules that they break."""
    return _checked(spark, d)[1].select("c_custkey", F.array_join("broken", ",").alias("broken"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.0' WHEN 3 THEN p_size || '.5' WHEN 4 THEN p_size || 'e2' WHEN 5 THEN ' ' || p_size || ' ' WHEN 6 THEN p_name END AS value FROM part),
n AS (SELECT p_partkey, CASE WHEN regexp_full_match(trim(value), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(value) AS DOUBLE) END AS number FROM v)
SELECT p_partkey, CASE WHEN number > 0 AND floor(number) = number THEN CAST(number AS BIGINT) ELSE 20 END AS setting FROM n""")
def configured_limits(spark, d):
    """Settings as positive whole numbers, a default for what is none."""
    size = F.col("p_size").cast("string")
    forms = [size, F.concat(F.lit("-"), size), F.concat(size, F.lit(".0")), F.concat(size, F.lit(".5")), F.concat(size, F.lit("e2")), F.concat(F.lit(" "), size, F.lit(" ")), F.col("p_name"), F.lit(None).cast("string")]
    value = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return px.read_table(spark, d, "part").select("p_partkey", tx.positive_number(value, 20).alias("setting"))


_COLUMNS = ["request_id", "status", "failure_reason", "score", "started_at"]


@query(f"""WITH {px.RUNS_SQL} SELECT request_id, array_to_string(list_filter(['requestId', CASE WHEN status IS NOT NULL THEN 'status' END, CASE WHEN failure_reason IS NOT NULL THEN 'failureReason' END, 'score', CASE WHEN started_at IS NOT NULL THEN 'startedAt' END], lambda x: x IS NOT NULL), ',') AS keys,
  failure_reason AS reason, CAST(score AS VARCHAR) AS score FROM runs""")
def run_records(spark, d):
    """Runs as records: the keys that each has, and values read back."""
    rows = px.runs(spark, d).select("request_id", table_record(_COLUMNS).alias("record"))
    at = lambda f: F.get_json_object("record", f"$.{f}")
    return rows.select("request_id", F.array_join(F.json_object_keys("record"), ",").alias("keys"), at("failureReason").alias("reason"), at("score").alias("score"))


@query(f"WITH {px.PAGES_SQL} SELECT request_id, position, url, 'Title of ' || url AS title, CASE WHEN evidence_status = 'complete' THEN 200 ELSE 404 END AS status_code FROM pages_of_runs")
def preview_pages(spark, d):
    """What a preview shows of the visited pages."""
    pages = px.pages(spark, d).withColumns({"title": F.concat(F.lit("Title of "), "url"), "status_code": F.when(F.col("evidence_status") == "complete", 200).otherwise(404), "scan": F.lit("{}")})
    return views.preview_rows(pages)
