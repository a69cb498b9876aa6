"""Queries over journey steps, loose payloads, redaction and log lines, with JSON of every shape made from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import jsontext as jt
from plumbline.functions import text as tx
from plumbline.functions import urls as ux
from plumbline.operators import diff, steps
from plumbline.plans import proxies as px
from plumbline.sources.tables import read_table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


#: Test input: steps of every form; U stands for a user's number, L for a long text.
_STEPS = [
    '{"action":"navigate","type":"goto","path":"/p/U"}',
    '{"action":"search","type":"click","selector":"#b-U"}',
    '{"type":"fill","action":"filter","selector":"#q","value":"vU"}',
    '{"action":"login","type":"fill","selector":"#u","credentialRef":"ref_U","field":"user"}',
    '{"action":"inspect","type":"expect","urlIncludes":"/U"}',
    '{"action":"inspect","type":"expect","selector":"#x","urlIncludes":"/U"}',
    '{"action":"inspect","type":"expect"}',
    '{"action":"login","type":"fill","selector":"#p","value":"secretU"}',
    '{"action":"delete","type":"click","selector":"#x"}',
    '{"action":"navigate","type":"goto","path":""}',
    '{"action":"navigate","type":"goto","path":7}',
    '{"action":"navigate","type":"goto","path":"/a","note":"U"}',
    '{"action":"login","type":"fill","selector":"#u","credentialRef":"bad ref U","field":"user"}',
    '{"type":"goto","path":"/x"}',
    '"just text"',
    '{"action":"filter","type":"fill","selector":"#q","value":""}',
    '{"action":"navigate","type":"hover","selector":"#x","value":"vU"}',
    "null",
    '{"action":"navigate","type":"goto","path":"/L"}',
    '{"action":"login","type":"fill","selector":"#u","credentialRef":"r","field":"both"}',
    '{"action":"inspect","type":"expect","urlIncludes":null}',
    "[1]",
    '{"action":"filter","type":"fill","selector":7,"value":"x"}',
]
_N = len(_STEPS)


def _pick(templates: list[str], k: Column, user: Column) -> Column:
    chosen = F.element_at(F.array(*[F.lit(t) for t in templates]), (k % len(templates) + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("U"), user.cast("string")), F.lit("L"), F.lit("x" * 600))


def _pick_sql(templates: list[str], k: str) -> str:
    items = ", ".join("'" + t.replace("'", "''") + "'" for t in templates)
    return f"replace(replace(list_extract([{items}], CAST({k} % {len(templates)} + 1 AS INTEGER)), 'U', CAST(user_id AS VARCHAR)), 'L', repeat('x', 600))"


def _raw_steps(spark, d):
    """(event_id, raw): two steps each; now and then too many, or no array at all."""
    e = read_table(spark, d, "events").select("event_id", "user_id").repartition("event_id")  # a small file is one partition, and the work is by row
    k = F.col("event_id")
    one, two = _pick(_STEPS, k, F.col("user_id")), _pick(_STEPS, k * 7 + 1, F.col("user_id"))
    many = F.concat(F.lit("["), F.repeat(F.concat(one, F.lit(",")), F.lit(50)), two, F.lit("]"))
    raw = F.when(k % 23 == 0, many).when(k % 29 == 0, '{"steps":[]}').when(k % 31 == 0, " [ ] ").otherwise(F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
    return e.select("event_id", raw.alias("raw"))


_RAW_SQL = f"""parts AS (SELECT event_id, {_pick_sql(_STEPS, "event_id")} AS one, {_pick_sql(_STEPS, "(event_id * 7 + 1)")} AS two FROM events),
raw AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN '[' || repeat(one || ',', 50) || two || ']' WHEN event_id % 29 = 0 THEN '{{"steps":[]}}' WHEN event_id % 31 = 0 THEN ' [ ] ' ELSE '[' || one || ',' || two || ']' END AS raw FROM parts),
items AS (SELECT event_id, CAST(i AS INTEGER) AS position, json_extract(raw, '$[' || (i - 1) || ']') AS j FROM (SELECT event_id, raw, unnest(range(1, CAST(json_array_length(raw) AS BIGINT) + 1)) AS i FROM raw WHERE json_type(raw) = 'ARRAY'))"""
_S = "json_extract_string(j, '$.{f}')"
_IS = "(json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.{f}') = 'VARCHAR', false))"


def _sized(f: str, least: int = 1, most: int = 512) -> str:
    return f"({_IS.format(f=f)} AND length({_S.format(f=f)}) BETWEEN {least} AND {most})"


def _only(*names: str) -> str:
    return "len(list_filter(json_keys(j), lambda x: x NOT IN ('action', 'type', " + ", ".join(f"'{n}'" for n in names) + "))) = 0"


def _has(f: str) -> str:
    return f"list_contains(json_keys(j), '{f}')"


_ACTIONS = "('login', 'navigate', 'inspect', 'search', 'filter', 'paginate', 'open-detail', 'submit-safe', 'mutate-test-data')"
_CREDENTIAL = f"({_IS.format(f='credentialRef')} AND regexp_full_match({_S.format(f='credentialRef')}, '[A-Za-z0-9_-]{{1,64}}'))"
_FIELD = f"({_IS.format(f='field')} AND {_S.format(f='field')} IN ('user', 'pass'))"
_OPTIONAL = f"((NOT {_has('urlIncludes')} OR {_sized('urlIncludes')}) AND (NOT {_has('selector')} OR {_sized('selector')}))"
#: A step as the schema has it: one form per type, no further keys.
_AUTHORED = f"""coalesce(json_type(j) = 'OBJECT' AND {_IS.format(f='action')} AND {_S.format(f='action')} IN {_ACTIONS} AND CASE {_S.format(f='type')}
  WHEN 'goto' THEN {_sized('path')} AND {_only('path')}
  WHEN 'click' THEN {_sized('selector')} AND {_only('selector')}
  WHEN 'fill' THEN ({_sized('selector')} AND {_sized('value', 1, 4096)} AND {_S.format(f='action')} <> 'login' AND {_only('selector', 'value')}) OR ({_sized('selector')} AND {_CREDENTIAL} AND {_FIELD} AND {_only('selector', 'credentialRef', 'field')})
  WHEN 'expect' THEN {_OPTIONAL} AND ({_has('urlIncludes')} OR {_has('selector')}) AND {_only('urlIncludes', 'selector')} ELSE false END, false)"""


@query(f"""WITH {_RAW_SQL}, judged AS (SELECT event_id, count(*) AS n, bool_and({_AUTHORED}) AS ok FROM items GROUP BY 1)
SELECT raw.event_id, json_type(raw) = 'ARRAY' AND coalesce(n, 0) <= 50 AND coalesce(ok, true) AS storable,
  CASE WHEN json_type(raw) <> 'ARRAY' THEN 'not_an_array' WHEN n > 50 THEN 'too_many_steps' WHEN NOT ok THEN 'step' END AS problem FROM raw LEFT JOIN judged ON judged.event_id = raw.event_id""")
def step_validation(spark, d):
    rows = _raw_steps(spark, d).select("event_id", steps.steps_problem(F.col("raw")).alias("found"))
    problem = F.col("found")
    whole = F.when(problem.isin("not_an_array", "too_many_steps", "too_large"), problem).when(problem.isNotNull(), "step")
    return rows.select("event_id", problem.isNull().alias("storable"), whole.alias("problem"))


@query(f"SELECT event_id, position, {_AUTHORED} AS authored FROM (WITH {_RAW_SQL} SELECT * FROM items)")
def step_problems(spark, d):
    rows = _raw_steps(spark, d).select("event_id", F.posexplode(steps.elements(F.col("raw"))).alias("position", "v"))
    return rows.select("event_id", (F.col("position") + 1).alias("position"), steps.step_problem(F.col("v")).isNull().alias("authored"))


_LITERAL = _sized("value", 0, 4096)
_KNOWN = f"""coalesce({_sized('action')} AND CASE {_S.format(f='type')} WHEN 'goto' THEN {_sized('path')} WHEN 'click' THEN {_sized('selector')}
  WHEN 'fill' THEN {_sized('selector')} AND ({_LITERAL} OR ({_CREDENTIAL} AND {_FIELD})) WHEN 'expect' THEN {_OPTIONAL} AND ({_has('urlIncludes')} OR {_has('selector')}) ELSE false END, false)"""


@query(f"""WITH {_RAW_SQL}, k AS (SELECT *, {_KNOWN} AS known, CASE WHEN {_IS.format(f='type')} THEN {_S.format(f='type')} END AS kind FROM items)
SELECT event_id, position, CASE WHEN {_IS.format(f='action')} THEN substr({_S.format(f='action')}, 1, 512) ELSE 'unknown' END AS action, coalesce(kind, 'unknown') AS type,
  CASE WHEN known AND kind = 'goto' THEN {_S.format(f='path')} END AS path, CASE WHEN known AND kind IN ('click', 'fill', 'expect') AND {_has('selector')} THEN {_S.format(f='selector')} END AS selector,
  CASE WHEN known AND kind = 'expect' AND {_has('urlIncludes')} THEN {_S.format(f='urlIncludes')} END AS url_includes,
  CASE WHEN known AND kind = 'fill' AND NOT {_LITERAL} THEN {_S.format(f='credentialRef')} END AS credential_ref, CASE WHEN known AND kind = 'fill' AND NOT {_LITERAL} THEN {_S.format(f='field')} END AS field,
  CASE WHEN known THEN kind = 'fill' AND {_LITERAL} ELSE {_IS.format(f='value')} END AS has_literal_value, known AS recognised FROM k""")
def step_screen(spark, d):
    return _raw_steps(spark, d).select("event_id", F.explode(steps.step_views(F.col("raw"))).alias("v")).select("event_id", "v.*")


@query(f"""WITH {_RAW_SQL}
SELECT event_id, position, CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_sort(list_filter(json_keys(j), lambda x: x IN ('action', 'type', 'path', 'selector', 'credentialRef', 'field', 'urlIncludes'))), ',') END AS kept,
  CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_extract_string(j, '$.path'), json_extract_string(j, '$.selector'), json_extract_string(j, '$.urlIncludes')) END AS place, contains(CAST(j AS VARCHAR), 'secret') AND json_type(j) <> 'OBJECT' AS told FROM items""")
def step_redaction(spark, d):
    rows = _raw_steps(spark, d).select("event_id", F.posexplode(steps.redacted_steps(F.col("raw"))).alias("position", "kept"))
    object_ = F.col("kept").startswith("{")
    place = F.coalesce(*[F.get_json_object("kept", f"$.{f}") for f in ("path", "selector", "urlIncludes")])
    return rows.select(
        "event_id",
        (F.col("position") + 1).alias("position"),
        F.when(object_, F.array_join(F.array_sort(F.json_object_keys("kept")), ",")).alias("kept"),
        F.when(object_, place).alias("place"),
        F.col("kept").contains("secret").alias("told"),
    )


@query("""SELECT event_id, json_extract_string(a, '$[0].x.p') = json_extract_string(b, '$[0].x.p') AND json_extract_string(a, '$[0].x.q[0].r') = json_extract_string(b, '$[0].x.q[0].r')
  AND json_extract_string(a, '$[0].k') = json_extract_string(b, '$[0].k') AND event_id % 5 <> 4 AS same
FROM (SELECT event_id, '[{"x":{"p":' || user_id || ',"q":[{"r":"' || event_type || '"}]},"k":' || (event_id % 3) || '}]' AS a, '[{"k":' || (event_id % 3) || ',"x":{"q":[{"r":"' || event_type || '"}],"p":' || (user_id - CAST(event_id % 2 = 0 AND event_id % 4 = 0 AS INTEGER)) || '}}]' AS b FROM events)""")
def step_equality(spark, d):
    """Steps with nested objects, written with their keys in another order, with other values, or as no array."""
    e = read_table(spark, d, "events")
    kind, key, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    third = (key % 3).cast("string")
    a = F.concat(F.lit('[{"x":{"p":'), user.cast("string"), F.lit(',"q":[{"r":"'), kind, F.lit('"}]},"k":'), third, F.lit("}]"))
    shifted = (user - F.when(key % 4 == 0, 1).otherwise(0)).cast("string")
    b = F.concat(F.lit(' [{"k": '), third, F.lit(', "x": {"q": [{"r": "'), kind, F.lit('"}], "p": '), shifted, F.lit("}}]"))
    b = F.when(key % 5 == 4, F.concat(F.lit('{"steps":'), b, F.lit("}"))).otherwise(b)
    return e.select("event_id", diff.comparable(a, b, F.lit(None), F.lit(None)).alias("same"))


#: Test input: elements of a payload; U stands for a user's number.
_PAYLOAD = [
    '{"code":"rule-U","severity":"critical","source":"deterministic","message":"m U","pageUrl":"/p/U","confidence":0.5}',
    '{"code":"rule-U","severity":"needs-review"}',
    '{"code":"ai-U","severity":"advisory","source":"ai-advisory","confidence":0.25}',
    '{"code":7,"severity":"minor"}',
    '"text"',
    '{"code":"rule-U","gateable":false,"confidence":"high","message":3}',
    '{"severity":"major"}',
    '{"code":"x","source":"ai-advisory","gateable":true}',
]


def _payload(spark, d, templates: list[str]):
    e = read_table(spark, d, "events")
    k = F.col("event_id")
    pair = F.concat(F.lit("["), _pick(templates, k, F.col("user_id")), F.lit(","), _pick(templates, k * 3 + 2, F.col("user_id")), F.lit("]"))
    return e.select("event_id", F.when(k % 17 == 0, '{"findings":1}').otherwise(pair).alias("raw"))


def _payload_sql(templates: list[str]) -> str:
    return f"""raw AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{{"findings":1}}' ELSE '[' || {_pick_sql(templates, "event_id")} || ',' || {_pick_sql(templates, "(event_id * 3 + 2)")} || ']' END AS raw FROM events),
items AS (SELECT event_id, json_extract(raw, '$[' || (i - 1) || ']') AS j FROM (SELECT event_id, raw, unnest(range(1, CAST(json_array_length(raw) AS BIGINT) + 1)) AS i FROM raw WHERE json_type(raw) = 'ARRAY'))"""


@query(f"""WITH {_payload_sql(_PAYLOAD)}, good AS (SELECT *, coalesce({_S.format(f='source')} = 'ai-advisory', false) AS advisory FROM items WHERE {_IS.format(f='code')})
SELECT event_id, {_S.format(f='code')} AS code, CASE WHEN {_IS.format(f='message')} THEN {_S.format(f='message')} END AS message,
  CASE WHEN {_S.format(f='severity')} IN ('critical', 'major', 'minor', 'advisory') THEN {_S.format(f='severity')} ELSE 'minor' END AS severity, CASE WHEN advisory THEN 'ai-advisory' ELSE 'deterministic' END AS source,
  CASE WHEN json_type(j, '$.gateable') = 'BOOLEAN' THEN {_S.format(f='gateable')} = 'true' ELSE NOT advisory END AS gateable,
  CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST({_S.format(f='confidence')} AS DOUBLE) END AS confidence, CASE WHEN {_IS.format(f='pageUrl')} THEN {_S.format(f='pageUrl')} END AS page_url FROM good""")
def payload_findings(spark, d):
    rows = _payload(spark, d, _PAYLOAD).select("event_id", F.explode(steps.parsed_findings(F.col("raw"))).alias("f"))
    return rows.select("event_id", "f.*")


_PAGE_PAYLOAD = [
    '{"url":"/p/U","route":"/r","title":"T U","evidenceStatus":"complete","statusCode":200,"artifacts":{"screenshotUrl":"s","axTreeUrl":7}}',
    '{"url":"/p/U","title":"","evidenceStatus":"odd","statusCode":200.5,"artifacts":{}}',
    '{"url":7}',
    '{"route":"/r"}',
    '{"url":"/q","statusCode":"404","artifacts":"none"}',
    '{"url":"/z","evidenceStatus":"degraded","statusCode":404,"artifacts":{"domSnapshotUrl":"d"}}',
]


@query(f"""WITH {_payload_sql(_PAGE_PAYLOAD)}, flags AS (SELECT *, json_type(j, '$.artifacts') = 'OBJECT' AS mapped FROM items WHERE {_IS.format(f='url')})
SELECT event_id, {_S.format(f='url')} AS url, CASE WHEN {_IS.format(f='route')} THEN {_S.format(f='route')} ELSE {_S.format(f='url')} END AS route, nullif({_S.format(f='title')}, '') AS title,
  CASE WHEN {_S.format(f='evidenceStatus')} IN ('complete', 'degraded') THEN {_S.format(f='evidenceStatus')} END AS evidence_status,
  CASE WHEN json_type(j, '$.statusCode') IN ('BIGINT', 'UBIGINT') THEN CAST({_S.format(f='statusCode')} AS INTEGER) END AS status_code,
  CASE WHEN mapped THEN coalesce(json_type(j, '$.artifacts.screenshotUrl') = 'VARCHAR', false) END AS screenshot, CASE WHEN mapped THEN coalesce(json_type(j, '$.artifacts.domSnapshotUrl') = 'VARCHAR', false) END AS dom,
  CASE WHEN mapped THEN coalesce(json_type(j, '$.artifacts.axTreeUrl') = 'VARCHAR', false) END AS ax_tree FROM flags""")
def payload_pages(spark, d):
    rows = _payload(spark, d, _PAGE_PAYLOAD).select("event_id", F.explode(steps.parsed_pages(F.col("raw"))).alias("p"))
    return rows.select("event_id", "p.*")


@query(f"""WITH {px.FINDINGS_SQL} SELECT request_id, position, code, severity, source, 'm ' || code AS message, CASE WHEN source = 'ai-advisory' THEN position % 2 = 0 END AS gateable,
  CASE WHEN source = 'ai-advisory' THEN (request_id % 10) / 10.0 END AS confidence, CASE WHEN source <> 'ai-advisory' THEN 't ' || code END AS title, CASE WHEN source <> 'ai-advisory' THEN page_url END AS page_url,
  CASE WHEN source <> 'ai-advisory' THEN conformance_level END AS conformance_level, CASE WHEN source <> 'ai-advisory' THEN selector END AS selector FROM findings""")
def finding_store(spark, d):
    """What is stored of scan findings and of advisory ones."""
    rows = px.findings(spark, d).select(
        "request_id",
        "position",
        "code",
        "severity",
        "source",
        F.concat(F.lit("m "), "code").alias("message"),
        (F.col("position") % 2 == 0).alias("gateable"),
        ((F.col("request_id") % 10) / 10).alias("confidence"),
        F.concat(F.lit("t "), "code").alias("title"),
        "page_url",
        "conformance_level",
        "selector",
    )
    return steps.stored_findings(rows)


#: Test input: a log event's fields; secrets at several depths, the deepest beyond the depth that is looked at.
_FIELDS = '{"runToken":"tU","kind":"E","level":"x","user":{"id":U,"Password":["a","b"],"deep":[{"cookies":{"a":1},"ok":"E"}]},"a":{"b":{"c":{"d":{"e":{"secret":"kept U","f":"E"}}}}},"none":null}'
_MASK = r"regexp_matches(key, '(?i)token|secret|password|authorization|cookie|credential')"


@query(f"""WITH f AS (SELECT event_id, replace(replace('{_FIELDS}', 'U', CAST(user_id AS VARCHAR)), 'E', event_type) AS raw FROM events),
t AS (SELECT f.event_id, tree.fullkey, tree.key, tree.type, tree.atom, len(regexp_extract_all(tree.path, '\\.|\\[')) AS depth FROM f, json_tree(f.raw) tree),
hidden AS (SELECT event_id, fullkey FROM t WHERE {_MASK} AND depth <= 5),
leaves AS (SELECT t.event_id, fullkey AS path, json_extract_string(atom, '$') AS value FROM t WHERE type NOT IN ('OBJECT', 'ARRAY') AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.event_id = t.event_id AND (t.fullkey = h.fullkey OR starts_with(t.fullkey, h.fullkey || '.') OR starts_with(t.fullkey, h.fullkey || '[')))
  UNION ALL SELECT event_id, fullkey, '[redacted]' FROM hidden)
SELECT event_id, path, value FROM leaves WHERE path IN ('$.runToken', '$.kind', '$.user.id', '$.user.Password', '$.user.deep[0].cookies', '$.user.deep[0].ok', '$.a.b.c.d.e.secret', '$.a.b.c.d.e.f')""")
def log_redaction(spark, d):
    """Leaves of log fields after redaction, by path."""
    e = read_table(spark, d, "events")
    raw = F.replace(F.replace(F.lit(_FIELDS), F.lit("U"), F.col("user_id").cast("string")), F.lit("E"), F.col("event_type"))
    paths = ["$.runToken", "$.kind", "$.user.id", "$.user.Password", "$.user.deep[0].cookies", "$.user.deep[0].ok", "$.a.b.c.d.e.secret", "$.a.b.c.d.e.f"]
    rows = e.select("event_id", jt.redact_keys(raw).alias("safe"))
    told = F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object("safe", p).alias("value")) for p in paths])
    return rows.select("event_id", F.explode(told).alias("x")).select("event_id", "x.path", "x.value")


@query("""SELECT event_id, 'run_' || event_type AS type, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'info' END AS level, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts,
  json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN '[redacted]' END AS token, CAST(CASE WHEN event_id % 2 = 0 THEN 5 ELSE 4 END AS INTEGER) AS n_keys FROM events""")
def log_lines(spark, d):
    e = read_table(spark, d, "events")
    fields = F.when(F.col("event_id") % 2 == 0, F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"apiToken":"x","ts":"never"}'))).otherwise(F.col("props"))
    line = jt.log_line(F.when(F.col("event_id") % 3 == 0, "error").otherwise("info"), F.concat(F.lit("run_"), "event_type"), F.col("ts"), fields)
    rows = e.select("event_id", line.alias("line"))
    at = lambda f: F.get_json_object("line", f"$.{f}")
    return rows.select("event_id", at("type").alias("type"), at("level").alias("level"), at("ts").alias("ts"), at("k").alias("k"), at("apiToken").alias("token"), F.size(F.json_object_keys("line")).alias("n_keys"))


@query("""SELECT event_id, CASE WHEN user_id >= 10 AND user_id % 2 = 0 THEN '[redacted credential]' ELSE CAST(user_id AS VARCHAR) END AS name, CASE WHEN event_type = 'error' THEN '[redacted credential]' ELSE event_type END AS value FROM events""")
def first_use_redaction(spark, d):
    """Strings that equal a secret are replaced wherever they stand; one-letter secrets are none."""
    e = read_table(spark, d, "events")
    tree = F.concat(F.lit('[{"role":"textbox","name":"'), F.col("user_id").cast("string"), F.lit('","states":{"value":["'), "event_type", F.lit('"]}}]'))
    secrets = F.array(F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("error"), F.lit("x"), F.lit(""))
    rows = e.select("event_id", jt.redact_values(tree, secrets).alias("safe"))
    return rows.select("event_id", F.get_json_object("safe", "$[0].name").alias("name"), F.get_json_object("safe", "$[0].states.value[0]").alias("value"))


_FAILED = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in tx.FAILURE_WORDS.items())


@query(f"""WITH words(code, told) AS (VALUES {_FAILED}), e AS (SELECT event_id, list_extract(['journey_step_failed', 'run_timed_out', 'audit_run_failed', event_type, 'invalid_step_id', 'navigation_not_allowed', 'action_not_allowed', 'journey_not_in_scope', 'journey_has_no_steps'], CAST(event_id % 9 + 1 AS INTEGER)) AS code,
  event_type, ts FROM events)
SELECT event_id, coalesce(told, 'The run stopped: ' || e.code || '.') AS told, CASE WHEN event_type = 'error' THEN 'read-only' ELSE 'safe-write' END AS mode, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM e LEFT JOIN words ON words.code = e.code""")
def failure_sentences(spark, d):
    codes = ["journey_step_failed", "run_timed_out", "audit_run_failed", None, "invalid_step_id", "navigation_not_allowed", "action_not_allowed", "journey_not_in_scope", "journey_has_no_steps"]
    e = read_table(spark, d, "events")
    code = F.element_at(F.array(*[F.lit(c) if c else F.col("event_type") for c in codes]), (F.col("event_id") % 9 + 1).cast("int"))
    environment = F.when(F.col("event_type") == "error", "production").otherwise("staging")
    return e.select("event_id", tx.failure_words(code).alias("told"), tx.policy_mode(environment).alias("mode"), tx.date_part(F.col("ts")).alias("day"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 2) AS host,
  regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 3) AS path, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 4) AS search FROM pages)
SELECT page_id, scheme || '://' || host || coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') || search AS page_key, CASE WHEN page_id % 2 = 0 THEN path || search END AS step_path,
  CASE WHEN page_id % 3 = 0 THEN 'https://typed.example.org' ELSE scheme || '://' || host END AS origin FROM p""")
def browser_keys(spark, d):
    """Keys, step paths and origins of URLs written otherwise: upper case, default port, dot segments, backslashes."""
    p = read_table(spark, d, "pages")
    parts = lambda k: F.regexp_extract("url", r"^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?", k)
    port = F.when(parts(1) == "http", ":80").otherwise(":443")
    odd = F.concat(F.upper(parts(1)), F.lit("://"), F.upper(parts(2)), port, F.lit("/./gone/.."), F.replace(parts(3), F.lit("/"), F.when(F.col("page_id") % 5 == 0, F.lit("\\")).otherwise(F.lit("/"))), parts(4), F.lit("#part"))
    target = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://"), parts(2), F.lit(":8443/start"))).otherwise("https://other.example.org/")
    entry = F.when(F.col("page_id") % 3 != 0, odd)
    return p.select("page_id", ux.browser_key(odd).alias("page_key"), ux.browser_step_path(odd, target).alias("step_path"), ux.journey_origin(entry, F.lit("HTTPS://Typed.example.org:443/x")).alias("origin"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 's/' || page_id WHEN 1 THEN '/s/' || page_id WHEN 2 THEN './s/' || page_id || '.html' WHEN 3 THEN '../../etc/' || page_id ELSE '../up' || page_id END AS path,
  CASE WHEN page_id % 5 IN (0, 1, 4) THEN 'https://site.test/app' END AS target FROM pages),
-- a path from the root, or below the folder: one that goes up takes a part of it away, and may not leave the fixture's root
r AS (SELECT *, CASE WHEN starts_with(path, '/') THEN [] WHEN target IS NULL THEN ['fixtures', 'demo'] ELSE ['app'] END AS base, len(regexp_extract_all(path, '\.\./')) AS up, regexp_replace(path, '^(\.{0,2}/)+', '') AS rest FROM p)
SELECT page_id, CASE WHEN target IS NULL AND up > 0 THEN NULL ELSE CASE WHEN target IS NULL THEN 'file://' ELSE regexp_extract(target, '^https?://[^/]+') END || '/' || array_to_string(list_append(base[1:greatest(len(base) - up, 0)], rest), '/') END AS led FROM r""")
def step_targets(spark, d):
    """Where a step's path leads, on a site and below a fixture's folder, which it cannot leave."""
    key = F.col("page_id").cast("string")
    k = F.col("page_id") % 5
    path = F.when(k == 0, F.concat(F.lit("s/"), key)).when(k == 1, F.concat(F.lit("/s/"), key)).when(k == 2, F.concat(F.lit("./s/"), key, F.lit(".html"))).when(k == 3, F.concat(F.lit("../../etc/"), key)).otherwise(F.concat(F.lit("../up"), key))
    target = F.when(k.isin(0, 1, 4), "https://site.test/app")
    return read_table(spark, d, "pages").select("page_id", ux.navigation_url(path, target, F.lit("/fixtures/demo")).alias("led"))
