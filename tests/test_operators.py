"""Literal-row cases of operators whose edges the data does not reach."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.operators import catalog, diff, lookups, runs, scans, steps, views
from plumbline.streaming.windows import budget_stream, step, throttle, throttle_stream

F_SCHEMA = "request_id string, source string, code string, page_url string, selector string, severity string"


def found(spark, *rows):
    return spark.createDataFrame([("r", "deterministic", *r) if len(r) == 4 else ("r", *r) for r in rows], F_SCHEMA)


def status(spark, current, baseline):
    out = diff.diff_status(diff.keyed(current), diff.keyed(baseline)).first()
    return out.status, out.new_findings, out.resolved_findings, out.unchanged_findings


def test_regression_cases(spark):
    a, b, major = ("alt", "/login", "#x", "critical"), ("alt", "/dashboard", "#x", "critical"), ("m", "/", None, "major")
    none = found(spark).limit(0)
    assert status(spark, found(spark, a), found(spark, a)) == ("none", 0, 0, 1)
    assert status(spark, found(spark, a), none) == ("fail", 1, 0, 0)
    assert status(spark, found(spark, major), none) == ("warn", 1, 0, 0)
    assert status(spark, found(spark, ("m", "/", None, "minor")), none) == ("warn", 1, 0, 0)  # any new finding warns
    assert status(spark, found(spark, a, b), found(spark, a)) == ("fail", 1, 0, 1)
    assert status(spark, found(spark, b), found(spark, a)) == ("fail", 1, 1, 0)
    assert status(spark, found(spark, ("ai-advisory", "x", None, None, "critical")), none) == ("none", 0, 0, 0)
    assert status(spark, found(spark, a, a), none) == ("fail", 2, 0, 0)  # a bag
    assert diff.new_findings(diff.keyed(found(spark, a, a)), diff.keyed(none)).count() == 2


def test_comparable(spark):
    rows = [('[{"a":"1","b":"2"}]', '[{"b":"2","a":"1"}]', None, None), ("[1]", "{}", None, None), ("[]", "[]", "x", None), ("[]", "[]", None, None), (None, "[]", None, None), ('[{"a":"1"},{"a":"2"}]', '[{"a":"2"},{"a":"1"}]', None, None)]
    got = spark.createDataFrame(rows, "a string, b string, x string, y string").coalesce(1).select(diff.comparable(*map(F.col, "abxy")).alias("c")).collect()
    assert [r.c for r in got] == [True, False, False, True, False, False]


def test_comparable_at_every_depth(spark):
    rows = [('[{"a":{"x":1,"y":[{"p":1,"q":2}]}}]', '[{"a":{"y":[{"q":2,"p":1}],"x":1}}]'), ('[{"a":{"x":1}}]', '[{"a":{"x":2}}]'), ('[{"a":1}]', '[{"a":"1"}]'), ("[", "[")]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(diff.comparable(F.col("a"), F.col("b"), F.lit(None), F.lit(None)).alias("c")).collect()
    assert [r.c for r in got] == [True, False, False, False]


def test_regression_of_runs(spark):
    pairs = spark.createDataFrame([("new", "old", True), ("bare", "old0", True), ("other", "old", False)], "request_id string, baseline_id string, comparable boolean")
    findings = diff.keyed(spark.createDataFrame([("new", "deterministic", "a", "/", None, "minor"), ("old", "deterministic", "b", "/", None, "minor"), ("other", "deterministic", "z", "/", None, "critical")], F_SCHEMA))
    got = {r.request_id: tuple(r)[1:] for r in diff.regression_of_runs(pairs, findings).collect()}
    assert got == {"new": ("old", "warn", 1, 1, 0), "bare": ("old0", "none", 0, 0, 0), "other": ("old", "incomparable", 0, 0, 0)}


def test_scores_keep_null_apart_from_zero(spark):
    pages = spark.createDataFrame([("a", 10, 10, None, "complete"), ("a", None, None, None, "complete"), ("b", None, None, None, "complete"), ("c", 1, 0, 0, "degraded")], "request_id string, checks_passed int, checks_failed int, checks_incomplete int, evidence_status string")
    got = {r.request_id: (r.score, r.evidence_status) for r in runs.run_scores(pages).collect()}
    assert got == {"a": (50, "complete"), "b": (None, "complete"), "c": (None, "degraded")}
    assert pages.limit(0).agg(runs.worst_evidence(F.col("evidence_status")).alias("w")).first().w == "degraded"


def test_hydrate_without_children(spark):
    r = spark.createDataFrame([("a",)], "request_id string")
    pages = spark.createDataFrame([], "request_id string, position int, url string")
    out = runs.hydrate(r, pages, pages).first()
    assert out.pages == [] and out.findings == []


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", None), ("c", None)], "k string, v double")
    assert {r.k: r.upper_median for r in runs.upper_median(rows, "v", ["k"]).collect()} == {"a": 2.0, "b": 5.0, "c": None}


def test_scan_to_findings(spark):
    node = {"html": "<a>\n x</a>", "target": [["iframe", "a"], ["#b"]], "failureSummary": " ", "any": [{"id": "1", "message": " do "}, {"id": "2", "message": "do"}], "all": [], "none": [{"id": "3", "message": "not"}]}
    rule = {"id": "r", "impact": "serious", "tags": ["wcag2a", "wcag111"], "help": "Help", "helpUrl": "u", "nodes": [node, node]}
    raw = [("p", json.dumps({"violations": [rule], "incomplete": [rule | {"impact": None, "nodes": [node | {"target": ["#x"]}]}]})), ("q", "{broken"), ("r", None)]
    df = spark.createDataFrame(raw, "page_url string, raw string").select("page_url", scans.parse_scan(F.col("raw")).alias("scan"))
    out = scans.findings_of_scans(df).orderBy("undecided", "node_place").collect()
    assert [(r.page_url, r.severity, r.selector, r.message) for r in out] == [("p", "major", "iframe a >>> #b", "Help")] * 2 + [("p", "needs-review", "#x", "Help")]
    assert out[0].remediation_any == ["do"] and out[0].remediation_all == ["not"] and out[0].wcag_criteria == ["1.1.1"] and out[0].conformance_level == "A"
    assert df.select(scans.failed_nodes(F.col("scan.violations")).alias("n")).collect()[0].n == 2


def test_ax_tree(spark):
    nodes = [{"ignored": True, "role": {"value": "link"}}, {"role": {"value": "generic"}}, {"role": {"value": "button"}, "name": {"value": "  "}}, {"role": {"value": "heading"}, "name": {"value": "x" * 201}, "properties": [{"name": "level", "value": {"value": "2"}}, {"name": "checked", "value": {"value": "true"}}, {"name": "expanded", "value": {"value": "false"}}]}]
    df = spark.createDataFrame([(json.dumps(nodes),)], "raw string").select(scans.prune_ax_tree(F.from_json("raw", scans.AX)).alias("t"))
    t = df.first().t
    assert [(n.role, n.name, n.level, n.states) for n in t] == [("button", None, None, []), ("heading", "x" * 200 + "…", 2.0, ["checked"])]


def test_findings_views_overlay(spark):
    f = found(spark, ("alt", "/", None, "critical"), ("b", None, None, "odd")).withColumn("client_id", F.lit("c"))
    t = spark.createDataFrame([("c", "deterministic:alt:/:", "accepted-risk", "n"), ("d", "deterministic:b::", "assigned", None)], "client_id string, finding_key string, state string, note string")
    got = {r.code: (r.display, r.finding_status, r.triage_note) for r in views.finding_views(f, t).collect()}
    assert got == {"alt": ("must", "Dismissed", "n"), "b": ("review", "Open", None)}


def test_page_findings_keeps_both_sides_and_repeats_for_duplicate_pages(spark):
    pages = spark.createDataFrame([("r", "/a", 0, "complete"), ("r", "/a", 1, "complete"), ("r", "/b", 2, "complete")], "request_id string, url string, position int, evidence_status string")
    f = spark.createDataFrame([("r", "/a", 0, "x"), ("r", "/lost", 1, "y")], "request_id string, page_url string, position int, code string")
    got = sorted((r.page_url, r.page_place, r.code) for r in views.page_findings(pages, f).fillna({"page_place": -1, "code": ""}).collect())
    assert got == [("/a", 0, "x"), ("/a", 1, "x"), ("/b", 2, ""), ("/lost", -1, "y")]
    assert views.clean_pages(pages, f).count() == 1


def test_shared_report(spark):
    reports = spark.createDataFrame([("1", "r", None, None, "t", None), ("2", "r", None, None, "u", "2026"), ("3", "r", "Own", None, "v", None)], "id string, request_id string, title string, created_at string, share_token string, revoked_at string")
    run = spark.createDataFrame([("r", "j", "2026")], "request_id string, journey_id string, created_at string")
    journeys = spark.createDataFrame([("j", "c")], "id string, client_id string")
    clients = spark.createDataFrame([("c", "Acme")], "id string, name string")
    shared = lambda t, c=clients: [(r.title, r.client_name) for r in views.shared_report(reports, run, journeys, c, t).collect()]
    assert shared("t") == [("Accessibility audit — Acme", "Acme")]
    assert shared("u") == [] and shared("v") == [("Own", "Acme")]
    assert shared("t", clients.limit(0)) == [("Accessibility audit — report", "Unnamed client")]


J_SCHEMA = "id string, client_id string, name string, target_url string, steps string, schedule string, schedule_hour int, last_scheduled_at timestamp_ntz, archived_at string"


def test_due_journeys(spark):
    now = dt.datetime(2026, 1, 10, 3, 30)
    rows = {
        "due": ("https://a/", '[{"a":1}]', "daily", None, None, None),
        "claimed": ("https://a/", '[{"a":1}]', "daily", 3, now - dt.timedelta(hours=2), None),
        "rested": ("https://a/", '[{"a":1}]', "daily", 3, now - dt.timedelta(hours=25), None),
        "weekly": ("https://a/", '[{"a":1}]', "weekly", 3, now - dt.timedelta(days=5), None),
        "odd": ("https://a/", '[{"a":1}]', "hourly", 3, now - dt.timedelta(days=1), None),
        "off": ("https://a/", '[{"a":1}]', "off", 3, None, None),
        "none": ("https://a/", '[{"a":1}]', None, 3, None, None),
        "hour": ("https://a/", '[{"a":1}]', "daily", 4, None, None),
        "target": ("", '[{"a":1}]', "daily", 3, None, None),
        "empty": ("https://a/", "[]", "daily", 3, None, None),
        "object": ("https://a/", "{}", "daily", 3, None, None),
        "archived": ("https://a/", '[{"a":1}]', "daily", 3, None, "2026"),
    }
    df = spark.createDataFrame([(k, "c", "n", *v) for k, v in rows.items()], J_SCHEMA)
    at = F.lit(now).cast("timestamp_ntz")
    assert [r.id for r in catalog.due_journeys(df, at, 9).collect()] == ["due", "rested", "odd"]
    assert [r.id for r in catalog.due_journeys(df, at, 1).collect()] == ["due"]
    claimed = catalog.claim_journeys(df, at, 9)
    assert catalog.due_journeys(claimed, at, 9).count() == 0
    assert [r.id for r in catalog.due_journeys(catalog.release_claim(claimed, "odd"), at, 9).collect()] == ["odd"]


def test_staleness(spark):
    now = dt.datetime(2026, 1, 1, 0, 6)
    rows = [("running", dt.datetime(2026, 1, 1), None), ("running", dt.datetime(2025, 12, 31, 23, 59, 59), None), ("running", dt.datetime(2025, 1, 1), now), ("running", None, None), ("complete", dt.datetime(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "status string, created_at timestamp, started_at timestamp").coalesce(1).withColumn("failure_reason", F.lit(None).cast("string"))
    assert [r.status for r in catalog.reconcile_stale(df, F.lit(now)).collect()] == ["running", "failed", "running", "running", "complete"]


def test_upserts(spark):
    schema = "request_id string, status string, created_at int, phase_ms string"
    out = catalog.upsert_runs(spark.createDataFrame([("a", "running", 1, "p"), ("b", "x", 1, None)], schema), spark.createDataFrame([("a", None, 5, None), ("c", "new", 2, "q")], schema))
    assert sorted(map(tuple, out.collect())) == [("a", None, 1, "p"), ("b", "x", 1, None), ("c", "new", 2, "q")]
    s = "id string, name string, owner string"
    out = catalog.upsert_last(spark.createDataFrame([("1", "a", "o")], s), spark.createDataFrame([("1", "b", None), ("2", "c", None)], s), ["id"], fallback=["owner"])
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "b", "o"), ("2", "c", None)]
    kids = spark.createDataFrame([("a", 1), ("b", 1)], "request_id string, n int")
    assert sorted(map(tuple, catalog.replace_children(kids, kids.limit(0), spark.createDataFrame([("a",)], "request_id string")).collect())) == [("b", 1)]


def test_expectations(spark):
    t = spark.createDataFrame([("dismissed", None, None), ("assigned", None, "x"), ("odd", None, None), ("accepted-risk", "why", None), ("assigned", None, " ")], "state string, note string, assignee string")
    assert {r.rule: r.violations for r in catalog.violations(t, catalog.triage_rules()).collect()} == {"state": 1, "note_when_closed": 1, "assignee_when_assigned": 1}


def test_crawl_graph(spark):
    edges = {"/": ["/about", "/pricing", "/hostile", "/docs/guide"], "/about": ["/", "/deep"], "/pricing": ["/", "/deep", "/pricing?tab=annual"], "/docs/guide": ["/docs/handbook"], "/deep": ["/"], "/docs/handbook": ["/"]}
    e = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src string, dst string")
    seeds = spark.createDataFrame([("s", "/")], "site string, page string")
    got = {r.page: r.depth for r in catalog.crawl(e, seeds).collect()}
    assert got == {"/": 0, "/about": 1, "/pricing": 1, "/hostile": 1, "/docs/guide": 1, "/deep": 2, "/docs/handbook": 2, "/pricing?tab=annual": 2}
    assert catalog.crawl(e, seeds, max_depth=1).count() == 5
    assert catalog.crawl(e, seeds, max_pages=3).count() == 3


def test_throttle_steps():
    state, hits = (0, 0), []
    for at in range(9):
        state, _, hit = step(state, at * 1_000_000, True)
        hits.append(hit)
    assert hits == [False] * 8 + [True]
    assert step(state, 301_000_000, True)[2] is False  # the window began with the first failure
    assert step((5, 3), 10, False)[0] == (0, 0)


def test_throttle_batch_equals_stream(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(k, i, t0 + dt.timedelta(seconds=20 * i), i % 11 != 10) for k in ("a", "b") for i in range(25)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, failed boolean")
    want = sorted(map(tuple, throttle(df).collect()))
    assert any(r[3] for r in want)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("throttled").collect())) == want


def test_budget_stream(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = budget_stream(rows, "ts").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 1000


def brute_slugs(names: list[str], taken: list[str]) -> list[str]:
    used, out = {*taken, "new"}, []
    for base in names:
        name, k = base, 2
        while name in used:
            name, k = f"{base}-{k}", k + 1
        used.add(name)
        out.append(name)
    return out


def test_unique_slugs(spark):
    cases = [["a", "a", "a-2"], ["a", "a", "a-2", "a-2"], ["a", "a", "a-2", "a-2-x"], ["new", "new", "new-2"], ["a-2", "a", "a", "a", "a-2", "a-3"], ["a-02", "a", "a", "a-2-2", "a-2", "a-2"], ["7", "7", "-3", "x--2", "x", "x"]]
    for names in cases:
        rows = spark.createDataFrame(list(enumerate(names)), "id int, base string").repartition(3)
        got = [r.slug for r in catalog.unique_slugs(rows, "base", "id").orderBy("id").collect()]
        assert got == brute_slugs(names, []), names
    rows = spark.createDataFrame([(1, "a", "t"), (2, "acme", "t"), (3, "b", "t")], "id int, base string, slug0 string")
    taken = spark.createDataFrame([("acme",), ("acme-2",), ("a",)], "slug string")
    assert {r.id: (r.slug, r.slug0) for r in catalog.unique_slugs(rows, "base", "id", taken).collect()} == {1: ("a-2", "t"), 2: ("acme-3", "t"), 3: ("b", "t")}


def test_unique_slugs_at_random(spark):
    rng = random.Random(4)
    names = [rng.choice("ab") + "".join(f"-{rng.randrange(5)}" for _ in range(rng.randrange(3))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, base string").repartition(4)
    assert [r.slug for r in catalog.unique_slugs(rows, "base", "id").orderBy("id").collect()] == brute_slugs(names, [])


def brute_crawl(links: dict[int, list[int]], bad: set[int], seed: int, max_depth: int, max_pages: int, max_links: int):
    """The queue of one site, a page at a time."""
    pages, errors, seen, queue, dropped = [], [], {seed}, [(seed, 0)], 0
    while queue:
        page, depth = queue.pop(0)
        if page in bad:
            errors.append(page)
            continue
        pages.append((page, depth))
        if depth < max_depth:
            for to in links.get(page, [])[:max_links]:
                if to in seen:
                    continue
                seen.add(to)
                if len(queue) >= max_pages - len(pages):
                    dropped += 1
                else:
                    queue.append((to, depth + 1))
    return pages, errors, len(seen), dropped


def test_crawl_within_bounds(spark):
    rng = random.Random(6)
    links = {i: [rng.randrange(200) for _ in range(rng.randrange(12))] for i in range(200)}
    bad = {i for i in range(200) if i % 6 == 1}
    rows = spark.createDataFrame([(i, k, to) for i, tos in links.items() for k, to in enumerate(tos)], "src long, position int, dst long")
    failed = spark.createDataFrame([(i, f"no {i}") for i in bad], "page long, message string")
    seeds = spark.createDataFrame([(i, i) for i in range(0, 200, 5)], "site long, page long")
    for most, width in ((100, 500), (20, 4), (5, 10), (1, 3)):
        pages, outcomes = catalog.crawl_pages(rows, seeds, failed, max_pages=most, max_links=width, max_errors=2)
        got: dict[int, list] = {}
        for r in sorted(pages.collect(), key=lambda r: (r.site, r.seq)):
            got.setdefault(r.site, []).append((r.page, r.depth))
        for r in outcomes.collect():
            want, errors, seen, dropped = brute_crawl(links, bad, r.site, 3, most, width)
            assert got.get(r.site, []) == want
            assert (r.seen, r.truncated) == (seen, "url-cap" if dropped else None)
            assert [(e.page, e.message) for e in r.errors] == [(i, f"no {i}") for i in errors[:2]] and r.errors_omitted == max(0, len(errors) - 2)


def test_links_as_a_browser_reads_them(spark):
    html = """<a href="/a">1</a><A class='x>y' HREF='b?q=1&amp;r=2#f'>2</A><!-- <a href="/no">x</a> --><a href=//H.test:80/c>3</a><a>none</a><a data-href="/no" href="../up/./d">4</a>
      <a href="mailto:x@y">m</a><a href="javascript:1">j</a><a href="">5</a><a href="#top">6</a><a href="http://h.test:99999/">bad</a><script>'<a href="/no">'</script><a href=" /sp ace ">7</a>"""
    pages = spark.createDataFrame([("http://h.test/x/y/page.html?z=1#old", html)], "url string, html string")
    got = [(r.position, r.href) for r in scans.page_links(pages).collect()]
    here = "http://h.test/x/y/"
    assert got == [(0, "http://h.test/a"), (1, here + "b?q=1&r=2#f"), (2, "http://h.test/c"), (3, "http://h.test/x/up/d"), (6, here + "page.html?z=1"), (7, here + "page.html?z=1#top"), (9, "http://h.test/sp%20ace")]
    many = spark.createDataFrame([("http://h/", "<a href=/x>" * 600 + "<a href='/" + "y" * 3000 + "'>")], "url string, html string")
    assert scans.page_links(many).count() == 500


def test_read_artifacts(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(b"png")
    wanted = spark.createDataFrame([("one.png",), ("two.png",)], "path string")
    assert {r.path: (r.status, r.content) for r in lookups.read_artifacts(spark, str(tmp_path), wanted).collect()} == {"one.png": ("ok", bytearray(b"png")), "two.png": ("pruned", None)}


def test_steps_payload_bounds(spark):
    big = json.dumps([{"action": "filter", "type": "fill", "selector": "#q", "value": "x" * 4000}] * 20)
    rows = [(json.dumps([{"action": "navigate", "type": "goto", "path": "/"}] * n),) for n in (50, 51, 5_000)] + [(big,), ("[]",), (None,), ("{",)]
    got = [r.p for r in spark.createDataFrame(rows, "raw string").coalesce(1).select(steps.steps_problem(F.col("raw")).alias("p")).collect()]
    assert got == [None, "too_many_steps", "too_many_steps", "too_large", None, "not_an_array", "not_an_array"]


def test_columns_of_any_name_pass_through(spark):
    """Columns named like those that the operators work with are neither lost nor overwritten."""
    names = ["_n", "_hour", "_day", "_place", "_in", "_due", "_lost", "n", "hour", "day", "place", "at", "minute", "row", "old", "new", "due", "lost", "ts0"]
    more = [F.lit(7 + k).alias(c) for k, c in enumerate(names)]
    rows = spark.createDataFrame([(i, dt.datetime(2026, 1, 1, 0, i)) for i in range(3)], "id long, ts timestamp").select("*", *more)
    kept = lambda df: {tuple(r) for r in df.select(*names).collect()}
    want = {tuple(range(7, 7 + len(names)))}
    out = catalog.consume_budget(rows, "ts", "id")
    assert kept(out) == want and out.columns[: len(rows.columns)] == rows.columns and [r.day_count for r in out.orderBy("id").collect()] == [1, 2, 3]
    assert kept(catalog.upsert_last(rows, rows.filter("id = 1"), ["id"])) == want
    journeys = rows.selectExpr("*", "ts AS last_scheduled_at", "'daily' AS schedule", "0 AS schedule_hour", "CAST(NULL AS STRING) AS archived_at", "'https://a.test/' AS target_url", "'[{}]' AS steps")
    claimed = catalog.claim_journeys(journeys, F.lit("2026-01-03 00:00:00").cast("timestamp"), 2)
    assert kept(claimed) == want and claimed.columns == journeys.columns
    assert kept(catalog.release_claims(claimed, journeys.filter("id = 0").select("id"))) == want


def test_redaction_to_its_depth(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"token": 1}}, "secret": 2}}}}}
    out = spark.createDataFrame([(json.dumps(deep),), ("no json",), (None,)], "raw string").coalesce(1).select(jsontext.redact_keys("raw").alias("x")).collect()
    want = {"a": {"b": {"c": {"d": {"e": {"f": {"token": 1}}, "secret": "[redacted]"}}}}}
    assert json.loads(out[0].x) == want and out[1].x is None and out[2].x is None


def test_redaction_never_fails_and_stays_in_the_jvm(spark):
    rows = ['{"a":"\\ud800","b":"\\ud83d\\ude00","token":1}', '{"a":1e400,"Token":1}', '{"a":NaN,"token":1}', '{"p":1,"p":{"secret":2}}', '[1,{"token":"x"}]', '"token"', "null", '{"\\u0074oken":1}', '{"a":' + "[" * 3_000 + "]" * 3_000 + "}", '{"token":[' * 3]
    out = spark.createDataFrame([(r,) for r in rows], "raw string").coalesce(1).select(jsontext.redact_keys("raw").alias("x"))
    assert [r.x for r in out.collect()] == ['{"a":"?","b":"😀","token":"[redacted]"}', '{"Token":"[redacted]","a":"Infinity"}', None, '{"p":{"secret":"[redacted]"}}', '[1,{"token":"[redacted]"}]', '"token"', "null", '{"token":"[redacted]"}', None, None]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_values_are_redacted_at_any_depth(spark):
    deep = '{"abc":"abc","x":' + '{"y":[' * 40 + '"abc","a\\"b","q","abcd",",",12' + "]}" * 40 + "}"
    rows = [(deep, ["abc", 'a"b', "q", '","', None, "", "12"]), ('["a","b"]', ['","', ","]), ("[]", None), ("nope", ["nope"]), (None, ["ab"])]
    out = spark.createDataFrame(rows, "raw string, secrets array<string>").coalesce(1).select(jsontext.redact_values(F.col("raw"), F.col("secrets")).alias("x"))
    hidden = '"[redacted credential]"'
    assert [r.x for r in out.collect()] == ['{"abc":' + hidden + ',"x":' + '{"y":[' * 40 + f'{hidden},{hidden},"q","abcd",",",12' + "]}" * 40 + "}", '["a","b"]', "[]", None, None]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_canonical_json_writes_equal_numbers_alike(spark):
    rows = ['[1e2,"1e2",-0.0,1.50,{"b":1,"a":2.0}]', '[100, "1e2", 0, 1.5, {"a":2,"b":1}]', '[100.0,"100",0,15e-1,{"a":2,"b":1}]']
    got = [r.x for r in spark.createDataFrame([(r,) for r in rows], "raw string").coalesce(1).select(jsontext.canonical_json(F.col("raw")).alias("x")).collect()]
    assert got[0] == got[1] == '[100,"1e2",0,1.5,{"a":2,"b":1}]' and got[2] != got[0]


def test_steps_with_repeated_keys(spark):
    raw = '[{"action":"navigate","type":"goto","path":"/a","path":"/b"},{"action":"navigate","type":"goto","path":"/c"}]'
    row = spark.createDataFrame([(raw,)], "raw string").select(steps.steps_problem(F.col("raw")).alias("p"), F.size(steps.elements(F.col("raw"))).alias("n"), F.to_json(steps.elements(F.col("raw"))[0]).alias("first")).first()
    assert row.p is None and row.n == 2 and json.loads(row.first)["path"] == "/b"


def test_workspace_lies_in_the_shared_folder(spark):
    from plumbline.session import Workspace, shared_dir

    ws = Workspace(spark, "t")
    table = ws.save(spark.range(3), "ids")
    assert table.count() == 3 and table.inputFiles()[0].split(":")[-1].replace("///", "/").startswith(shared_dir(spark).split(":")[-1].replace("///", "/"))
    ws.drop(table)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_backfill_gives_the_operator_the_stored_rows(spark, sf, monkeypatch):
    from plumbline.plans import run_queries

    met = []
    insert = catalog.insert_missing
    monkeypatch.setattr(catalog, "insert_missing", lambda stored, incoming, key: met.append((stored.count(), stored.join(incoming, key).count())) or insert(stored, incoming, key))
    run_queries.backfill_missing(spark, sf).count()
    assert len(met) == 1 and min(met[0]) > 0


def test_crawl_folds_sites_in_one_stream(spark, monkeypatch):
    """Sites over several Arrow batches, null and equal keys among them, give what each gives alone; no call per site."""
    calls = []
    from pyspark.sql import GroupedData

    from plumbline.operators.crawling import crawl_sites

    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a, **k: calls.append(1))
    seeds = spark.createDataFrame([(i, f"https://a.test/{i % 40}", ["a.test"]) for i in range(1_500)] + [(None, "https://a.test/1", ["a.test"])], "site long, url string, allowed array<string>").repartition(3)
    captured = spark.createDataFrame([(f"https://a.test/{i}", None, "t", 1, None) for i in range(40)], "url string, settled_url string, title string, cost_ms long, error string")
    links = spark.createDataFrame([(f"https://a.test/{i}", k, f"https://a.test/{(i * 3 + k) % 40}") for i in range(40) for k in range(3)], "url string, position int, href string")
    pages, outcomes = crawl_sites(seeds, captured, links, max_depth=1, max_pages=3)
    got: dict = {}
    for r in pages.collect():
        got.setdefault(r.site, set()).add(int(r.url.rsplit("/", 1)[1]))
    for i in range(1_500):
        p = i % 40
        met = [p] + [x for k in range(3) if (x := (p * 3 + k) % 40) != p]
        assert got[i] == set(list(dict.fromkeys(met))[:3])
    assert outcomes.count() >= 1_500 and not calls


def test_crawl_levels_take_open_sites_only(spark, monkeypatch):
    """Each level is dealt by its rows, and holds a row of state and the visits of sites that still have some."""
    from pyspark.sql.classic.dataframe import DataFrame

    from plumbline import session
    from plumbline.operators.crawling import crawl_sites

    monkeypatch.setattr(session, "TASK_ROWS", 5)
    levels, run = [], DataFrame.mapInArrow

    def kept(df, *args):
        levels.append((df.groupBy("site").count().collect(), df.rdd.getNumPartitions()))
        return run(df, *args)

    monkeypatch.setattr(DataFrame, "mapInArrow", kept)
    seeds = spark.createDataFrame([(i, f"https://a.test/{i}", ["a.test"]) for i in range(40)], "site long, url string, allowed array<string>")
    captured = spark.createDataFrame([("https://a.test/0", None, "t", 1, None)], "url string, settled_url string, title string, cost_ms long, error string")
    links = spark.createDataFrame([("https://a.test/0", k, f"HTTPS://A.test/x/../{41 + k}") for k in range(3)] + [("https://a.test/41", 0, "https://a.test/50")], "url string, position int, href string")
    pages, outcomes = crawl_sites(seeds, captured, links, max_depth=3)
    assert [(len(sites), sum(r["count"] for r in sites)) for sites, _ in levels] == [(40, 80), (1, 4), (1, 2)] and levels[0][1] >= 16
    assert sorted((r.url, r.depth) for r in pages.filter("site = 0").collect()) == [("HTTPS://A.test/x/../41", 1), ("HTTPS://A.test/x/../42", 1), ("HTTPS://A.test/x/../43", 1), ("https://a.test/0", 0), ("https://a.test/50", 2)]
    assert {r.site: (r.pages, r.seen) for r in outcomes.collect()} == {i: (1, 1) for i in range(1, 40)} | {0: (5, 5)}


def test_steps_are_read_once(spark):
    """Each field of a step is taken from its variant in one place of the plan, as a lambda repeats what it names."""
    rows = spark.createDataFrame([('[{"action":"navigate","type":"goto","path":"/a"}]',)], "raw string")
    for made in (steps.steps_problem(F.col("raw")), steps.step_views(F.col("raw"))):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("json_object_keys(") <= 2


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """What is nested, and a crawl's levels, are dealt to as many tasks as the number of rows asks for."""
    from plumbline import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    r = spark.range(100).withColumnRenamed("id", "request_id")
    children = r.withColumn("position", F.lit(1)).withColumn("code", F.lit("x"))
    out = runs.hydrate(r, children, children)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [request_id") == 4 and out.filter("size(pages) = 1").count() == 100
    assert session.dealt(children, children.count(), "request_id").rdd.getNumPartitions() == 10
    links = spark.createDataFrame([(i, 0, (i + 1) % 100) for i in range(100)], "src long, position int, dst long")
    pages, _ = catalog.crawl_pages(links, spark.range(100).select(F.col("id").alias("site"), F.col("id").alias("page")))
    assert "RepartitionByExpression [site" in pages._jdf.queryExecution().optimizedPlan().toString() and pages.count() == 400


def test_checked_write_does_not_sort(spark, monkeypatch):
    """A write into partitions sorts and holds a task's rows; this one has none, and gives both tables."""
    from pyspark.sql import DataFrameWriter

    from plumbline.operators.expectations import write_checked

    monkeypatch.setattr(DataFrameWriter, "partitionBy", None)
    kept, held, counts = write_checked(spark.range(10), {"small": F.col("id") < 7}, "few")
    assert kept.count() == 7 and sorted((r.id, r.broken) for r in held.collect()) == [(i, ["small"]) for i in (7, 8, 9)] and counts == {"rows": 10, "small": 3}
