"""Literal-row cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import findings as fx
from plumbline.functions import text as tx
from plumbline.functions import urls as ux
from plumbline.functions import wcag, web
from plumbline.operators import catalog


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_finding_key_takes_null_as_empty(spark):
    got = values(spark, [("deterministic", "c", None, None), ("deterministic", "c", "", "")], "s string, c string, p string, x string", fx.finding_key(*map(F.col, "scpx")))
    assert got == ["deterministic:c::"] * 2


def test_display_severity_and_rank(spark):
    rows = [("critical",), ("major",), ("minor",), ("needs-review",), ("advisory",), ("odd",), (None,)]
    assert values(spark, rows, "s string", fx.display_severity(F.col("s"))) == ["must", "should", "nice", "review", "advisory", "review", "review"]
    assert values(spark, rows, "s string", fx.display_rank(F.col("s"))) == [5, 5, 5, 5, 4, 5, 5]


def test_finding_status_precedence(spark):
    rows = [(True, "dismissed"), (False, "accepted-risk"), (False, "assigned"), (True, "assigned"), (True, None), (None, None)]
    assert values(spark, rows, "l boolean, t string", fx.finding_status(F.col("l"), F.col("t"))) == ["Dismissed", "Dismissed", "Fixed", "Assigned", "Open", "Fixed"]
    assert values(spark, [(True, None)], "l boolean, t string", fx.finding_status(F.col("l"), F.col("t"), F.lit(True))) == ["Retest due"]


def test_verdict_precedence(spark):
    rows = [("running", "fail", True), ("failed", "pass", False), ("complete", "inconclusive", True), ("complete", "fail", True), ("complete", "pass", True), ("complete", "pass", None), (None, "pass", False)]
    assert values(spark, rows, "s string, c string, u boolean", fx.run_verdict(*map(F.col, "scu"))) == ["scan", "inconclusive", "inconclusive", "fail", "risk", "pass", "pass"]


def test_gate_is_never_null(spark):
    rows = [("deterministic", "minor", "A"), ("deterministic", "needs-review", "A"), ("deterministic", "critical", None), ("ai-advisory", "critical", "AA"), ("deterministic", None, "AA"), (None, "critical", "A"), ("deterministic", "critical", "AAA")]
    assert values(spark, rows, "s string, v string, l string", fx.gates(*map(F.col, "svl"))) == [True, False, False, False, True, False, False]


@pytest.mark.parametrize(("passed", "failed", "evidence", "score"), [(90, 10, "complete", 90), (100, 50, "complete", 67), (2489, 15, "complete", 99), (2504, 0, "complete", 100), (80, 20, "complete", 80), (90, 10, "degraded", None), (0, 0, "complete", None), (50, 0, "complete", 100), (0, 50, "complete", 0), (10, 10, "complete", 50), (2495, 5, "complete", 99)])
def test_score(spark, passed, failed, evidence, score):
    assert values(spark, [(passed, failed, evidence)], "p long, f long, e string", fx.score_of(*map(F.col, "pfe"))) == [score]


def test_tags(spark):
    rows = [(["wcag143"],), (["wcag1412"],), (["wcag2a", "wcag412", "wcag244"],), (["best-practice"],), (["wcag2a-obsolete"],), (["wcag2aaa", "wcag21aa"],), ([],), (None,)]
    assert values(spark, rows, "t array<string>", fx.criteria_of_tags(F.col("t"))) == [["1.4.3"], ["1.4.12"], ["2.4.4", "4.1.2"], [], [], [], [], None]
    assert values(spark, rows, "t array<string>", fx.level_of_tags(F.col("t"))) == [None, None, "A", None, None, "AA", None, None]


def test_snippet_and_title(spark):
    rows = [(" <a>\n\t x </a> ",), ("x" * 600,), (None,)]
    assert values(spark, rows, "h string", fx.snippet(F.col("h"))) == ["<a> x </a>", "x" * 512 + "…", None]
    assert values(spark, [("é" * 301,), ("é" * 300,)], "t string", fx.bound_title(F.col("t"))) == ["é" * 300 + "…", "é" * 300]


def test_evidence(spark):
    rows = [("s", "d", "a", None), ("s", "d", "a", 399), ("s", "d", "a", 400), ("s", None, "a", 200), ("", "d", "a", 200)]
    assert values(spark, rows, "s string, d string, a string, c int", fx.evidence_status(*map(F.col, "sdac"))) == ["complete", "complete", "degraded", "degraded", "degraded"]


def test_paths(spark):
    rows = [("/help",), ("/help/",), ("/help/index.html",), ("/help/INDEX.HTM",), ("/",), ("",), ("/index.html",), ("/a/b/c/",)]
    assert values(spark, rows, "p string", ux.normalise_path(F.col("p"))) == ["/help"] * 4 + ["/"] * 3 + ["/a/b/c"]


def test_discovery_keys(spark):
    rows = [("https://A.test/help",), ("https://a.test/help/",), ("https://a.test/help/index.html#top",), ("https://a.test/help?q=1",), ("/relative",), ("",), ("not a url",), ("#frag",), (None,)]
    key = "https://a.test/help"
    assert values(spark, rows, "u string", ux.discovery_key(F.col("u"))) == [key, key, key, f"{key}?q=1"] + [None] * 5


def test_locations(spark):
    rows = [("https://a.test/x?token=1#y",), ("http://a.test:8080",), ("file:///tmp/a.html",), ("nope",), (None,)]
    assert values(spark, rows, "u string", ux.settled_location(F.col("u"))) == ["https://a.test/x", "http://a.test:8080/", "file:///tmp/a.html", ux.UNPARSEABLE, ux.UNPARSEABLE]
    text = [("Went to https://a.test/x?t=1. Then (http://b.test/y#z) and 'https://c.test/q?r=1'!",)]
    assert values(spark, text, "u string", ux.reduce_urls(F.col("u"))) == ["Went to https://a.test/x. Then (http://b.test/y) and 'https://c.test/q'!"]


BLOCKED = "169.254.169.254 127.1.2.3 10.255.255.255 172.31.255.255 192.168.1.1 100.64.0.1 0.0.0.0 224.0.0.1 255.255.255.255 ::1 fe80::1 fc00::1 fd12:3456::1 ::ffff:169.254.169.254 64:ff9b::7f00:1 2002:7f00:1:: example.com".split()
FREE = "93.184.216.34 8.8.8.8 172.32.0.1 11.0.0.1 2606:2800:220:1:248:1893:25c8:1946".split()


def test_blocked_addresses(spark):
    rows = [(a,) for a in [*BLOCKED, "", *FREE]]
    assert values(spark, rows, "a string", ux.blocked_address(F.col("a"))) == [True] * (len(BLOCKED) + 1) + [False] * len(FREE)


def test_allowed_hosts(spark):
    rows = [("app.example.com",), ("eu.app.example.com",), ("APP.example.com.",), ("app.example.com.attacker.com",), ("attacker.com",)]
    allowed = F.array(F.lit("App.example.com"))
    assert values(spark, rows, "h string", ux.host_allowed(F.col("h"), allowed)) == [True, True, True, False, False]
    assert values(spark, rows[:1], "h string", ux.host_allowed(F.col("h"), F.array().cast("array<string>"))) == [False]


def test_target_refusals(spark):
    rows = [("https://a.test/x",), ("ftp://a.test/",), ("https://u:p@a.test/",), ("https://b.test/",), ("https://10.0.0.1/",), ("nonsense",), (None,)]
    allowed = F.array(F.lit("a.test"), F.lit("10.0.0.1"))
    assert values(spark, rows, "u string", ux.target_refusal(F.col("u"), allowed)) == [None, "scheme", "credentials", "host_not_allowed", "private_address", "invalid_url", "invalid_url"]


def test_target_refusals_by_the_host_that_a_browser_connects_to(spark):
    hosts = ["2130706433", "0x7f.1", "0x7f.0.0.1", "127.0.0.1.", "017700000001", "[::ffff:127.0.0.1]", "%31%32%37.0.0.1", "１２７。0.0.1", "256.0.0.1", "1.2.3.4.5", "fa\u00df.de", "XN--ZCA.de", "xn--a.de", "8.8.8.8", "a b", ""]
    rows = [(f"http://{h}/",) for h in hosts]
    allowed = F.array(*[F.lit(h) for h in ("127.0.0.1", "[::ffff:7f00:1]", "xn--fa-hia.de", "xn--zca.de", "8.8.8.8")])
    got = spark.createDataFrame(rows, "u string").select(ux.host_as_browser(F.col("u")).alias("h"), ux.target_refusal(F.col("u"), allowed).alias("r")).collect()
    assert [r.h for r in got] == ["127.0.0.1"] * 5 + ["[::ffff:7f00:1]", "127.0.0.1", "127.0.0.1", None, None, "xn--fa-hia.de", "xn--zca.de", None, "8.8.8.8", None, None]
    private, bad = "private_address", "invalid_url"
    assert [r.r for r in got] == [private] * 8 + [bad, bad, None, None, bad, None, bad, bad]


def test_url_parser():
    base = web.parse_url("http://h/a/b?c#d")
    told = {"../x": "http://h/x", "?q": "http://h/a/b?q", "#f": "http://h/a/b?c#f", "": "http://h/a/b?c", "//O:80/y": "http://o/y", "\\\\o\\y": "http://o/y", "http:z": "http://h/a/z", "https:z": "https://z/", "a b\n\u00fc": "http://h/a/a%20b%C3%BC", "%2E%2e/z": "http://h/z", "mailto:a@b": "mailto:a@b", "javascript:x y": "javascript:x y", "http://u:p@q:081/": "http://u:p@q:81/"}
    assert {k: web.parse_url(k, base).href for k in told} == told
    for refused in ("http://", "http://a:b", "http://h:65536/", "http://[::1", "http://a^b/", "http://u@/", "x", "http://1.2.3.0x/a.b"[:14] + "zz.09"):
        assert web.parse_url(refused) is None, refused
    assert web.parse_url("file:///C|/a/../../b").href == "file:///C:/b" and web.parse_url("file://localhost/x").href == "file:///x"


def test_links_of_a_document():
    read = lambda text: web.page_anchors(text, "https://s.test/a/b", 99)
    assert read('<base href="https://cdn.test/x/"><a href="y">') == ["https://cdn.test/x/y"]
    assert read('<a href=1><base href="/z/"><base href="/w/">') == ["https://s.test/z/1"]
    assert read('<base href="data:x"><a href=1>') == ["https://s.test/a/1"]
    assert read("<noscript><a href=1></noscript><a href=2><!-- <a href=3>") == ["https://s.test/a/2"]
    assert read("<a href='?page=1&section=2'><a href='?a&copy=2&copy;&amp;b&lt'>") == ["https://s.test/a/b?page=1&section=2", "https://s.test/a/b?a&copy=2%C2%A9&b%3C"]
    assert read("<template><a href=1></template><svg><a href=2></a><title><a href=3></title></svg><a href=4>") == [None, None, "https://s.test/a/4"]
    assert read("<script><!--<script></script><a href=1>--></script><style><a href=2></style ><A\nHREF\f=\f3 href=4><a href='5") == ["https://s.test/a/3"]
    assert read("<!--><a href=1><!---><a href=2><!-- --!><a href=3><? <a href=4>><a/href=5/>") == [f"https://s.test/a/{k}" for k in (1, 2, 3)] + ["https://s.test/a/5/"]
    assert read("<a href='http://h:99999/'><plaintext><a href=1>") == [None]
    assert read(None) == [] and web.page_anchors("<a href=1>", None, 9) == [None]


def test_host_problems(spark):
    rows = [("ok.example.com",), ("",), ("*.a.com",), ("a.com:80",), ("a" * 254,), ("münchen.de",), ("localhost",), ("1.2.3.4",), ("co.uk",)]
    assert values(spark, rows, "h string", ux.host_problem(F.col("h"))) == [None, "blank", "wildcard", "not_just_a_host", "too_long", "not_punycode", "not_a_hostname", "address", "public_suffix"]


def test_browser_urls(spark):
    rows = [("HTTPS://Ex.Test:443/a/../b/./c?q#f",), ("http://ex.test:8080",), ("nope",), (None,)]
    parts = ux.browser_url(F.col("u"))
    got = values(spark, rows, "u string", F.concat_ws("|", parts["protocol"], parts["host"], parts["pathname"], parts["search"]))
    assert got == ["https:|ex.test|/b/c|?q", "http:|ex.test:8080|/|", "", ""]


def test_text(spark):
    one = lambda v, c: values(spark, [(v,)], "t string", c(F.col("t")))[0]
    assert one("<a href=\"x\">'&'</a>", tx.escape_html) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    assert one("  Ünï Café & Co. ", lambda t: tx.slug(t, 48)) == "n-caf-co"
    assert one("ada  lovelace king", tx.initials) == "AK"
    assert one("   ", tx.initials) == "O"
    assert one("/docs/Guide Page.html", lambda t: tx.page_key(F.lit(3), t)) == "03-docs-guide-page"
    assert one("/", lambda t: tx.page_key(F.lit(12), t)) == "12-page"
    assert one("✓ Pass!", tx.verdict_words) == "pass"
    assert one('<div id="__NEXT">', tx.detect_platform) == "react"
    assert one("/wp-content/x", tx.detect_platform) == "wordpress"
    assert one("<p>", lambda t: tx.detect_platform(t, F.lit("wordpress"))) == "wordpress"
    assert one("<p>", lambda t: tx.detect_platform(t, F.lit("unknown"))) == "generic"


def test_limits():
    assert [tx.clamp_limit(x) for x in (None, float("nan"), float("inf"), 0, -5, 100000, 2.5)] == [20, 20, 20, 1, 1, 100, 2]
    assert [tx.positive_or(x, 7) for x in ("3", "0", "-1", "x", None, "2.5")] == [3, 7, 7, 7, 7, 7]


def test_criteria(spark):
    rows = [("1.4.3",), ("WCAG 1.4.10",), ("143",), ("9.9.9",), ("alt",)]
    got = {r.raw: r.description for r in wcag.describe_criteria(spark.createDataFrame(rows, "raw string"), "raw").collect()}
    assert got == {"1.4.3": "1.4.3 Contrast (Minimum) (AA)", "WCAG 1.4.10": "1.4.10 Reflow (AA)", "143": "1.4.3 Contrast (Minimum) (AA)", "9.9.9": "9.9.9", "alt": "alt"}
    listed = wcag.distinct_criteria(spark.createDataFrame([(["1.4.10", "143", "x"],), (["1.4.3"],)], "c array<string>"), "c").collect()
    assert [r.number for r in listed] == ["1.4.3", "1.4.10"]


def test_policy(spark):
    rows = [("production", "delete"), ("production", "search"), ("staging", "submit-safe"), ("test", "mutate-test-data"), ("nowhere", "login"), (None, None)]
    assert values(spark, rows, "e string, a string", catalog.action_allowed(F.col("e"), F.col("a"))) == [False, True, True, True, False, False]
    assert "mutate-test-data" in catalog.actions_anywhere() and "delete" not in catalog.actions_anywhere()


def test_target_parts_refuse_as_whole_urls_do(spark):
    odd = ["https://a.test/x", "HTTP://B.A.Test.:80/x/../y#f", "https://u:p@a.test/", "ftp://a.test/", "no url", None, "https://0x7f.1/", "http://[::1]/", "http://[2001:db8::1]/", "https://10.0.0.1/", "https://8.8.8.8/", "https://xn--mnchen-3ya.test/", "https://münchen.test/"]
    lists = [["a.test"], ["*.A.test."], [], None, ["127.0.0.1", "[::1]", None, "8.8.8.8", "[2001:db8::1]", "10.0.0.1"], ["münchen.test", "xn--mnchen-3ya.test"]]
    rows = spark.createDataFrame([(u, a) for u in odd for a in lists], "url string, allowed array<string>")
    stored = rows.withColumn("parts", ux.target_parts(F.col("url"))).localCheckpoint()
    got = stored.select("url", "allowed", ux.target_refusal(F.col("url"), F.col("allowed")).alias("whole"), ux.parts_refusal(F.col("parts"), F.col("allowed")).alias("parts")).collect()
    assert [r.parts for r in got] == [r.whole for r in got] and len({r.whole for r in got}) > 6


def test_url_facts_are_key_and_parts(spark):
    """Read at once, in SQL or in Python, a URL has the key and parts that it has by the functions for each."""
    shown = ["https://a.test/x", "https://a.test", "http://a.test/", "http://a/", "https://a.test/x/y//", "https://a_b.a-.test//", "https://1.2.b/", "https://a.test/~x/A_b-c"]
    odd = ["HTTP://B.A.Test.:80/x/../y#f", "https://a.test:443/x", "https://a.test/x?", "https://a.test/x?q=1#f", "https://a.test/Index.HTML", "https://a.test/x/%2e%2e/y", "https://a.test/x\\y", "https://u:p@a.test/", "ftp://a.test/"]
    odd += ["file:///etc/x", "mailto:a@b.test", "no url", "", None, "https://0x7f.1/", "http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://[2001:db8::1]/", "https://10.0.0.1/", "https://8.8.8.8/x/", "https://1.2/"]
    odd += ["https://xn--mnchen-3ya.test/", "https://a.xn--b/", "https://münchen.test/", "https://a..b/", "https://.a/", "https://a.test\n", " https://a.test/x ", "https://a.test/x y", "https:///a.test/x", "https://a.test./", "https://a.1a/"]
    rows = spark.createDataFrame([(u,) for u in shown + odd], "url string")
    whole = ux.target_parts(F.col("url"))
    got = rows.select("url", ux.url_facts(F.col("url")).alias("facts"), F.struct(ux.browser_key(F.col("url")).alias("key"), whole["early"].alias("early"), whole["host"].alias("host"), whole["late"].alias("late")).alias("want")).collect()
    assert {r.url: r.facts for r in got} == {r.url: r.want for r in got}
    assert [r.url for r in rows.filter(F.col("url").rlike(ux._SHOWN)).collect()] == shown  # noqa: SLF001


def test_blocked_ranges_are_not_built_for_every_address(monkeypatch):
    """Ranges are numbers made once; the ends of each are in it, their neighbours as the networks say."""
    import ipaddress

    nets = [ipaddress.ip_network(f"{n}/{p}") for n, p in ux.BLOCKED_IPV4]
    six = [ipaddress.ip_network(n) for n in ("fc00::/7", "fe80::/10", "ff00::/8")]
    want = {}
    for net, all_nets in [(n, nets) for n in nets] + [(n, six) for n in six]:
        for at in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1):
            if 0 <= at < 1 << net.max_prefixlen:
                ip = type(net.network_address)(at)
                want[str(ip)] = any(ip in n for n in all_nets)
    for text in [t for t in want if "." in t]:
        want[f"::ffff:{text}"] = want[f"64:ff9b::{text}"] = want[text]
    monkeypatch.setattr(ipaddress, "ip_network", None)
    assert {a: ux._blocked_v6(a) for a in want} == want  # noqa: SLF001
    assert ux._blocked_v6(None) and ux._blocked_v6("no") and not ux._blocked_v6("2001:db8::1%eth0")  # noqa: SLF001
