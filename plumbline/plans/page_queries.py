"""Queries over captured pages, texts, hosts, tags, policies and throttles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import findings as fx
from plumbline.functions import text as tx
from plumbline.functions import urls as ux
from plumbline.functions import wcag
from plumbline.operators import catalog, diff, scans
from plumbline.sources.tables import read_table
from plumbline.streaming.windows import throttle

Q: dict = {}
SQL: dict[str, str] = {}

_HEAD = r"regexp_extract(url, '^(https?|file)://([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?', {n}, 'i')"
_ORIGIN = f"lower({_HEAD.format(n=1)} || '://' || {_HEAD.format(n=2)})"
_PATH = f"CASE WHEN {_HEAD.format(n=3)} = '' THEN '/' ELSE {_HEAD.format(n=3)} END"
_NORM = r"coalesce(nullif(regexp_replace(regexp_replace({p}, '/index\.html?$', '/', 'i'), '/+$', ''), ''), '/')"


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _pages(spark, d):
    return read_table(spark, d, "pages")


@query(f"SELECT page_id, {_ORIGIN} || {_NORM.format(p=_PATH)} || {_HEAD.format(n=4)} AS page_key FROM pages")
def url_key(spark, d):
    return _pages(spark, d).select("page_id", ux.discovery_key(F.col("url")).alias("page_key"))


@query(f"SELECT page_id, {_ORIGIN} || {_PATH} AS location, lower({_HEAD.format(n=2)}) AS host FROM pages")
def url_location(spark, d):
    return _pages(spark, d).select("page_id", ux.settled_location(F.col("url")).alias("location"), ux.url_hostname(F.col("url")).alias("host"))


@query(f"SELECT page_id, {_NORM.format(p=_PATH)} AS route FROM pages")
def path_norm(spark, d):
    return _pages(spark, d).select("page_id", ux.route_of(F.col("url")).alias("route"))


@query(f"SELECT page_id, CASE WHEN lower({_HEAD.format(n=2)}) = 'thther.example.org' THEN {_PATH} || {_HEAD.format(n=4)} END AS step FROM pages")
def step_paths(spark, d):
    return _pages(spark, d).select("page_id", ux.step_path(F.col("url"), F.lit("https://THTHER.example.org/start")).alias("step"))


@query(r"""SELECT page_id, CASE WHEN substr(url, 5, 1) = ':' AND page_id % 3 = 0 THEN 'scheme' WHEN lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) LIKE '%.example.org' THEN NULL ELSE 'host_not_allowed' END AS refusal FROM pages""")
def target_refusals(spark, d):
    url = F.when((F.substring("url", 5, 1) == ":") & (F.col("page_id") % 3 == 0), F.regexp_replace("url", "^http:", "ftp:")).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", ux.target_refusal(url, F.array(F.lit("Example.org"))).alias("refusal"))


@query(r"""WITH t AS (SELECT c_custkey, trim(lower(c_name || ' ' || c_mktsegment)) AS n FROM customer), s AS (SELECT c_custkey, regexp_replace(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t)
SELECT c_custkey, regexp_replace(substr(slug, 1, 24), '-+$', '') AS slug FROM s""")
def slugs(spark, d):
    c = read_table(spark, d, "customer")
    return c.select("c_custkey", tx.slug(F.concat_ws(" ", "c_name", "c_mktsegment"), 24).alias("slug"))


def _slug_sql() -> str:
    """Rows in order, each given its base or the first free suffix: one step of the recursion per row of a family of bases."""
    return r"""WITH RECURSIVE n AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '  ' || p_brand || ' ! ' WHEN 1 THEN p_name || ' 2' WHEN 2 THEN 'New' WHEN 3 THEN '??' WHEN 4 THEN 'Client' ELSE p_name END AS name FROM part),
b AS (SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'client') AS base FROM n),
f AS (SELECT *, coalesce(nullif(regexp_replace(base, '(-[0-9]+)+$', ''), ''), base) AS root FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS i FROM f),
w AS (SELECT root, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS VARCHAR) AS slug, ['new'] AS taken FROM (SELECT DISTINCT root FROM o)
  UNION ALL
  SELECT root, i, p_partkey, slug, list_append(taken, slug) FROM (
    SELECT o.root, o.i, o.p_partkey, w.taken, CASE WHEN NOT list_contains(w.taken, o.base) THEN o.base
      ELSE list_extract(list_filter(list_transform(range(2, len(w.taken) + 3), lambda k: o.base || '-' || k), lambda c: NOT list_contains(w.taken, c)), 1) END AS slug
    FROM w JOIN o ON o.root = w.root AND o.i = w.i + 1))
SELECT p_partkey, slug FROM w WHERE i > 0"""


@query(_slug_sql())
def unique_slugs(spark, d):
    key = F.col("p_partkey")
    named = F.when(key % 11 == 0, F.concat(F.lit("  "), "p_brand", F.lit(" ! "))).when(key % 11 == 1, F.concat("p_name", F.lit(" 2"))).when(key % 11 == 2, "New").when(key % 11 == 3, "??").when(key % 11 == 4, "Client").otherwise(F.col("p_name"))
    p = read_table(spark, d, "part").select("p_partkey", tx.client_slug(named).alias("base"))
    return catalog.unique_slugs(p, "base", "p_partkey").select("p_partkey", "slug")


@query(r"""SELECT page_id, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '-' || coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', ''), ''), 'page') AS k FROM pages""")
def page_keys(spark, d):
    return _pages(spark, d).select("page_id", tx.page_key(F.col("page_id") % 100, F.regexp_replace("url", r"^https?://[^/?#]*", "")).alias("k"))


@query(r"SELECT page_id, sha256('see ' || regexp_replace(url, '[?#].*$', '') || '. Then go on') AS reduced FROM pages")
def text_reduce(spark, d):
    told = F.concat(F.lit("see "), F.col("url"), F.lit(". Then go on"))
    out = F.when(F.col("url").rlike(r"[?#]"), ux.reduce_urls(told)).otherwise(told)
    return _pages(spark, d).select("page_id", F.sha2(out, 256).alias("reduced"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def html_escape(spark, d):
    return _pages(spark, d).select("page_id", F.sha2(tx.escape_html(F.col("html")), 256).alias("escaped"))


@query(r"""WITH f AS (SELECT page_id, trim(regexp_replace(html, '[ \t\n\r\f\v]+', ' ', 'g')) AS flat FROM pages)
SELECT page_id, CASE WHEN length(flat) > 512 THEN substr(flat, 1, 512) || '…' ELSE flat END AS snippet FROM f""")
def snippets(spark, d):
    return _pages(spark, d).select("page_id", fx.snippet(F.col("html")).alias("snippet"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS title FROM documents")
def title_bound(spark, d):
    return read_table(spark, d, "documents").select("doc_id", fx.bound_title(F.col("text")).alias("title"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)data-reactroot|__next') THEN 'react' WHEN regexp_matches(html, '(?i)wp-content|wp-includes|wordpress') THEN 'wordpress' ELSE 'generic' END AS platform,
CASE WHEN regexp_matches(html, 'class="ad"') THEN 'ads' WHEN regexp_matches(html, 'lang="fr"') THEN 'french' ELSE 'generic' END AS marked FROM pages""")
def platform_detect(spark, d):
    html = F.col("html")
    return _pages(spark, d).select("page_id", tx.detect_platform(html).alias("platform"), tx.detect_platform(html, None, [("ads", 'class="ad"'), ("french", 'lang="fr"')]).alias("marked"))


#: Test input: hosts of part keys, in spellings of IPv4 addresses and of names, and what a browser makes of them.
_FORMS_SQL = """n AS (SELECT p_partkey, p_partkey % 8 AS k, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 7919 * 104729) % 4294967296 ELSE 2130706432 + p_partkey END AS n, replace(lower(p_brand), '#', '-') AS brand FROM part),
f AS (SELECT *, CASE WHEN k < 6 THEN (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) WHEN k = 6 THEN 'www.' || brand || '.example' END AS host FROM n)"""


def _host_form() -> F.Column:
    k = F.col("p_partkey") % 8
    n = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") * 7919 * 104729) % F.lit(2**32)).otherwise(F.lit(2130706432) + F.col("p_partkey"))
    byte = lambda s: (F.shiftright(n, s) % 256).cast("string")
    name = F.replace(F.upper("p_brand"), F.lit("#"), F.lit("-"))
    octal = F.concat(F.lit("0"), F.conv(F.shiftright(n, 24).cast("string"), 10, 8))
    return (
        F.when(k == 0, n.cast("string"))
        .when(k == 1, F.concat(F.lit("0x"), F.hex(n)))
        .when(k == 2, F.concat_ws(".", octal, byte(16), (n % 65_536).cast("string")))
        .when(k == 3, F.concat_ws(".", byte(24), F.concat(F.lit("0X"), F.hex(n % F.lit(1 << 24)))))
        .when(k == 4, F.concat(F.concat_ws(".", byte(24), byte(16), byte(8), byte(0)), F.lit(".")))
        .when(k == 5, F.concat_ws(".", F.concat(F.lit("%3"), F.lit("0"), F.conv(F.shiftright(n, 24).cast("string"), 10, 8)), byte(16), byte(8), byte(0)))
        .when(k == 6, F.concat(F.lit("ＷＷＷ。"), name, F.lit(".ex%61mple")))
        .otherwise(F.concat(F.lit("300."), byte(16), F.lit(".1.2")))
    )


@query(rf"""WITH {_FORMS_SQL} SELECT p_partkey, host, CASE WHEN k = 7 THEN 'invalid_url' WHEN k < 6 AND ({' OR '.join(f"n >> {32 - p} = {int(__import__('ipaddress').IPv4Address(a)) >> (32 - p)}" for a, p in ux.BLOCKED_IPV4)}) THEN 'private_address' END AS refusal FROM f""")
def host_forms(spark, d):
    """The host that a browser connects to, and whether it may, of hosts in odd spellings; all are in the allowlist."""
    url = F.concat(F.lit("http://"), _host_form(), F.lit(":8080/x"))
    rows = read_table(spark, d, "part").select("p_partkey", ux.host_as_browser(url).alias("host"), url.alias("url"))
    return rows.select("p_partkey", "host", ux.target_refusal(F.col("url"), F.array(F.coalesce("host", F.lit("x")))).alias("refusal"))


#: Test input: documents of kinds that only a tokenizer reads right, with the page's number for K.
_DOCUMENTS = [
    '<a href="first"></a><base target=x><base href="https://cdn.test/K/"><base href="https://no.test/"><a href="y">',
    '<noscript><a href="/no"></noscript><a href="?page=K&section=2&copy=2&amp;lt=3">',
    '<a href="/a&#47;K"><!-- <a href="/open">',
    '<template><a href="/t"></template><svg><title><a href="/s"></a></title></svg><a href="/p/K">',
    '<script><!-- <script> </script> <a href="/no"> --></script><textarea><a href="/no"></textarea><a href="http://2130706433/K">',
    """<a href="http://fa\u00df.de/K"><a title='x>y' href=/u?a=1&lt=K data-x><a href="/unclosed""",
]
#: Where they lead, as structs of position and address.
_READ = "[[{'p': 0, 'h': 'https://cdn.test/' || page_id || '/first'}, {'p': 1, 'h': 'https://cdn.test/' || page_id || '/y'}], [{'p': 0, 'h': origin || path || '?page=' || page_id || '&section=2&copy=2&lt=3'}], [{'p': 0, 'h': origin || '/a/' || page_id}], [{'p': 1, 'h': origin || '/p/' || page_id}], [{'p': 0, 'h': 'http://127.0.0.1/' || page_id}], [{'p': 0, 'h': 'http://xn--fa-hia.de/' || page_id}, {'p': 1, 'h': origin || '/u?a=1&lt=' || page_id}]]"


@query(rf"""WITH p AS (SELECT page_id, {_HEAD.format(n=1)} || '://' || {_HEAD.format(n=2)} AS origin, {_HEAD.format(n=3)} AS path FROM pages),
l AS (SELECT page_id, unnest(list_extract({_READ}, CAST(page_id % {len(_DOCUMENTS)} + 1 AS INTEGER))) AS x FROM p) SELECT page_id, x.p AS position, x.h AS href FROM l""")
def link_documents(spark, d):
    """Links behind bases, scripts, comments and references, which only the document as a browser builds it tells."""
    text = F.element_at(F.array(*[F.lit(x) for x in _DOCUMENTS]), (F.col("page_id") % len(_DOCUMENTS) + 1).cast("int"))
    html = F.replace(text, F.lit("K"), F.col("page_id").cast("string"))
    return scans.page_links(_pages(spark, d).select("page_id", "url", html.alias("html"))).drop("url")


#: Anchors that test what is no link, added to every page: in a comment, in a script, other schemes, no quotes, references, too long.
_EXTRA = [
    '<!-- <a href="/hidden">x</a> --><script>var a = "<a href=\'/script\'>"</script>',
    '<a title="a > b" href=../up/K>x</a>',
    "<A HREF='//Cdn.Example.COM:443/x?a=1&amp;b=K'>x</A>",
    '<a href="mailto:k@example.org">x</a><a name="n">x</a><a href="javascript:void(0)">x</a><a href="?p=K#f">x</a><a href="http://">x</a>',
    '<a href="/LONG">x</a>',
]
#: Where they lead, by the number of the anchor: what the query has to find.
_LED = "[dir || 'up/' || page_id, CASE WHEN origin LIKE 'https:%' THEN 'https://cdn.example.com' ELSE 'http://cdn.example.com:443' END || '/x?a=1&b=' || page_id, NULL, NULL, origin || path || '?p=' || page_id || '#f', NULL, NULL]"


def _extra_sql() -> str:
    text = " || ".join("'" + x.replace("'", "''") + "'" for x in _EXTRA)
    return f"replace(replace({text}, 'K', CAST(page_id AS VARCHAR)), 'LONG', repeat('x', 2048))"


@query(rf"""WITH p AS (SELECT page_id, html, {_HEAD.format(n=1)} || '://' || {_HEAD.format(n=2)} AS origin, {_HEAD.format(n=3)} AS path FROM pages),
l AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS own, origin, path,
  CASE WHEN length(path) - length(replace(path, '/', '')) <= 2 THEN origin || '/' ELSE regexp_replace(origin || path, '[^/]*/[^/]*$', '') END AS dir FROM p),
a AS (SELECT page_id, list_concat(list_transform(own, lambda x: replace(origin || '/' || url_encode(x), '%2C', ',')), CASE WHEN page_id % 3 < 2 THEN {_LED} ELSE [] END) AS hrefs FROM l)
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, least(len(hrefs), 500) + 1)) AS i FROM a) WHERE hrefs[i] IS NOT NULL""")
def link_extract(spark, d):
    """Links of every page; two thirds of the pages get further anchors, so that all kinds of links are met."""
    key = F.col("page_id").cast("string")
    extra = F.replace(F.replace(F.lit("".join(_EXTRA)), F.lit("K"), key), F.lit("LONG"), F.lit("x" * 2048))
    html = F.when(F.col("page_id") % 3 < 2, F.concat("html", extra)).otherwise(F.col("html"))
    return scans.page_links(_pages(spark, d).select("page_id", "url", html.alias("html"))).drop("url")


@query(f"""WITH t AS (SELECT page_id, {_NORM.format(p=_PATH)} AS route, lower({_HEAD.format(n=2)}) AS host, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title, html FROM pages)
SELECT page_id, route, host, CASE WHEN length(title) > 300 THEN substr(title, 1, 300) || '…' ELSE title END AS title,
  CASE WHEN page_id % 4 = 1 OR regexp_matches(html, '(?i)data-reactroot|__next') THEN 'react' WHEN page_id % 4 = 2 OR regexp_matches(html, '(?i)wp-content|wp-includes|wordpress') THEN 'wordpress' ELSE 'generic' END AS platform FROM t""")
def page_profiles(spark, d):
    html = F.concat("html", F.when(F.col("page_id") % 4 == 1, F.lit('<div id="__NEXT">')).when(F.col("page_id") % 4 == 2, F.lit("<img src=/WP-Content/x>")).otherwise(""))
    return scans.page_profiles(_pages(spark, d).withColumn("html", html))


@query(r"""WITH v AS (SELECT c_nationkey AS request_id, c_custkey AS visit, 'u' || (c_custkey % 40) AS served_url, 'u' || (c_custkey % 60) AS current_url FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY request_id, served_url, current_url ORDER BY visit) AS n FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY visit) - 1 AS position, count(*) OVER (PARTITION BY request_id) AS total FROM f WHERE n = 1)
SELECT request_id, visit, CAST(position AS INTEGER) AS position, greatest(total - 20, 0) AS truncated FROM g WHERE position < 20""")
def page_caps(spark, d):
    c = read_table(spark, d, "customer")
    key = F.col("c_custkey")
    named = lambda n: F.concat(F.lit("u"), (key % n).cast("string"))
    visits = c.select(F.col("c_nationkey").alias("request_id"), key.alias("visit"), named(40).alias("served_url"), named(60).alias("current_url"))
    return scans.dedupe_visits(visits).select("request_id", "visit", "position", "truncated")


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919 + l_suppkey * 104729) % 4294967296 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, {' OR '.join(f"n >> {32 - p} = {int(__import__('ipaddress').IPv4Address(a)) >> (32 - p)}" for a, p in ux.BLOCKED_IPV4)} AS blocked FROM a""")
def ip_blocklist(spark, d):
    n = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % F.lit(2**32)
    octet = lambda k: (F.shiftright(n, k) % 256).cast("string")
    address = F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ux.blocked_ipv4(address).alias("blocked"))


#: Test input: what follows a market segment in a host.
_TAILS = ["", ".com", ".co.uk/x", ".*.com", ".10", "_.org", ".com.", ":443", "ü.de", "-.org", ".LONG.org", ".x--y.example"]


@query(rf"""WITH h AS (SELECT c_custkey, regexp_replace(lower(CASE WHEN c_custkey % 13 = 6 THEN 'co.uk' WHEN c_custkey % 13 = 7 THEN '  ' ELSE trim(' ' || c_mktsegment || replace(list_extract({_TAILS}, CAST(c_custkey % {len(_TAILS)} + 1 AS INTEGER)), 'LONG', repeat('a.', 130) || 'b')) END), '\.$', '') AS host FROM customer)
SELECT c_custkey, CASE WHEN trim(host) = '' THEN 'blank' WHEN contains(host, '*') THEN 'wildcard' WHEN regexp_matches(host, '[:/?#@]') THEN 'not_just_a_host' WHEN length(host) > 253 THEN 'too_long'
  WHEN NOT regexp_full_match(host, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?') THEN CASE WHEN regexp_matches(host, '[^ -~]') THEN 'not_punycode' ELSE 'not_a_hostname' END
  WHEN regexp_matches(host, '(^|\.)[0-9]+$') THEN 'address' WHEN host IN ('co.uk', 'org.uk', 'com.au') THEN 'public_suffix' END AS problem FROM h""")
def host_problems(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.col("c_custkey") % len(_TAILS) + 1).cast("int"))
    host = F.when(F.col("c_custkey") % 13 == 6, "co.uk").when(F.col("c_custkey") % 13 == 7, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.replace(tail, F.lit("LONG"), F.lit("a." * 130 + "b"))))
    rows = read_table(spark, d, "customer").withColumn("hosts", ux.normalised_hosts(F.array(host)))
    return rows.select("c_custkey", ux.host_problem(F.col("hosts")[0]).alias("problem"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 3 = 0 AS is_array, event_id % 6 = 0 AS filled, event_id % 6 = 0 AS same FROM events""")
def json_guards(spark, d):
    """Array guard, emptiness and canonical equality of JSON columns that may hold anything."""
    e = read_table(spark, d, "events")
    raw = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 3 == 0, "[]").otherwise(F.col("props"))
    spaced = F.when(F.col("event_id") % 6 == 0, F.replace(raw, F.lit(":"), F.lit(" : "))).otherwise(F.lit("{}"))
    filled = F.size(F.from_json(raw, "array<string>")) > 0
    array = raw.rlike(r"^\s*\[")
    same = diff.comparable(raw, spaced, F.lit(None), F.lit(None))
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), array.alias("is_array"), (array & F.coalesce(filled, F.lit(False))).alias("filled"), same.alias("same"))


@query("""WITH t AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 3 AS l, p_partkey % 20 AS c FROM part)
SELECT p_partkey, CASE WHEN a = 0 THEN '' WHEN '1.4.' || c < '2.1.1' AND a = 2 THEN '1.4.' || c || ',2.1.1' ELSE '1.4.' || c END AS criteria, CASE WHEN l = 0 THEN 'A' WHEN l = 1 THEN 'AA' END AS level FROM t""")
def tags_levels(spark, d):
    p = read_table(spark, d, "part")
    key = F.col("p_partkey")
    one = F.concat(F.lit("wcag14"), (key % 20).cast("string"))
    criteria = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("best-practice"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("wcag211"), one, one)).otherwise(F.array(one, F.lit("wcag2a-obsolete")))
    levels = F.when(key % 3 == 0, F.array(F.lit("wcag21aa"), F.lit("wcag2a"))).when(key % 3 == 1, F.array(F.lit("wcag22aa"), F.lit("wcag2aaa"))).otherwise(F.array(F.lit("cat.color")))
    tags = F.concat(criteria, levels)
    return p.select("p_partkey", F.array_join(fx.criteria_of_tags(tags), ",").alias("criteria"), fx.level_of_tags(tags).alias("level"))


def _criteria_values() -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in line) + ")" for line in wcag.CRITERIA)


@query(f"""WITH dim(number, level, name) AS (VALUES {_criteria_values()}), r AS (SELECT p_partkey, 'WCAG 1.4.' || p_partkey % 20 AS raw, '1.4.' || p_partkey % 20 AS number FROM part)
SELECT p_partkey, level, coalesce(r.number || ' ' || name || ' (' || level || ')', raw) AS description FROM r LEFT JOIN dim ON dim.number = r.number""")
def criteria_dim(spark, d):
    raw = F.concat(F.lit("WCAG 1.4."), (F.col("p_partkey") % 20).cast("string"))
    return wcag.describe_criteria(read_table(spark, d, "part").select("p_partkey", raw.alias("raw")), "raw").select("p_partkey", "level", "description")


@query(f"""WITH dim(number, level, name) AS (VALUES {_criteria_values()}) SELECT number, level, name FROM dim WHERE number IN (SELECT '1.4.' || p_size % 20 FROM part)""")
def criteria_distinct(spark, d):
    rows = read_table(spark, d, "part").select(F.array(F.concat(F.lit("14"), (F.col("p_size") % 20).cast("string"))).alias("c"))
    return wcag.distinct_criteria(rows, "c")


@query("""WITH n AS (SELECT p.page_id, r AS rule_place, k AS node_place, CASE WHEN r = 1 THEN 'incomplete' ELSE 'violations' END AS kind FROM pages p, range(0, 2) a(r), range(0, 3) b(k) WHERE k <= p.page_id % 3)
SELECT page_id, kind = 'incomplete' AS undecided, node_place, CASE WHEN kind = 'incomplete' THEN 'color-contrast' ELSE 'image-alt' END AS code,
  CASE WHEN kind = 'incomplete' THEN 'needs-review' WHEN page_id % 4 = 0 THEN 'critical' WHEN page_id % 4 = 1 THEN 'major' ELSE 'minor' END AS severity,
  'iframe a >>> #n' || node_place AS selector, CASE WHEN node_place = 0 THEN 'Help' ELSE 'Fix it' END AS message, 'Add alt' AS fixes, CASE WHEN kind = 'incomplete' THEN '1.4.3' ELSE '1.1.1' END AS criteria,
  CASE WHEN kind = 'incomplete' THEN 'AA' ELSE 'A' END AS level FROM n""")
def scan_findings(spark, d):
    """Nested scan JSON, built from the pages table, to one finding per node."""
    k = F.col("page_id")
    impact = F.element_at(F.array(*[F.lit(x) for x in ("critical", "serious", "moderate", "minor")]), (k % 4 + 1).cast("int"))
    node = lambda i: F.format_string('{"html":"<a>  x</a>","target":[["iframe","a"],"#n%d"],"failureSummary":"%s","any":[{"id":"a","message":" Add alt "},{"id":"b","message":"Add alt"}],"all":[],"none":[]}', i, F.when(i == 0, "  ").otherwise("Fix it"))
    nodes = F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), node), ",")
    rule = lambda name, tags, imp: F.concat(F.lit(f'{{"id":"{name}","tags":{tags},"help":"Help","helpUrl":"u","impact":"'), imp, F.lit('","nodes":['), nodes, F.lit("]}"))
    scan = F.concat(F.lit('{"violations":['), rule("image-alt", '["wcag2a","wcag111"]', impact), F.lit('],"incomplete":['), rule("color-contrast", '["wcag2aa","wcag143"]', impact), F.lit("]}"))
    # a target of mixed strings and arrays is made uniform before parsing
    uniform = F.regexp_replace(scan, r'"target":\[\["iframe","a"\],("#n\d+")\]', r'"target":[["iframe","a"],[$1]]')
    rows = read_table(spark, d, "pages").select("page_id", scans.parse_scan(uniform).alias("scan"))
    out = scans.findings_of_scans(rows)
    return out.select("page_id", "undecided", "node_place", "code", "severity", "selector", "message", F.array_join("remediation_any", ",").alias("fixes"), F.array_join("wcag_criteria", ",").alias("criteria"), F.col("conformance_level").alias("level"))


#: Test input: messages of failed runs; N stands for a number, T for a text.
_TOLD = ['Step N ("T") could not click', "Step T could not", "journey-N is not allowed by run contract scope", "T not allowed by environment policy", 'Action "T" is not allowed in production', "stepId must be N", "A run against a target URL must name its own steps", "socket hang up N", "the stepId must"]


def _told_sql() -> str:
    items = ", ".join("'" + x.replace("'", "''") + "'" for x in _TOLD)
    return f"replace(replace(list_extract([{items}], CAST(event_id % {len(_TOLD)} + 1 AS INTEGER)), 'N', CAST(user_id AS VARCHAR)), 'T', event_type)"


@query(rf"""WITH m AS (SELECT event_id, {_told_sql()} AS message, event_id % 16 = 7 AS unsafe FROM events)
SELECT event_id, CASE WHEN unsafe THEN 'navigation_not_allowed' WHEN regexp_matches(message, '^Step [0-9]+ \(".*"\) could not ') THEN 'journey_step_failed' WHEN contains(message, 'not allowed by run contract scope') THEN 'journey_not_in_scope'
  WHEN contains(message, 'not allowed by environment policy') OR regexp_matches(message, '^Action ".*" is not allowed in ') THEN 'action_not_allowed' WHEN starts_with(message, 'stepId must') THEN 'invalid_step_id'
  WHEN starts_with(message, 'A run against a target URL must name its own steps') THEN 'journey_has_no_steps' ELSE 'audit_run_failed' END AS code FROM m""")
def failure_codes(spark, d):
    chosen = F.element_at(F.array(*[F.lit(x) for x in _TOLD]), (F.col("event_id") % len(_TOLD) + 1).cast("int"))
    message = F.replace(F.replace(chosen, F.lit("N"), F.col("user_id").cast("string")), F.lit("T"), F.col("event_type"))
    name = F.when(F.col("event_id") % 16 == 7, "UnsafeTargetError")
    return read_table(spark, d, "events").select("event_id", tx.failure_code(message, name).alias("code"))


@query("""WITH policy(env, actions) AS (VALUES ('production', ['login', 'navigate', 'inspect', 'search', 'filter', 'paginate', 'open-detail']), ('staging', ['login', 'navigate', 'inspect', 'search', 'filter', 'paginate', 'open-detail', 'submit-safe']),
  ('test', ['login', 'navigate', 'inspect', 'search', 'filter', 'paginate', 'open-detail', 'submit-safe', 'mutate-test-data'])),
e AS (SELECT event_id, ['production', 'staging', 'test', 'elsewhere'][event_id % 4 + 1] AS env, [CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'submit-safe' WHEN 'click' THEN 'search' ELSE 'inspect' END, CASE WHEN user_id % 3 = 0 THEN 'mutate-test-data' ELSE 'filter' END, 'navigate'] AS actions FROM events),
j AS (SELECT e.*, coalesce(p.actions, []) AS able FROM e LEFT JOIN policy p ON p.env = e.env)
SELECT event_id, list_extract(list_filter(actions, lambda a: NOT list_contains(able, a)), 1) AS forbidden, list_contains(able, actions[1]) AS allowed FROM j""")
def step_policy(spark, d):
    one = fx.lookup(F.col("event_type"), {"error": "delete", "purchase": "submit-safe", "click": "search"}, "inspect")
    two = F.when(F.col("user_id") % 3 == 0, "mutate-test-data").otherwise("filter")
    env = F.element_at(F.array(*[F.lit(x) for x in ("production", "staging", "test", "elsewhere")]), (F.col("event_id") % 4 + 1).cast("int"))
    return read_table(spark, d, "events").select("event_id", catalog.first_forbidden(env, F.array(one, two, F.lit("navigate"))).alias("forbidden"), catalog.action_allowed(env, one).alias("allowed"))


@query("""SELECT p_partkey, CAST(n AS INTEGER) AS n_nodes, 'button:Save' || CASE WHEN p_partkey % 2 = 0 THEN ':checked' ELSE ':invalid=grammar' END AS first_node FROM (SELECT p_partkey, 1 + p_size % 3 AS n FROM part)""")
def ax_prune(spark, d):
    n = F.col("p_size") % 3
    state = F.when(F.col("p_partkey") % 2 == 0, '{"name":"checked","value":{"value":"true"}},{"name":"disabled","value":{"value":"false"}}').otherwise('{"name":"invalid","value":{"value":"grammar"}}')
    more = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, '{"role":{"value":"generic"}}').otherwise('{"role":{"value":"link"},"properties":[{"name":"level","value":{"value":"2"}}]}')), ",")
    raw = F.concat(F.lit('[{"ignored":true,"role":{"value":"link"}},{"role":{"value":"button"},"name":{"value":" Save "},"properties":['), state, F.lit("]},"), more, F.lit("]"))
    pruned = scans.prune_ax_tree(F.from_json(raw, scans.AX))
    first = F.concat(F.col("t")[0]["role"], F.lit(":"), F.col("t")[0]["name"], F.lit(":"), F.array_join(F.col("t")[0]["states"], "+"))
    return read_table(spark, d, "part").withColumn("t", pruned).select("p_partkey", F.size("t").alias("n_nodes"), first.alias("first_node"))


@query("""SELECT user_id, upper(substr(first_name, 1, 1) || substr(last_name, 1, 1)) AS initials, words FROM (
  SELECT c_custkey AS user_id, c_mktsegment AS first_name, split_part(c_name, '#', 1) AS last_name, CASE c_custkey % 5 WHEN 0 THEN 'The address you gave' WHEN 1 THEN 'One click from there' WHEN 2 THEN 'Two clicks from there' WHEN 3 THEN 'Three clicks from there' ELSE '4 clicks from there' END AS words FROM customer)""")
def copy_words(spark, d):
    c = read_table(spark, d, "customer")
    name = F.concat(F.lit(" "), "c_mktsegment", F.lit("  von "), F.split("c_name", "#")[0])
    return c.select(F.col("c_custkey").alias("user_id"), tx.initials(name).alias("initials"), tx.depth_words((F.col("c_custkey") % 5).cast("int")).alias("words"))


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN CAST(floor(value) AS INTEGER) % 400 + 200 END AS code, CASE WHEN event_id % 5 <> 0 THEN 's.png' WHEN event_id % 10 = 0 THEN '' END AS shot, CASE WHEN event_id % 7 = 3 THEN 'complete' ELSE 'degraded' END AS told FROM events)
SELECT event_id, CASE WHEN told = 'complete' THEN 'evidence complete' WHEN code IS NULL THEN 'evidence ' || told WHEN code >= 400 THEN 'served ' || code || ' — not usable as evidence' ELSE 'evidence ' || told || ' (page returned ' || code || ')' END AS told,
  CASE WHEN coalesce(shot, '') <> '' AND (code IS NULL OR code < 400) THEN 'complete' ELSE 'degraded' END AS status FROM e""")
def evidence_words(spark, d):
    e = read_table(spark, d, "events")
    code = F.when(F.col("user_id") % 4 != 0, F.floor("value").cast("int") % 400 + 200)
    told = fx.page_evidence(F.when(F.col("event_id") % 7 == 3, "complete").otherwise("degraded"), code)
    shot = F.when(F.col("event_id") % 5 != 0, "s.png").when(F.col("event_id") % 10 == 0, "")
    return e.select("event_id", told.alias("told"), fx.evidence_status(shot, F.lit("d.html"), F.lit("a.json"), code).alias("status"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'error' AS failed, event_type IN ('error', 'signup') AS used FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e WHERE used),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS anchor, 0 AS n, 0 AS seen, false AS hit FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT o.user_id, o.i, o.event_id,
    CASE WHEN o.failed AND (CASE WHEN w.n > 0 AND o.us - w.anchor >= 864000000000 THEN 0 ELSE w.n END) = 0 THEN o.us ELSE w.anchor END,
    CASE WHEN o.failed THEN (CASE WHEN w.n > 0 AND o.us - w.anchor >= 864000000000 THEN 0 ELSE w.n END) + 1
      WHEN (CASE WHEN w.n > 0 AND o.us - w.anchor >= 864000000000 THEN 0 ELSE w.n END) >= 3 THEN w.n ELSE 0 END,
    CASE WHEN w.n > 0 AND o.us - w.anchor >= 864000000000 THEN 0 ELSE w.n END,
    (CASE WHEN w.n > 0 AND o.us - w.anchor >= 864000000000 THEN 0 ELSE w.n END) >= 3
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, seen AS failures, hit AS throttled FROM w WHERE i > 0""")
def throttle_windows(spark, d):
    """Failures and throttling per user with a window of ten days and three failures, so that the data reaches the limit."""
    e = read_table(spark, d, "events").filter("event_type in ('error', 'signup')")
    attempts = e.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return throttle(attempts, 3, 864_000)
