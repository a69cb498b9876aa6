"""Queries over crawls with redirects, canonical keys, scope and a time budget.

Test input: customers are pages with five links each. A page's number tells its host, how long it
takes, whether it cannot be read and where it settles; links spell addresses in two ways.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.crawling import crawl_sites
from plumbline.session import dealt
from plumbline.sources.tables import read_table

Q: dict = {}
SQL: dict[str, str] = {}

_FAN, _LINKS, _PAGES, _BUDGET, _ERRORS, _PAUSE = 5, 4, 9, 400, 2, 7


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _address(k: F.Column) -> F.Column:
    return F.concat(F.lit("https://h"), (k % 3).cast("string"), F.lit(".site.test/p"), k.cast("string"))


def _crawled(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = c.count()
    c = dealt(c, n * _FAN, "k")
    k = F.col("k")
    settled = F.when(k % 17 == 8, "https://idp.test/login").when(k % 19 == 5, "http://127.0.0.1/").when(k % 11 == 4, _address((k + 1) % n))
    captured = c.select(_address(k).alias("url"), settled.alias("settled_url"), F.concat(F.lit("Page "), k.cast("string")).alias("title"), (k % 50 * 3).alias("cost_ms"), F.when(k % 7 == 3, "timeout").alias("error"))
    to = F.expr(f"(k * 5 + position * position * 3 + position) % {n}")
    links = c.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(_FAN - 1)))).withColumn("to", to)
    odd = F.concat(F.lit("HTTPS://H"), (F.col("to") % 3).cast("string"), F.lit(".Site.test:443/x/../p"), F.col("to").cast("string"), F.lit("/#f"))
    href = F.when(F.col("to") % 13 == 5, F.concat(F.lit("https://elsewhere.test/p"), F.col("to").cast("string"))).when(F.col("position") % 2 == 1, odd).otherwise(_address(F.col("to")))
    links = links.select(_address(k).alias("url"), "position", href.alias("href"))
    seeds = c.select(k.alias("site"), _address(k).alias("url"), F.array(F.lit("site.test")).alias("allowed"))
    return crawl_sites(seeds, captured, links, max_pages=_PAGES, max_links=_LINKS, max_errors=_ERRORS, budget_ms=_BUDGET, pause_ms=_PAUSE)


#: The queue of every site, a page a step.
_WALK = f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
graph AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 3 THEN 'timeout' WHEN c_custkey % 17 = 8 THEN 'host_not_allowed' WHEN c_custkey % 19 = 5 THEN 'host_not_allowed' END AS fault,
  CASE WHEN c_custkey % 11 = 4 THEN (c_custkey + 1) % n ELSE c_custkey END AS s, c_custkey % 50 * 3 AS cost, c_custkey % 17 = 8 AND c_custkey % 7 <> 3 AS away FROM customer, n),
tos AS (SELECT c_custkey AS k, list_filter(list_transform(range({_LINKS}), lambda i: (c_custkey * 5 + i * i * 3 + i) % n), lambda t: t % 13 <> 5) AS tos FROM customer, n),
steps AS (SELECT g.*, list_filter(t.tos, lambda x, i: list_position(t.tos, x) = i) AS tos FROM graph g LEFT JOIN tos t ON t.k = g.s),
walk AS (
  SELECT c_custkey AS site, [{{'k': c_custkey, 'd': 0}}] AS queue, [c_custkey] AS seen, CAST([] AS STRUCT(k BIGINT, d INTEGER)[]) AS pages, CAST([] AS STRUCT(k BIGINT, m VARCHAR)[]) AS errors,
    CAST(0 AS BIGINT) AS elapsed, CAST(0 AS BIGINT) AS dropped, CAST(NULL AS VARCHAR) AS truncated, CAST(NULL AS VARCHAR) AS refused, CAST(NULL AS VARCHAR) AS host, 0 AS step FROM customer
  UNION ALL
  SELECT site, CASE WHEN stop IS NOT NULL OR turned IS NOT NULL THEN [] ELSE list_concat(rest, list_transform(pushed, lambda t: {{'k': t, 'd': d + 1}})) END,
    CASE WHEN stop IS NOT NULL THEN seen ELSE list_concat(seen2, fresh) END, CASE WHEN stop IS NULL AND kept THEN list_append(pages, {{'k': s, 'd': d}}) ELSE pages END,
    CASE WHEN stop IS NULL AND fault IS NOT NULL AND d > 0 THEN list_append(errors, {{'k': k, 'm': fault}}) ELSE errors END,
    CASE WHEN stop IS NOT NULL THEN elapsed ELSE elapsed + cost + CASE WHEN len(rest) + len(pushed) > 0 THEN {_PAUSE} ELSE 0 END END,
    dropped + CASE WHEN stop IS NULL THEN len(fresh) - len(pushed) ELSE 0 END, stop, turned, CASE WHEN turned = 'redirected' THEN 'idp.test' END, step + 1
  FROM (
    SELECT *, list_slice(fresh, 1, greatest(0, {_PAGES} - len(pages) - 1 - len(rest))) AS pushed FROM (
      SELECT *, CASE WHEN kept AND d < 3 THEN list_filter(tos, lambda t: NOT list_contains(seen2, t)) ELSE [] END AS fresh FROM (
        SELECT w.*, g.*, w.queue[1].d AS d, w.queue[2:] AS rest, CASE WHEN elapsed > {_BUDGET} THEN 'budget' WHEN len(pages) >= {_PAGES} THEN 'url-cap' END AS stop,
          CASE WHEN fault IS NOT NULL AND w.queue[1].d = 0 THEN CASE WHEN fault = 'timeout' THEN 'unreachable' WHEN away THEN 'redirected' ELSE 'not_allowed' END END AS turned,
          fault IS NULL AND (s = g.k OR NOT list_contains(seen, s)) AS kept, CASE WHEN fault IS NULL AND NOT list_contains(seen, s) THEN list_append(seen, s) ELSE seen END AS seen2
        FROM walk w JOIN steps g ON g.k = w.queue[1].k WHERE len(queue) > 0)))
), ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY site ORDER BY step DESC) = 1)"""


@query(_WALK + " SELECT site, 'https://h' || (p.k % 3) || '.site.test/p' || p.k AS page, p.d AS depth, CAST(place AS INTEGER) AS place FROM (SELECT site, unnest(pages) AS p, unnest(range(len(pages))) AS place FROM ends)")
def crawl_settled(spark, d):
    """Pages of every site in the order of the visits, by the address on which they settled."""
    place = F.row_number().over(Window.partitionBy("site").orderBy("seq")) - 1
    # an address is told as the first link to it spelled it
    page = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/(x/../)?(p[0-9]+)/?$", "/$2")
    return _crawled(spark, d)[0].select("site", page.alias("page"), "depth", place.alias("place"))


@query(_WALK + f""" SELECT site, CAST(len(pages) AS BIGINT) AS pages, CAST(len(seen) AS BIGINT) AS seen, coalesce(truncated, CASE WHEN dropped > 0 THEN 'url-cap' END) AS truncated,
  coalesce(array_to_string(list_transform(errors[1:{_ERRORS}], lambda e: e.k || ' ' || e.m), ','), '') AS errors, CAST(greatest(len(errors) - {_ERRORS}, 0) AS BIGINT) AS errors_omitted, elapsed AS elapsed_ms, refused, host AS refused_host FROM ends""")
def crawl_ends(spark, d):
    """How every crawl ended: what was met, why it stopped, what failed, or why its entry was refused."""
    out = _crawled(spark, d)[1]
    told = F.array_join(F.transform("errors", lambda e: F.concat(F.regexp_extract(e["url"], r"/p(\d+)", 1), F.lit(" "), e["message"])), ",")
    return out.select("site", "pages", "seen", "truncated", told.alias("errors"), F.col("errors_omitted").cast("long").alias("errors_omitted"), "elapsed_ms", "refused", "refused_host")
