"""Scan output to findings: nested rules and nodes, accessibility-tree pruning, platform detection, links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import findings as fx
from plumbline.functions import text as tx
from plumbline.functions import urls as ux
from plumbline.functions.web import page_anchors

CHECK = "array<struct<id:string,message:string>>"
NODE = f"struct<html:string,target:array<array<string>>,failureSummary:string,any:{CHECK},all:{CHECK},none:{CHECK}>"
RULE = f"array<struct<id:string,impact:string,tags:array<string>,help:string,helpUrl:string,nodes:array<{NODE}>>>"
# Roles that carry no meaning, and states that do.
SKIPPED_ROLES = ["none", "presentation", "generic", "InlineTextBox", "LineBreak"]
STATES = ["checked", "disabled", "expanded", "invalid", "pressed", "readonly", "required", "selected"]
MAX_NODES, MAX_NAME, MAX_LINKS, MAX_HREF = 400, 200, 500, 2048
AX = "array<struct<ignored:boolean,role:struct<value:string>,name:struct<value:string>,properties:array<struct<name:string,value:struct<value:string>>>>>"


def parse_scan(raw: Column) -> Column:
    """struct(violations, incomplete) of a JSON scan; malformed input gives NULLs, not an error.

    A node's target may hold plain strings among arrays; they become arrays of one.
    """
    flat = F.regexp_replace(raw, r'("target"\s*:\s*\[)((?:\s*"(?:[^"\\]|\\.)*"\s*,?)+)(\])', r"$1[$2]$3")
    return F.from_json(flat, f"struct<violations:{RULE},incomplete:{RULE}>", {"mode": "PERMISSIVE"})


def findings_of_scans(scans: DataFrame, scan_col: str = "scan", page_col: str = "page_url") -> DataFrame:
    """A finding per failed node of every page's rules; undecided rules need review. Other columns stay."""
    rest = [c for c in scans.columns if c != scan_col]
    parts = []
    for kind in ("violations", "incomplete"):
        rules = scans.select(*rest, F.posexplode(F.col(scan_col)[kind]).alias("rule_place", "rule"), F.lit(kind == "incomplete").alias("undecided"))
        parts.append(rules.select(*rest, "undecided", "rule_place", "rule", F.posexplode("rule.nodes").alias("node_place", "node")))
    rows = parts[0].unionByName(parts[1])
    return rows.select(
        *rest,
        "undecided",
        "rule_place",
        "node_place",
        F.col("rule.id").alias("code"),
        fx.severity_of_impact(F.col("rule.impact"), F.col("undecided")).alias("severity"),
        F.lit("deterministic").alias("source"),
        F.col("rule.help").alias("title"),
        fx.message_or(F.col("node.failureSummary"), F.col("rule.help")).alias("message"),
        fx.remediation(F.col("node.any")).alias("remediation_any"),
        fx.remediation(F.col("node.all"), F.col("node.none")).alias("remediation_all"),
        fx.criteria_of_tags(F.coalesce("rule.tags", F.array().cast("array<string>"))).alias("wcag_criteria"),
        fx.level_of_tags(F.coalesce("rule.tags", F.array().cast("array<string>"))).alias("conformance_level"),
        fx.selector_of_target(F.col("node.target")).alias("selector"),
        fx.snippet(F.col("node.html")).alias("html_snippet"),
        F.col("rule.helpUrl").alias("help_url"),
    )


def failed_nodes(rules: Column) -> Column:
    """Nodes over all rules of a scan."""
    return F.aggregate(F.coalesce(F.transform(rules, lambda r: F.coalesce(F.size(r["nodes"]), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)


def prune_ax_tree(nodes: Column, most: int = MAX_NODES) -> Column:
    """Meaningful nodes of an accessibility tree: role, bounded name, level, states."""
    role = lambda n: n["role"]["value"]
    kept = F.filter(nodes, lambda n: ~F.coalesce(n["ignored"], F.lit(False)) & F.coalesce(F.length(role(n)) > 0, F.lit(False)) & ~F.coalesce(role(n).isin(*SKIPPED_ROLES), F.lit(False)))
    named = lambda n: tx.clip(F.nullif(F.trim(n["name"]["value"]), F.lit("")), MAX_NAME)
    props = lambda n: F.coalesce(n["properties"], F.array().cast("array<struct<name:string,value:struct<value:string>>>"))
    level = lambda n: F.try_element_at(F.filter(F.transform(F.filter(props(n), lambda p: p["name"] == "level"), lambda p: p["value"]["value"].try_cast("double")), lambda v: v.isNotNull()), F.lit(-1))
    value = lambda p: p["value"]["value"]
    on = lambda p: p["name"].isin(*STATES) & F.coalesce((F.length(value(p)) > 0) & (value(p) != "false"), F.lit(False))
    states = lambda n: F.transform(F.filter(props(n), on), lambda p: F.when(value(p) == "true", p["name"]).otherwise(F.concat(p["name"], F.lit("="), value(p))))
    return F.transform(F.slice(kept, 1, most), lambda n: F.struct(role(n).alias("role"), named(n).alias("name"), level(n).alias("level"), states(n).alias("states")))


def page_links(pages: DataFrame, html: str = "html", url: str = "url", most: int = MAX_LINKS) -> DataFrame:
    """(all columns but html, position, href): where a page's links lead, in order, as absolute http(s) URLs.

    Pages are read by the HTML standard's tokenizer as in a browser that runs scripts: anchors in comments,
    scripts, noscript, templates and other text are none, and the first base element with an address
    is what links are relative to. Of a page the first ``most`` anchors with an address count; of
    these, links that are not http(s), cannot be read or are longer than MAX_HREF are left out. Positions
    count all anchors, from 0. Null pages have no links. Other columns, of any name, are carried in a struct.
    """
    rest = [c for c in pages.columns if c != html]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    rows = pages.select(row, F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, positions, hrefs = [], [], []
            for i, (text, own) in enumerate(zip(batch.column("html"), batch.column("url"), strict=True)):
                for k, href in enumerate(page_anchors(text.as_py(), own.as_py(), most)):
                    if href is not None and len(href) <= MAX_HREF and href.startswith(("http://", "https://")):
                        at.append(i)
                        positions.append(k)
                        hrefs.append(href)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), pa.array(positions, pa.int32()), pa.array(hrefs, pa.string())], ["row", "position", "href"])

    shape = T.StructType([rows.schema["row"], T.StructField("position", T.IntegerType()), T.StructField("href", T.StringType())])
    out = rows.mapInArrow(run, shape)
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "position", "href")


def page_title(html: Column) -> Column:
    """The bounded text of the title element, NULL without one."""
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?i)<title"), fx.bound_title(F.trim(F.regexp_replace(inner, r"\s+", " "))))


def page_profiles(pages: DataFrame, markers: list[tuple[str, str]] = tx.PLATFORMS) -> DataFrame:
    """Route, host, title and platform of captured pages (url, html)."""
    rest = [c for c in pages.columns if c not in ("url", "html")]
    return pages.select(*rest, ux.route_of(F.col("url")).alias("route"), ux.url_hostname(F.col("url")).alias("host"), page_title(F.col("html")).alias("title"), tx.detect_platform(F.col("html"), None, markers).alias("platform"))


def dedupe_visits(visits: DataFrame, run: str = "request_id", order: str = "visit", cap: int = 20) -> DataFrame:
    """First visit of each identity (served and current URL) of a run, at most ``cap``, with the number cut off.

    First visits are found by grouping and counted by grouping, so only the ``cap`` kept ones of a
    run are ranked: Spark prunes the window before its shuffle.
    """
    row, place = F.struct(*[F.col(f"`{c}`") for c in visits.columns]), F.struct(F.col(order).alias("order"))  # a null order is the first
    first = visits.groupBy(F.col(run).alias("run"), F.col("served_url").alias("served"), F.col("current_url").alias("current"))
    first = first.agg(F.min(place)["order"].alias("order"), F.min_by(row, place).alias("row"))
    counts = first.groupBy(F.col("run").alias("counted")).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("truncated"))
    kept = first.withColumn("position", F.row_number().over(Window.partitionBy("run").orderBy("order")) - 1).filter(F.col("position") < cap)
    out = kept.join(counts, F.col("run").eqNullSafe(F.col("counted")))
    return out.select("row.*", "position", "truncated")
