"""Crawls of captured sites as a browser makes them: redirects, one page a key, scope, errors and a time budget.

A level of all sites is one join with what was captured and one with the links of each page. What depends on
the order of visits (which link is met first, what still fits, when time is up) is a fold over one site's
level, which is bounded: at most MAX_PAGES visits of MAX_PAGE_LINKS links. A site is one row of state
between levels, and only sites that still have visits go on to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import urls as ux
from plumbline.operators.catalog import MAX_DEPTH, MAX_ERRORS, MAX_PAGE_LINKS, MAX_PAGES
from plumbline.session import Workspace, dealt

#: Milliseconds that a crawl may take before it starts another page, and the pause between pages.
BUDGET_MS, PAUSE_MS = 60_000, 0
MAX_TITLE = 200


def _shape(ddl: str) -> dict[str, str]:
    return dict(c.split(" ", 1) for c in ddl.split(", "))


#: A site's crawl so far: pages, time, links met but not followed, failures, why it stopped or was refused (and by which
#: host); the keys that it has met and the hosts that it may visit.
_STATE = _shape("pages long, elapsed long, dropped long, failed long, truncated string, refused string, refused_host string, met array<string>, allowed array<string>")
#: A page to visit, why it is refused, where it settles (and by which host), and the page's links.
_VISIT = _shape("n long, url string, key string, refusal string, settled string, settled_key string, host string, late string, title string, cost long, error string")
_LINKS = _shape("to_url array<string>, to_key array<string>, to_host array<string>, to_error array<string>")
_IN = {"kind": "string"} | _STATE | _VISIT | _LINKS
#: Of a level: ``state`` of sites that go on and their ``next`` visits, ``end`` of the others, each ``page`` and each ``error``.
_OUT = {"kind": "string"} | _shape("n long, url string, key string, title string, depth int, error string, seen long") | _STATE
_NO_STATE = (None,) * (1 + len(_STATE))


def _level(depth: int, max_depth: int, max_pages: int, max_errors: int, budget: int, pause: int):
    """One level of one site: its visits in order against all that the crawl has seen."""

    def fold(state: tuple, queue: list[tuple]) -> list[tuple]:
        pages, elapsed, dropped, failed, truncated, refused, refused_host, met, allowed = state
        seen, after, out = set(met or ()), [], []
        listed: dict[str, bool] = {}

        def unlisted(host: str) -> bool:
            """Whether a host is none of the site's nor lies under one."""
            if host not in listed:
                own = host.lower().removesuffix(".")
                listed[host] = not any(own == h or own.endswith(f".{h}") for h in allowed or ())
            return listed[host]

        def error(n: int, url: str, message: str) -> None:
            nonlocal failed
            if failed < max_errors:
                out.append(("error", failed, url, None, None, None, message, *_NO_STATE))
            failed += 1

        for place, (n, url, key, why, settled, settled_key, host, late, title, cost, broken, *links) in enumerate(queue):
            if elapsed > budget:
                truncated = "budget"
            elif pages >= max_pages:
                truncated = "url-cap"
            if truncated or refused:
                break
            elapsed += cost or 0
            if (broken is not None or why is not None) and depth == 0:
                # an entry that came to rest elsewhere is told by its host, but not by an address that must not be fetched
                away = broken is None and why == "host_not_allowed" and late is None
                refused = "unreachable" if broken is not None else "redirected" if away else "not_allowed"
                refused_host = host if away else None
            elif broken is not None or why is not None:
                error(n, url, why if broken is None else broken)
            elif settled_key == key or settled_key not in seen:
                seen.add(settled_key)
                pages += 1
                out.append(("page", n, settled, None, title, depth, None, *_NO_STATE))
                for to_url, to_key, to_host, to_error in zip(*(x or () for x in links), strict=True) if depth < max_depth else ():
                    if to_key in seen or unlisted(to_host):
                        continue
                    seen.add(to_key)
                    if to_error is not None:  # its host cannot be resolved to a safe address
                        error(n, to_url, to_error)
                    elif len(queue) - place - 1 + len(after) >= max_pages - pages:
                        dropped += 1
                    else:
                        after.append((to_url, to_key))
            if place + 1 < len(queue) or after:
                elapsed += pause
        first = max((v[0] for v in queue), default=0) + 1
        goes_on = bool(after) and not (truncated or refused)
        if goes_on:
            out += [("next", first + k, url, key, None, None, None, *_NO_STATE[:-1], allowed) for k, (url, key) in enumerate(after)]
        kept = (list(seen), allowed) if goes_on else (None, None)
        out.append(("state" if goes_on else "end", None, None, None, None, None, None, len(seen), pages, elapsed, dropped, failed, truncated, refused, refused_host, *kept))
        return out

    return fold


#: Rows of a fold's results that are sent on at once.
_SENT = 10_000


def _values(column: pa.Array) -> Iterator:
    """A column's values, read as a whole and not one by one; a number that is missing is 0."""
    kind = column.type
    if column.null_count == len(column):
        return repeat(None, len(column))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return _cut(_values(column.flatten()), column.value_lengths().to_pylist())
    if pa.types.is_integer(kind):
        column = column.fill_null(0)
    return iter(column.to_numpy(zero_copy_only=False).tolist())


def _cut(items: Iterator, sizes: list[int | None]) -> Iterator[list | None]:
    for size in sizes:
        yield None if size is None else list(islice(items, size))


def _by_site(fold):
    """Folds every site of a partition that is sorted by site and ``n``; a task holds one site's rows and a batch.

    A call per group would cost milliseconds a site, which is more than all of a small site's work.
    """
    first = len(_STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: list = []
        out: list[tuple] = []
        site, state, queue, type_ = None, None, [], None

        def ended() -> None:
            if state is not None:
                made = fold(state, queue)
                out.extend(made)
                sites.extend([site] * len(made))

        def sent() -> pa.RecordBatch:
            columns = [pa.array(values, _arrow(t)) for values, t in zip(zip(*out, strict=True), _OUT.values(), strict=True)]
            batch = pa.RecordBatch.from_arrays([pa.array(sites, type_), *columns], ["site", *_OUT])
            sites.clear()
            out.clear()
            return batch

        for batch in batches:
            type_ = batch.schema.field("site").type
            for own, kind, *row in zip(batch.column("site").to_pylist(), *(_values(batch.column(c)) for c in _IN), strict=True):
                if own != site and (own == own or site == site):  # a site that is not a number equals itself
                    ended()
                    site, state, queue = own, None, []
                if kind == "state":
                    state = row[:first]
                else:
                    queue.append(row[first:])
            if len(out) >= _SENT:
                yield sent()
        ended()
        if out:
            yield sent()

    return run


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(pa.string()) if kind.startswith("array") else {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind]


def _rows(df: DataFrame, kind: str) -> DataFrame:
    """``df`` in the common shape of states and visits."""
    return df.select("site", *[(F.lit(kind) if c == "kind" else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _IN.items()])


def crawl_sites(
    seeds: DataFrame,
    captured: DataFrame,
    links: DataFrame,
    unsafe: DataFrame | None = None,
    max_depth: int = MAX_DEPTH,
    max_pages: int = MAX_PAGES,
    max_links: int = MAX_PAGE_LINKS,
    max_errors: int = MAX_ERRORS,
    budget_ms: int = BUDGET_MS,
    pause_ms: int = PAUSE_MS,
) -> tuple[DataFrame, DataFrame]:
    """Pages (site, url, title, depth, seq) and outcomes of a crawl of every site at once, breadth first.

    ``seeds`` is (site, url, allowed array<string>): hosts besides the entry's own. ``captured`` is what
    a browser met: (url, settled_url, title, cost_ms, error); a URL that it lacks settles on itself in no
    time. ``links`` is (url, position, href) by the settled URL of the page. ``unsafe`` is (host,
    message): hosts that resolve to no safe address.

    URLs are compared by their browser keys. A visit costs its time; before each the crawl stops when
    the time so far is over the budget (``budget``) or as many pages are recorded as ``max_pages``
    (``url-cap``). A page that settles on one already met, other than under its own key, is not
    recorded again and its links are not read; one that settles out of scope is an error. Links to other hosts are not
    met at all. When as many pages are recorded or waiting as ``max_pages``, links are met but dropped (``url-cap``).

    Outcomes: site, pages, seen, truncated, errors (url, message; up to ``max_errors``),
    errors_omitted, elapsed_ms, refused (not_allowed, unreachable or redirected, then ``refused_host``):
    an entry that cannot be crawled. A site without seeds is not in either table; a null URL is refused.
    """
    ws = Workspace(seeds.sparkSession, "crawl-sites")
    # small files may come as one partition: reading URLs is the work, so rows are dealt out before it, and an address is read once
    links = links.filter(F.col("position") < max_links)
    seeds, captured, links = (dealt(df, df.count(), *keys) for df, *keys in ((seeds, "site"), (captured, "url"), (links, "url", "position")))
    own = ux.url_facts(F.col("url"))
    hosts = seeds.dropDuplicates(["site"]).withColumn("own", own)
    plain = lambda c: F.regexp_replace(F.lower(c), r"\.$", "")
    # the hosts of a site are written once as ``host_allowed`` compares them, not once a visit
    allowed = F.array_compact(F.concat(F.array("own.host"), F.coalesce("allowed", F.array().cast("array<string>"))))
    allowed = F.transform(allowed, lambda a: plain(F.regexp_replace(a, r"^\*\.", "")))
    hosts = ws.save(hosts.select("site", "url", "own.key", F.coalesce("own.early", "own.late").alias("refusal"), allowed.alias("allowed")), "seeds")
    rest = F.coalesce("settled_url", "url")
    captured = captured.select(ux.url_facts(F.col("url"))["key"].alias("key"), rest.alias("settled"), ux.url_facts(rest).alias("at"), F.left("title", F.lit(MAX_TITLE)).alias("title"), F.col("cost_ms").cast("long").alias("cost"), "error")
    captured = captured.filter("key is not null").dropDuplicates(["key"])
    captured = ws.save(captured.select("key", "settled", F.col("at.key").alias("settled_key"), "at.early", "at.host", "at.late", plain("at.host").alias("plain"), "title", "cost", "error"), "captured")
    # links that every site refuses are never met
    links = links.select(ux.url_facts(F.col("url"))["key"].alias("settled_key"), F.col("position").cast("long").alias("position"), F.col("href").alias("url"), ux.url_facts(F.col("href")).alias("to"))
    links = links.filter("settled_key is not null and to.key is not null and to.early is null and to.late is null").select("settled_key", "position", "url", "to.key", "to.host")
    if unsafe is None:
        links = links.withColumn("error", F.lit(None).cast("string"))
    else:
        links = links.join(unsafe.select("host", F.coalesce("message", F.lit("")).alias("error")), "host", "left")
    links = links.groupBy("settled_key").agg(F.sort_array(F.collect_list(F.struct("position", "url", "key", "host", "error"))).alias("to"))
    links = ws.save(links.select(F.col("settled_key").alias("page"), *[F.col(f"to.{c}").alias(f"to_{c}") for c in ("url", "key", "host", "error")]), "links")

    known = hosts.filter("site is not null")  # one without a site is told, but not crawled
    start = hosts.withColumns({c: F.lit(0) for c in ("pages", "elapsed", "dropped", "failed")})
    state = _rows(start.withColumn("met", F.when(F.col("site").isNotNull() & F.col("key").isNotNull(), F.array("key")).otherwise(F.array())).drop("url", "key", "refusal"), "state")
    level = known.filter(F.lit(max_depth >= 0)).withColumn("n", F.lit(0)).select("site", "n", "url", "key", "refusal", "allowed")
    n_captured, n_linked, n_links = captured.count(), *links.agg(F.count("*"), F.coalesce(F.sum(F.size("to_key")), F.lit(0))).first()
    per_page = n_links / max(n_linked, 1)
    site = seeds.schema["site"].dataType.simpleString()
    shape = ", ".join(f"{c} {t}" for c, t in ({"site": site} | _OUT).items())
    levels: list[DataFrame] = []

    def beside(left: DataFrame, right: DataFrame, by: str, rows: float) -> DataFrame:
        """A left join with as many tasks as the rows ask for, so that what one sorts does not grow with the tables."""
        return dealt(left, int(rows), by).join(dealt(right, int(rows), by), by, "left")

    n_states, n_visits = hosts.count(), known.count()
    for depth in range(max(max_depth, 0) + 1):
        visits = beside(level, captured, "key", n_visits + n_captured).withColumn("settled", F.coalesce("settled", "url")).withColumn("settled_key", F.coalesce("settled_key", "key"))
        listed = F.exists("allowed", lambda a: (F.col("plain") == a) | F.endswith("plain", F.concat(F.lit("."), a)))
        unlisted = F.when(F.size("allowed") == 0, "no_allowed_hosts").when(~listed, "host_not_allowed")  # NULL for what was not captured
        visits = visits.withColumn("refusal", F.coalesce("refusal", "early", F.when(F.col("plain").isNotNull(), unlisted), "late")).drop("allowed")
        if depth < max_depth:
            # refused ones have no links; many may come to rest at one address, so they are spread by their own
            read = F.when(F.col("error").isNull() & F.col("refusal").isNull(), F.col("settled_key"))
            visits = visits.withColumn("page", F.coalesce(read, F.concat(F.lit("!"), F.coalesce("key", F.col("site").cast("string")))))
            visits = beside(visits, links, "page", n_visits * (1 + per_page) + n_links)
        group = dealt(_rows(visits, "visit").unionByName(state), int(n_states + n_visits * (1 + per_page)), "site").sortWithinPartitions("site", "n")
        done = ws.save(group.mapInArrow(_by_site(_level(depth, max_depth, max_pages, max_errors, budget_ms, pause_ms)), shape), "level")
        levels.append(done)
        state, level = _rows(done.filter("kind = 'state'"), "state"), done.filter("kind = 'next'").select("site", "n", "url", "key", F.col("error").alias("refusal"), "allowed")
        sizes = {r.kind: r["count"] for r in done.groupBy("kind").count().collect()}
        n_states, n_visits = sizes.get("state", 0), sizes.get("next", 0)
        if not n_visits:
            break
    every = levels[0]
    for done in levels[1:]:
        every = every.unionByName(done)
    # numbers of visits rise from level to level within a site
    pages = every.filter("kind = 'page'").select("site", "url", "title", "depth", F.col("n").alias("seq"))
    failed = every.filter("kind = 'error'").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("n", "url", "error"))).alias("told"))
    told = F.transform("told", lambda e: F.struct(e["url"].alias("url"), e["error"].alias("message")))
    outcomes = every.filter("kind = 'end'").join(failed, "site", "left").select(
        "site",
        "pages",
        "seen",
        F.coalesce("truncated", F.when(F.col("dropped") > 0, "url-cap")).alias("truncated"),
        F.coalesce(told, F.array().cast("array<struct<url:string,message:string>>")).alias("errors"),
        F.greatest(F.col("failed") - max_errors, F.lit(0)).cast("int").alias("errors_omitted"),
        F.col("elapsed").alias("elapsed_ms"),
        "refused",
        "refused_host",
    )
    return pages, outcomes
