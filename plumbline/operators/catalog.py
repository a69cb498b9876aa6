"""Catalog maintenance: staleness, schedules, retention, upserts, expectations, policies, budgets, crawl.

Every time-dependent operator takes ``now``; none reads the clock.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx
from plumbline.operators.views import run_refusal
from plumbline.session import Workspace, dealt

STALE_SECONDS, RETENTION_DAYS = 360, 90
DEFAULT_HOUR, DAILY_HOURS, WEEKLY_DAYS = 3, 23, 6
RUNS_PER_HOUR, RUNS_PER_DAY, PREVIEWS_PER_HOUR, PREVIEWS_PER_DAY = 20, 100, 40, 200
FAILURES_TO_THROTTLE, THROTTLE_SECONDS = 8, 300
MAX_PAGES, MAX_DEPTH, MAX_ERRORS, MAX_PAGE_LINKS = 100, 3, 100, 500
RESERVED_SLUGS = ("new",)
# What each environment lets a step do.
READ_ONLY = ["login", "navigate", "inspect", "search", "filter", "paginate", "open-detail"]
ALLOWED = {
    "production": READ_ONLY,
    "preview": [*READ_ONLY, "submit-safe"],
    "staging": [*READ_ONLY, "submit-safe"],
    "test": [*READ_ONLY, "submit-safe", "mutate-test-data"],
}


# --- time -----------------------------------------------------------------------------------


def is_abandoned(status: Column, started: Column, created: Column, now: Column, seconds: int = STALE_SECONDS) -> Column:
    """A running run that began longer ago than the threshold; an unknown start is not abandoned."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce(started, created).cast("timestamp"))
    return F.coalesce((status == "running") & (age > seconds * 1_000_000), F.lit(False))


def reconcile_stale(runs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Runs as readers see them: abandoned ones are failed with run_timed_out."""
    stale = is_abandoned(F.col("status"), F.col("started_at"), F.col("created_at"), now, seconds)
    return runs.withColumns({"failure_reason": F.when(stale, "run_timed_out").otherwise(F.col("failure_reason")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def due_journeys(journeys: DataFrame, now: Column, limit: int = 3) -> DataFrame:
    """Journeys to run in this hour: scheduled, live, runnable and not claimed within their window; longest waiting first."""
    moment = now.cast("timestamp")
    last = F.col("last_scheduled_at").cast("timestamp")
    weekly = F.col("schedule") == "weekly"
    rested = F.when(weekly, last < moment - F.make_interval(days=F.lit(WEEKLY_DAYS))).otherwise(last < moment - F.make_interval(hours=F.lit(DAILY_HOURS)))
    due = (
        F.coalesce(F.col("schedule") != "off", F.lit(False))
        & F.col("archived_at").isNull()
        & run_refusal(F.col("target_url"), F.col("steps")).isNull()
        & (F.coalesce("schedule_hour", F.lit(DEFAULT_HOUR)) == F.hour(moment))
        & (last.isNull() | rested)
    )
    return journeys.filter(due).orderBy(F.asc_nulls_first("last_scheduled_at"), "id").limit(limit)


def claim_journeys(journeys: DataFrame, now: Column, limit: int = 3) -> DataFrame:
    """All journeys, the due ones stamped with ``now``. A single writer must own the table: Spark has no row locks."""
    due = due_journeys(journeys, now, limit).select(F.col("id").alias("due"))
    whole = journeys.select(F.struct(*[F.col(f"`{c}`") for c in journeys.columns]).alias("row"))
    kind = journeys.schema["last_scheduled_at"].dataType
    stamp = F.when(F.col("due").isNotNull(), now.cast(kind)).otherwise(F.col("row.last_scheduled_at"))
    out = whole.join(due, F.col("row.id") == F.col("due"), "left")
    return out.select(*[stamp.alias(c) if c == "last_scheduled_at" else F.col("row")[c].alias(c) for c in journeys.columns])


def release_claim(journeys: DataFrame, journey_id) -> DataFrame:
    return journeys.withColumn("last_scheduled_at", F.when(F.col("id") != journey_id, F.col("last_scheduled_at")))


def release_claims(journeys: DataFrame, failed: DataFrame) -> DataFrame:
    """Journeys, those in ``failed`` (id) free again: their run was not started."""
    lost = failed.select(F.col("id").alias("lost")).distinct()
    whole = journeys.select(F.struct(*[F.col(f"`{c}`") for c in journeys.columns]).alias("row"))
    free = F.when(F.col("lost").isNull(), F.col("row.last_scheduled_at"))
    out = whole.join(lost, F.col("row.id") == F.col("lost"), "left")
    return out.select(*[free.alias(c) if c == "last_scheduled_at" else F.col("row")[c].alias(c) for c in journeys.columns])


def tick(runs: DataFrame, journeys: DataFrame, now: Column, limit: int = 3, seconds: int = STALE_SECONDS) -> dict[str, DataFrame]:
    """One scheduled turn: runs after the sweep, how many it closed, the journeys to start, and all journeys with their claims.

    Journeys whose start then fails go to ``release_claims``.
    """
    stale = is_abandoned(F.col("status"), F.col("started_at"), F.col("created_at"), now, seconds)
    return {
        "runs": reconcile_stale(runs, now, seconds),
        "closed": runs.agg(F.count_if(stale).alias("rows_affected")),
        "due": due_journeys(journeys, now, limit),
        "journeys": claim_journeys(journeys, now, limit),
    }


def archive_journey(journeys: DataFrame, journey_id, now: Column) -> DataFrame:
    """Journeys, one archived (again archived: the later time)."""
    return journeys.withColumn("archived_at", F.when(F.col("id") == journey_id, now.cast(journeys.schema["archived_at"].dataType)).otherwise(F.col("archived_at")))


def revoke_report(reports: DataFrame, report_id, now: Column) -> DataFrame:
    """Reports, the share link of one revoked."""
    return reports.withColumn("revoked_at", F.when(F.col("id") == report_id, now.cast(reports.schema["revoked_at"].dataType)).otherwise(F.col("revoked_at")))


def clear_triage(triage: DataFrame, cleared: DataFrame) -> DataFrame:
    """Triage marks without those in ``cleared`` (client_id, finding_key)."""
    return triage.join(cleared.select("client_id", "finding_key").distinct(), ["client_id", "finding_key"], "left_anti")


def bump_epochs(operators: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Operators, the sessions of those in ``ids`` (id) ended."""
    hit = operators.join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    on = F.col("_hit").isNotNull()
    return hit.withColumn("session_epoch", F.col("session_epoch") + F.when(on, 1).otherwise(0)).withColumn("updated_at", F.when(on, now).otherwise(F.col("updated_at"))).drop("_hit")


def set_disabled(operators: DataFrame, ids: DataFrame, now: Column, disabled: bool = True) -> DataFrame:
    """Operators, those in ``ids`` (id) disabled or not; either way their sessions end."""
    hit = bump_epochs(operators, ids, now).join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    when = now if disabled else F.lit(None)
    return hit.withColumn("disabled_at", F.when(F.col("_hit").isNotNull(), when.cast(operators.schema["disabled_at"].dataType)).otherwise(F.col("disabled_at"))).drop("_hit")


def upsert_operators(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Operators by address, whatever its case: id, address, epoch and creation stay as stored, name, hash and disabled_at are the incoming ones."""
    kept = ("id", "email", "session_epoch", "created_at")
    old = stored.select(*[F.col(c).alias(f"_{c}") for c in stored.columns])
    new = incoming.withColumns({c: F.lit(None).cast(stored.schema[c].dataType) for c in stored.columns if c not in incoming.columns}).withColumn("_given", F.lit(True))
    both = new.join(old, F.lower("email") == F.lower("_email"), "full_outer")
    given = F.col("_given").isNotNull()
    fresh = {"session_epoch": F.lit(0), "created_at": now, "updated_at": now}

    def pick(c: str) -> Column:
        if c in kept:
            return F.coalesce(f"_{c}", F.coalesce(c, fresh[c]) if c in fresh else F.col(c))
        return F.when(given, now if c == "updated_at" else F.col(c)).otherwise(F.col(f"_{c}"))

    return both.select(*[pick(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])


def append_events(events: DataFrame, fresh: DataFrame, order: str = "created_at") -> DataFrame:
    """Events with further ones, which get the next ids in their order; columns they lack are NULL.

    One task numbers the further ones, a batch that is small next to the log.
    """
    last = events.agg(F.max("id").alias("last")).first().last or 0
    numbered = fresh.drop("id").withColumn("id", F.row_number().over(Window.orderBy(order)) + F.lit(last))
    return events.unionByName(numbered, allowMissingColumns=True)


def clear_artifacts(pages: DataFrame, runs: DataFrame, cutoff: Column) -> DataFrame:
    """Pages, those of runs created before the cutoff without artifacts (map); others as they are."""
    old = runs.filter(F.col("created_at") < cutoff).select("request_id", F.lit(True).alias("_old"))
    empty = F.create_map().cast("map<string,string>")
    return pages.join(old, "request_id", "left").withColumn("artifacts", F.when(F.col("_old"), empty).otherwise(F.col("artifacts"))).drop("_old")


# --- writes as folds ------------------------------------------------------------------------


def upsert_runs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and incoming runs by request_id: earliest creation and start stay, phase_ms and intent fall back to what was there, all else is the incoming row's."""
    old = stored.select(*[F.col(c).alias(f"_{c}") for c in stored.columns])
    joined = incoming.withColumn("_in", F.lit(True)).join(old, F.col("request_id") == F.col("_request_id"), "full_outer")
    out = []
    for c in stored.columns:
        new, was = F.col(c), F.col(f"_{c}")
        if c in ("created_at", "started_at"):
            out.append(F.least(new, was).alias(c))
        elif c in ("phase_ms", "intent"):
            out.append(F.coalesce(new, was).alias(c))
        else:
            out.append(F.when(F.col("_in"), new).otherwise(was).alias(c))
    return joined.select(*out)


def replace_children(stored: DataFrame, incoming: DataFrame, parents: DataFrame, key: str = "request_id") -> DataFrame:
    """Child rows of saved parents give way to the incoming ones, also where none came."""
    return stored.join(parents.select(key).distinct(), key, "left_anti").unionByName(incoming)


def insert_missing(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, each once."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh.dropDuplicates([key]))


def upsert_last(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), fallback: Sequence[str] = ()) -> DataFrame:
    """Last write wins by keys; ``keep`` columns stay as stored, ``fallback`` ones do where the new value is NULL."""
    keys = list(keys)
    # rows travel in structs, so that columns of any name may come
    old = stored.select(F.struct(*[F.col(f"`{c}`") for c in stored.columns]).alias("old"))
    new = incoming.select(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]).alias("new"))
    joined = new.join(old, [F.col("new")[k] == F.col("old")[k] for k in keys], "full_outer")
    was, now = (lambda c: F.col("old")[c]), (lambda c: F.col("new")[c])
    pick = lambda c: F.coalesce(was(c), now(c)) if c in keep else F.coalesce(now(c), was(c)) if c in fallback else F.when(F.col("new").isNotNull(), now(c)).otherwise(was(c))
    return joined.select(*[pick(c).alias(c) for c in stored.columns])


# --- policies and budgets -------------------------------------------------------------------


def action_allowed(environment: Column, action: Column) -> Column:
    out = F.lit(False)
    for name, actions in ALLOWED.items():
        out = out | ((environment == name) & action.isin(*actions))
    return F.coalesce(out, F.lit(False))


def first_forbidden(environment: Column, actions: Column) -> Column:
    """The first action of an array that the environment forbids, or NULL."""
    return F.try_element_at(F.filter(actions, lambda a: a.isNotNull() & ~action_allowed(environment, a)), F.lit(1))


def actions_anywhere() -> list[str]:
    return list(dict.fromkeys(a for actions in ALLOWED.values() for a in actions))


def distinct_actions(rows: DataFrame, actions: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct actions of all rows' arrays, in text order, per group or over all."""
    one = rows.select(*by, F.explode(actions).alias("_action")).distinct()
    return one.groupBy(*by).agg(F.array_sort(F.collect_list("_action")).alias(actions))


def consume_budget(requests: DataFrame, ts: str, key: str, per_hour: int = RUNS_PER_HOUR, per_day: int = RUNS_PER_DAY, prefix: str = "runs") -> DataFrame:
    """Requests with their place in the UTC hour and day; the day is judged first, and refused requests count too.

    A place is the requests of earlier minutes of the hour (day) and the place within the minute, so
    no task ranks more than a minute's requests.
    """
    told = ["hour_count", "day_count", "refused_by", "allowed", "resets_in", "hour_key", "day_key"]
    kept = [c for c in requests.columns if c not in told]
    # the request travels in a struct, so that columns of any name may come
    rows = requests.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(ts).alias("ts"), F.col(key).alias("key"), F.date_trunc("minute", ts).alias("minute"))
    minutes = rows.groupBy(F.col("minute").alias("at")).agg(F.count("*").alias("n"))
    earlier = lambda unit: F.coalesce(F.sum("n").over(Window.partitionBy(F.date_trunc(unit, "at")).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = minutes.withColumn("hour", earlier("hour")).withColumn("day", earlier("day"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("minute").orderBy("ts", "key")))
    rows = rows.join(minutes, F.col("minute").eqNullSafe(F.col("at")))
    count = lambda unit: (F.col(unit) + F.col("place")).cast("int").alias(f"{unit}_count")
    out = rows.select(*[F.col("row")[c].alias(c) for c in kept], count("hour"), count("day"))
    over_day, over_hour = F.col("day_count") > per_day, F.col("hour_count") > per_hour
    window = F.when(over_day, "day").when(over_hour, "hour")
    out = out.withColumn("refused_by", window).withColumn("allowed", window.isNull())
    resets = F.when(over_day, tx.seconds_to_day(F.col(ts))).when(over_hour, tx.seconds_to_hour(F.col(ts)))
    return out.withColumn("resets_in", resets).withColumn("hour_key", tx.hour_key(F.col(ts), prefix)).withColumn("day_key", tx.day_key(F.col(ts), prefix))


# --- expectations ---------------------------------------------------------------------------


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule is false; NULL passes, as in a CHECK."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(name) for name, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules])
    return counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.violations")


def run_rules() -> dict[str, Column]:
    return {"score_0_100": F.col("score").between(0, 100), "request_id_present": F.col("request_id").isNotNull()}


def triage_rules() -> dict[str, Column]:
    return {
        "state": F.col("state").isin("dismissed", "accepted-risk", "assigned"),
        "note_when_closed": ~F.col("state").isin("dismissed", "accepted-risk") | (F.length(F.trim(F.coalesce("note", F.lit("")))) > 0),
        "assignee_when_assigned": (F.col("state") != "assigned") | (F.length(F.trim(F.coalesce("assignee", F.lit("")))) > 0),
    }


def report_rules() -> dict[str, Column]:
    return {"audience": F.col("audience").isin("legal", "dev", "exec")}


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


# --- crawl ----------------------------------------------------------------------------------


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int | None = None) -> DataFrame:
    """Pages reached from the seeds by links (src, dst), breadth first: (site, page, depth), each page at its least depth.

    ``seeds`` has (site, page). The frontier of each level is a join on the edge table; levels are
    written to the shared folder, so lineage does not grow. With ``max_pages`` a site keeps its
    first pages by depth and key.
    """
    ws = Workspace(edges.sparkSession, "crawl")
    seen = ws.save(seeds.select("site", "page", F.lit(0).alias("depth")).distinct(), "level")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["page"] == edges["src"]).select("site", F.col("dst").alias("page")).distinct()
        frontier = ws.save(step.join(seen, ["site", "page"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        seen = seen.unionByName(frontier)
    if max_pages is not None:
        order = Window.partitionBy("site").orderBy("depth", "page")
        seen = seen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_pages).drop("_n")
    return seen


#: Links of a page that a level's tasks are laid out for; pages with more only make the tasks larger.
USUAL_LINKS = 16


def crawl_pages(links: DataFrame, seeds: DataFrame, failed: DataFrame | None = None, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, max_links: int = MAX_PAGE_LINKS, max_errors: int = MAX_ERRORS) -> tuple[DataFrame, DataFrame]:
    """A crawl of every site at once, breadth first, within its bounds: pages (site, page, depth, seq) and outcomes.

    ``links`` is (src, position, dst), ``seeds`` (site, page), ``failed`` (page, message) pages that cannot
    be read. A page is visited once, in the order in which links to it are met: by the place of the
    page that links and the link's position. Of a page ``max_links`` links count. A failed page is an
    error, not a page, and its links are not seen. When as many pages are recorded or waiting as
    ``max_pages`` allows, further links are met but not followed.

    Outcomes (site, seen, truncated, errors, errors_omitted): ``seen`` counts all pages met,
    ``truncated`` is url-cap if any was not followed, ``errors`` lists up to ``max_errors`` pages.

    A level is one join of its pages with the links and two windows per site. The windows see the links
    of one level of one site: at most ``max_pages`` times ``max_links``. Tasks are as many as the pages found so far ask for.
    """
    ws = Workspace(links.sparkSession, "crawl")
    links = links.filter(F.col("position") < max_links)
    broken = failed.select(F.col("page").alias("_bad"), "message") if failed is not None else None

    def visited(rows: DataFrame) -> DataFrame:
        """Rows of a level with ``error``, and ``lost``: the failures of the site among what was taken before them."""
        rows = rows.join(broken, F.col("page") == F.col("_bad"), "left").withColumn("error", F.coalesce("message", F.when(F.col("_bad").isNotNull(), ""))).drop("_bad", "message") if broken is not None else rows.withColumn("error", F.lit(None).cast("string"))
        so_far = Window.partitionBy("site").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("lost", F.col("lost") + F.coalesce(F.count_if(F.col("error").isNotNull()).over(so_far), F.lit(0)))

    level = seeds.select("site", "page", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("lost"), F.lit(True).alias("followed"))
    level = ws.save(visited(level.dropDuplicates(["site"])), "level")
    every = level
    for depth in range(1, max_depth + 1):
        open_pages = level.filter("followed and error is null").select("site", F.col("page").alias("src"), F.col("seq").alias("from"), "lost")
        found = every.count()
        most = max(found, open_pages.count() * min(max_links, USUAL_LINKS))
        met = dealt(open_pages, most, "src").join(links, "src").select("site", F.col("dst").alias("page"), "from", "position", "lost")
        met = dealt(met, most, "site")  # all that follows is by site
        met = met.join(every.select("site", "page"), ["site", "page"], "left_anti")
        first = Window.partitionBy("site", "page").orderBy("from", "position")
        met = met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        # taken so far and the most that may be: a(i) = min(a(i - 1) + 1, cap(i)), as caps do not fall
        taken = every.groupBy("site").agg(F.count_if("followed").alias("taken"), F.max("seq").alias("last"))
        order = Window.partitionBy("site").orderBy("from", "position")
        met = met.join(taken, "site").withColumn("i", F.row_number().over(order))
        room = F.min(F.lit(max_pages) + F.col("lost") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("upto", F.least(F.col("taken") + F.col("i"), F.greatest(F.col("taken"), room + F.col("i"))))
        met = met.withColumn("followed", F.col("upto") > F.lag("upto", 1).over(order).cast("long")).withColumn("followed", F.coalesce("followed", F.col("upto") > F.col("taken")))
        # failures of this level are seen when it is worked off, after those before it
        lost = level.groupBy("site").agg(F.max(F.col("lost") + F.when(F.col("error").isNotNull() & F.col("followed"), 1).otherwise(0)).alias("lost"))
        rows = met.drop("lost").join(lost, "site").select("site", "page", F.lit(depth).alias("depth"), (F.col("last") + F.col("i")).cast("long").alias("seq"), "lost", "followed")
        dropped = rows.filter("not followed").withColumn("error", F.lit(None).cast("string"))
        level = ws.save(visited(rows.filter("followed")).unionByName(dropped), "level")
        every = every.unionByName(level)
    every = ws.save(every, "crawl")
    every = dealt(every, every.count(), "site")
    pages = every.filter("followed and error is null")
    pages = pages.select("site", "page", "depth", (F.row_number().over(Window.partitionBy("site").orderBy("seq")) - 1).alias("seq"))
    told = F.struct("seq", "page", "error")
    outcomes = every.groupBy("site").agg(
        F.count("*").alias("seen"),
        F.when(F.count_if(~F.col("followed")) > 0, "url-cap").alias("truncated"),
        F.array_sort(F.collect_list(F.when(F.col("followed") & F.col("error").isNotNull(), told))).alias("_errors"),
    )
    listed = F.transform(F.slice("_errors", 1, max_errors), lambda e: F.struct(e["page"].alias("page"), e["error"].alias("message")))
    return pages, outcomes.select("site", "seen", "truncated", listed.alias("errors"), F.greatest(F.size("_errors") - max_errors, F.lit(0)).alias("errors_omitted"))


def unique_slugs(rows: DataFrame, base: str, order: str, taken: DataFrame | None = None, reserved: tuple[str, ...] = RESERVED_SLUGS) -> DataFrame:
    """Slugs, each once: in order, a row gets its base if that is free, else the base with the first free suffix from -2 on.

    ``taken`` (slug) are in use already; ``reserved`` ones never are given. Whether a name is free can
    depend only on bases that are equal but for suffixes, so rows are dealt by the base without them,
    and a task streams through its rows in order. It holds the names given for one such base, as
    numbers up to which all are taken and the few beyond.
    """
    columns = [f.name for f in rows.schema.fields]
    bare = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"(-[0-9]+)+$", ""), F.lit("")), c)
    own = rows.select(bare(F.col(base)).alias("root"), F.lit(1).alias("late"), F.col(order).alias("place"), F.col(base).alias("base"), F.struct(*columns).alias("row"))
    if taken is not None:
        used = taken.select(bare(F.col("slug")).alias("root"), F.lit(0).alias("late"), F.lit(None).cast(rows.schema[order].dataType).alias("place"), F.col("slug").alias("base"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))
        own = own.unionByName(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, given, upto = None, set(), {}

        def is_taken(name: str) -> bool:
            stem, _, number = name.rpartition("-")
            return name in given or (number.isascii() and number.isdigit() and number[0] != "0" and 1 < int(number) <= upto.get(stem, 1))

        for batch in batches:
            slugs = []
            for now, late, name in zip(batch.column("root").to_pylist(), batch.column("late").to_pylist(), batch.column("base").to_pylist(), strict=True):
                if now != root:
                    root, given, upto = now, set(reserved), {}
                slug = name
                if not is_taken(name):
                    given.add(name)
                elif late:
                    k = upto.get(name, 1) + 1
                    while is_taken(f"{name}-{k}"):
                        given.discard(f"{name}-{k}")
                        upto[name] = k
                        k += 1
                    upto[name] = k
                    slug = f"{name}-{k}"
                slugs.append(slug)
            keep = pa.compute.equal(batch.column("late"), 1)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep), pa.array(slugs, pa.string()).filter(keep)], ["row", "slug"])

    shape = T.StructType([own.schema["row"], T.StructField("slug", T.StringType())])
    out = own.repartition("root").sortWithinPartitions("root", "late", "place").mapInArrow(run, shape)
    return out.select("row.*", "slug")
