"""Column functions over findings, runs and pages: keys, severities, verdicts, gates, scan tags.

All are built-in expressions. NULL means "not measured" and stays NULL unless a function says
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names, their display groups and order, and the levels that gate.
DISPLAY = {"critical": "must", "major": "should", "minor": "nice", "needs-review": "review", "advisory": "advisory"}
DISPLAY_ORDER = ["must", "should", "nice", "review", "advisory"]
IMPACT = {"critical": "critical", "serious": "major", "moderate": "minor", "minor": "minor"}
GATING_LEVELS = ["A", "AA"]
GATE_VERSION, SCORE_VERSION = 2, 2
MIN_CONFIDENCE = 0.7
MAX_SNIPPET, MAX_TITLE = 512, 300


def lookup(column: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The table's value for a key; ``default`` for other keys and NULL."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in table.items():
        out = out.when(column == key, value)
    return out.otherwise(F.lit(default))


def finding_key(source: Column, code: Column, page_url: Column, selector: Column) -> Column:
    """Identity of a finding over runs: parts joined by colons, NULL as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    colon = F.lit(":")
    return F.concat(text(source), colon, text(code), colon, text(page_url), colon, text(selector))


def display_severity(severity: Column) -> Column:
    """must / should / nice / review / advisory; what is unknown needs review."""
    return lookup(severity, DISPLAY, "review")


def display_rank(display: Column) -> Column:
    """Place in the display order, from 0; unknown groups last."""
    place = F.array_position(F.array(*[F.lit(x) for x in DISPLAY_ORDER]), display)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(DISPLAY_ORDER))).cast("int")


def finding_status(in_latest: Column, triage: Column, previously_fixed: Column | None = None) -> Column:
    """Dismissed before Fixed before Assigned before Retest due or Open."""
    fixed = F.lit(False) if previously_fixed is None else F.coalesce(previously_fixed, F.lit(False))
    return (
        F.when(triage.isin("dismissed", "accepted-risk"), "Dismissed")
        .when(~F.coalesce(in_latest, F.lit(False)), "Fixed")
        .when(triage == "assigned", "Assigned")
        .when(fixed, "Retest due")
        .otherwise("Open")
    )


def is_deterministic(source: Column) -> Column:
    return F.coalesce(source == "deterministic", F.lit(False))


def gates(source: Column, severity: Column, level: Column) -> Column:
    """A conformance failure that blocks: deterministic, decided, level A or AA. Never NULL."""
    return is_deterministic(source) & F.coalesce(severity != "needs-review", F.lit(True)) & F.coalesce(level.isin(*GATING_LEVELS), F.lit(False))


def is_unresolved(source: Column, severity: Column) -> Column:
    """A finding that leaves a passing run at risk."""
    return is_deterministic(source) & F.coalesce(severity.isin("major", "needs-review"), F.lit(False))


def run_verdict(status: Column, ci_status: Column, unresolved: Column) -> Column:
    """scan / inconclusive / fail / risk / pass, in this precedence; ``unresolved`` says whether any finding is."""
    return (
        F.when(status == "running", "scan")
        .when((status == "failed") | (ci_status == "inconclusive"), "inconclusive")
        .when(ci_status == "fail", "fail")
        .when(F.coalesce(unresolved, F.lit(False)), "risk")
        .otherwise("pass")
    )


def passes_confidence(confidence: Column, least: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce(confidence >= least, F.lit(False))


def evidence_status(screenshot: Column, dom: Column, ax_tree: Column, status_code: Column) -> Column:
    """complete with all three artifacts, unless the page was served as an error (an unknown status is no error)."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    served = F.coalesce(status_code < 400, F.lit(True))
    return F.when(has(screenshot) & has(dom) & has(ax_tree) & served, "complete").otherwise("degraded")


def page_evidence(status: Column, status_code: Column) -> Column:
    """A sentence about a page's evidence."""
    code = status_code.cast("string")
    return (
        F.when(status == "complete", "evidence complete")
        .when(status_code.isNull(), F.concat(F.lit("evidence "), status))
        .when(status_code >= 400, F.concat(F.lit("served "), code, F.lit(" — not usable as evidence")))
        .otherwise(F.concat(F.lit("evidence "), status, F.lit(" (page returned "), code, F.lit(")")))
    )


def score_of(passed: Column, failed: Column, evidence: Column) -> Column:
    """Share of passed checks in whole percent, half up; 99 at most if any failed; NULL without full evidence or checks."""
    n = passed + failed
    rounded = F.floor((200 * passed + n) / (2 * F.nullif(n, F.lit(0)))).cast("int")
    capped = F.when(failed > 0, F.least(rounded, F.lit(99))).otherwise(rounded)
    return F.when((evidence == "complete") & (n > 0), capped)


def severity_of_impact(impact: Column, incomplete: Column) -> Column:
    """Severity of a scan rule; rules that could not be decided need review."""
    return F.when(incomplete, "needs-review").otherwise(lookup(impact, IMPACT, "minor"))


def criteria_of_tags(tags: Column) -> Column:
    """Success criteria named by tags like wcag1412 (1.4.12), distinct, in text order."""
    named = F.filter(tags, lambda t: t.rlike(r"^wcag\d\d\d+$"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda t: F.regexp_replace(t, r"^wcag(\d)(\d)(\d+)$", "$1.$2.$3"))))


def level_of_tags(tags: Column) -> Column:
    """The strictest conformance level named by tags like wcag21aa, or NULL."""
    named = F.filter(tags, lambda t: t.rlike(r"^wcag\d+a{1,3}$"))
    least = F.array_min(F.transform(named, lambda t: F.length(F.regexp_extract(t, r"(a+)$", 1))))
    return F.when(least.isNotNull(), F.repeat(F.lit("A"), least.cast("int")))


def selector_of_target(target: Column) -> Column:
    """Nested target of a node (array<array<string>>): parts by blanks, frames by ``>>>``."""
    return F.array_join(F.transform(target, lambda part: F.array_join(part, " ")), " >>> ")


def snippet(html: Column, most: int = MAX_SNIPPET) -> Column:
    """HTML on one line, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(html, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def message_or(summary: Column, help_text: Column) -> Column:
    """The trimmed failure summary, or the rule's help."""
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), help_text)


def remediation(*checks: Column) -> Column:
    """Distinct trimmed messages of check arrays (array<struct<message>>), in order; empty for none."""
    empty = F.array().cast("array<string>")
    texts = [F.coalesce(F.transform(c, lambda x: F.trim(x["message"])), empty) for c in checks]
    return F.array_distinct(F.filter(F.concat(*texts), lambda m: F.length(m) > 0))


def bound_title(title: Column, most: int = MAX_TITLE) -> Column:
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("…"))).otherwise(title)
