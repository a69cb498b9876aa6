"""Text, slug, time-window and failure functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Failure codes by pattern, in order of precedence.
FAILURES = [
    (r'^Step \d+ \(".*"\) could not ', "journey_step_failed"),
    (r"not allowed by run contract scope", "journey_not_in_scope"),
    (r'not allowed by environment policy|^Action ".*" is not allowed in ', "action_not_allowed"),
    (r"^stepId must", "invalid_step_id"),
    (r"^A run against a target URL must name its own steps", "journey_has_no_steps"),
]
# Markers of site platforms, in order of precedence.
PLATFORMS = [("react", r"(?i)data-reactroot|__next"), ("wordpress", r"(?i)wp-content|wp-includes|wordpress")]
# What each platform's adapter can tell.
CAPABILITIES = {"generic": (False, False, False), "react": (True, True, False), "wordpress": (False, False, True)}
# What a failed run's reason means.
FAILURE_WORDS = {
    "journey_step_failed": "A step could not be performed — usually a selector that no longer matches the page. Record the journey again against the current site.",
    "journey_has_no_steps": "This run named a site but no path through it, so there was nothing to walk.",
    "journey_not_in_scope": "This journey is not in the run contract’s scope, so the run was refused.",
    "action_not_allowed": "A step asked for something this environment forbids. Production is read-only.",
    "invalid_step_id": "The run’s step name was not usable as an evidence filename.",
    "navigation_not_allowed": "The run refused to follow a navigation: somewhere outside this journey’s allowed hosts, or a private address. If the destination is legitimate, the journey’s allowed hosts have to be widened deliberately.",
    "run_timed_out": "The run never reported back and was closed out. Usually the journey outlived the function’s time limit.",
    "audit_run_failed": "The run stopped for a reason it could not categorise. Running it again will say whether it repeats.",
}


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def slug(text: Column, most: int) -> Column:
    """Lower-case letters and digits, all else single hyphens, cut, without hyphens at the ends."""
    dashed = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, most), r"-+$", "")


def client_slug(name: Column, most: int = 48) -> Column:
    """A client's id from its name, before it is made unique: as ``slug``, but what the cut leaves stays; client for nothing."""
    dashed = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, most), F.lit("")), F.lit("client"))


def failure_words(code: Column) -> Column:
    """A sentence on a failed run's reason code; unknown codes are told as they are."""
    out = F.when(F.lit(False), "")
    for known, words in FAILURE_WORDS.items():
        out = out.when(code == known, words)
    return out.otherwise(F.concat(F.lit("The run stopped: "), code, F.lit(".")))


def policy_mode(environment: Column) -> Column:
    return F.when(environment == "production", "read-only").otherwise("safe-write")


def date_part(ts: Column) -> Column:
    """The day of a time, as text."""
    return F.date_format(ts, "yyyy-MM-dd")


def host_words(host: Column, most: int = 80) -> Column:
    """A host as copy shows it, cut in front of an ellipsis."""
    return clip(host, most)


def page_key(index: Column, route: Column) -> Column:
    """File-name key of a captured page: two digits of its place and a slug of its route without extension."""
    bare = F.regexp_replace(route, r"\.[A-Za-z0-9]+$", "")
    name = slug(bare, 40)
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("-"), F.when(name == "", "page").otherwise(name))


def initials(name: Column) -> Column:
    """First letters of the first and last word, upper-case; O without words."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    first = F.substring(F.try_element_at(words, F.lit(1)), 1, 1)
    last = F.when(F.size(words) > 1, F.substring(F.try_element_at(words, F.lit(-1)), 1, 1)).otherwise("")
    return F.coalesce(F.upper(F.concat(first, last)), F.lit("O"))


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def depth_words(depth: Column) -> Column:
    words = ["The address you gave", "One click from there", "Two clicks from there", "Three clicks from there"]
    out = F.when(F.lit(False), "")
    for i, w in enumerate(words):
        out = out.when(depth == i, w)
    return out.otherwise(F.concat(depth.cast("string"), F.lit(" clicks from there")))


def failure_code(message: Column, error_name: Column | None = None) -> Column:
    """Reason code of a failed run's message."""
    out = F.when(F.lit(False) if error_name is None else F.coalesce(error_name == "UnsafeTargetError", F.lit(False)), "navigation_not_allowed")
    for pattern, code in FAILURES:
        out = out.when(message.rlike(pattern), code)
    return out.otherwise("audit_run_failed")


def detect_platform(html: Column, hint: Column | None = None, markers: list[tuple[str, str]] = PLATFORMS) -> Column:
    """A known hint wins; else the first platform with a marker in the page; else generic."""
    known = [name for name, _ in markers] + ["generic"]
    out = F.when(F.lit(False) if hint is None else F.coalesce(hint.isin(*known), F.lit(False)), F.lit(None) if hint is None else hint)
    for name, pattern in markers:
        out = out.when(html.rlike(pattern), name)
    return out.otherwise("generic")


def capabilities(platform: Column) -> Column:
    """struct(spa_navigation, component_source, cms_template); unknown platforms are generic."""
    pick = lambda i: F.coalesce(*[F.when(platform == k, F.lit(v[i])) for k, v in CAPABILITIES.items()], F.lit(False))
    return F.struct(pick(0).alias("spa_navigation"), pick(1).alias("component_source"), pick(2).alias("cms_template"))


def verdict_words(text: Column) -> Column:
    """Letters and blanks of a verdict label, trimmed, lower-case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[^A-Za-z ]", "")))


def hour_key(ts: Column, prefix: str = "runs") -> Column:
    return F.concat(F.lit(f"{prefix}:hour:"), F.date_format(ts, "yyyyMMddHH"))


def day_key(ts: Column, prefix: str = "runs") -> Column:
    return F.concat(F.lit(f"{prefix}:day:"), F.date_format(ts, "yyyyMMdd"))


def seconds_to_hour(ts: Column) -> Column:
    return (F.lit(3600) - (F.minute(ts) * 60 + F.second(ts))).cast("int")


def seconds_to_day(ts: Column) -> Column:
    return (F.lit(86_400) - (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))).cast("int")


def positive_or(value: str | None, fallback: int) -> int:
    """A positive whole number from configuration, else the fallback."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return fallback
    return int(number) if number.is_integer() and number > 0 else fallback


def positive_number(value: Column, fallback: int) -> Column:
    """A column of settings as positive whole numbers: ``12``, ``12.0``, ``1.2e1`` and blanks around them; the fallback for anything else."""
    number = F.when(F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(value).try_cast("double"))
    whole = (number > 0) & (number < 2.0**53) & (F.floor(number) == number)
    return F.when(F.coalesce(whole, F.lit(False)), number.cast("long")).otherwise(F.lit(fallback).cast("long"))


def clamp_limit(limit: float | None, default: int = 20, most: int = 100) -> int:
    """Rows of a page of a list: whole, at least 1, at most ``most``; no number means the default."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")):
        return default
    return max(1, min(most, int(limit // 1)))
