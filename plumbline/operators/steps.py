"""Steps of journeys as JSON: which may be stored, how they are shown, what is kept of a run's; loose payloads.

Steps are JSON text of any shape. An element is looked at as a variant, so that a number is told
from a string and a missing field from an empty one; nothing here fails on what it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.catalog import actions_anywhere

# Bounds of steps, the form of a credential's name, and the keys that say where a step goes.
MAX_TEXT, MAX_VALUE, MAX_STEPS, MAX_PAYLOAD = 512, 4096, 50, 64_000
CREDENTIAL = r"^[A-Za-z0-9_-]{1,64}$"
TYPES = ["goto", "click", "fill", "expect"]
FIELDS = ["user", "pass"]
KEPT_KEYS = ["action", "type", "path", "selector", "credentialRef", "field", "urlIncludes"]
# Severities that a payload may name.
SEVERITIES = ["critical", "major", "minor", "advisory"]


def elements(raw: Column) -> Column:
    """The elements of a JSON array as variants; NULL for anything else."""
    return F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<variant>"))


def _kind(v: Column, field: str | None = None) -> Column:
    """Type of a variant or of a field of it (STRING, BOOLEAN, ARRAY<..>, OBJECT<..>, VOID ..), empty if there is none."""
    at = v if field is None else F.try_variant_get(v, f"$.{field}", "variant")
    return F.coalesce(F.schema_of_variant(at), F.lit(""))


def _text(v: Column, field: str) -> Column:
    """A field that is a string, else NULL."""
    return F.when(_kind(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _number(v: Column, field: str) -> Column:
    return F.when(_kind(v, field).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{field}", "double"))


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _keys(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


#: The fields of a step that any form has.
_TEXTS = ["action", "type", "path", "selector", "value", "credentialRef", "field", "urlIncludes"]


def step_facts(v: Column) -> Column:
    """What the checks ask of a step (variant), as a struct: whether it is an object, its keys, its text fields.

    In a lambda Spark works out an expression as often as it is named. The checks name these dozens of
    times, so they go over an array of facts, where each is a field.
    """
    return F.struct(_is_object(v).alias("object"), _keys(v).alias("keys"), *[_text(v, f).alias(f) for f in _TEXTS])


def all_facts(raw: Column) -> Column:
    """``step_facts`` of every element of a JSON array; NULL for anything else."""
    return F.transform(elements(raw), step_facts)


def _sized(s: Column, field: str, least: int = 1, most: int = MAX_TEXT) -> Column:
    """Whether a field is a string of a length within bounds."""
    return F.coalesce(F.length(s[field]).between(least, most), F.lit(False))


def _matches(s: Column, field: str, pattern: str) -> Column:
    return F.coalesce(s[field].rlike(pattern), F.lit(False))


def _optional(s: Column, field: str) -> Column:
    return ~F.array_contains(s["keys"], field) | _sized(s, field)


def step_problem(v: Column) -> Column:
    """Why a step (variant) may not be stored as authored, or NULL."""
    return F.element_at(F.transform(F.array(step_facts(v)), _problem), 1)


def _problem(s: Column) -> Column:
    """Why a step (its facts) may not be stored as authored, or NULL.

    The checks go from the whole to its parts: object, action, type, the type's fields, further keys.
    """
    has = lambda f: F.array_contains(s["keys"], f)
    only = lambda *names: F.size(F.array_except(s["keys"], F.array(*[F.lit(n) for n in ("action", "type", *names)]))) == 0
    kind, action = s["type"], s["action"]
    named = has("credentialRef") | has("field")
    return (
        F.when(~s["object"], "not_an_object")
        .when(~F.coalesce(action.isin(*actions_anywhere()), F.lit(False)), "action")
        .when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "type")
        .when((kind == "goto") & ~_sized(s, "path"), "path")
        .when(kind.isin("click", "fill") & ~_sized(s, "selector"), "selector")
        .when((kind == "fill") & named & ~_matches(s, "credentialRef", CREDENTIAL), "credential")
        .when((kind == "fill") & named & ~F.coalesce(s["field"].isin(*FIELDS), F.lit(False)), "field")
        .when((kind == "fill") & ~named & ~_sized(s, "value", 1, MAX_VALUE), "value")
        .when((kind == "fill") & ~named & (action == "login"), "literal_login")
        .when((kind == "expect") & ~(_optional(s, "urlIncludes") & _optional(s, "selector")), "expectation")
        .when((kind == "expect") & ~(has("urlIncludes") | has("selector")), "nothing_expected")
        .when((kind == "goto") & ~only("path"), "unknown_key")
        .when((kind == "click") & ~only("selector"), "unknown_key")
        .when((kind == "fill") & named & ~only("selector", "credentialRef", "field"), "unknown_key")
        .when((kind == "fill") & ~named & ~only("selector", "value"), "unknown_key")
        .when((kind == "expect") & ~only("urlIncludes", "selector"), "unknown_key")
    )


def steps_problem(raw: Column) -> Column:
    """Why a journey's steps (JSON text) may not be stored, or NULL. Steps are counted before any is looked at."""


    def first(steps: Column) -> Column:
        few = F.when(F.size(steps) <= MAX_STEPS, steps)
        found = F.filter(F.transform(F.transform(few, step_facts), _problem), lambda p: p.isNotNull())
        step = F.try_element_at(found, F.lit(1))
        return F.when(steps.isNull(), "not_an_array").when(F.size(steps) > MAX_STEPS, "too_many_steps").otherwise(step)

    def whole(problem: Column) -> Column:
        return F.coalesce(problem, F.when(F.length(F.to_json(F.try_parse_json(raw))) > MAX_PAYLOAD, "too_large"))

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(once(elements(raw), first), whole)


def is_recognised(v: Column) -> Column:
    """Whether a stored step (variant) has one of the known forms; further keys do no harm."""
    return F.element_at(F.transform(F.array(step_facts(v)), _recognised), 1)


def _recognised(s: Column) -> Column:
    kind = s["type"]
    filled = _sized(s, "value", 0, MAX_VALUE) | (_matches(s, "credentialRef", CREDENTIAL) & F.coalesce(s["field"].isin(*FIELDS), F.lit(False)))
    expects = _optional(s, "urlIncludes") & _optional(s, "selector") & (_sized(s, "urlIncludes") | _sized(s, "selector"))
    form = F.when(kind == "goto", _sized(s, "path")).when(kind == "click", _sized(s, "selector")).when(kind == "fill", _sized(s, "selector") & filled).when(kind == "expect", expects)
    return s["object"] & _sized(s, "action") & F.coalesce(form, F.lit(False))


def step_views(raw: Column) -> Column:
    """Steps as they are shown, a struct per element; empty for anything but an array.

    A literal value is never told, only that there is one. What is not recognised says so, with a
    bounded action and type.
    """
    loose = lambda s, f: F.coalesce(F.substring(s[f], 1, MAX_TEXT), F.lit("unknown"))
    judged = lambda s: F.struct(s.alias("s"), _recognised(s).alias("known"))

    def view(of: Column, i: Column) -> Column:
        s, known = of["s"], of["known"]
        kind = s["type"]
        literal = (kind == "fill") & _sized(s, "value", 0, MAX_VALUE)
        told = lambda f, *kinds: F.when(known & kind.isin(*kinds), s[f])
        named = lambda f: F.when(~literal, told(f, "fill"))
        return F.struct(
            (i + 1).alias("position"),
            loose(s, "action").alias("action"),
            loose(s, "type").alias("type"),
            told("path", "goto").alias("path"),
            told("selector", "click", "fill", "expect").alias("selector"),
            told("urlIncludes", "expect").alias("url_includes"),
            named("credentialRef").alias("credential_ref"),
            named("field").alias("field"),
            F.when(known, F.coalesce(literal, F.lit(False))).otherwise(s["value"].isNotNull()).alias("has_literal_value"),
            known.alias("recognised"),
        )

    return F.coalesce(F.transform(F.transform(all_facts(raw), judged), view), F.array().cast("array<struct<position:int,action:string,type:string,path:string,selector:string,url_includes:string,credential_ref:string,field:string,has_literal_value:boolean,recognised:boolean>>"))


def redacted_steps(raw: Column) -> Column:
    """What is kept of a run's steps: of an object the keys that say where it goes (JSON text), anything else as it is."""
    keep = lambda v: F.to_json(F.map_filter(F.from_json(F.to_json(v), "map<string,variant>"), lambda k, _: k.isin(*KEPT_KEYS)))
    return F.transform(elements(raw), lambda v: F.when(_is_object(v), keep(v)).otherwise(F.to_json(v)))


def stored_findings(findings: DataFrame) -> DataFrame:
    """Findings as they are stored: advisory ones keep message, gateable and confidence; scan results all but those two."""
    advisory = F.coalesce(F.col("source") == "ai-advisory", F.lit(False))
    always = ("code", "severity", "source", "message")
    only_advisory = ("gateable", "confidence")
    identity = [c for c in ("request_id", "position") if c in findings.columns]
    scanned = [c for c in findings.columns if c not in (*identity, *always, *only_advisory)]
    return findings.select(
        *identity,
        *always,
        *[F.when(advisory, F.col(c)).alias(c) for c in only_advisory if c in findings.columns],
        *[F.when(~advisory, F.col(c)).alias(c) for c in scanned],
    )


def parsed_findings(raw: Column) -> Column:
    """Findings of a loose payload (JSON text): what is no object with a text code is left out, the rest made to fit."""

    def one(v: Column) -> Column:
        advisory = F.coalesce(_text(v, "source") == "ai-advisory", F.lit(False))
        return F.struct(
            _text(v, "code").alias("code"),
            _text(v, "message").alias("message"),
            F.when(_text(v, "severity").isin(*SEVERITIES), _text(v, "severity")).otherwise("minor").alias("severity"),
            F.when(advisory, "ai-advisory").otherwise("deterministic").alias("source"),
            F.when(_kind(v, "gateable") == "BOOLEAN", F.try_variant_get(v, "$.gateable", "boolean")).otherwise(~advisory).alias("gateable"),
            _number(v, "confidence").alias("confidence"),
            _text(v, "pageUrl").alias("page_url"),
        )

    good = F.filter(elements(raw), lambda v: _is_object(v) & _text(v, "code").isNotNull())
    return F.coalesce(F.transform(good, one), F.array().cast("array<struct<code:string,message:string,severity:string,source:string,gateable:boolean,confidence:double,page_url:string>>"))


def parsed_pages(raw: Column) -> Column:
    """Pages of a loose payload (JSON text); NULL for anything but an array, pages without a text URL are left out."""

    def one(v: Column) -> Column:
        code = _number(v, "statusCode")
        has = lambda k: F.when(_kind(v, "artifacts").startswith("OBJECT"), _kind(v, f"artifacts.{k}") == "STRING")
        return F.struct(
            _text(v, "url").alias("url"),
            F.coalesce(_text(v, "route"), _text(v, "url")).alias("route"),
            F.nullif(_text(v, "title"), F.lit("")).alias("title"),
            F.when(_text(v, "evidenceStatus").isin("complete", "degraded"), _text(v, "evidenceStatus")).alias("evidence_status"),
            F.when(code == F.floor(code), code.cast("int")).alias("status_code"),
            has("screenshotUrl").alias("screenshot"),
            has("domSnapshotUrl").alias("dom"),
            has("axTreeUrl").alias("ax_tree"),
        )

    return F.transform(F.filter(elements(raw), lambda v: _is_object(v) & _text(v, "url").isNotNull()), one)
