"""Functions over JSON texts: redaction, log lines, canonical form; all built in, as variants.

What a text may hold that JSON cannot: a lone surrogate becomes ``?``, a number beyond doubles the
string ``Infinity``, ``NaN`` is no JSON. Objects come back with their keys in order. Of a repeated
key the last value counts where the session says so (``plumbline.session.lenient_json``), else the text is no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of keys whose values are never told, what is told instead, the depth to which
# keys are looked at, and the keys of a log line's envelope.
SECRET_PARTS = ["token", "secret", "password", "authorization", "cookie", "credential"]
REDACTED, REDACTED_SECRET = "[redacted]", "[redacted credential]"
MAX_DEPTH = 5
ENVELOPE = ["type", "level", "ts"]
_SECRET = "(?i)" + "|".join(SECRET_PARTS)
#: Strings (with their colon, if they are keys), numbers and what lies between, of canonical JSON.
_TOKENS = r'"(?:[^"\\]|\\.)*"\s*:?|-?[0-9][0-9.eE+\-]*|[^"0-9\-]+'


def _without_secrets(value: Column, depth: int = 0) -> Column:
    """A variant with the values of secret keys replaced: one step of objects and of arrays a level."""
    if depth > MAX_DEPTH:
        return value
    replaced = F.parse_json(F.lit(f'"{REDACTED}"'))
    of_object = F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, x: F.when(k.rlike(_SECRET), replaced).otherwise(_without_secrets(x, depth + 1)))
    of_array = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _without_secrets(x, depth + 1))
    return F.coalesce(F.to_variant_object(of_object), F.to_variant_object(of_array), value)


def redact_keys(text: Column | str) -> Column:
    """JSON text in which values of keys that look secret are replaced, down to MAX_DEPTH levels; NULL for what is no JSON.

    A text without any of the words is not taken apart.
    """
    text = F.col(text) if isinstance(text, str) else text
    value = F.try_parse_json(text)
    # a letter of a key may be written as an escape
    return F.when(text.rlike(_SECRET + r"|\\u"), F.to_json(_without_secrets(value))).otherwise(F.to_json(value))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))


def redact_values(text: Column, secrets: Column) -> Column:
    """JSON text in which every string that equals one of ``secrets`` (an array) is replaced; empty and one-letter secrets are no secrets.

    Strings are replaced at any depth; keys are not. NULL for what is no JSON.
    """
    usable = F.filter(F.coalesce(secrets, F.array().cast("array<string>")), lambda s: F.coalesce(F.length(s) > 1, F.lit(False)))
    quoted = F.transform(usable, lambda s: F.regexp_replace(F.to_json(F.to_variant_object(F.array(s))), r"^\[|\]$", ""))
    told = F.transform(_tokens(F.to_json(F.try_parse_json(text))), lambda t: F.when(F.array_contains(quoted, t), f'"{REDACTED_SECRET}"').otherwise(t))
    return F.array_join(told, "")


def log_line(level: Column, kind: Column, ts: Column, fields: Column) -> Column:
    """A JSON line of an event: type, level, ts, then the redacted ``fields`` (a JSON object's text) without the envelope's keys."""
    head = F.to_json(F.struct(kind.alias("type"), level.alias("level"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts")))
    own = F.from_json(redact_keys(fields), "map<string,variant>")
    kept = F.to_json(F.map_filter(own, lambda k, _: ~k.isin(*ENVELOPE)))
    return F.when(F.coalesce(F.length(kept), F.lit(0)) > 2, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substr(kept, F.lit(2)))).otherwise(head)


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of all objects in order, no blanks and equal numbers written alike; NULL for what is no JSON."""
    number = lambda t: F.regexp_replace(F.regexp_replace(t.try_cast("double").cast("string"), r"\.0$", ""), "^-0$", "0")
    return F.array_join(F.transform(_tokens(F.to_json(F.try_parse_json(text))), lambda t: F.when(t.rlike("^-?[0-9]"), number(t)).otherwise(t)), "")
