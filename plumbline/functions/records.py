"""Rows as JSON records: what is absent has no key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Times of records: UTC, milliseconds.
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def record(**fields: Column) -> Column:
    """JSON text of the fields in the given order; keys of NULLs are left out, at every depth, arrays keep their NULLs.

    Timestamps are written in ISO form with milliseconds. A record without any value is ``{}``.
    """
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "true", "timestampFormat": ISO, "timestampNTZFormat": ISO})


def camel(name: str) -> str:
    """A column's name as a record's key."""
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def table_record(columns: list[str]) -> Column:
    """A record of a table's columns by their names in camel case."""
    return record(**{camel(c): F.col(f"`{c}`") for c in columns})
