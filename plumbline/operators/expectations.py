"""Expectations that a write checks on its way: counts by observation, broken rows in quarantine, one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.operators.steps import MAX_PAYLOAD, steps_problem
from plumbline.session import Workspace


def steps_rules(steps: str = "steps") -> dict[str, Column]:
    """Stored steps are an array of valid steps within their caps."""
    problem = steps_problem(F.col(steps))
    return {"steps_shape": F.coalesce(problem != "not_an_array", F.lit(True)), "steps_caps": F.coalesce(~problem.isin("too_many_steps", "too_large"), F.lit(True)), "steps_valid": problem.isNull()}


def body_rules(body: str = "body") -> dict[str, Column]:
    """A request's body is a JSON object of bounded size with a journey and an environment."""
    value = F.try_parse_json(F.col(body))
    text = lambda f: F.coalesce(F.length(F.trim(F.try_variant_get(value, f"$.{f}", "string"))) > 0, F.lit(False))
    return {"body_size": F.coalesce(F.octet_length(body) <= MAX_PAYLOAD, F.lit(False)), "body_object": F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), "body_journey": text("journeyId"), "body_environment": text("environment")}


def write_checked(df: DataFrame, rules: dict[str, Column], name: str = "rows") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write ``df`` once: rows that keep all rules, rows that break some (with ``broken``, their names), and violations per rule.

    Counts come from the write itself (``DataFrame.observe``), so the rows are read once and each
    rule is worked out once. A rule that is NULL passes, as in a CHECK. Both tables are one in the shared folder, told apart
    by a column: a write to two partitions would sort all of a task's rows first, and hold them.
    """
    ws = Workspace(df.sparkSession, "expectations")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.coalesce(~c, F.lit(False)).alias(f"rule_{k}") for k, c in enumerate(rules.values())])
    broken = F.array_compact(F.array(*[F.when(F.col(f"rule_{k}"), rule) for k, rule in enumerate(rules)]))
    seen = Observation(name)
    row = row.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.col(f"rule_{k}")).alias(f"rule_{k}") for k in range(len(rules))])
    where = ws.path(name)
    out = row.select("row", broken.alias("broken")).withColumn("quarantined", F.size("broken") > 0)
    out.write.parquet(where)
    told = seen.get
    stored = df.sparkSession.read.schema(out.schema).parquet(where)
    kept = stored.filter(~F.col("quarantined")).select("row.*")
    held = stored.filter("quarantined").select("row.*", "broken")
    return kept, held, {"rows": told["rows"], **{rule: told[f"rule_{k}"] for k, rule in enumerate(rules)}}
