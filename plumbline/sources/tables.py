"""Readers for the Parquet tables that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import lenient_json


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; projections and filters put on it reach the Parquet scan. JSON in it is read leniently."""
    lenient_json(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
