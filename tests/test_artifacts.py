"""The artifact source: commits, failed attempts, pages by cursor, pruned files."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import artifacts


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(artifacts.ArtifactSource)
    return spark


def put(rows, folder, mode="append"):
    rows.write.format("artifacts").option("path", folder).mode(mode).save()


def test_artifacts_are_written_whole_and_read_back(registered, tmp_path):
    spark, folder = registered, str(tmp_path / "store")
    rows = spark.range(50).select(F.format_string("runs/%03d/page é.png", "id").alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartition(4)
    put(rows, folder)
    put(spark.createDataFrame([("runs/007/page é.png", b"new"), ("empty", None)], "path string, content binary"), folder)
    wanted = spark.createDataFrame([("runs/007/page é.png",), ("runs/008/page é.png",), ("empty",), ("gone",)], "path string")
    got = {r.path: (r.status, None if r.content is None else bytes(r.content)) for r in artifacts.fetch_artifacts(spark, folder, wanted).collect()}
    assert got == {"runs/007/page é.png": ("ok", b"new"), "runs/008/page é.png": ("ok", b"8"), "empty": ("ok", b""), "gone": ("pruned", None)}
    for f in glob.glob(f"{folder}/data/*/*/runs%2F008*"):  # pruned from outside
        os.remove(f)
    assert artifacts.fetch_artifacts(spark, folder, wanted).filter("path = 'runs/008/page é.png'").first().status == "pruned"
    put(spark.createDataFrame([("only", b"x")], "path string, content binary"), folder, "overwrite")
    assert [r.path for r in spark.read.format("artifacts").option("path", folder).load().collect()] == ["only"]


def test_a_failed_write_leaves_nothing_that_is_listed(registered, tmp_path):
    spark, folder = registered, str(tmp_path / "store")
    put(spark.createDataFrame([("kept", b"1")], "path string, content binary"), folder)
    bad = spark.createDataFrame([(f"f{k}", b"x") for k in range(20)] + [("../out", b"x")], "path string, content binary").repartition(3)
    with pytest.raises(Exception, match="below its folder"):
        put(bad, folder)
    assert [r.path for r in spark.read.format("artifacts").option("path", folder).load().collect()] == ["kept"]
    assert not os.path.exists(tmp_path / "out") and not glob.glob(f"{folder}/../out")


def test_pages_by_cursor_and_cutoff(registered, tmp_path):
    spark, folder = registered, str(tmp_path / "store")
    assert artifacts.artifact_page(spark, folder).count() == 0
    put(spark.range(25).select(F.format_string("f%02d", "id").alias("path"), F.lit(b"abc").alias("content")).repartition(3), folder)
    put(spark.createDataFrame([("f03", b"again")], "path string, content binary"), folder)
    pages, cursor = [], ""
    while True:
        rows = artifacts.artifact_page(spark, folder, cursor, 10).collect()
        if not rows:
            break
        pages.append([r.path for r in rows])
        cursor = rows[-1].path
    assert [len(p) for p in pages] == [10, 10, 5] and sum(pages, []) == [f"f{k:02d}" for k in range(25)]
    assert artifacts.artifact_page(spark, folder, "f02", 1).first().size == 5
    assert artifacts.artifact_page(spark, folder, before="2020-01-01T00:00:00").count() == 0
    assert artifacts.artifact_page(spark, folder, before="2999-01-01T00:00:00").count() == 25
