"""The corpus pipeline: ordered stages, each a corpus operator whose decisions take effect.

Every stage but the last returns the columns of its input; rows with a null doc_id pass every
filter that needs an id. Stages handle nulls, empty and very long texts, ties, repeated rows and
empty tables as their operators do; further columns of any name keep their values.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import bpe_digests
from plumbline.llm.common import fits_broadcast, ids_only
from plumbline.llm.langid import fold
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.quality import fit_quality, quality_mask
from plumbline.llm.substring_dedup import with_repeats_cut
from plumbline.session import Workspace
from plumbline.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from the labelled documents in its input."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return docs.mapInArrow(quality_mask(model), docs.schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    ws = Workspace(spark, "pipeline-near")
    gone = ws.save(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return ids_only(docs, gone, "doc_id", gone.count(), keep=False)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat from a document with a smaller doc_id; n_chars follows the text."""
    cut = with_repeats_cut(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files and the rows in them follow mix_slot.

    The columns travel in a struct, so that columns named like the operator's own keep their values.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source")
    return mix_sources(rows).sort("mix_slot", "mix_block", "doc_id").select("row.*")


def with_place(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): place is the number of a row in the order of a written table's files and their rows.

    Spark packs files by size, so only the numbers in the files' names and the rows' numbers in the files tell the
    order in which a table was written. The window has a row per file. A frame without files is
    written first. Input columns of any name, ``_metadata`` and ``place`` among them, play no part.
    """
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["row_index"])
    except AnalysisException:
        docs = Workspace(docs.sparkSession, "pipeline-place").save(docs, "docs")
        file = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", file["file_name"].alias("file"), file["row_index"].alias("row"))
    number = [F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    before = F.sum("n").over(Window.orderBy(*number, "file").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("start"))
    starts = Workspace(docs.sparkSession, "pipeline-starts").save(starts, "starts")
    starts = F.broadcast(starts) if fits_broadcast(starts, starts.count()) else starts
    return rows.join(starts, "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("place"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents' ids and of the decoded texts, and each row's place in the mixture.

    ``place`` counts from 0 in the order of the input's files and rows, which the mixing stage sets.
    """
    return bpe_digests(with_place(docs), carry=["place"])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The quality stage cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each stage's result written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, name)
    return docs
