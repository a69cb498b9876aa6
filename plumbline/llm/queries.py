"""Registered corpus queries (``op<N>_<name>``) and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import bpe_digests
from plumbline.llm.chat import rotate_perspectives
from plumbline.llm.fingerprints import fingerprints
from plumbline.llm.langid import fold, learn_profiles, predict_language
from plumbline.llm.licenses import scan_licenses
from plumbline.llm.mixing import mix_sources
from plumbline.llm.mtree import mtree_top_k
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.periods import planted, run_digests
from plumbline.llm.quality import fit_quality, score_quality
from plumbline.llm.repair import damaged, repair_digests
from plumbline.llm.substring_dedup import remove_repeats
from plumbline.llm.warc import archive_pages
from plumbline.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    return predict_language(docs, learn_profiles(docs.filter(~held_out)), held_out)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return fingerprints(read_table(spark, sf_dir, "documents")).select(*names)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out), held_out)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return run_digests(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return repair_digests(damaged(turns), turns)


def queries() -> dict[str, Query]:
    found = [
        op1_bpe,
        op2_language_id,
        op3_near_duplicates,
        op4_fingerprints,
        op5_quality,
        op6_warc,
        op7_chat,
        op8_mixing,
        op9_substring_dedup,
        op10_top_k,
        op11_licenses,
        op12_periodic_runs,
        op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from plumbline.llm.oracles import ORACLES

    return dict(ORACLES)
