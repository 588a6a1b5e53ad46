"""A training corpus from raw documents: quality rules, line dedup, near dedup, redaction, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of
documents, the last one the packed pieces. n_chars follows the text. Repeated rows, nulls and empty
tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kickline.llm import ann, bpe, fim, line_dedup, near_dedup, packing, pii, prefix_trie, quality, substring_dedup, topk, toxicity, url_filter  # noqa: F401  registers every query
from kickline.session import scratch_path, ship


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars as long as the text where there is one."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are depleted go; the others lose their host's boilerplate lines."""
    ship(spark)
    return _counted(quality.judge(docs).filter("_kept").withColumn("text", F.col("_clean")), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; documents stay, even without a line."""
    ship(spark)
    return _counted(line_dedup.drop_frequent_lines(docs), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    ship(spark)
    verdict = near_dedup.near_duplicates(docs)
    drop = verdict.filter("NOT kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship(spark)
    return _counted(pii.redact(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs, **packing.vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("best_fit_packing", packing_stage)]

#: Near dedup, boosted trees and byte-pair encoding have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(ship(spark), f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
