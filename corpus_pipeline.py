"""The corpus pipeline: quality rules, language, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written
as Parquet to the shared folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import jaccard_join, language, line_templates, packing, quality
from wardlens.llm.native import words
from wardlens.session import cut_lineage

#: Best-fit packing, estimates and profiles cannot be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told and is the stated one."""
    return language.in_stated_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that consist of such lines alone go."""
    return line_templates.documents_with_new_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins; a document's length is its number of words and an end mark."""
    return packing.pack(docs.select("doc_id", (F.size(words(F.col("text"))) + 1).alias("length")), "length")


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
