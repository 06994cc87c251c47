"""From raw documents to packed training sequences.

``STAGES`` are functions of (spark, docs, sf_dir). Each works on all that its predecessor kept and returns a DataFrame
with the columns of ``documents``; the last returns the packed pieces. ``run`` writes each result as Parquet to the
shared folder and reads it again for the next stage, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from donorlake.llm import mixing, ngram_join, packing, personal_data, quality_rules
from donorlake.llm.common import shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the names of their kinds; n_chars follows the text."""
    clean = personal_data.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; a document that is taken more than once is there as often."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the mix with their places in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram join", one_of_each_group),
    ("personal data", without_personal_data),
    ("source mix", mixed_sources),
    ("packing", packed),
]

#: Tokens come from a vocabulary that SQL has no functions for; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
