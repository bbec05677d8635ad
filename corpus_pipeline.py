"""A corpus pipeline of four of the operators: language, near duplicates, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.llm import jaccard, language, mixing, packing
from loomtable.llm.common import table, work_dir, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that the operator rejects (no text, or no letter in it) go."""
    model = language.train(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return language.identify(rows, model).where("lang_pred != 'und'").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    return packing.pack(docs)


STAGES = [("language_id", keep_languages), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't express the language model: tests hold each stage against its operator, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    path = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
