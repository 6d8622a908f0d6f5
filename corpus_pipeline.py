"""Corpus preparation in four stages, each of which works on all that its predecessor kept.

quality rules: rejected documents go. near-duplicates: of each group of linked SimHash fingerprints the
document with the smallest id stays. repeats: bytes under 200-byte strings that occur elsewhere go from the
texts; no document goes. packing: one row per piece of a document in its sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyad.llm import packing, quality, simhash, suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packed)]

#: No SQL: the stages tokenise, and link by reachability; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
