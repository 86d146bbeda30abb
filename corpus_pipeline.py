"""From documents to packed sequences: each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditmill.llm import exact_dedup, mixture, packing, quality, simhash
from creditmill.llm.common import table
from creditmill.session import drop_table, new_table_path, passing_tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes twice are there twice."""
    return mixture.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixture", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot state SimHash groups and tokenized sequences; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote on its way, and its input, are deleted once its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_table_path(spark, f"llm-{name.replace(' ', '-')}")
        with passing_tables(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if last:
            drop_table(spark, last)
        docs, last = spark.read.schema(result.schema).parquet(path), path
    return docs
