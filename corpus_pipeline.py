"""A training corpus from ``documents``: five stages, each written and read again as the next one's input.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name but those that begin with ``__veil``; all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import common, decontaminate, langid, mixing, sharding, simhash


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language claims stay; texts that are null, without a letter, or claimed by none go.

    Repeated rows are judged alike. Where no row has a language to learn from, nothing is claimed and nothing stays.
    """
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0
    return langid.keep_known(docs, train)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, of its repeats one row.

    Null and empty texts are one group; a null id stays only where its group has no other.
    """
    return simhash.drop_near_duplicates(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark text go, repeated rows alike; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics.

    Rows of one id share a draw. Null sources are one source, null or unlisted languages share a target, and null texts
    count no tokens.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot and shard, by its id; null ids share one. Columns of these two names are replaced."""
    return sharding.place(docs)


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Language identification and SimHash groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
