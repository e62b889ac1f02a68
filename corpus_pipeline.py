"""A corpus from raw text to packed training sequences.

Stages: language identification (documents that it rejects go), exact dedup, MinHash
near dedup (one document of each group stays), benchmark decontamination, packing.
Every stage takes all documents its predecessor kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.llm.common import importable, stored
from creditledger.llm.decontaminate import drop_contaminated
from creditledger.llm.exact import drop_exact_copies
from creditledger.llm.language import drop_rejected
from creditledger.llm.minhash import drop_near_copies
from creditledger.llm.packing import pack
from creditledger.llm.queries import tokenizer_file

#: Near duplicates share so many percent of their five-word shingles.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return drop_near_copies(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, without its ids: they follow from the text, start and length."""
    importable(spark)
    return pack(docs, tokenizer_file()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language identification and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
