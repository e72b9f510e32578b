"""A corpus pipeline of five stages over the documents of a folder of Parquet tables.

Every stage takes the documents that the one before it kept, and is written to
the shared folder and read again. All but the last return the columns of the
documents; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm import decontaminate, language, line_dedup, packing, simhash
from seepage.session import settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language the network cannot tell, go."""
    return language.accepted(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines of 50 words or more go, and documents of which nothing is left."""
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays: fingerprints of three-word shingles, three bits apart at most."""
    return simhash.first_copies(docs, words=3, distance=3)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packing_by_retrieval(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens, filled by the lexical neighbours of their seeds."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=True)


STAGES = [
    ("language_id", language_id), ("line_repeats", line_repeats), ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages), ("packing", packing_by_retrieval),
]

#: The network's labels, the fingerprints' hash and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; the packed pieces, with the crc32 of their ids as bytes in the ids' place."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "bytes_crc32")
