"""From raw documents to packed training sequences: five stages, each over all the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelyard.llm import bloom_lines, config_packing, poisson_mix, robust_quality, token_groups
from labelyard.llm.entries import tokenizer_path
from labelyard.sizing import workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this percentage of their shingles of so many words at least.
NEAR_WORDS, NEAR_THRESHOLD = 5, 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return robust_quality.judged(docs, COLUMNS).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; every document stays."""
    kept = bloom_lines.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return token_groups.one_of_each(docs, NEAR_WORDS, NEAR_THRESHOLD).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come several times or not at all."""
    return poisson_mix.replicate(docs, poisson_mix.source_rates(docs)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens and their places in sequences; repeated documents are packed one by one."""
    return config_packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing),
]

#: Robust estimates and token packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is stored and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{workspace(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
