"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing, SentencePiece samples.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logweave.llm.mixing import repeat_rows
from logweave.llm.quality_perplexity import keep_good
from logweave.llm.secret_scan import redact_live
from logweave.llm.simhash_dedup import keep_one
from logweave.llm.sp_sampling import sample_segmentations


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity bands or the base rules reject go. Null and blank texts go; null ids and repeated rows are judged like others; an empty table stays empty."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity 0.8 or more) stays: the first by id, those without an id last. A repeated row stays once, blank texts are one group; an empty table stays empty."""
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked; widely copied examples stay. Every row comes back, null texts as they are."""
    return redact_live(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their Poisson counts say, in a shuffled order. Null sources are one source; equal rows draw equal counts; an empty table stays empty."""
    return repeat_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document, as piece ids. A null or empty text has one, without pieces."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", source_mixing),
    ("sentencepiece sampling", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
