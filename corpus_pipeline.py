"""The pipeline from documents to token ids: each stage takes what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, line_dedup, mixing, quality, simhash
from quillspark.llm.common import col, fresh, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Labels of the held-out fold are not read."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat; n_chars follows the text."""
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup(docs, lines=n_lines, dropped=n_dropped)
    return out.withColumn("n_chars", F.when(col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of at least 0.8."""
    return simhash.dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of sources, languages and topics."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and a digest of the bytes that they decode to."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_filter), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("byte_bpe", tokens)]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
