"""The corpus pipeline: STAGES over `documents`, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept; all but the last return the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, mixing, simhash, token_files, toxicity
from lodestone.llm import textops as tx


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold; learnt from all labels of the input rows."""
    return toxicity.clean(docs, tx.read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, tx.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row per document and copy, read back from them."""
    return token_files.token_files(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("token_files", write_tokens)]
ORACLE_SQL = None  # trained scores, latent search and tokens are beyond SQL: tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tx.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tx.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
