"""From raw documents to token shards: language, near-duplicates, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before it kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontam, langid, mixing, simhash, tokenbin
from loomwork.llm.common import stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without letters or with a narrow margin go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Rows that are equal in all columns are one document; different texts under one doc_id are different ones. Rows
    without a doc_id all stay. Null and empty texts form one group. An empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontam.clean_only(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities that bring the token shares to their targets."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return tokenbin.encoded(docs, library=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can express neither dictionaries of zstandard nor byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return docs
