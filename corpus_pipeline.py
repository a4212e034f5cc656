"""A training-corpus pipeline of five stages over `documents`; each stage's rows are written and read again
as the next one's input. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import bpe, jaccard, language, linededup, mixing
from lacuna.llm.common import cut
from lacuna.llm.queries import tokenizer


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null, no letters, or near no language's profile)."""
    return language.keep_known(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines, the first stays; a document none of whose lines stays goes."""
    return linededup.keep_first_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard.dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once or twice."""
    return mixing.take(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text."""
    return bpe.bpe_stream(docs, tokenizer("word_bpe_49k.json"), outputs=("ids",))


STAGES = [("language", language_stage), ("lines", line_stage), ("near duplicates", near_stage), ("mix", mix_stage), ("tokens", token_stage)]

#: Profiles, SimHash groups and byte-pair merging can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
