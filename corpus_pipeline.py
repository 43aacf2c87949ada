"""Corpus cleaning in stages: each takes what the one before it kept and gives documents on.

Stages keep every column of `documents`; the last returns token counts and hashes of what is left.
Nulls, empty texts, ties, repeated rows, empty tables and extra columns are treated as each operator
states; rows that share an id and a text are one document throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocktide.llm import decontaminate, encode, language, sentences, simhash
from stocktide.llm.common import read
from stocktide.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: a text without a letter, or mostly like no learned language, goes."""
    return language.keep_determined(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash component (four-word shingles, at most 4 differing bits)."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts sentences covered by a span that came before; a document that is nothing but repeats goes."""
    return sentences.drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of `benchmark`."""
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of what is left."""
    return encode.encode_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None  # no stage but the joins can be said in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
