"""Corpus preparation as five stages over ``documents``.

``STAGES`` holds ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns the rows it
keeps with the columns of ``docs``, the last one the encoded documents. Every stage works on all
rows the one before it kept and is written as Parquet and read back. Classifiers learn from the rows
they are given. Rows with null texts have no letters and go in the first stage; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wartalens.llm import bpe, decontaminate, language_id, minhash_dedup, queries, toxicity
from wartalens.llm.common import read
from wartalens.session import stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter go."""
    return language_id.keep_languages(docs, language_id.fit(language_id.learnable(docs)))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return minhash_dedup.keep_one(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document left."""
    return queries.bpe_digests(bpe.encode_decode(docs, queries.byte_bpe()))


STAGES = [
    ("language", languages), ("toxicity", civil), ("near_duplicates", distinct), ("contamination", untested), ("bpe", encoded),
]
#: Language profiles, nearest examples and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
