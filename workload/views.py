"""Spark views the check queries start from, all derived from the given tables."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wartalens.operators.dictionary import build_dictionary, doc2bow
from wartalens.operators.preprocess import preprocess_documents
from wartalens.session import spread, stage
from wartalens.sources.stopwords import build_stopwords

# Frequent words of the test languages, on top of the built-in lists.
EXTRA_STOPWORDS = (
    "the and of to in is that for it as was with be by on not he are this or at from his had they you which one "
    "de la le les des et un une du en que qui dans pour est pas sur au par plus avec se aux "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los las del se con una por para su al lo como mas pero sus"
).split()
STOPWORDS = build_stopwords(EXTRA_STOPWORDS)

LEAD_IN = "JAKARTA, KOMPAS.com – "
LEAD_OUT = " pukul 21.30 WIB &nbsp;<br> http://a.b/c?d=1"
DETIK_IN = "detikcom - "
DETIK_OUT = " Rapat​kerja 😀🎉 10-05 wib &amp; www.contoh.id/x?y=2 memperjuangkan Straße"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from ``documents``: every row, with news artefacts and missing values worked in."""
    text, doc = F.col("text"), F.col("doc_id")
    content = (
        F.when(doc % 97 == 0, F.lit(None))
        .when(doc % 3 == 0, F.concat(F.lit(LEAD_IN), text, F.lit(LEAD_OUT)))
        .when(doc % 3 == 1, F.concat(F.lit(DETIK_IN), text, F.lit(DETIK_OUT)))
        .otherwise(text)
    )
    released = F.when(doc % 83 == 0, "n/a").otherwise(
        F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), (doc % 61).cast("int")), "yyyy-MM-dd")
    )
    return spread(read(spark, sf_dir, "documents"), "doc_id").select(
        doc.alias("article_id"),
        F.col("source").alias("portal"),
        F.concat(F.lit("Artikel "), doc.cast("string")).alias("title"),
        F.try_to_timestamp(released).alias("released"),
        F.when(doc % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://x.example/"), F.md5("text"))).alias("url"),
        content.alias("content"),
        F.when(doc % 89 == 0, F.lit(None)).otherwise(F.col("n_chars")).cast("int").alias("content_len"),
        "lang",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, content, tokens)``."""
    return preprocess_documents(articles(spark, sf_dir), STOPWORDS, keep=["lang", "content"])


def staged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table, written once for queries that read it several times."""
    return stage(docs(spark, sf_dir).drop("content"), "tokens")


def languages(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = read(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()
    return [row["lang"] for row in rows]


class Surrogate:
    """Deterministic topic model: one topic per language, word shares within it.

    ``phi`` is the share of a vocabulary word among the vocabulary words of the language,
    ``theta`` is proportional to the sum of tf * phi over a document.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = staged_docs(spark, sf_dir)
        self.languages = languages(spark, sf_dir)
        self.vocab = stage(build_dictionary(self.docs), "vocab")

    @property
    def n_topics(self) -> int:
        return len(self.languages)

    @property
    def bow(self) -> DataFrame:
        return doc2bow(self.docs, self.vocab)

    @cached_property
    def phi_wide(self) -> DataFrame:
        """``(term_id, term, cells array<double>)``: one entry per language."""
        counts = doc2bow(self.docs, self.vocab, key="lang", together=True)
        per_term = counts.groupBy("term_id", "term").agg(*[
            F.sum(F.when(F.col("lang") == lang, F.col("tf")).otherwise(0)).alias(f"n{i}")
            for i, lang in enumerate(self.languages)
        ])
        per_term = stage(per_term, "phi")
        totals = {
            i: per_term.select(F.sum(f"n{i}")).scalar() for i in range(self.n_topics)
        }
        return per_term.select("term_id", "term", F.array(*[F.try_divide(f"n{i}", totals[i]) for i in range(self.n_topics)]).alias("cells"))

    @cached_property
    def phi(self) -> DataFrame:
        long = self.phi_wide.select("term", F.posexplode("cells").alias("topic_id", "prob"))
        return stage(long.filter("prob > 0").select("topic_id", "term", "prob"), "phi")

    @property
    def weights(self) -> DataFrame:
        """``(doc_id, length, w0, w1, ...)``: vocabulary words of a document and its sums of tf * phi."""
        joined = self.bow.select("doc_id", "term_id", "tf").join(self.phi_wide.select("term_id", "cells"), "term_id")
        return joined.groupBy("doc_id").agg(F.sum("tf").alias("length"), *[
            F.sum(F.col("tf") * F.get("cells", F.lit(i))).alias(f"w{i}") for i in range(self.n_topics)
        ])

    def _shares(self, weights: DataFrame) -> DataFrame:
        total = sum((F.col(f"w{i}") for i in range(1, self.n_topics)), F.col("w0"))
        return weights.select(
            "doc_id", F.array(*[F.round(F.col(f"w{i}") / total, 9) for i in range(self.n_topics)]).alias("theta")
        )

    @property
    def theta(self) -> DataFrame:
        return self._shares(self.weights)

    @cached_property
    def staged_theta(self) -> DataFrame:
        return stage(self.theta, "theta")

    @cached_property
    def sizes(self) -> DataFrame:
        from wartalens.operators.relevance import topic_weights

        weights = stage(self.weights, "weights")             # every word is in phi, so they hold the lengths too
        return stage(topic_weights(self._shares(weights), weights.select("doc_id", "length")), "sizes")


def tidy(df: DataFrame) -> DataFrame:
    """Rows fit for comparison: integers as long, doubles at six places."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), " ")
        columns.append(column.alias(field.name))
    return df.select(*columns)
