"""Dictionary (document frequency pruning) and bag of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wartalens.functions.arrays import run_counter
from wartalens.functions.batches import slicer
from wartalens.operators.ranges import running_sum
from wartalens.session import stage

KEEP_N = 100_000


def doc_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Documents (df) and occurrences (cf) per term.

    Both are summed over slices of documents before the one aggregation, so a word costs a row for each slice
    that holds it, not for each document.
    """
    cut, count = slicer(), run_counter()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                terms, _, numbers, counts = count(part.column(0))
                df = np.bincount(numbers, minlength=len(terms))
                cf = np.bincount(numbers, counts, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(cf)], ["term", "df", "cf"])

    counted = docs.select(tokens).mapInArrow(sums, "term string, df long, cf long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def filter_extremes(
    frequencies: DataFrame,
    n_docs,
    no_below: int = 12,
    no_above: float = 0.5,
    keep_n: int = KEEP_N,
) -> DataFrame:
    """Terms in ``no_below .. no_above * n_docs`` documents, the ``keep_n`` most frequent, ids from 0.

    ``n_docs`` is a number or a scalar column. Counts per document frequency tell the least frequency
    that is needed; terms from there on are numbered by ranges (:func:`running_sum`), so no task sorts
    or holds the vocabulary. The frequencies are few: their number grows with the root of all
    occurrences, and only they meet in one task.
    """
    upper = F.floor(F.lit(no_above) * (F.lit(n_docs) if isinstance(n_docs, (int, float)) else n_docs))
    known = stage(frequencies.filter((F.col("df") >= no_below) & (F.col("df") <= upper)), "frequencies")
    above = F.sum("n").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, -1))
    per_frequency = known.groupBy("df").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(above, F.lit(0)))
    least = per_frequency.filter(F.col("above") < keep_n).agg(F.min("df")).first()[0]
    needed = known.filter(F.col("df") >= F.lit(least).cast("long"))
    numbered = running_sum(needed, [F.desc("df"), F.col("term")], F.lit(1), "term_id")
    return numbered.filter(F.col("term_id") < keep_n).select("term_id", "term", "df", "cf")


def build_dictionary(
    docs: DataFrame,
    no_below: int = 12,
    no_above: float = 0.5,
    keep_n: int = KEEP_N,
    tokens: str = "tokens",
) -> DataFrame:
    n_docs = docs.select(F.count("*")).scalar()
    return filter_extremes(doc_frequency(docs, tokens), n_docs, no_below, no_above, keep_n)


def doc2bow(
    docs: DataFrame, vocab: DataFrame, key: str = "doc_id", tokens: str = "tokens", together: bool = False
) -> DataFrame:
    """``(doc_id, term_id, term, tf)``; words outside the vocabulary are dropped.

    Counting happens within a document, so the only join is with the vocabulary. Its row bound
    (``keep_n``, or its stored size) tells Spark whether to broadcast it. ``together`` counts documents of one
    key (a number or a text) in a slice as one, for keys that many documents share: a row for each slice, key and term.
    """
    cut, count = slicer(), run_counter()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                keys, groups = part.column(0), None
                if together:
                    coded = keys.dictionary_encode(null_encoding="encode")
                    keys, groups = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                terms, rows, numbers, counts = count(part.column(1), groups)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), terms.take(pa.array(numbers)), pa.array(counts, pa.int64())], ["key", "term", "tf"])

    rows = docs.select(F.col(key).alias("key"), tokens)
    schema = T.StructType([rows.schema["key"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    counted = rows.mapInArrow(runs, schema).withColumnRenamed("key", key)
    return counted.join(vocab.select("term", "term_id"), "term").select(key, "term_id", "term", "tf")


def vocabulary_terms(vocab: DataFrame) -> list[str]:
    """Terms in id order on the driver: at most ``keep_n`` strings."""
    return [row["term"] for row in vocab.orderBy("term_id").select("term").collect()]


def bow_vectors(
    docs: DataFrame, terms: list[str], tokens: str = "tokens", features: str = "features"
) -> DataFrame:
    """Sparse count vectors whose indices are the dictionary ids."""
    model = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol=features)
    return model.transform(docs)
