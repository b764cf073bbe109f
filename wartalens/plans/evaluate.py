"""Evaluation of a stored run: all metric tables and the tidy metric list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartalens.operators import corpus_stats, document_topics, relevance, topics
from wartalens.operators.coherence import coherence_all
from wartalens.operators.dictionary import bow_vectors, doc2bow, vocabulary_terms
from wartalens.operators.lda import perplexity, phi_table, theta_table
from wartalens.operators.phrases import apply_phrases
from wartalens.operators.preprocess import preprocess_documents
from wartalens.session import stage
from wartalens.sources.tables import ModelStore

def rebuild_corpus(articles: DataFrame, store: ModelStore, key: str = "article_id") -> DataFrame:
    """Tokens of raw articles by the stored text options, stopwords and phrase tables; null content is empty."""
    words = [row["word"] for row in store.table("stopwords").collect()]
    options = store.text_options()
    docs = preprocess_documents(articles, words, key=key, protected=options["protected"], overrides=options["stem_overrides"])
    return apply_phrases(docs, store.table("bigrams"), store.table("trigrams"))


def _long(table: DataFrame) -> DataFrame:
    """One-row metric table to ``(metric, value)`` rows."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in table.columns]
    return table.select(F.inline(F.array(*cells)))


def model_metrics(docs: DataFrame, phi: DataFrame, vocab: DataFrame, extra: list[DataFrame] = ()) -> DataFrame:
    """``(metric, value)``: topics, vocabulary size, four coherences, quality figures, ``extra`` one-row tables."""
    parts = [
        phi.agg(F.countDistinct("topic_id").alias("num_topics")),
        vocab.agg(F.count("*").alias("vocabulary_size")),
        coherence_all(docs, phi),
        topics.topic_diversity(phi),
        topics.topic_similarity(phi),
        topics.topic_specialization(phi),
        *extra,
    ]
    return reduce(DataFrame.unionByName, [_long(p) for p in parts])


def evaluate(articles: DataFrame, store: ModelStore, k: int | None = None) -> dict[str, DataFrame]:
    """All evaluation tables of one stored model."""
    model, vocab, docs = store.model(k), store.table("vocab"), store.table("tokens")
    phi = stage(phi_table(model, vocab), "phi")
    vectors = bow_vectors(docs, vocabulary_terms(vocab))
    theta = stage(theta_table(model, vectors), "theta")
    lengths = doc2bow(docs, vocab).groupBy("doc_id").agg(F.sum("tf").alias("length"))
    sizes = stage(relevance.topic_weights(theta, lengths), "sizes")      # one row per topic
    return {
        "corpus_stats": corpus_stats.corpus_stats(articles),
        "portal_counts": corpus_stats.portal_counts(articles),
        "length_histogram": corpus_stats.length_histogram(articles),
        "monthly_counts": corpus_stats.monthly_counts(articles),
        "coherence_by_k": corpus_stats.coherence_by_k(store.table("coherence_report")),
        "topic_terms": topics.topic_terms(phi),
        "topic_statistics": topics.topic_statistics(phi),
        "dominant_topics": document_topics.dominant_topic_counts(theta),
        "avg_topic_probabilities": document_topics.avg_topic_probability(theta),
        "active_topics": document_topics.active_topics(theta),
        "temporal_topic_trends": document_topics.temporal_topic_trends(
            theta, articles.select(F.col("article_id").alias("doc_id"), "released"), len(
                model.estimatedDocConcentration())
        ),
        "topic_proportions": relevance.topic_proportions(sizes),
        "term_saliency": relevance.term_saliency(phi, sizes),
        "term_relevance": relevance.term_relevance(phi, sizes),
        "topic_distance": relevance.topic_distance(phi),
        "model_metrics": model_metrics(
            docs, phi, vocab, [perplexity(model, vectors), document_topics.entropy_summary(theta)]
        ),
    }
