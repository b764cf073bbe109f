"""Inter-topic view tables: proportions, saliency, relevance, topic distance.

``sizes(topic_id, weight)`` holds the token mass of each topic; ``phi`` is
``(topic_id, term, prob)``. Term frequencies follow from both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wartalens.operators.topics import topic_pairs


def topic_weights(theta: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token mass per topic: theta weighted by document length (bag-of-words size)."""
    joined = theta.select(key, "theta").join(lengths.select(key, "length"), key)
    spread_out = joined.select("length", F.posexplode("theta").alias("topic_id", "prob"))
    return spread_out.groupBy("topic_id").agg(F.sum(F.col("prob") * F.col("length")).alias("weight"))


def topic_proportions(sizes: DataFrame) -> DataFrame:
    total = sizes.select(F.sum("weight")).scalar()
    return sizes.select("topic_id", (F.col("weight") / total).alias("proportion"))


def term_frequencies(phi: DataFrame, sizes: DataFrame) -> DataFrame:
    """Model-implied frequency of every term and its share."""
    weighed = phi.join(F.broadcast(sizes), "topic_id")      # one row per topic
    terms = weighed.groupBy("term").agg(F.sum(F.col("prob") * F.col("weight")).alias("frequency"))
    total = sizes.select(F.sum("weight")).scalar()
    return terms.select("term", "frequency", (F.col("frequency") / total).alias("p_term"))


def term_saliency(phi: DataFrame, sizes: DataFrame) -> DataFrame:
    """``p(w) * sum_t p(t|w) * log(p(t|w) / p(t))``, p(t|w) from phi's columns."""
    proportion = topic_proportions(sizes)
    by_term = Window.partitionBy("term")
    shares = phi.filter("prob > 0").withColumn("p_topic_term", F.col("prob") / F.sum("prob").over(by_term))
    distinct = (
        shares.join(F.broadcast(proportion), "topic_id")    # one row per topic
        .groupBy("term")
        .agg(F.sum(F.col("p_topic_term") * F.log(F.col("p_topic_term") / F.col("proportion"))).alias("distinctiveness"))
    )
    return term_frequencies(phi, sizes).join(distinct, "term").select(
        "term", "frequency", "distinctiveness", (F.col("p_term") * F.col("distinctiveness")).alias("saliency")
    )


def term_relevance(phi: DataFrame, sizes: DataFrame, lam: float = 0.6, topn: int = 30) -> DataFrame:
    """``lam * log(phi) + (1 - lam) * log(phi / p(w))``: the ``topn`` most relevant terms per topic."""
    scored = (
        phi.filter("prob > 0").join(term_frequencies(phi, sizes), "term")
        .withColumn("relevance", F.lit(lam) * F.log("prob") + F.lit(1 - lam) * F.log(F.col("prob") / F.col("p_term")))
    )
    ranked = Window.partitionBy("topic_id").orderBy(F.desc("relevance"), "term")
    return (
        scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= topn)
        .select("topic_id", "rank", "term", "relevance")
    )


def topic_distance(phi: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (nats) for topic pairs ``topic_a < topic_b``.

    A term that only one topic has adds ``p / 2 * log 2``, so the sum over common terms
    plus the mass outside them needs no outer join.
    """
    left = phi.filter("prob > 0").select("term", F.col("topic_id").alias("topic_a"), F.col("prob").alias("p"))
    right = phi.filter("prob > 0").select("term", F.col("topic_id").alias("topic_b"), F.col("prob").alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    common = (
        left.join(right, "term").filter("topic_a < topic_b")
        .groupBy("topic_a", "topic_b")
        .agg(
            F.sum((F.col("p") * F.log(F.col("p") / middle) + F.col("q") * F.log(F.col("q") / middle)) / 2).alias("js"),
            F.sum(F.col("p") + F.col("q")).alias("mass"),
        )
    )
    mass = phi.groupBy("topic_id").agg(F.sum("prob").alias("m"))
    outside = F.col("x_a") + F.col("x_b") - F.coalesce("mass", F.lit(0.0))
    return topic_pairs(mass, "m").join(common, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b",
        (F.coalesce("js", F.lit(0.0)) + outside * F.log(F.lit(2.0)) / 2).alias("distance"),
    )
