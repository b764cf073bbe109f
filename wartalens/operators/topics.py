"""Topic description and quality, on ``phi(topic_id, term, prob)``.

``phi`` has at most topics x vocabulary rows, both bounded by the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_terms(phi: DataFrame, topn: int = 20) -> DataFrame:
    """``topn`` likeliest terms per topic with rank from 1; ties by term."""
    ranked = Window.partitionBy("topic_id").orderBy(F.desc("prob"), "term")
    return (
        phi.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= topn)
        .select("topic_id", "rank", "term", "prob")
    )


def topic_keywords(phi: DataFrame, topn: int = 10, separator: str = ", ") -> DataFrame:
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return topic_terms(phi, topn).groupBy("topic_id").agg(F.array_join(in_order, separator).alias("keywords"))


def topic_diversity(phi: DataFrame, topn: int = 10) -> DataFrame:
    """Distinct terms among all top lists over ``topn`` times the number of topics."""
    return topic_terms(phi, topn).agg(
        (F.countDistinct("term") / (F.countDistinct("topic_id") * topn)).alias("topic_diversity")
    )


def topic_pairs(per_topic: DataFrame, value: str) -> DataFrame:
    """Pairs ``topic_a < topic_b`` with the value of each (``x_a``, ``x_b``); one input row per topic."""
    listed = per_topic.agg(F.sort_array(F.collect_list(F.struct("topic_id", F.col(value).alias("x")))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda one, i: F.transform(
        F.slice("all", i + 2, F.size("all")),
        lambda two: F.struct(
            one["topic_id"].alias("topic_a"), two["topic_id"].alias("topic_b"),
            one["x"].alias("x_a"), two["x"].alias("x_b"),
        ),
    )))
    return listed.select(F.inline(pairs))


def topic_similarity_pairs(phi: DataFrame) -> DataFrame:
    """Cosine of the word distributions for topic pairs ``topic_a < topic_b``."""
    norms = phi.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("prob") * F.col("prob"))).alias("norm"))
    left = phi.select("term", F.col("topic_id").alias("topic_a"), F.col("prob").alias("p"))
    right = phi.select("term", F.col("topic_id").alias("topic_b"), F.col("prob").alias("q"))
    dots = (
        left.join(right, "term").filter("topic_a < topic_b")
        .groupBy("topic_a", "topic_b").agg(F.sum(F.col("p") * F.col("q")).alias("dot"))
    )
    return topic_pairs(norms, "norm").join(dots, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b",
        (F.coalesce("dot", F.lit(0.0)) / (F.col("x_a") * F.col("x_b"))).alias("similarity"),
    )


def topic_similarity(phi: DataFrame) -> DataFrame:
    """Mean and population deviation of the pairwise cosines (0 with a single topic)."""
    return topic_similarity_pairs(phi).agg(
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("avg_topic_similarity"),
        F.coalesce(F.stddev_pop("similarity"), F.lit(0.0)).alias("std_topic_similarity"),
    )


def topic_specialization_by_topic(phi: DataFrame, topn: int = 100) -> DataFrame:
    """Entropy (bits) of the renormalised ``topn`` likeliest terms."""
    top = topic_terms(phi, topn)
    mass = F.sum("prob").over(Window.partitionBy("topic_id"))
    return (
        top.withColumn("p", F.col("prob") / mass)
        .groupBy("topic_id")
        .agg((-F.sum(F.col("p") * F.log2(F.col("p") + F.lit(1e-12)))).alias("specialization"))
    )


def topic_specialization(phi: DataFrame, topn: int = 100) -> DataFrame:
    return topic_specialization_by_topic(phi, topn).agg(
        F.avg("specialization").alias("avg_topic_specialization"),
        F.stddev_pop("specialization").alias("std_topic_specialization"),
    )


def topic_affixes(phi: DataFrame, topn: int = 10, size: int = 3) -> DataFrame:
    """Commonest prefix and suffix among the top words longer than ``size``; ties by rank."""
    words = topic_terms(phi, topn).filter(F.length("term") > size)

    def commonest(affix, name: str) -> DataFrame:
        counted = words.groupBy("topic_id", affix.alias("affix")).agg(
            F.count("*").alias("n"), F.min("rank").alias("first")
        )
        return counted.groupBy("topic_id").agg(
            F.max_by("affix", F.struct("n", (-F.col("first")).alias("early"))).alias(name)
        )

    topics = phi.select("topic_id").distinct()
    prefix = commonest(F.substring("term", 1, size), "common_prefix")
    suffix = commonest(F.right(F.col("term"), F.lit(size)), "common_suffix")
    return topics.join(prefix, "topic_id", "left").join(suffix, "topic_id", "left")


def topic_statistics(phi: DataFrame, topn: int = 20) -> DataFrame:
    """Per topic: mass of the top 5 among the top ``topn``, word lengths, entropy, three words, affixes."""
    top = topic_terms(phi, topn).withColumn(
        "p", F.col("prob") / (F.sum("prob").over(Window.partitionBy("topic_id")) + F.lit(1e-12))
    )
    first_three = F.transform(
        F.slice(F.sort_array(F.collect_list(F.struct("rank", "term"))), 1, 3), lambda x: x["term"]
    )
    stats = top.groupBy("topic_id").agg(
        F.array_join(first_three, " + ").alias("top_3_words"),
        (F.sum(F.when(F.col("rank") <= 5, F.col("prob")).otherwise(0.0)) / F.sum("prob"))
        .alias("prob_concentration_top5"),
        F.avg(F.length("term")).alias("avg_word_length"),
        F.stddev_pop(F.length("term")).alias("word_length_std"),
        F.coalesce(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))), F.lit(0.0)).alias("topic_entropy"),
    )
    return stats.join(topic_affixes(phi), "topic_id")
