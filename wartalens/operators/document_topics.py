"""Document-topic operators on ``theta(doc_id, theta array<double>)``, index = topic id.

The distribution stays in one row per document, so ranking, argmax and entropy need no
shuffle, and corpus figures are map-side combined sums over topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column, explode_rows, let


def ranked_topics(theta: Column | str) -> Column:
    """Array of ``struct(topic_id, prob)``, likeliest first, ties by id."""
    keyed = F.transform(as_column(theta), lambda p, i: F.struct((-p).alias("order"), i.alias("topic_id"), p.alias("prob")))
    return F.transform(
        F.array_sort(keyed), lambda x: F.struct(x["topic_id"].alias("topic_id"), x["prob"].alias("prob"))
    )


def score_table(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Full distribution per document, long form, with rank from 1."""
    return explode_rows(theta, [key], ranked_topics("theta"), "x", "pos").select(
        key, (F.col("pos") + 1).alias("rank"), F.col("x.topic_id").alias("topic_id"), F.col("x.prob").alias("prob")
    )


def topn_topics(theta: DataFrame, topn: int = 3, min_prob: float = 0.01, key: str = "doc_id") -> DataFrame:
    """``topn`` topics per document; probabilities below ``min_prob`` are absent."""
    return score_table(theta, key).filter((F.col("rank") <= topn) & (F.col("prob") >= min_prob))


def top_distribution(theta: DataFrame, topn: int = 8, key: str = "doc_id") -> DataFrame:
    return score_table(theta, key).filter(F.col("rank") <= topn).select(
        key, "rank", F.concat(F.lit("Topik "), (F.col("topic_id") + 1).cast("string")).alias("label"), "prob"
    )


def topic_ranking_table(theta: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ranking, 1-based label, probability (4 places), percent (2 places), keywords."""
    table = score_table(theta, key).join(F.broadcast(keywords), "topic_id")   # one row per topic
    return table.select(
        key,
        F.col("rank").alias("ranking"),
        F.concat(F.lit("Topik "), (F.col("topic_id") + 1).cast("string")).alias("label"),
        F.format_string("%.4f", "prob").alias("probability"),
        F.format_string("%.2f%%", F.col("prob") * 100).alias("percent"),
        "keywords",
    )


def confidence_band(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Top probability in percent, and its quarter."""
    scored = theta.select(key, (F.array_max("theta") * 100).alias("confidence"))
    band = (
        F.when(F.col("confidence") < 25, "0-25").when(F.col("confidence") < 50, "25-50")
        .when(F.col("confidence") < 75, "50-75").otherwise("75-100")
    )
    return scored.select(key, "confidence", band.alias("band"))


def article_summary(docs: DataFrame, theta: DataFrame, text: str = "content", tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Raw words, processed tokens, dominant topic (1-based label) and its confidence in percent."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))
    measured = docs.select(key, words.alias("n_words"), F.size(tokens).alias("n_tokens"))
    top = theta.select(
        key,
        F.concat(F.lit("Topik "), F.array_position("theta", F.array_max("theta")).cast("string")).alias("dominant"),
        (F.array_max("theta") * 100).alias("confidence"),
    )
    return measured.join(top, key)


def dominant_topic(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Likeliest topic per document; ties go to the lowest id."""
    return theta.select(
        key,
        (F.array_position("theta", F.array_max("theta")) - 1).cast("int").alias("topic_id"),
        F.array_max("theta").alias("prob"),
    )


def document_entropy(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entropy in bits of every document's distribution; zero entries add nothing."""
    bits = F.aggregate(
        "theta", F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    return theta.select(key, bits.alias("entropy"))


def entropy_summary(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    return document_entropy(theta, key).agg(
        F.avg("entropy").alias("avg_topic_concentration"),
        F.stddev_pop("entropy").alias("std_topic_concentration"),
    )


def dominant_topic_counts(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents and percent per dominant topic."""
    total = theta.select(F.count("*")).scalar()
    counts = dominant_topic(theta, key).groupBy("topic_id").agg(F.count("*").alias("document_count"))
    return counts.withColumn("percentage", F.col("document_count") / total * 100)


def topic_prevalence(theta: DataFrame, topn: int = 5, key: str = "doc_id") -> DataFrame:
    return dominant_topic_counts(theta, key).orderBy(F.desc("document_count"), "topic_id").limit(topn)


def avg_topic_probability(theta: DataFrame) -> DataFrame:
    """Mean and population deviation of theta per topic."""
    return theta.select(F.posexplode("theta").alias("topic_id", "prob")).groupBy("topic_id").agg(
        F.avg("prob").alias("avg_probability"), F.stddev_pop("prob").alias("std_probability")
    )


def active_topics(theta: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Topics whose mean probability exceeds each threshold."""
    means = avg_topic_probability(theta)
    counts = means.agg(*[F.count_if(F.col("avg_probability") > t).alias(f"over_{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"over_{i}").alias("active_topics")) for i, t in enumerate(thresholds)
    ])
    return counts.select(F.inline(rows))


def temporal_topic_trends(
    theta: DataFrame, dates: DataFrame, n_topics: int, key: str = "doc_id", released: str = "released"
) -> DataFrame:
    """Months by dominant topic (columns ``topic_0`` ...), joined on the document key; gaps are 0."""
    dated = dominant_topic(theta, key).join(
        dates.filter(F.col(released).isNotNull()).select(key, F.date_format(released, "yyyy-MM").alias("month")), key
    )
    return dated.groupBy("month").agg(*[
        F.count_if(F.col("topic_id") == k).alias(f"topic_{k}") for k in range(n_topics)
    ])


def document_top_words(
    docs: DataFrame, topn: int = 30, min_tokens: int = 5, key: str = "doc_id", tokens: str = "tokens"
) -> DataFrame:
    """Most frequent tokens per document, ties by first occurrence; none below ``min_tokens``.

    Positions are grouped inside the row: sorting ``(token, position)`` puts repeats side
    by side, so counting needs no shuffle.
    """
    def counted(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i)["t"] != F.get(s, i - 1)["t"]),
        )
        runs = let(
            starts,
            lambda a: F.zip_with(
                a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(s))),
                lambda start, end: F.struct(
                    (start - end).alias("minus_n"), F.get(s, start)["p"].alias("p"), F.get(s, start)["t"].alias("t")
                ),
            ),
        )
        return F.slice(F.sort_array(runs), 1, topn)

    placed = F.transform(tokens, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    words = let(F.sort_array(placed), lambda s: F.when(F.size(s) >= min_tokens, counted(s)))
    return explode_rows(docs, [key], words, "x", "pos").select(
        key, (F.col("pos") + 1).alias("rank"), F.col("x.t").alias("term"), (-F.col("x.minus_n")).cast("long").alias("n")
    )
