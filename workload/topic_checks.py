"""Topic, coherence, relevance and document-topic operators on the surrogate model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartalens.operators import coherence, corpus_stats, document_topics, relevance, topics
from wartalens.session import new_path, stage
from wartalens.sources.tables import write_tables
from workload import sql, views
from workload.registry import check


def surrogate(name, select, block=sql.PHI):
    """Register an operator over the surrogate model."""
    def register(build):
        @check(name, sql.with_(block, select))
        def _query(spark, sf):
            return build(views.Surrogate(spark, sf))

        return build

    return register


@surrogate("topic_terms", "SELECT topic_id, rank, term, round(prob, 6) AS prob FROM ranked WHERE rank <= 20")
def _topic_terms(m):
    return topics.topic_terms(m.phi)


KEYWORDS = "SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 10 GROUP BY topic_id"


@surrogate("topic_keywords", KEYWORDS)
def _topic_keywords(m):
    return topics.topic_keywords(m.phi)


def coherence_sql(value, where, width):
    block = sql.document_counts() if width is None else sql.window_counts(width)
    return sql.with_(block, f"SELECT topic_id, round(avg({value}), 6) AS coherence FROM valued WHERE {where} GROUP BY topic_id")


def coherence_check(measure, text):
    @check(f"coherence_{measure}", text)
    def _query(spark, sf):
        model = views.Surrogate(spark, sf)
        return coherence.coherence_by_topic(model.docs, model.phi, measure)


coherence_check("c_uci", coherence_sql("pmi", "rank_a <> rank_b", 10))
coherence_check("c_npmi", coherence_sql("npmi", "rank_a <> rank_b", 10))
coherence_check("u_mass", coherence_sql("ln((p_ab + 1e-12) / p_b)", "rank_b < rank_a", None))
coherence_check("c_v", sql.with_(sql.window_counts(110) + """,
summed AS (SELECT topic_id, rank_b, sum(npmi) AS w FROM valued GROUP BY ALL),
cosines AS (
  SELECT v.topic_id, v.rank_a, sum(v.npmi * s.w) / (sqrt(sum(v.npmi * v.npmi)) * sqrt(sum(s.w * s.w))) AS value
  FROM valued v JOIN summed s USING (topic_id, rank_b) GROUP BY ALL)""",
    "SELECT topic_id, round(avg(value), 6) AS coherence FROM cosines GROUP BY topic_id"))


@surrogate("topic_diversity", """
SELECT round(count(DISTINCT term) / (count(DISTINCT topic_id) * 10), 6) AS topic_diversity FROM ranked WHERE rank <= 10""")
def _diversity(m):
    return topics.topic_diversity(m.phi)


SIMILARITY = sql.PHI + """,
norms AS (SELECT topic_id, sqrt(sum(prob * prob)) AS norm FROM phi GROUP BY topic_id),
dots AS (SELECT p.topic_id AS a, q.topic_id AS b, sum(p.prob * q.prob) AS dot FROM phi p JOIN phi q USING (term)
  WHERE p.topic_id < q.topic_id GROUP BY ALL),
cosines AS (SELECT x.topic_id AS topic_a, y.topic_id AS topic_b, coalesce(dot, 0) / (x.norm * y.norm) AS similarity
  FROM norms x JOIN norms y ON x.topic_id < y.topic_id LEFT JOIN dots ON a = x.topic_id AND b = y.topic_id)"""


@surrogate("topic_similarity", """
SELECT round(avg(similarity), 6) AS avg_topic_similarity, round(stddev_pop(similarity), 6) AS std_topic_similarity
FROM cosines""", SIMILARITY)
def _similarity(m):
    return topics.topic_similarity(m.phi)


@surrogate("topic_specialization", """
SELECT round(avg(h), 6) AS avg_topic_specialization, round(stddev_pop(h), 6) AS std_topic_specialization FROM (
  SELECT topic_id, -sum(p * log2(p + 1e-12)) AS h FROM (
    SELECT topic_id, prob / sum(prob) OVER (PARTITION BY topic_id) AS p FROM ranked WHERE rank <= 100) GROUP BY topic_id)""")
def _specialization(m):
    return topics.topic_specialization(m.phi)


AFFIXES = sql.PHI + """,
affix_words AS (SELECT topic_id, rank, term FROM ranked WHERE rank <= 10 AND length(term) > 3),
prefixes AS (SELECT topic_id, affix, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, first) AS nth FROM (
  SELECT topic_id, substr(term, 1, 3) AS affix, count(*) AS n, min(rank) AS first FROM affix_words GROUP BY ALL)),
suffixes AS (SELECT topic_id, affix, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, first) AS nth FROM (
  SELECT topic_id, right(term, 3) AS affix, count(*) AS n, min(rank) AS first FROM affix_words GROUP BY ALL)),
affixes AS (SELECT t.topic_id, p.affix AS common_prefix, s.affix AS common_suffix
  FROM (SELECT DISTINCT topic_id FROM phi) t
  LEFT JOIN prefixes p ON p.topic_id = t.topic_id AND p.nth = 1
  LEFT JOIN suffixes s ON s.topic_id = t.topic_id AND s.nth = 1)"""


@surrogate("topic_affixes", "SELECT topic_id, common_prefix, common_suffix FROM affixes", AFFIXES)
def _affixes(m):
    return topics.topic_affixes(m.phi)


@surrogate("topic_statistics", """
SELECT s.*, common_prefix, common_suffix FROM (
  SELECT topic_id, string_agg(term, ' + ' ORDER BY rank) FILTER (rank <= 3) AS top_3_words,
    round(sum(prob) FILTER (rank <= 5) / sum(prob), 6) AS prob_concentration_top5,
    round(avg(length(term)), 6) AS avg_word_length, round(stddev_pop(length(term)), 6) AS word_length_std,
    round(-sum(p * log2(p)), 6) AS topic_entropy
  FROM (SELECT *, prob / (sum(prob) OVER (PARTITION BY topic_id) + 1e-12) AS p FROM ranked WHERE rank <= 20)
  GROUP BY topic_id) s JOIN affixes USING (topic_id)""", AFFIXES)
def _statistics(m):
    return topics.topic_statistics(m.phi)


@surrogate("topic_proportions", """
SELECT topic_id, round(weight / (SELECT sum(weight) FROM sizes), 6) AS proportion FROM sizes""", sql.SIZES)
def _proportions(m):
    return relevance.topic_proportions(m.sizes)


SALIENCY = sql.SIZES + """,
given AS (SELECT topic_id, term, prob / sum(prob) OVER (PARTITION BY term) AS share FROM phi),
distinct_terms AS (SELECT term, sum(share * ln(share / (weight / (SELECT sum(weight) FROM sizes)))) AS d
  FROM given JOIN sizes USING (topic_id) GROUP BY term)"""


@surrogate("term_saliency", """
SELECT term, round(frequency, 6) AS frequency, round(d, 6) AS distinctiveness, round(p_term * d, 6) AS saliency
FROM frequencies JOIN distinct_terms USING (term)""", SALIENCY)
def _saliency(m):
    return relevance.term_saliency(m.phi, m.sizes)


@surrogate("term_relevance", """
SELECT topic_id, rank, term, round(relevance, 6) AS relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, term) AS rank FROM (
    SELECT topic_id, term, round(0.6 * ln(prob) + 0.4 * ln(prob / p_term), 9) AS relevance
    FROM phi JOIN frequencies USING (term))) WHERE rank <= 30""", sql.SIZES)
def _relevance(m):
    return relevance.term_relevance(m.phi, m.sizes)


@surrogate("topic_distance", """
SELECT x.topic_id AS topic_a, y.topic_id AS topic_b, round(sum(
  CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS distance
FROM dense x JOIN dense y USING (term), LATERAL (SELECT x.prob AS p, y.prob AS q)
WHERE x.topic_id < y.topic_id AND p + q > 0 GROUP BY ALL""", sql.PHI + """,
dense AS (SELECT t.topic_id, v.term, coalesce(p.prob, 0) AS prob FROM topics t JOIN vocab v ON true
  LEFT JOIN phi p ON p.topic_id = t.topic_id AND p.term = v.term)""")
def _distance(m):
    return relevance.topic_distance(m.phi)


@surrogate("topn_topics", "SELECT doc_id, rank, topic_id, round(prob, 6) AS prob FROM theta_ranked WHERE rank <= 3 AND prob >= 0.01", sql.THETA)
def _topn(m):
    return document_topics.topn_topics(m.theta)


@surrogate("topic_ranking_table", f"""
SELECT doc_id, rank AS ranking, 'Topik ' || (topic_id + 1) AS label, printf('%.4f', prob) AS probability,
  printf('%.2f%%', prob * 100) AS percent, keywords
FROM theta_ranked JOIN ({KEYWORDS}) USING (topic_id)""", sql.THETA)
def _ranking_table(m):
    return document_topics.topic_ranking_table(m.theta, topics.topic_keywords(m.phi))


@surrogate("top8_distribution", """
SELECT doc_id, rank, 'Topik ' || (topic_id + 1) AS label, round(prob, 6) AS prob FROM theta_ranked WHERE rank <= 8""", sql.THETA)
def _top8(m):
    return document_topics.top_distribution(m.theta)


@surrogate("confidence_band", """
SELECT doc_id, round(prob * 100, 6) AS confidence, CASE WHEN prob * 100 < 25 THEN '0-25' WHEN prob * 100 < 50 THEN '25-50'
  WHEN prob * 100 < 75 THEN '50-75' ELSE '75-100' END AS band FROM dominant""", sql.THETA)
def _band(m):
    return document_topics.confidence_band(m.theta)


@check("article_summary", sql.with_(sql.THETA, r"""
SELECT d.doc_id, len(list_filter(regexp_split_to_array(coalesce(a.content, ''), '\s+'), lambda w: w <> '')) AS n_words,
  len(d.tokens) AS n_tokens, 'Topik ' || (t.topic_id + 1) AS dominant, round(t.prob * 100, 6) AS confidence
FROM docs d JOIN articles a ON a.article_id = d.doc_id JOIN dominant t USING (doc_id)"""))
def _summary(spark, sf):
    model = views.Surrogate(spark, sf)
    texts = views.articles(spark, sf).select(F.col("article_id").alias("doc_id"), "content")
    return document_topics.article_summary(model.docs.join(texts, "doc_id"), model.theta)


@surrogate("dominant_topic", "SELECT doc_id, topic_id, round(prob, 6) AS prob FROM dominant", sql.THETA)
def _dominant(m):
    return document_topics.dominant_topic(m.theta)


ENTROPY = sql.THETA + """,
entropies AS (SELECT doc_id, coalesce(-sum(CASE WHEN prob > 0 THEN prob * log2(prob) END), 0) AS entropy FROM theta GROUP BY doc_id)"""


@surrogate("document_entropy", "SELECT doc_id, round(entropy, 6) + 0.0 AS entropy FROM entropies", ENTROPY)
def _entropy(m):
    return document_topics.document_entropy(m.theta)


@surrogate("entropy_summary", """
SELECT round(avg(entropy), 6) AS avg_topic_concentration, round(stddev_pop(entropy), 6) AS std_topic_concentration
FROM entropies""", ENTROPY)
def _entropy_summary(m):
    return document_topics.entropy_summary(m.theta)


DOMINANT = """
SELECT topic_id, count(*) AS document_count, round(count(*) / (SELECT count(*) FROM dominant) * 100, 6) AS percentage
FROM dominant GROUP BY topic_id"""


@surrogate("dominant_topic_counts", DOMINANT, sql.THETA)
def _dominant_counts(m):
    return document_topics.dominant_topic_counts(m.staged_theta)


@surrogate("topic_prevalence_top5", DOMINANT + " ORDER BY document_count DESC, topic_id LIMIT 5", sql.THETA)
def _prevalence(m):
    return document_topics.topic_prevalence(m.staged_theta)


MEANS = "SELECT topic_id, avg(prob) AS m, stddev_pop(prob) AS s FROM theta GROUP BY topic_id"


@surrogate("avg_topic_probability", f"""
SELECT topic_id, round(m, 6) AS avg_probability, round(s, 6) AS std_probability FROM ({MEANS})""", sql.THETA)
def _avg_probability(m):
    return document_topics.avg_topic_probability(m.theta)


@surrogate("active_topics", f"""
SELECT CAST(threshold AS DOUBLE) AS threshold, (SELECT count(*) FROM ({MEANS}) WHERE m > threshold) AS active_topics
FROM (SELECT unnest([0.01, 0.05, 0.1]) AS threshold)""", sql.THETA)
def _active(m):
    return document_topics.active_topics(m.theta)


@check("temporal_topic_trends", sql.with_(sql.THETA, """
SELECT strftime(a.released, '%Y-%m') AS month, count(*) FILTER (topic_id = 0) AS topic_0,
  count(*) FILTER (topic_id = 1) AS topic_1, count(*) FILTER (topic_id = 2) AS topic_2, count(*) FILTER (topic_id = 3) AS topic_3
FROM dominant d JOIN articles a ON a.article_id = d.doc_id WHERE a.released IS NOT NULL GROUP BY 1"""))
def _trends(spark, sf):
    model = views.Surrogate(spark, sf)
    dates = views.articles(spark, sf).select(F.col("article_id").alias("doc_id"), "released")
    return document_topics.temporal_topic_trends(model.theta, dates, model.n_topics)


# A grid report made of the data: "K" is the number of articles of a source, its
# "coherence" the mean length ratio, so ties and order are decided by the operator.
GRID_REPORT = """report AS (
  SELECT row_number() OVER (ORDER BY source) - 1 AS grid_pos, count(*) AS "K",
    round(avg(n_chars / (n_chars + 1000)), 9) AS coherence_cv FROM documents GROUP BY source)"""


def grid_report(spark, sf):
    from pyspark.sql import Window

    docs = views.read(spark, sf, "documents")
    grouped = docs.groupBy("source").agg(
        F.count("*").alias("K"), F.round(F.avg(F.col("n_chars") / (F.col("n_chars") + 1000)), 9).alias("coherence_cv")
    )
    position = F.row_number().over(Window.orderBy("source")) - 1
    return stage(grouped.select(position.alias("grid_pos"), "K", "coherence_cv"), "report")


@check("select_best_k", sql.with_(GRID_REPORT, """
SELECT "K" AS best_k, round(coherence_cv, 6) AS best_cv FROM report ORDER BY coherence_cv DESC, grid_pos LIMIT 1"""))
def _best_k(spark, sf):
    return corpus_stats.select_best_k(grid_report(spark, sf))


@check("coherence_by_k", sql.with_(GRID_REPORT, """
SELECT grid_pos, "K", round(coherence_cv, 6) AS coherence_cv,
  row_number() OVER (ORDER BY coherence_cv DESC, "K", grid_pos) = 1 AS is_best FROM report"""))
def _by_k(spark, sf):
    return corpus_stats.coherence_by_k(grid_report(spark, sf))


@check("write_tables", sql.with_(sql.THETA, f"""
SELECT 'topic_terms' AS table_name, count(*) AS n_rows FROM ranked WHERE rank <= 20
UNION ALL SELECT 'topic_statistics', count(DISTINCT topic_id) FROM phi
UNION ALL SELECT 'dominant_topics', count(DISTINCT topic_id) FROM dominant
UNION ALL SELECT 'avg_topic_probabilities', count(*) FROM ({MEANS})
UNION ALL SELECT 'temporal_topic_trends', count(DISTINCT strftime(released, '%Y-%m')) FROM dominant JOIN articles ON article_id = doc_id
UNION ALL SELECT 'coherence_report', count(DISTINCT source) FROM documents"""))
def _write_tables(spark, sf):
    model = views.Surrogate(spark, sf)
    theta = model.staged_theta
    dates = views.articles(spark, sf).select(F.col("article_id").alias("doc_id"), "released")
    paths = write_tables(
        {
            "topic_terms": topics.topic_terms(model.phi),
            "topic_statistics": topics.topic_statistics(model.phi),
            "dominant_topics": document_topics.dominant_topic_counts(theta),
            "avg_topic_probabilities": document_topics.avg_topic_probability(theta),
            "temporal_topic_trends": document_topics.temporal_topic_trends(theta, dates, model.n_topics),
            "coherence_report": grid_report(spark, sf),
        },
        new_path(spark, "tables"), "csv",
    )
    counts = [
        spark.read.csv(path, header=True).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counts)
