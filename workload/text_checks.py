"""Cleaning, tokens, stemming, phrases, dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from wartalens.functions import text, tokens
from wartalens.operators import dictionary, phrases
from wartalens.operators.preprocess import distinct_stems, remove_stopwords_table, root_stems
from wartalens.session import stage
from wartalens.sources.stopwords import stopword_table
from workload import sql, views
from workload.registry import check


def step(name, spark_function, sql_function):
    @check(name, sql.with_(sql.ARTICLES, f"SELECT article_id, {sql_function('content')} AS text FROM articles"))
    def _query(spark, sf):
        return views.articles(spark, sf).select("article_id", spark_function("content").alias("text"))


step("fold_unicode", text.fold_unicode, sql.fold)
step("strip_urls", text.strip_urls, sql.strip_urls)
step("strip_emoji", text.strip_emoji, sql.strip_emoji)
step("strip_entities", text.strip_entities, sql.strip_entities)
step("lower_trim", text.lower_trim, sql.lower_trim)
step("strip_lead", text.strip_lead, sql.strip_lead)
step("strip_clock", text.strip_clock, sql.strip_clock)
step("strip_html_words", text.strip_html_words, sql.strip_html_words)
step("keep_letters", text.keep_letters, sql.keep_letters)
step("squeeze_spaces", text.squeeze_spaces, sql.squeeze)
step("base_clean", text.base_clean, sql.clean)


CLEANED = sql.ARTICLES + f""",
cleaned AS (SELECT article_id, {sql.clean('content')} AS c FROM articles),
tokenised AS MATERIALIZED (
  SELECT article_id, list_filter(string_split(c, ' '), lambda t: length(t) > 1) AS tokens FROM cleaned)"""


def joined(column: str) -> str:
    return f"array_to_string({column}, ' ')"


@check("tokenize", sql.with_(CLEANED, f"SELECT article_id, {joined('tokens')} AS tokens FROM tokenised"))
def _tokenize(spark, sf):
    return views.articles(spark, sf).select(
        "article_id", tokens.tokenize(text.base_clean("content")).alias("tokens")
    )


STOPPED = f"list_filter(tokens, lambda t: t NOT IN {sql.STOP})"


@check("remove_stopwords", sql.with_(CLEANED, f"SELECT article_id, {joined(STOPPED)} AS tokens FROM tokenised"))
def _remove_stopwords(spark, sf):
    docs = views.articles(spark, sf).select(
        "article_id", tokens.tokenize(text.base_clean("content")).alias("tokens")
    )
    return remove_stopwords_table(docs, stopword_table(spark, views.STOPWORDS))


VOCABULARY = CLEANED + f""",
distinct_tokens AS (SELECT DISTINCT unnest(tokens) AS token FROM tokenised)"""


@check("stem_tokens", sql.with_(VOCABULARY, f"SELECT token, {sql.stem('token')} AS stem FROM distinct_tokens"))
def _stem_tokens(spark, sf):
    docs = views.articles(spark, sf).select(tokens.tokenize(text.base_clean("content")).alias("tokens"))
    return distinct_stems(docs)


ROOTED = VOCABULARY + f""",
said AS (SELECT unnest(string_split({sql.clean('text')}, ' ')) AS root FROM conversations),
known_roots AS MATERIALIZED (SELECT DISTINCT root FROM said WHERE length(root) > 1),
""" + sql.root_stems("distinct_tokens", "known_roots")


@check("stem_by_roots", sql.with_(ROOTED, "SELECT token, stem FROM root_stems"))
def _stem_by_roots(spark, sf):
    """Tokens of the articles against the words of the conversations as root table."""
    words = lambda column: F.explode(tokens.tokenize(text.base_clean(column)))
    said = views.read(spark, sf, "conversations").select(words("text").alias("root"))
    return root_stems(views.articles(spark, sf).select(words("content").alias("token")), said)


PROTECTED = ["memperjuangkan", "thering", "anding", "pation"]


@check("protect_words", sql.with_(VOCABULARY, f"""
SELECT token, CASE WHEN token IN {sql.words(PROTECTED)} THEN token ELSE {sql.stem('token')} END AS stem
FROM distinct_tokens"""))
def _protect_words(spark, sf):
    docs = views.articles(spark, sf).select(tokens.tokenize(text.base_clean("content")).alias("tokens"))
    distinct = distinct_stems(docs).select("token")
    kept = tokens.stem_tokens(F.array("token"), protected=PROTECTED)
    return distinct.select("token", F.get(kept, F.lit(0)).alias("stem"))


@check("preprocess_documents", sql.with_(sql.DOCS, f"SELECT doc_id, {joined('tokens')} AS tokens FROM docs"))
def _preprocess(spark, sf):
    return views.docs(spark, sf).select("doc_id", "tokens")


COUNTED = sql.DOCS + ",\n" + sql.counted("bi_", "flat")


@check("ngram_counts", sql.with_(COUNTED, "SELECT ngram, n FROM bi_counts"))
def _ngram_counts(spark, sf):
    return phrases.ngram_counts(views.docs(spark, sf))


SCORED = "SELECT left_word, right_word, n_ab, n_a, n_b, round(score, 6) AS score FROM {}"


@check("score_phrases", sql.with_(COUNTED, SCORED.format("bi_phrases")))
def _score_phrases(spark, sf):
    counts = stage(phrases.ngram_counts(views.docs(spark, sf)), "ngrams")
    return phrases.score_phrases(counts)


FLAT_TEXT = """
SELECT d.doc_id, coalesce(string_agg(f.term, ' ' ORDER BY f.pos), '') AS tokens
FROM docs d LEFT JOIN {} f USING (doc_id) GROUP BY d.doc_id"""


@check("merge_phrases", sql.with_(
    COUNTED + ",\n" + sql.merged("m1_", "flat", "bi_phrases", "flat_bi"), FLAT_TEXT.format("flat_bi")))
def _merge_phrases(spark, sf):
    docs = views.staged_docs(spark, sf)
    found = stage(phrases.score_phrases(phrases.ngram_counts(docs)), "bigrams")
    return phrases.merge_phrases(docs, found).select("doc_id", "tokens")


@check("trigram_pass", sql.with_(sql.PHRASED, SCORED.format("tri_phrases")))
def _trigram_pass(spark, sf):
    return phrases.learn_phrases(views.staged_docs(spark, sf), outer_words=True)[1]


@check("apply_phrases", sql.with_(sql.PHRASED, FLAT_TEXT.format("flat_tri")))
def _apply_phrases(spark, sf):
    docs = views.staged_docs(spark, sf)
    return phrases.apply_phrases(docs, *phrases.learn_phrases(docs, outer_words=True)).select("doc_id", "tokens")


@check("doc_frequency", sql.with_(sql.DOCS + ",\n" + sql.FREQ, "SELECT term, df, cf FROM freq"))
def _doc_frequency(spark, sf):
    return dictionary.doc_frequency(views.docs(spark, sf))


@check("filter_extremes", sql.with_(sql.DOCS + ",\n" + sql.VOCAB, "SELECT term_id, term, df, cf FROM vocab"))
def _filter_extremes(spark, sf):
    return dictionary.build_dictionary(views.docs(spark, sf))


@check("doc2bow", sql.with_(sql.DOCS + ",\n" + sql.BOW, "SELECT doc_id, term_id, term, tf FROM bow"))
def _doc2bow(spark, sf):
    docs = views.staged_docs(spark, sf)
    return dictionary.doc2bow(docs, stage(dictionary.build_dictionary(docs), "vocab"))


@check("bow_vectors", sql.with_(sql.DOCS + ",\n" + sql.BOW, """
SELECT d.doc_id, '(' || (SELECT count(*) FROM vocab) || ',[' || coalesce(ids, '') || '],[' || coalesce(counts, '') || '])' AS features
FROM docs d LEFT JOIN (
  SELECT doc_id, string_agg(term_id, ',' ORDER BY term_id) AS ids, string_agg(tf || '.0', ',' ORDER BY term_id) AS counts
  FROM bow GROUP BY doc_id) USING (doc_id)"""))
def _bow_vectors(spark, sf):
    docs = views.staged_docs(spark, sf)
    vocab = stage(dictionary.build_dictionary(docs), "vocab")
    vectors = dictionary.bow_vectors(docs, dictionary.vocabulary_terms(vocab))
    return vectors.select("doc_id", F.col("features").cast("string").alias("features"))
