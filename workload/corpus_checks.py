"""Sources, corpus selection and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wartalens.operators import corpus, corpus_stats, document_topics
from wartalens.operators.dictionary import build_dictionary
from wartalens.operators.preprocess import preprocess_documents
from wartalens.plans.evaluate import rebuild_corpus
from wartalens.session import new_path, spread, stage
from wartalens.sources.articles import extract_articles, read_articles
from wartalens.sources.stopwords import build_stopwords, load_stopword_list, stopword_table
from wartalens.sources.tables import ModelStore
from wartalens.operators.phrases import learn_phrases
from workload import sql, views
from workload.registry import check

SHOWN = "article_id, portal, title, strftime(released, '%Y-%m-%d') AS released, url, md5(content) AS content_md5, content_len"


def shown(df):
    return df.select(
        "article_id", "portal", "title", "released", "url", F.md5("content").alias("content_md5"), "content_len"
    )


@check("read_articles", sql.with_(sql.ARTICLES, f"SELECT {SHOWN} FROM articles"))
def _read_articles(spark, sf):
    path = new_path(spark, "articles-csv")
    raw = views.articles(spark, sf).drop("lang")
    as_text = raw.withColumn("released", F.coalesce(F.date_format("released", "yyyy-MM-dd HH:mm:ss"), F.lit("n/a")))
    as_text.write.csv(path, header=True, escape='"')
    return shown(read_articles(spark, path))


WORD_LINES = """words AS (
  SELECT DISTINCT lower(trim(w)) AS word FROM (
    SELECT unnest(string_split(replace(text, chr(10), ','), ',')) AS w FROM conversations) WHERE trim(w) <> '')"""


@check("load_stopword_list", sql.with_(WORD_LINES, "SELECT word FROM words WHERE word <> ''"))
def _load_stopword_list(spark, sf):
    path = new_path(spark, "stopword-lines")
    views.read(spark, sf, "conversations").select("text").write.text(path)
    return load_stopword_list(spark, path)


@check("extract_articles", sql.with_(sql.extracted(), f"SELECT page_id, {sql.TITLE} AS title, content FROM texts"))
def _extract_articles(spark, sf):
    return extract_articles(spread(views.read(spark, sf, "pages"), "page_id"))


@check("url_title", f"SELECT page_id, {sql.TITLE} AS title FROM pages")
def _url_title(spark, sf):
    return extract_articles(views.read(spark, sf, "pages")).select("page_id", "title")


REBUILT = """
SELECT d.doc_id, coalesce(string_agg(f.term, ' ' ORDER BY f.pos), '') AS tokens
FROM docs d LEFT JOIN flat_tri f USING (doc_id) GROUP BY d.doc_id"""


KEPT_WHOLE, GIVEN_STEMS = ["memperjuangkan", "thering", "pation"], {"rapat": "rapatkan", "kerja": "bekerja", "anding": "and"}
AS_STORED = sql.ARTICLES + ",\n" + sql.tokens_of(
    "articles", "article_id", "content", "lang",
    lambda w: f"CASE WHEN {w} IN {sql.words(KEPT_WHOLE)} THEN {w} "
    + " ".join(f"WHEN {w} = {sql.lit(a)} THEN {sql.lit(b)}" for a, b in GIVEN_STEMS.items()) + f" ELSE {sql.stem(w)} END")


@check("rebuild_corpus", sql.with_(AS_STORED + ",\n" + sql.PHRASES, REBUILT))
def _rebuild_corpus(spark, sf):
    """Protected words and given stems are part of the stored run, in its phrases and in the rebuilt tokens."""
    store = ModelStore(spark, new_path(spark, "store"))
    articles = views.articles(spark, sf)
    store.save_table("stopwords", stopword_table(spark, views.STOPWORDS))
    store.save_text_options(KEPT_WHOLE, GIVEN_STEMS)
    bigrams, trigrams = learn_phrases(
        stage(preprocess_documents(articles, views.STOPWORDS, KEPT_WHOLE, GIVEN_STEMS), "tokens"), outer_words=True)
    store.save_table("bigrams", bigrams)
    store.save_table("trigrams", trigrams)
    return rebuild_corpus(articles, store)


DEDUPED = sql.ARTICLES + """,
deduped AS (SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS nth FROM articles) WHERE nth = 1)"""
LONG_ENOUGH = "SELECT * REPLACE (coalesce(content_len, 0) AS content_len) FROM {} WHERE coalesce(content_len, 0) >= 100"


@check("dedup_by_url", sql.with_(DEDUPED, f"SELECT {SHOWN} FROM deduped"))
def _dedup(spark, sf):
    return shown(corpus.dedup_by_url(views.articles(spark, sf)))


@check("min_length_filter", sql.with_(
    sql.ARTICLES + f", kept AS ({LONG_ENOUGH.format('articles')})", f"SELECT {SHOWN} FROM kept"))
def _min_length(spark, sf):
    return shown(corpus.min_length_filter(views.articles(spark, sf)))


@check("drop_null_content", sql.with_(sql.ARTICLES, f"SELECT {SHOWN} FROM articles WHERE content IS NOT NULL"))
def _drop_null(spark, sf):
    return shown(corpus.drop_null_content(views.articles(spark, sf)))


CORPUS = DEDUPED + f""",
corpus AS MATERIALIZED (SELECT * FROM ({LONG_ENOUGH.format('deduped')}) WHERE content IS NOT NULL)"""


@check("load_corpus", sql.with_(CORPUS, f"SELECT {SHOWN} FROM corpus"))
def _load_corpus(spark, sf):
    return shown(corpus.select_corpus(views.articles(spark, sf)))


SAMPLE_N = 137
HASHED = "md5(CAST(article_id AS VARCHAR) || '-42')"
STRATIFIED = CORPUS + f""",
strata AS (SELECT portal, count(*) AS size, (SELECT count(*) FROM corpus) AS total FROM corpus GROUP BY portal),
floors AS (SELECT portal, (size * {SAMPLE_N}) // total AS quota, (size * {SAMPLE_N}) % total AS rest FROM strata),
quotas AS (SELECT portal, quota + CASE WHEN row_number() OVER (ORDER BY rest DESC, portal)
  <= {SAMPLE_N} - (SELECT sum(quota) FROM floors) THEN 1 ELSE 0 END AS quota FROM floors),
drawn AS (SELECT c.*, q.quota, row_number() OVER (PARTITION BY c.portal ORDER BY {HASHED}, article_id) AS nth
  FROM corpus c JOIN quotas q USING (portal))"""


@check("stratified_sample", sql.with_(STRATIFIED, "SELECT article_id, portal FROM drawn WHERE nth <= quota"))
def _stratified(spark, sf):
    chosen = corpus.select_corpus(views.articles(spark, sf)).select("article_id", "portal")
    return corpus.stratified_sample(stage(chosen, "corpus"), SAMPLE_N)


@check("random_sample", sql.with_(CORPUS, f"SELECT article_id FROM corpus ORDER BY {HASHED}, article_id LIMIT {SAMPLE_N}"))
def _random(spark, sf):
    chosen = corpus.select_corpus(views.articles(spark, sf)).select("article_id")
    return corpus.random_sample(stage(chosen, "corpus"), SAMPLE_N)


GATE = sql.DOCS + ",\n" + sql.VOCAB + """,
known AS (SELECT doc_id, count(DISTINCT term) AS known_terms FROM flat JOIN vocab USING (term) GROUP BY doc_id),
measured AS (SELECT d.doc_id, coalesce(length(a.content), 0) AS n_chars, len(d.tokens) AS n_tokens,
  coalesce(k.known_terms, 0) AS known_terms
  FROM docs d JOIN articles a ON a.article_id = d.doc_id LEFT JOIN known k USING (doc_id))"""


@check("article_gate", sql.with_(GATE, """
SELECT *, CASE WHEN n_tokens < 30 THEN 'too_few_tokens' WHEN known_terms = 0 THEN 'no_vocabulary'
  WHEN n_chars < 100 THEN 'short_text' ELSE 'ok' END AS status FROM measured"""))
def _gate(spark, sf):
    docs = stage(views.docs(spark, sf), "docs")
    return corpus.article_gate(docs, stage(build_dictionary(docs), "vocab"))


@check("corpus_stats", sql.with_(sql.ARTICLES, """
SELECT count(*) AS total_articles, round(avg(content_len), 6) AS avg_content_length,
  round(median(content_len), 6) AS median_content_length,
  strftime(min(released), '%Y-%m-%d') AS date_start, strftime(max(released), '%Y-%m-%d') AS date_end,
  count(DISTINCT portal) AS portals FROM articles"""))
def _corpus_stats(spark, sf):
    return corpus_stats.corpus_stats(views.articles(spark, sf))


PORTALS = "SELECT portal, count(*) AS articles FROM articles WHERE portal IS NOT NULL GROUP BY portal"


@check("portal_counts", sql.with_(sql.ARTICLES, PORTALS))
def _portal_counts(spark, sf):
    return corpus_stats.portal_counts(views.articles(spark, sf))


@check("top_portals", sql.with_(sql.ARTICLES, PORTALS + " ORDER BY articles DESC, portal LIMIT 10"))
def _top_portals(spark, sf):
    return corpus_stats.top_portals(views.articles(spark, sf))


@check("length_histogram", sql.with_(sql.ARTICLES, """
, ends AS (SELECT min(content_len) AS lo, max(content_len) AS hi, avg(content_len) AS m, median(content_len) AS md FROM articles),
binned AS (SELECT least(((content_len - lo) * 50) // (hi - lo), 49) AS bin, count(*) AS articles
  FROM articles, ends WHERE content_len IS NOT NULL GROUP BY 1)
SELECT r.range AS bin, round(lo + r.range * ((hi - lo) / 50), 6) AS bin_start,
  round(lo + (r.range + 1) * ((hi - lo) / 50), 6) AS bin_end,
  coalesce(articles, 0) AS articles, round(m, 6) AS mean_length, round(md, 6) AS median_length
FROM range(50) r JOIN ends ON true LEFT JOIN binned b ON b.bin = r.range""".lstrip()))
def _histogram(spark, sf):
    return corpus_stats.length_histogram(views.articles(spark, sf))


@check("monthly_counts", sql.with_(sql.ARTICLES, """
SELECT strftime(released, '%Y-%m') AS month, count(*) AS articles FROM articles WHERE released IS NOT NULL GROUP BY 1"""))
def _monthly(spark, sf):
    return corpus_stats.monthly_counts(views.articles(spark, sf))


@check("build_stopwords", sql.with_(WORD_LINES, f"""
SELECT unnest([{', '.join(sql.lit(w) for w in build_stopwords())}]) AS word
UNION SELECT word FROM words WHERE word <> ''"""))
def _build_stopwords(spark, sf):
    path = new_path(spark, "stopword-lines")
    views.read(spark, sf, "conversations").select("text").write.text(path)
    return load_stopword_list(spark, path).unionByName(stopword_table(spark, build_stopwords())).distinct()


TOP_WORDS = sql.DOCS + """,
counted AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM flat GROUP BY ALL),
top_words AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM counted
  WHERE doc_id IN (SELECT doc_id FROM docs WHERE len(tokens) >= 5))"""


@check("document_top_words", sql.with_(TOP_WORDS, "SELECT doc_id, rank, term, n FROM top_words WHERE rank <= 30"))
def _top_words(spark, sf):
    return document_topics.document_top_words(views.docs(spark, sf))
