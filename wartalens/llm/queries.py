"""One query per operator, over the whole given tables, and SQL where it can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wartalens.llm import (
    bpe, conversation_repair, decontaminate, language_id, link_trust, minhash_dedup, quality_rules, quote_links, sharding,
    token_counts, token_files, toxicity, whitening,
)
from wartalens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), byte_bpe())


def bpe_digests(pairs: DataFrame) -> DataFrame:
    """Contract columns of encoded and decoded documents."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return pairs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op8_bpe_backtracking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode_decode(read(spark, sf_dir, "documents"), byte_bpe()))


@query("op9_prefix_sum_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("found", decontaminate.scan_column(docs, read(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("found")).alias("contaminated"),
    )


@query("op10_quality_decision_list")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_hyperdimensional_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.fit(language_id.learnable(docs)))


@query("op7_toxicity_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op2_odd_sketch_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link(read(spark, sf_dir, "documents"))


@query("op1_trie_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def quoting_messages(turns: DataFrame) -> DataFrame:
    """Mail-like messages from turns: each quotes the turn before it, and below that the turn it answered."""
    said = turns.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("msg_id"), F.coalesce("text", F.lit("")).alias("text"))
    back = lambda n: said.select((F.col("msg_id") + n).alias("msg_id"), F.col("text").alias(f"_{n}"))
    marked = lambda column, marks: F.concat(F.regexp_replace(column, "(?m)^", marks), F.lit("\n"))
    return said.join(back(1), "msg_id", "left").join(back(2), "msg_id", "left").select("msg_id", F.concat(
        F.coalesce(marked(F.col("_1"), "> "), F.lit("")), F.coalesce(marked(F.col("_2"), ">> "), F.lit("")), "text",
    ).alias("text"))


CONVERSATIONS_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id * 1000000 + turn AS msg_id,
         regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS body
  FROM conversations),
hashed AS (
  SELECT msg_id, body, CASE WHEN body <> '' THEN
    md5(regexp_replace(lower(regexp_replace(body, '[ \t\r\n]+', ' ', 'g')), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) END AS h
  FROM said),
firsts AS (SELECT h, min(msg_id) AS first FROM hashed WHERE h IS NOT NULL GROUP BY h),
quotes AS (
  SELECT a.msg_id, n.back AS level, f.first, q.h IS NOT NULL AS quoted
  FROM hashed a CROSS JOIN (VALUES (1), (2)) n(back)
  JOIN hashed q ON q.msg_id = a.msg_id - n.back LEFT JOIN firsts f ON f.h = q.h),
links AS (
  SELECT msg_id, arg_min(first, level) AS parent_id FROM quotes WHERE first < msg_id GROUP BY msg_id),
reach AS (
  SELECT h.msg_id, h.msg_id AS root_id, 0 AS depth FROM hashed h ANTI JOIN links l USING (msg_id)
  UNION ALL
  SELECT l.msg_id, r.root_id, r.depth + 1 FROM links l JOIN reach r ON r.msg_id = l.parent_id),
n AS (SELECT msg_id, count(*) FILTER (quoted) AS n_passages FROM quotes GROUP BY msg_id)
SELECT r.root_id, row_number() OVER (PARTITION BY r.root_id ORDER BY r.depth, r.msg_id) - 1 AS position,
       r.msg_id, l.parent_id, r.depth::BIGINT AS depth, coalesce(n.n_passages, 0) AS n_passages, h.body
FROM reach r JOIN hashed h USING (msg_id) LEFT JOIN links l USING (msg_id) LEFT JOIN n USING (msg_id)
"""


@query("op3_quotation_links", CONVERSATIONS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(quoting_messages(read(spark, sf_dir, "conversations")))


URL_RULES: list[link_trust.Rule] = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def urls_sql() -> str:
    """Rules, seeds and every round of the link graph, in whole numbers as in the operator."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({quote(v)}, {quote(h)}, {quote(p)})" for v, h, p in URL_RULES)
    scale, damping = link_trust.SCALE, f"CAST({link_trust.DAMPING} AS DOUBLE)"

    def parts(url: str) -> str:
        rest = f"substr({url}, position('://' IN {url}) + 3)"
        host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{link_trust.UPPER}', '{link_trust.LOWER}')"
        return (f"CASE WHEN contains({url}, '://') THEN {host} ELSE '' END AS host, "
                f"CASE WHEN contains({url}, '://') THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path")

    steps = [f"""rules(verdict, host, path) AS (VALUES {rules}),
own AS MATERIALIZED (SELECT row_number() OVER () AS nth, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
links AS (SELECT nth, url AS page_url, unnest(list_distinct(regexp_extract_all(html, {quote(link_trust.LINK)}, 1))) AS link FROM own),
seen AS (
  SELECT page_url, CASE WHEN link LIKE '//%' THEN 'http:' || link ELSE link END AS url, FALSE AS own FROM links
  UNION ALL SELECT url, url, TRUE FROM own),
addresses AS MATERIALIZED (SELECT DISTINCT url, {parts('url')} FROM (SELECT url FROM seen UNION SELECT page_url FROM seen)),
ruled AS MATERIALIZED (
  SELECT a.url, a.host, a.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS said
  FROM addresses a LEFT JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)
  GROUP BY ALL),
mentions AS MATERIALIZED (
  SELECT p.host AS src, t.host AS dst, t.said, count(*) AS n
  FROM seen s JOIN ruled p ON p.url = s.page_url JOIN ruled t ON t.url = s.url
  WHERE p.host <> '' AND t.host <> '' AND (s.own OR p.host <> t.host) GROUP BY ALL),
counted AS (
  SELECT dst AS host, sum(n) AS n, coalesce(sum(n) FILTER (said = 'allow'), 0) AS a, coalesce(sum(n) FILTER (said = 'block'), 0) AS b
  FROM mentions GROUP BY dst),
round0 AS MATERIALIZED (
  SELECT * FROM (SELECT 'trust' AS kind, host, CAST(floor(CAST(a * {scale} AS DOUBLE) / n) AS BIGINT) AS mass FROM counted
    UNION ALL SELECT 'distrust', host, CAST(floor(CAST(b * {scale} AS DOUBLE) / n) AS BIGINT) FROM counted) WHERE mass > 0),
edges AS MATERIALIZED (SELECT src, dst, sum(n) AS n FROM mentions WHERE src <> dst GROUP BY ALL),
flows AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst AS onto, {damping} * n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, {damping} * n / sum(n) OVER (PARTITION BY dst) FROM edges)"""]
    steps += [f"""round{k} AS MATERIALIZED (
  SELECT kind, onto AS host, CAST(sum(floor(mass * share)) AS BIGINT) AS mass FROM round{k - 1} JOIN flows USING (kind, host)
  GROUP BY ALL HAVING sum(floor(mass * share)) > 0)""" for k in range(1, link_trust.ROUNDS + 1)]
    rounds = " UNION ALL ".join(f"SELECT * FROM round{k}" for k in range(link_trust.ROUNDS + 1))
    return "WITH " + ",\n".join(steps) + f""",
scores AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM ({rounds}) GROUP BY host)
SELECT o.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE
    WHEN s.distrust >= {int(link_trust.BLOCK_AT * scale)} AND s.distrust > s.trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(CAST(s.trust AS DOUBLE), 0) / {scale} AS trust, coalesce(CAST(s.distrust AS DOUBLE), 0) / {scale} AS distrust
FROM own o JOIN ruled r USING (url) LEFT JOIN scores s USING (host)"""


@query("op11_link_trust", urls_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = link_trust.judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damaged(conversation_repair.turn_rows(read(spark, sf_dir, "conversations")))
    return conversation_repair.repair(turns).withColumnRenamed("conv", "conv_id")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
