"""Documents to token arrays; stopword and stem tables of any size."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column, explode_rows
from wartalens.functions.lookup import inline_map, inline_set
from wartalens.functions.roots import root_candidates
from wartalens.functions.stemming import stem_word
from wartalens.functions.text import base_clean
from wartalens.functions.tokens import preprocess_text, stem_tokens, tokenize
from wartalens.session import numbered_rows, stage

INLINE_WORDS = 200_000        # word tables up to this length become a hash table in the plan


def preprocess_documents(
    articles: DataFrame,
    stopwords: Iterable[str],
    protected: Iterable[str] = (),
    overrides: Mapping[str, str] | None = None,
    text: str = "content",
    key: str = "article_id",
    keep: Iterable[str] = (),
    **clean_options: bool,
) -> DataFrame:
    """``(doc_id, tokens, kept columns)``; text order is kept, nothing is shuffled."""
    tokens = preprocess_text(text, stopwords, protected, overrides, **clean_options)
    return articles.select(F.col(key).alias("doc_id"), *keep, tokens.alias("tokens"))


def _rejoin(rows: DataFrame, tokens_by_pos: DataFrame, tokens: str) -> DataFrame:
    rebuilt = tokens_by_pos.groupBy("_row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("_new")
    )
    empty = F.array().cast("array<string>")
    kept = F.when(F.col(tokens).isNotNull(), F.coalesce("_new", empty))
    return rows.join(rebuilt, "_row", "left").withColumn(tokens, kept).drop("_new", "_row")


def remove_stopwords_table(
    docs: DataFrame,
    stopwords: DataFrame,
    tokens: str = "tokens",
    inline_limit: int = INLINE_WORDS,
) -> DataFrame:
    """Drop words of a one-column table: in-row if the table is short, else an anti join.

    Both ways give the same rows; missing or repeated keys and null tokens stay as they are.
    """
    named = stopwords.toDF("term")
    is_stopword = inline_set(named, inline_limit)
    if is_stopword is not None:
        return docs.withColumn(tokens, F.filter(tokens, lambda t: ~is_stopword(t)))
    rows = numbered_rows(docs)
    kept = explode_rows(rows, ["_row"], F.col(tokens), "term", "pos").join(named, "term", "left_anti")
    return _rejoin(rows, kept, tokens)


def stem_with_table(
    docs: DataFrame,
    stem_map: DataFrame,
    tokens: str = "tokens",
    inline_limit: int = INLINE_WORDS,
) -> DataFrame:
    """Stem by a user's ``(token, stem)`` table; tokens it lacks get the rule-based stem."""
    named = stem_map.select("token", "stem")
    lookup = inline_map(named, inline_limit)
    if lookup is not None:
        return docs.withColumn(tokens, F.transform(tokens, lambda t: F.coalesce(lookup(t), stem_word(t))))
    rows = numbered_rows(docs)
    stemmed = (
        rows.select("_row", F.posexplode_outer(tokens).alias("pos", "token")).filter("pos IS NOT NULL").join(named, "token", "left")
        .select("_row", "pos", F.coalesce("stem", stem_word("token")).alias("term"))
    )
    return _rejoin(rows, stemmed, tokens)


def distinct_stems(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct tokens with their rule-based stem: the table a user edits into a ``stem_map``."""
    distinct = explode_rows(docs, [], F.array_distinct(as_column(tokens)), "token").distinct()
    return distinct.select("token", stem_word("token").alias("stem"))


def root_stems(tokens: DataFrame, roots: DataFrame, token: str = "token") -> DataFrame:
    """``(token, stem)`` of every distinct token: the first of its candidates that ``roots`` knows, else the token.

    ``roots`` has one column of root words; nulls and repeats in it do no harm. Candidates are built once
    per distinct token and meet the roots in one semi join, so neither table has a size bound.
    """
    known = roots.toDF("candidate").filter("candidate IS NOT NULL").distinct()
    distinct = tokens.select(F.col(token).alias("token")).filter("token IS NOT NULL").distinct()
    forms = distinct.select("token", F.posexplode(root_candidates("token")).alias("nth", "candidate"))
    first = forms.join(known, "candidate", "left_semi").groupBy("token").agg(F.min_by("candidate", "nth").alias("stem"))
    return distinct.join(first, "token", "left").select("token", F.coalesce("stem", "token").alias("stem"))


def stem_by_roots(
    docs: DataFrame,
    roots: DataFrame,
    protected: Iterable[str] = (),
    overrides: Mapping[str, str] | None = None,
    tokens: str = "tokens",
    inline_limit: int = INLINE_WORDS,
) -> DataFrame:
    """Stem by confix stripping against a table of root words; protected words and given stems win.

    The stems of the distinct tokens are written once and looked up by :func:`stem_with_table`.
    """
    rows = stage(docs, "unstemmed")
    distinct = explode_rows(rows, [], F.array_distinct(as_column(tokens)), "token")
    stems = root_stems(distinct, roots)
    kept, given = sorted(set(protected)), dict(overrides or {})
    stem = F.col("stem")
    if given:
        pairs = [F.lit(part) for item in sorted(given.items()) for part in item]
        stem = F.when(F.col("token").isin(sorted(given)), F.element_at(F.create_map(*pairs), F.col("token"))).otherwise(stem)
    if kept:
        stem = F.when(F.col("token").isin(kept), F.col("token")).otherwise(stem)
    return stem_with_table(rows, stage(stems.select("token", stem.alias("stem")), "stems"), tokens, inline_limit)


def preprocess_with_tables(
    articles: DataFrame,
    stopwords: DataFrame,
    roots: DataFrame | None = None,
    protected: Iterable[str] = (),
    overrides: Mapping[str, str] | None = None,
    text: str = "content",
    key: str = "article_id",
    keep: Iterable[str] = (),
    inline_limit: int = INLINE_WORDS,
    **clean_options: bool,
) -> DataFrame:
    """As :func:`preprocess_documents`, with stopwords and root words in tables of any size.

    Without ``roots`` the dictionary-free rules stem.
    """
    cleaned = tokenize(base_clean(text, **clean_options))
    docs = articles.select(F.col(key).alias("doc_id"), *keep, cleaned.alias("tokens"))
    docs = remove_stopwords_table(docs, stopwords, inline_limit=inline_limit)
    if roots is None:
        docs = docs.withColumn("tokens", stem_tokens("tokens", protected, overrides))
    else:
        docs = stem_by_roots(docs, roots, protected, overrides, inline_limit=inline_limit)
    return remove_stopwords_table(docs, stopwords, inline_limit=inline_limit)
