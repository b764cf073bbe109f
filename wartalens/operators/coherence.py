"""Topic coherence: c_v, c_uci, c_npmi (sliding windows) and u_mass (documents).

One pass over the documents counts windows, terms and pairs inside each row, for any number of models
and window widths at once, and ships only ``(term, term, counts)`` sums: top terms times their
partners, whatever the size of the corpus. Windows are never materialised. For a term the number of
windows holding it is the length of the union of the start ranges of its occurrences; both range ends
grow with the position, so one walk over the sorted positions gives it. A pair merges the two position lists
and walks once: windows with both a and b number |a| + |b| - |a or b|. Each distinct pair of terms
that share a topic is counted once, in however many topics and models it stands.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.functions.arrays import explode_rows, let
from wartalens.functions.lookup import inline_map
from wartalens.operators.topics import topic_terms
from wartalens.session import stage

EPSILON = 1e-12
TOP_TERMS = 20
WINDOWS = {"c_v": 110, "c_uci": 10, "c_npmi": 10}
MEASURES = ("c_v", "c_uci", "c_npmi", "u_mass")
NO_TOPIC = -1

Topics = dict[int, list[str]]


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _covered(positions: Column, size: Column, width: int | None) -> Column:
    """Windows of ``width`` that hold any of the sorted positions; without width: the document, if any."""
    if width is None:
        return F.when(F.size(positions) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    last = F.greatest(size - width, F.lit(0))
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).alias("upto")),
        lambda acc, p: let(F.least(p, last), lambda hi: F.struct(
            (acc["total"] + F.greatest(hi - F.greatest(p - (width - 1), acc["upto"] + 1, F.lit(0)) + 1, F.lit(0))).cast("long").alias("total"),
            F.greatest(hi, acc["upto"]).alias("upto"),
        )),
        lambda acc: acc["total"],
    )


class _Terms:
    """Numbers of all top terms, the later partners of each, and the terms of each model."""

    def __init__(self, models: Sequence[Topics]):
        self.terms = sorted({term for topics in models for terms in topics.values() for term in terms})
        self.number = {term: i for i, term in enumerate(self.terms)}
        partners: list[set[int]] = [set() for _ in self.terms]
        self.of_model = []
        for topics in models:
            self.of_model.append(sorted({self.number[t] for terms in topics.values() for t in terms}))
            for terms in topics.values():
                numbers = sorted({self.number[t] for t in terms})
                for i, one in enumerate(numbers):
                    partners[one].update(numbers[i + 1:])
        self.partners = [sorted(p) for p in partners]


def _document_cells(tokens: Column, known: _Terms, number_of, widths: Sequence[int | None]) -> Column:
    """Counts of one document as an array of ``struct(a, b, n0, n1, ...)``, one count per width.

    Terms stand as ``(a, a)``, pairs as ``(a, b)`` with a < b, the windows of model j as ``(-1 - j, -1 - j)``.
    """
    named = lambda counts: [c.cast("long").alias(f"n{i}") for i, c in enumerate(counts)]
    cell = lambda a, b, counts: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), *named(counts))

    def occurrences(t: Column) -> Column:
        placed = F.filter(F.transform(t, lambda x, p: F.struct(x.alias("t"), p.alias("p"))), lambda x: x["t"].isin(known.terms))
        return F.sort_array(F.transform(placed, lambda x: F.struct(number_of(x["t"]).alias("a"), x["p"].alias("p"))))

    def by_term(size: Column, found: Column) -> Column:
        """``struct(a, p, n0, ...)`` per term of the document: number, sorted positions, counts."""
        starts = F.filter(F.sequence(F.lit(0), F.size(found) - 1),
                          lambda i: (i == 0) | (F.get(found, i)["a"] != F.get(found, i - 1)["a"]))
        runs = let(starts, lambda s: F.zip_with(
            s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(found))),
            lambda start, end: F.struct(
                F.get(found, start)["a"].alias("a"),
                F.transform(F.slice(found, start + 1, end - start), lambda x: x["p"]).alias("p"))))
        counted = F.transform(runs, lambda r: F.struct(r["a"], r["p"], *named([_covered(r["p"], size, w) for w in widths])))
        none = F.array().cast("array<struct<a:int,p:array<int>" + "".join(f",n{i}:bigint" for i in range(len(widths))) + ">>")
        return F.when(F.size(found) > 0, counted).otherwise(none)

    def cells(size: Column, present: Column, numbers: Column) -> Column:
        windows = []
        for j, members in enumerate(known.of_model):
            relevant = F.arrays_overlap(_literal(members, "array<int>"), numbers)
            windows.append(cell(F.lit(-1 - j), F.lit(-1 - j), [
                F.lit(1) if w is None else F.when(relevant, F.greatest(size - (w - 1), F.lit(1))).otherwise(F.lit(0)) for w in widths]))
        singles = F.transform(present, lambda one: cell(one["a"], one["a"], [one[f"n{i}"] for i in range(len(widths))]))

        def pair(one: Column, two: Column) -> Column:
            return let(F.sort_array(F.concat(one["p"], two["p"])), lambda either: cell(one["a"], two["a"], [
                one[f"n{i}"] + two[f"n{i}"] - _covered(either, size, w) for i, w in enumerate(widths)]))

        def with_partners(one: Column) -> Column:
            partners = F.get(_literal(known.partners, "array<array<int>>"), one["a"])
            return F.transform(F.array_intersect(partners, numbers), lambda b: let(
                F.get(present, (F.array_position(numbers, b) - 1).cast("int")), lambda two: pair(one, two)))

        return F.concat(F.array(*windows), singles, F.flatten(F.transform(present, with_partners)))

    def counted(t: Column) -> Column:
        return let(F.size(t), lambda size: let(occurrences(t), lambda found: let(by_term(size, found), lambda present: let(
            F.transform(present, lambda one: one["a"]), lambda numbers: cells(size, present, numbers)))))

    return let(tokens, counted)


def count_pairs(
    docs: DataFrame, models: Sequence[Topics], widths: Sequence[int | None], tokens: str = "tokens"
) -> DataFrame:
    """``(model, a, b, n0, n1, ...)`` sums over all documents, one count per width, in one pass.

    ``model`` is null for terms (``a = b``) and pairs (``a < b``); the windows of a model stand with its
    position and null terms. ``None`` as width counts documents. Sliding windows are those of documents with at
    least one term of the model; a document shorter than the window is one window.
    """
    known = _Terms(models)
    spark = docs.sparkSession
    listed = _literal([{"t": t, "a": str(i)} for i, t in enumerate(known.terms)], "array<struct<t:string,a:string>>")
    found = inline_map(spark.range(1).select(F.inline(listed)), len(known.terms) + 1)
    column = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    cells = _document_cells(column, known, lambda t: found(t).cast("int"), widths)
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(widths))]
    summed = explode_rows(docs, [], cells, "x").select("x.*").groupBy("a", "b").agg(*sums)
    term = lambda c: F.when(F.col(c) >= 0, F.get(_literal(known.terms, "array<string>"), F.col(c)))
    return summed.select(
        F.when(F.col("a") < 0, -1 - F.col("a")).alias("model"), term("a").alias("a"), term("b").alias("b"),
        *[f"n{i}" for i in range(len(widths))])


def term_cooccurrence(
    docs: DataFrame, topics: Topics, window: int | None = None, tokens: str = "tokens"
) -> DataFrame:
    """``(topic_id, a, b, n)`` sums over all documents for one model and width.

    Terms: ``(-1, t, t)``. Pairs: ``(topic, a, b)`` with a < b. Windows: ``(-1, '', '')``.
    """
    counts = stage(count_pairs(docs, [topics], [window], tokens).withColumnRenamed("n0", "n"), "cooccurrence")
    alone = counts.filter("a IS NULL OR a = b").select(
        F.lit(NO_TOPIC).alias("topic_id"), F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"), "n")
    ranked = _ranked_terms(docs, topics)
    first, second = (ranked.select("topic_id", F.col("term").alias(c)) for c in ("a", "b"))
    pairs = counts.filter("a < b").join(first, "a").join(second, ["topic_id", "b"]).select("topic_id", "a", "b", "n")
    return alone.unionByName(pairs).filter("n > 0")


def top_term_lists(phi: DataFrame, topn: int = TOP_TERMS) -> dict[int, list[str]]:
    """Top terms per topic on the driver: topics x ``topn`` strings."""
    rows = topic_terms(phi, topn).orderBy("topic_id", "rank").collect()
    topics: dict[int, list[str]] = {}
    for row in rows:
        topics.setdefault(int(row["topic_id"]), []).append(row["term"])
    return topics


def _ranked_terms(docs: DataFrame, topics: dict[int, list[str]]) -> DataFrame:
    """``(topic_id, rank, term)`` from a literal, so that Spark knows how small it is."""
    rows = [
        {"topic_id": k, "rank": i + 1, "term": term} for k, terms in topics.items() for i, term in enumerate(terms)
    ]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<topic_id:int,rank:int,term:string>>")
    return docs.sparkSession.range(1).select(F.inline(listed))


def _pair_grid(counts: DataFrame, topics: Topics, model: int = 0, width: int = 0) -> DataFrame:
    """All ordered pairs of top terms of a topic (a term with itself too), with probabilities.

    ``counts`` are those of :func:`count_pairs`, stored; ``width`` is the position of the window width in them.
    """
    counts = counts.withColumnRenamed(f"n{width}", "n")
    n_windows = counts.filter(F.col("model") == model).select(F.max("n")).scalar()
    singles = counts.filter("a = b")
    pairs = counts.filter("a < b").select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("n").alias("n_pair"))
    ranked = _ranked_terms(counts, topics)
    first = ranked.select("topic_id", F.col("rank").alias("rank_a"), F.col("term").alias("w_a"))
    second = ranked.select("topic_id", F.col("rank").alias("rank_b"), F.col("term").alias("w_b"))
    return (
        first.join(second, "topic_id")
        .withColumn("low", F.least("w_a", "w_b"))
        .withColumn("high", F.greatest("w_a", "w_b"))
        .join(pairs, ["low", "high"], "left")
        .join(singles.select(F.col("a").alias("w_a"), F.col("n").alias("n_a")), "w_a", "left")
        .join(singles.select(F.col("a").alias("w_b"), F.col("n").alias("n_b")), "w_b", "left")
        .withColumn("total", n_windows)
        .select(
            "topic_id", "rank_a", "rank_b", "w_a", "w_b",
            (F.coalesce("n_a", F.lit(0)) / F.col("total")).alias("p_a"),
            (F.coalesce("n_b", F.lit(0)) / F.col("total")).alias("p_b"),
            (F.when(F.col("w_a") == F.col("w_b"), F.coalesce("n_a", F.lit(0)))
             .otherwise(F.coalesce("n_pair", F.lit(0))) / F.col("total")).alias("p_ab"),
        )
    )


def _pmi() -> Column:
    both = F.col("p_a") * F.col("p_b")
    return F.when(both == 0, F.lit(0.0)).otherwise(F.log((F.col("p_ab") + F.lit(EPSILON)) / both))


def _npmi() -> Column:
    return _pmi() / -F.log(F.col("p_ab") + F.lit(EPSILON))


def coherence_by_topic(
    docs: DataFrame, phi: DataFrame, measure: str = "c_v", topn: int = TOP_TERMS, window: int | None = None
) -> DataFrame:
    """``(topic_id, coherence)`` for one of ``c_v``, ``c_uci``, ``c_npmi``, ``u_mass``."""
    return coherence_of_lists(docs, top_term_lists(phi, topn), measure, window)


def coherence_of_lists(
    docs: DataFrame, topics: dict[int, list[str]], measure: str = "c_v", window: int | None = None
) -> DataFrame:
    width = None if measure == "u_mass" else (window or WINDOWS[measure])
    counts = stage(count_pairs(docs, [topics], [width]), "cooccurrence")
    return _measured(_pair_grid(counts, topics), measure)


def _measured(grid: DataFrame, measure: str) -> DataFrame:
    if measure == "u_mass":
        value = F.log((F.col("p_ab") + F.lit(EPSILON)) / F.col("p_b"))
        scored = grid.filter("rank_b < rank_a").withColumn("value", F.when(F.col("p_b") > 0, value).otherwise(0.0))
    elif measure == "c_uci":
        scored = grid.filter("rank_a <> rank_b").withColumn("value", _pmi())
    elif measure == "c_npmi":
        scored = grid.filter("rank_a <> rank_b").withColumn("value", _npmi())
    else:
        scored = _context_cosines(grid)
    return scored.groupBy("topic_id").agg(F.avg("value").alias("coherence"))


def _context_cosines(grid: DataFrame) -> DataFrame:
    """Cosine of every term's NPMI vector to the sum of all vectors of its topic."""
    vectors = grid.withColumn("v", _npmi()).groupBy("topic_id", "w_a").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank_b", "v"))), lambda x: x["v"]).alias("v")
    )
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    summed = vectors.groupBy("topic_id").agg(F.collect_list("v").alias("all")).select(
        "topic_id",
        F.transform(
            F.get("all", F.lit(0)),
            lambda _, i: F.aggregate(F.col("all"), F.lit(0.0), lambda s, v: s + F.get(v, i)),
        ).alias("w"),
    )
    size = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("w"), F.col("w")))
    return vectors.join(summed, "topic_id").select(
        "topic_id", F.when(size > 0, dot(F.col("v"), F.col("w")) / size).otherwise(0.0).alias("value")
    )


def coherence(docs: DataFrame, phi: DataFrame, measure: str = "c_v", topn: int = TOP_TERMS) -> DataFrame:
    """One row: the mean of the topic coherences."""
    return coherence_by_topic(docs, phi, measure, topn).agg(F.avg("coherence").alias("coherence"))


def coherence_of_models(
    docs: DataFrame, models: Sequence[Topics], measures: Sequence[str] = MEASURES
) -> list[DataFrame]:
    """For each model one row with a column per measure; all come from one pass over the documents."""
    widths = list(dict.fromkeys(WINDOWS.get(measure) for measure in measures))
    counts = stage(count_pairs(docs, models, widths), "cooccurrence")
    rows = []
    for j, topics in enumerate(models):
        means = [
            _measured(_pair_grid(counts, topics, j, widths.index(WINDOWS.get(measure))), measure)
            .agg(F.avg("coherence")).scalar().alias(f"coherence_{measure}") for measure in measures
        ]
        rows.append(docs.sparkSession.range(1).select(*means))
    return rows


def coherence_all(docs: DataFrame, phi: DataFrame, topn: int = TOP_TERMS) -> DataFrame:
    """One row with ``c_v``, ``c_uci``, ``c_npmi`` and ``u_mass``, from one pass over the documents."""
    return coherence_of_models(docs, [top_term_lists(phi, topn)])[0]
