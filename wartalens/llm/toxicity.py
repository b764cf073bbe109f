"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms of a text are its words and the beginnings of its words. A term that at least ``least_share``
of the labelled examples hold counts in every vector, whatever the labels say of it; weights are counts times
inverse document frequency, vectors have length 1. The examples are held in an inverted index cut into
blocks with the largest weight of every term per block. A query adds up the block bounds, opens blocks from
the highest bound down and stops when no unopened block can reach the k-th best example: the
neighbours are exact. They vote by squared similarity. How often a vote is right is learned from the
examples themselves, each voted on by the others (isotonic curve), so scores are probabilities. The
neighbours and the terms shared with the toxic ones are the evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from wartalens.llm.common import prepare_python, quoted
from wartalens.llm.decontaminate import DELIMITERS
from wartalens.session import stage

EXAMPLES = 2_000                      # expected number of labelled documents the classifier is fitted on
LEAST_SHARE = 0.01                    # part of the examples that must hold a term (two examples at least)
NEIGHBOURS = 16
BLOCK = 256
STARTS = (4, 5, 6, 7)                 # lengths of word beginnings
RESULT = "score double, neighbours array<bigint>, terms array<string>"
REMEMBERED = 50_000                   # results of repeated texts kept per process
SLICE_BYTES = 2 << 20                 # text whose words are looked up at a time


def delimited(text: str | None) -> bytes:
    """The words of a text, spaces between them."""
    return text.lower().encode("utf-8", "replace").translate(DELIMITERS) if text else b""


def words(text: str | None) -> list[bytes]:
    return delimited(text).split()


def word_terms(word: bytes) -> list[str]:
    """The word, and its beginnings, marked."""
    w = word.decode("utf-8", "replace")
    return [w, *(f"^{w[:k]}" for k in STARTS if k < len(w))]


@dataclass
class Model:
    """Terms with weights, examples as rows of one sparse matrix, and the curve from vote to score."""

    terms: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: example ``i`` holds ``numbers[ends[i]:ends[i + 1]]`` with the weights at the same places
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    numbers: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    toxic: np.ndarray = field(default_factory=lambda: np.empty(0, np.int8))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: score of a text that no example resembles, and of every text where labels are all alike
    rate: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[i], self.ends[i + 1])
        return self.numbers[part], self.weights[part]

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF vector of length 1 from the counts of all terms: those found, ascending, and their weights."""
        numbers = np.flatnonzero(counts)
        raw = counts[numbers] * self.idf[numbers]
        length = math.sqrt(float(raw @ raw))
        return numbers, raw / length if length else raw


class BlockMaxIndex:
    """Exact top-k by inner product over sparse examples."""

    def __init__(self, rows: list[tuple], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(rows), block
        self.n_blocks = -(-self.n // block)
        terms = np.concatenate([np.empty(0, np.int64), *(np.asarray(numbers, np.int64) for numbers, _ in rows)])
        weights = np.concatenate([np.empty(0), *(np.asarray(own, np.float64) for _, own in rows)])
        examples = np.repeat(np.arange(self.n), [len(numbers) for numbers, _ in rows])
        order = np.lexsort((examples, terms))
        self.ids, self.weights = examples[order], weights[order]
        # postings lie by term and example; a cell is the part of a term's list inside one block
        cells = terms[order] * self.n_blocks + self.ids // block
        self.starts = np.searchsorted(cells, np.arange(n_terms * self.n_blocks + 1))
        most = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(most, cells, self.weights)
        self.most = most.reshape(n_terms, self.n_blocks)
        self.opened = 0

    def _open(self, numbers: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the ``chosen`` blocks with a score, and their scores."""
        cells = (numbers[:, None] * self.n_blocks + chosen).ravel()
        low = self.starts[cells]
        sizes = self.starts[cells + 1] - low
        place = np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        place += np.arange(len(place))
        share = self.weights[place]
        share *= np.repeat(np.repeat(weights, len(chosen)), sizes)
        score = np.bincount(self.ids[place], share, self.n)
        found = np.flatnonzero(score)
        return found, np.round(score[found], 9)

    @staticmethod
    def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest scores, falling, ties by id."""
        if len(ids) > k:                   # only what reaches the k-th score is sorted
            kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[kept], scores[kept]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]

    def search(self, numbers: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` best ``(score, example)`` with a score above 0, ties by example number."""
        terms, own = np.asarray(numbers, np.int64), np.asarray(weights, np.float64)
        bound = own @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        ids, scores = np.empty(0, np.int64), np.empty(0)
        at, step, end = 0, 4, int(np.count_nonzero(bound > 0))
        while at < end:
            if len(ids) == k:              # a block whose bound is below the k-th score can't change the result
                end = at + int(np.count_nonzero(bound[at:end] >= scores[-1] - 1e-9))
            chosen = order[at:min(at + step, end)]
            if not len(chosen):
                break
            more, worth = self._open(terms, own, chosen)
            ids, scores = self._best(np.concatenate([ids, more]), np.concatenate([scores, worth]), k)
            self.opened += len(chosen)
            at, step = at + step, step * 2
        return list(zip(scores.tolist(), ids.tolist(), strict=True))


class Scorer:
    """Scores of texts under a model. Built once a task (0.2 s): workers outlive a stage, and its memory should not."""

    def __init__(self, model: Model):
        self.model = model
        self.names = list(model.terms)
        self.index = BlockMaxIndex([model.example(i) for i in range(len(model.keys))], len(model.terms))
        named = np.asarray(self.names, object)
        begins = np.asarray([t[0] == "^" for t in self.names], bool)
        #: words, and beginnings without their mark: the strings and the number of each term
        self.whole = pa.array(named[~begins], pa.large_string()), np.append(np.flatnonzero(~begins), -1)
        self.beginnings = pa.array([t[1:] for t in named[begins]], pa.large_string()), np.append(np.flatnonzero(begins), -1)
        self.seen: dict[bytes, tuple[float, list[int], list[str]]] = {}

    def _numbers(self, words: pa.LargeStringArray) -> np.ndarray:
        """Terms of each word, one row a word: its beginnings and the word itself, -1 where a term is not known."""
        def look(strings: pa.LargeStringArray, known: tuple[pa.LargeStringArray, np.ndarray]) -> np.ndarray:
            terms, number = known
            return number[pc.fill_null(pc.index_in(strings, value_set=terms, skip_nulls=True), -1).to_numpy()]

        lengths = pc.utf8_length(words).to_numpy()
        columns = [
            np.where(lengths > k, look(pc.utf8_slice_codeunits(words, 0, k), self.beginnings), -1) for k in STARTS]
        return np.stack([*columns, look(words, self.whole)], axis=1)

    def counts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Counts of all known terms in each of the texts, which are taken in slices of about ``SLICE_BYTES``.

        Arrow cuts the texts of a slice and numbers their different words, so that a word is looked up once a slice.
        """
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < SLICE_BYTES):
                part.append(delimited(texts[at]))
                size += len(part[-1])
                at += 1
            yield from self._slice_counts(part)

    def _slice_counts(self, part: list[bytes]) -> Iterator[np.ndarray]:
        cut = pc.split_pattern(pa.array(part, pa.large_binary()).cast(pa.large_string()), " ")
        numbered, n_words = cut.flatten().dictionary_encode(), cut.value_lengths().to_numpy()
        known = self._numbers(numbered.dictionary)
        sizes, flat = (known >= 0).sum(axis=1), known[known >= 0]
        kind = numbered.indices.to_numpy()
        taken = sizes[kind]
        upto = np.cumsum(taken)
        found = np.repeat((np.cumsum(sizes) - sizes)[kind] - (upto - taken), taken)
        found += np.arange(len(found))
        found = flat[found]
        edges = np.append(0, upto)[np.append(0, np.cumsum(n_words))]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield np.bincount(found[low:high], minlength=len(self.names))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the toxic ones among the neighbours, by squared similarity; 0 without any."""
        total = sum(s * s for s, _ in near)
        return sum(s * s for s, i in near if self.model.toxic[i]) / total if total else 0.0

    def without(self, example: int) -> float:
        """Vote of the other examples on one of them."""
        near = self.index.search(*self.model.example(example), NEIGHBOURS + 1)
        return self.vote([(s, i) for s, i in near if i != example][:NEIGHBOURS])

    def _shared(self, numbers: np.ndarray, weights: np.ndarray, near: list[tuple[float, int]]) -> list[str]:
        """The five terms that say most of the likeness to toxic neighbours."""
        theirs = np.zeros(len(self.names))
        for similarity, i in near:
            if self.model.toxic[i]:
                terms, own = self.model.example(i)
                theirs[terms] += similarity * own
        worth = weights * theirs[numbers]
        best = np.argsort(-worth, kind="stable")[:5]
        return [self.names[numbers[b]] for b in best if worth[b] > 0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """Score, nearest examples and terms of each text; a text seen before is not scored again."""
        if self.model.curve is None:
            return [(self.model.rate, [], [])] * len(texts)
        marks = [xxh3_128_digest(t.encode("utf-8", "replace")) if t else None for t in texts]
        found = {m: self.seen.get(m) for m in marks}
        found[None] = self.model.rate, [], []
        new = {m: t for m, t in zip(marks, texts, strict=True) if found[m] is None}
        for mark, counts in zip(new, self.counts(list(new.values())), strict=True):
            found[mark] = self._score(counts)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[mark] = found[mark]
        return [found[m] for m in marks]

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        return self.scores([text])[0]

    def _score(self, counts: np.ndarray) -> tuple[float, list[int], list[str]]:
        model = self.model
        numbers, weights = model.vector(counts)
        near = self.index.search(numbers, weights, NEIGHBOURS) if len(numbers) else []
        if not near:
            return model.rate, [], []
        return scored(self.vote(near), model.curve), [int(model.keys[i]) for _, i in near[:5]], self._shared(numbers, weights, near)


def scored(vote: float, curve: tuple[np.ndarray, np.ndarray]) -> float:
    """Score of a vote: the curve between its knots, and a thousandth of the vote to keep apart what the curve joins."""
    return 0.999 * float(np.interp(vote, *curve)) + 0.001 * vote


def calibrated(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve of the label over the vote: neighbouring votes are pooled while their rates fall (isotonic regression).

    Knots are the mean vote and the rate of each pool, rates drawn to one half by half an example of each label.
    """
    pools: list[list[float]] = []                  # examples, sum of votes, toxic ones
    for vote in np.unique(votes):
        same = votes == vote
        pools.append([float(same.sum()), float(votes[same].sum()), float(toxic[same].sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    at = np.asarray(pools)
    return at[:, 1] / at[:, 0], np.maximum.accumulate((at[:, 2] + 0.5) / (at[:, 0] + 1.0))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(quoted(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label_key: str = "doc_id",
        label: str = "toxic", examples: int = EXAMPLES, least_share: float = LEAST_SHARE) -> Model:
    """Model from labelled documents that are not held out.

    Fitted on a sample of about ``examples`` labelled keys, drawn by hash (all, if fewer); the sample of
    keys is broadcast, its size being bounded by that parameter, so no text is shuffled. Null keys
    and labels are left out, a key labelled twice takes its highest label. Equal texts are one
    example with the highest label, so that copies don't outvote others; texts without a frequent term are none.
    Where all labels are alike every text scores their rate, without labels 0.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    marks = labels.select(quoted(label_key).alias("_key"), quoted(label).cast("int").alias("_label")).filter(
        "_key is not null and _label is not null").filter(~held_out("_key"))
    total = marks.count()
    share = min(1.0, examples / total) if total else 1.0
    drawn = stage(
        marks.filter(F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit("examples")), F.lit(1 << 30)) < int(share * (1 << 30)))
        .groupBy("_key").agg(F.max("_label").alias("_label")), "toxic-sample")
    sample = stage(
        docs.select(quoted(key).alias("_id"), quoted(text).cast("string").alias("_text"))
        .join(F.broadcast(drawn), F.col("_id") == F.col("_key"))
        .groupBy(F.coalesce("_text", F.lit("")).alias("text"))
        .agg(F.min(F.col("_id").cast("bigint")).alias("id"), F.max("_label").alias("label"))
        .select("id", "text", "label"), "toxic-examples")
    rows, bad = sample.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if not 0 < bad < rows:
        return Model(rate=bad / rows if rows else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for content in batch.column(0).to_pylist():
                seen.update({t for w in set(words(content)) for t in word_terms(w)})
        terms = list(seen)
        for i in range(0, len(terms), 50_000):
            part = terms[i:i + 50_000]
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(part, pa.string()), "n": pa.array([seen[t] for t in part], pa.int64())})

    chosen = (
        sample.select("text").mapInArrow(count, "term string, n bigint")
        .groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, math.ceil(least_share * rows)))
        .toArrow().sort_by("term").to_pydict()
    )
    model = Model(
        terms={t: i for i, t in enumerate(chosen["term"])}, rate=bad / rows,
        idf=np.asarray([math.log((1 + rows) / (1 + n)) + 1e-3 for n in chosen["n"]], np.float64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [model.vector(counts) for counts in scorer.counts(batch.column(1).to_pylist())]
            # examples whose heaviest terms are the same lie together, which keeps block bounds low
            heavy = [n[np.lexsort((n, -w))[:3]] for n, w in found]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "label": batch.column(2),
                "place": pa.array(heavy, pa.list_(pa.int32())),
                "terms": pa.array([n for n, _ in found], pa.list_(pa.int32())),
                "weights": pa.array([np.round(w, 9) for _, w in found], pa.list_(pa.float64())),
            })

    # the sample and the terms bound this table
    placed = sample.mapInArrow(
        vectors, "id bigint, label int, place array<int>, terms array<int>, weights array<double>").filter("size(terms) > 0")
    table = placed.orderBy("place", "id").select("id", "label", "terms", "weights").toArrow().combine_chunks()
    lengths = np.asarray([len(t) for t in table["terms"]], np.int64)
    model.ends = np.concatenate([[0], np.cumsum(lengths)])
    model.numbers = _flat(table["terms"], np.int32)
    model.weights = _flat(table["weights"], np.float64)
    model.toxic = (table["label"].to_numpy() > 0).astype(np.int8)
    model.keys = table["id"].to_numpy()
    if not 0 < model.toxic.sum() < len(model.toxic):
        return Model(rate=bad / rows)
    shared = spark.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "vote": pa.array([scorer.without(i) for i in batch.column(0).to_pylist()], pa.float64())})

    voted = spark.range(len(model.keys)).mapInArrow(votes, "id bigint, vote double").toArrow().sort_by("id")
    model.curve = calibrated(voted["vote"].to_numpy(), model.toxic.astype(np.float64))
    model.rate = min(model.rate, scored(0.0, model.curve))
    return model


def _flat(lists: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks)]).astype(kind)


def score_column(text: Column, model: Model, spark) -> Column:
    """Struct ``score, neighbours, terms`` of a text. Null and empty texts, and those without a known term, score ``rate``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for series in batches:
            yield pd.DataFrame(scorer.scores(list(series)), columns=["score", "neighbours", "terms"])

    return score(text.cast("string"))


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, terms`` for every row, repeated keys and nulls included."""
    spark = docs.sparkSession
    prepare_python(spark)
    narrow = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"))
    found = narrow.withColumn("found", score_column(F.col("text"), model, spark))
    return found.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "found.score",
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.neighbours", "found.terms")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows that score under ``threshold``; columns stay as they are. Null and empty texts score low and stay."""
    prepare_python(docs.sparkSession)
    return docs.filter(score_column(quoted(text), model, docs.sparkSession)["score"] < threshold)
