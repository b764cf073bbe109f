"""LDA training over a grid of topic counts, phi and theta tables."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.ml.clustering import LDA as SparkLDA
from pyspark.ml.clustering import LDAModel, LocalLDAModel
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wartalens.functions.arrays import let

PASS_UPDATES = 2              # updates a pass at most, whatever the number of documents
BLOCK_DOCS = 4096             # documents of a packed block at most
BLOCK_ENTRIES = 2**20         # words of a packed block, unless one document has more
GROUP_CELLS = 2**18           # cells of the documents that are inferred together (2 MB)
CHUNK_CELLS = 2**17           # cells of the word sums that travel together (1 MB)
GAMMA_SHAPE = 100.0           # spread of the random start, as in Spark
PACKED = "block long, size int, sizes binary, words binary, counts binary"


def asymmetric_prior(k: int) -> list[float]:
    """Document prior falling with the topic number, normalised to 1."""
    raw = [1.0 / (i + math.sqrt(k)) for i in range(k)]
    return [x / sum(raw) for x in raw]


def training_vectors(vectors: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """Pin the row layout: online LDA draws mini-batches by partition and position.

    The number of partitions follows from the number of documents alone, so the draws are the same on
    any number of cores: one per 500 documents up to 64, then one per 20,000.
    """
    partitions = max(1, min(64, math.ceil(n_docs / 500)), math.ceil(n_docs / 20_000))
    return vectors.select(key, "features").repartition(partitions, key).sortWithinPartitions(key)


def _inference():
    """``exp(digamma)`` and the variational inference of documents (the digamma's error is under 1e-9).

    Made here, so that they travel with the tasks that use them.
    """
    cells = GROUP_CELLS

    def exp_digamma(x):
        u = x * (x + 5.0)                                    # 1/x + ... + 1/(x+5), first with last
        a, b, y = u + 4.0, u + 6.0, x + 5.5
        ab = a * b
        steps = (x + y - 0.5) * (ab + u * (a + b)) / (u * ab)
        z = 1.0 / (y * y)
        series = 1.0 + z * (1 / 24 - z * (37 / 5760 - z * (10313 / 2903040 - z * (5509121 / 1393459200))))
        return y * series * np.exp(-steps)

    def settle(table, counts, alpha, x, reach, rounds, least):
        """Rounds of Spark's update until one moves a document's mean parameter by 1e-3 or less.

        Gives the parameters, how far they may be extrapolated, the rounds so far and who has settled; it
        returns once ``least`` or fewer documents are left. After every two rounds the parameters go on along
        their way (squared extrapolation), so that slow documents take fewer rounds. Past 2,000 rounds they
        only take rounds, which never lead away.
        """
        found, far, done = x.copy(), reach.copy(), np.zeros(len(x), bool)
        rows, waiting, most = np.arange(len(x)), np.ones(len(x), bool), 1e-3 * len(alpha)

        def once(x):
            theta = exp_digamma(x)
            share = counts / (np.matmul(theta[:, None, :], table)[:, 0, :] + 1e-100)
            return alpha + theta * np.matmul(table, share[:, :, None])[:, :, 0]

        def left(moved, x):
            now = (np.add.reduce(np.abs(moved), axis=1) <= most) & waiting
            if now.any():
                found[rows[now]], done[rows[now]], waiting[now] = x[now], True, False
            return np.count_nonzero(waiting)

        while True:
            x1 = once(x)
            d1 = x1 - x
            still = left(d1, x1)
            if still and rounds < 2000:
                if still <= 0.75 * len(rows):
                    rows, x, x1, d1, table, counts, reach = (part[waiting] for part in (rows, x, x1, d1, table, counts, reach))
                    waiting = np.ones(still, bool)
                x2 = once(x1)
                d2 = x2 - x1
                still = left(d2, x2)
                if rounds:
                    bend = d2 - d1
                    wanted = np.sqrt(np.add.reduce(d1 * d1, 1) / np.maximum(np.add.reduce(bend * bend, 1), 1e-300))[:, None]
                    length = np.clip(wanted, 1.0, reach)
                    x = x + 2.0 * length * d1 + length * length * bend
                    outside = (x < alpha).any(axis=1, keepdims=True)
                    if outside.any():
                        x = np.where(outside, x2, x)
                    reach = np.where(outside, np.maximum(length / 2.0, 1.0), np.where(wanted >= reach, reach * 4.0, reach))
                else:                                        # the first round brings the sum, the others keep it
                    x = x2
            else:
                x = x1
            rounds += 2
            if still <= least:
                found[rows[waiting]], far[rows[waiting]] = x[waiting], reach[waiting]
                return found, far, rounds, done

    def infer(words, counts, sizes, table, alpha, start):
        """Parameters of documents with a word each, and every word's count over its weight; ``start`` a row a document.

        Documents of about one size are worked on together; the slow ones of all groups meet again in new groups.
        """
        firsts, waiting, k = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable"), len(alpha)
        gamma, reach, shares, rounds, looser = start.copy(), np.ones((len(sizes), 1)), np.empty(len(words)), 0, 1.25
        while len(waiting):
            at, slow, passed = 0, [], rounds
            while at < len(waiting):
                docs = waiting[at:at + 512]
                widths = sizes[docs]
                fits = (widths * np.arange(1, len(docs) + 1) * k <= cells) & (widths <= looser * widths[0] + 8)
                docs = docs[:max(1, np.count_nonzero(fits))]
                at += len(docs)
                place = np.arange(sizes[docs[-1]])
                real = place < sizes[docs][:, None]
                cell = np.where(real, firsts[docs][:, None] + place, 0)
                given = np.where(real, counts[cell], 0.0)
                weights = np.ascontiguousarray(table[words[cell]].transpose(0, 2, 1))
                least = len(docs) // 5 if len(waiting) > 16 else 0
                gamma[docs], reach[docs], now, done = settle(weights, given, alpha, gamma[docs], reach[docs], rounds, least)
                passed = max(passed, now)
                theta = exp_digamma(gamma[docs])
                share = given / (np.matmul(theta[:, None, :], weights)[:, 0, :] + 1e-100)
                real &= done[:, None]
                shares[cell[real]] = share[real]
                slow.append(docs[~done])
            slow = np.concatenate(slow)
            waiting, rounds, looser = slow[np.argsort(sizes[slow], kind="stable")], passed, 2.0
        return gamma, shares

    return exp_digamma, infer


def _sparse(features: str) -> Column:
    """``struct(size, indices, values)`` of a vector column; a dense vector names no indices, so it gets them."""
    def parts(raw: Column) -> Column:
        every = F.transform(raw["values"], lambda _, i: i)
        return F.struct(
            F.coalesce(raw["size"], F.size(raw["values"])).alias("size"),
            F.coalesce(raw["indices"], every).alias("indices"), raw["values"].alias("values"))

    return let(F.unwrap_udt(features), parts)


def packed_documents(vectors: DataFrame, features: str = "features") -> DataFrame:
    """``(block, size, sizes, words, counts)``: documents of a partition in blocks of plain numbers, in their order.

    ``sizes`` has the words of every document, empty ones too: they are drawn like others. Counts that are
    small whole numbers take a byte each.
    """
    most_docs, most_entries = BLOCK_DOCS, BLOCK_ENTRIES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names = TaskContext.get().partitionId() << 32, ["block", "size", "sizes", "words", "counts"]
        for batch in batches:
            lists, values = batch.column("indices"), batch.column("values")
            ends = np.cumsum(lists.value_lengths().to_numpy())
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                to = min(at + most_docs, max(at + 1, int(np.searchsorted(ends, before + most_entries, "right"))))
                counts = values.slice(at, to - at).flatten().to_numpy()
                words = lists.slice(at, to - at).flatten().to_numpy()
                doc = np.repeat(np.arange(to - at), np.diff(ends[at:to], prepend=before))
                if not counts.all():
                    words, doc, counts = words[counts != 0], doc[counts != 0], counts[counts != 0]
                small = counts.astype(np.uint8) if len(counts) == 0 or (counts.min() >= 0 and counts.max() < 256) else counts
                small = small if (small == counts).all() else counts
                sizes = np.bincount(doc, minlength=to - at).astype(np.int32)
                size = int(batch.column("size")[at].as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([size], pa.int32()), pa.array([sizes.tobytes()], pa.binary()),
                    pa.array([words.astype(np.int32).tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())], names)
                number, at = number + 1, to

    rows = vectors.select(_sparse(features).alias("_v")).select("_v.size", "_v.indices", "_v.values")
    return rows.mapInArrow(pack, PACKED)


class LDA(SparkLDA):
    """Spark's online LDA, with the documents' inference in batches of documents.

    Draws (with replacement), updates, learning rate, priors, start and stopping rule are Spark's; the model is a
    Spark model. A task draws from its blocks of :func:`packed_documents`, infers what it drew and adds up one table of
    topic by word sums, which travels in pieces and is added piece by piece. Random numbers follow from the seed, the
    update and the block. Other optimizers and a learned document prior are left to Spark.
    """

    def _fit(self, dataset: DataFrame) -> LDAModel:
        if self.getOptimizer() != "online" or self.getOptimizeDocConcentration() or not self.isDefined("docConcentration"):
            return super()._fit(dataset)
        own = dataset.columns != [part.split()[0] for part in PACKED.split(", ")]
        packed = packed_documents(dataset, self.getFeaturesCol()).persist() if own else dataset
        try:
            return self._model(packed, self._topics(packed))
        finally:
            if own:
                packed.unpersist()

    def _topics(self, packed: DataFrame) -> np.ndarray:
        """Topic by word parameters after all updates."""
        spark, k, seed = packed.sparkSession, self.getK(), self.getSeed() & (2**63 - 1)
        size, n_docs = packed.agg(F.max("size"), F.sum(F.octet_length("sizes") / 4)).first()
        if size is None:
            raise ValueError("no documents to fit a model to")
        rate, tau, kappa = self.getSubsamplingRate(), self.getLearningOffset(), self.getLearningDecay()
        alpha, eta = np.array(self.getDocConcentration()), self.getTopicConcentration()
        scale = n_docs / max(1, math.ceil(rate * n_docs))
        exp_digamma, _ = _inference()
        topics = np.random.default_rng(seed).gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, (k, size))
        rows = packed.coalesce(spark.sparkContext.defaultParallelism)
        for update in range(1, self.getMaxIter() + 1):
            weights = exp_digamma(topics) / exp_digamma(topics.sum(axis=1, keepdims=True))
            sums = self._sums(rows, weights, alpha, rate, [seed, update])
            if sums is not None:
                pace = (tau + update) ** -kappa
                topics = (1 - pace) * topics + pace * (sums * weights * scale + eta)
        return topics

    @staticmethod
    def _sums(rows: DataFrame, weights: np.ndarray, alpha: np.ndarray, rate: float, seed: list[int]) -> np.ndarray | None:
        """Topic by word sums of the documents of one update; None if it drew no word."""
        (k, size), shape, enough = weights.shape, GAMMA_SHAPE, BLOCK_ENTRIES
        shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T))
        wide = max(1, CHUNK_CELLS // k)                      # words of a piece
        pieces = max(1, math.ceil(size / wide))
        exp_digamma, infer = _inference()

        def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            """Words, counts, words of each document and its start: what a block's documents drew."""
            for batch in batches:
                for row in range(batch.num_rows):
                    block, _, sizes, words, counts = (column[row].as_py() for column in batch.columns)
                    rng = np.random.default_rng([*seed, block >> 32, block & (2**32 - 1)])
                    sizes, words = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(words, np.int32)
                    counts = np.frombuffer(counts, np.uint8 if len(counts) == len(words) else np.float64)
                    docs = np.repeat(np.arange(len(sizes)), rng.poisson(rate, len(sizes)))
                    docs = docs[sizes[docs] > 0]
                    if len(docs):
                        firsts, sizes = (np.cumsum(sizes) - sizes)[docs], sizes[docs]
                        ends = np.cumsum(sizes)
                        cells = np.arange(ends[-1]) + np.repeat(firsts - ends + sizes, sizes)
                        yield words[cells], counts[cells].astype(np.float64), sizes, rng.gamma(shape, 1.0 / shape, (len(docs), k))

        def together(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
            """Draws of several blocks, up to about :data:`BLOCK_ENTRIES` words."""
            held = []
            for part in parts:
                held.append(part)
                if sum(len(words) for words, *_ in held) >= enough:
                    yield [np.concatenate(column) for column in zip(*held)]
                    held = []
            if held:
                yield [np.concatenate(column) for column in zip(*held)]

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, sums = shared.value, None
            for words, counts, sizes, start in together(draws(batches)):
                gamma, shares = infer(words, counts, sizes, table, alpha, start)
                theta = exp_digamma(gamma)
                sums = np.zeros((k, size)) if sums is None else sums
                for topic in range(k):
                    sums[topic] += np.bincount(words, shares * np.repeat(theta[:, topic], sizes), size)
            if sums is not None:
                for piece in range(pieces):
                    part = sums[:, piece * wide:(piece + 1) * wide].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.binary())], ["piece", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for batch in batches:
                for piece, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(part.as_buffer(), np.float64)
                    total[piece] = total[piece] + part if piece in total else part.copy()
            for piece, part in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["piece", "sums"])

        form = "piece int, sums binary"
        found = rows.mapInArrow(drawn, form).repartition(pieces, "piece").mapInArrow(added, form).collect()
        shared.destroy()
        if not found:
            return None
        parts = [np.frombuffer(row["sums"], np.float64).reshape(k, -1) for row in sorted(found, key=lambda row: row["piece"])]
        return np.concatenate(parts, axis=1)

    def _model(self, packed: DataFrame, topics: np.ndarray) -> LDAModel:
        """The Spark model of the parameters."""
        spark = packed.sparkSession
        context, jvm = spark.sparkContext, spark.sparkContext._jvm
        k, size = topics.shape
        stored = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(
            _py2java(context, DenseMatrix(size, k, topics.ravel())),      # columns are topics
            _py2java(context, DenseVector(self.getDocConcentration())), float(self.getTopicConcentration()), GAMMA_SHAPE)
        model = LocalLDAModel(jvm.org.apache.spark.ml.clustering.LocalLDAModel(self.uid, size, stored, spark._jsparkSession))
        model = self._copyValues(model)
        model._transfer_params_to_java()
        return model


def train_lda(
    vectors: DataFrame,
    n_docs: int,
    num_topics: int = 20,
    passes: int = 10,
    chunksize: int = 2000,
    seed: int = 42,
) -> LDAModel:
    """Online variational LDA: ``passes * n_docs`` documents are drawn, ``chunksize`` of them an update or more.

    Spark draws every mini-batch at random, with replacement: a "pass" is as many draws as there are
    documents, not a walk over the corpus. Each draw walks the whole table and each update moves topic by word
    sums of every partition, so a pass has at most :data:`PASS_UPDATES` updates: beyond that many chunks an
    update takes several chunks, as distributed trainers take one of every worker. So time grows with the
    documents, not with their square.
    """
    batch = max(chunksize, math.ceil(n_docs / PASS_UPDATES))
    updates = max(1, passes * math.ceil(n_docs / batch))
    lda = LDA(
        k=num_topics,
        maxIter=updates,
        optimizer="online",
        seed=seed,
        subsamplingRate=min(1.0, batch / max(n_docs, 1)),
        learningOffset=1.0,
        learningDecay=0.5,
        optimizeDocConcentration=False,
        docConcentration=asymmetric_prior(num_topics),
        topicConcentration=1.0 / num_topics,
        featuresCol="features",
    )
    return lda.fit(vectors)


def fit_grid(
    vectors: DataFrame, n_docs: int, ks: Sequence[int] = (10, 15, 20, 25), parallelism: int = 2, **options
) -> list[tuple[int, LDAModel, float]]:
    """One model per K on the same documents, packed once; ``parallelism`` fits run at a time."""
    prepared = packed_documents(training_vectors(vectors, n_docs)).persist()
    prepared.count()              # packed before the fits, which would else do it side by side

    def fit(k: int) -> tuple[int, LDAModel, float]:
        start = time.time()
        model = train_lda(prepared, n_docs, num_topics=k, **options)
        return k, model, round(time.time() - start, 1)

    try:
        with ThreadPool(max(1, min(parallelism, len(ks)))) as pool:
            return pool.map(fit, list(ks), chunksize=1)
    finally:
        prepared.unpersist()


def phi_table(model: LDAModel, vocab: DataFrame) -> DataFrame:
    """``(topic_id, term_id, term, prob)`` over the whole vocabulary; each term looks its shares up in the model."""
    topics = model.topicsMatrix().toArray()
    shared = vocab.sparkSession.sparkContext.broadcast(topics / topics.sum(axis=0))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = shared.value
        size, k = shares.shape
        for batch in batches:
            for part in (batch.slice(i, 10_000) for i in range(0, batch.num_rows, 10_000)):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero((ids >= 0) & (ids < size))
                row = pa.array(np.repeat(rows, k))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(k, dtype=np.int32), len(rows))), part.column(0).take(row), part.column(1).take(row),
                    pa.array(shares[ids[rows]].ravel())], ["topic_id", "term_id", "term", "prob"])

    known = vocab.select(F.col("term_id").cast("long"), "term").filter("term_id IS NOT NULL")
    return known.mapInArrow(looked_up, "topic_id int, term_id long, term string, prob double")


def _inferred(model: LDAModel) -> Callable:
    """A function from Arrow lists of words and counts to ``(rows with a word, their parameters, doc, word, count)``.

    Spark's inference, in batches of documents. All documents have the same start, so a document's parameters
    do not depend on the others.
    """
    exp_digamma, infer = _inference()
    topics, alpha = model.topicsMatrix().toArray(), model.estimatedDocConcentration().toArray()
    start = np.random.default_rng(model.getSeed() & (2**63 - 1)).gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, len(alpha))
    table = exp_digamma(topics) / exp_digamma(topics.sum(axis=0))
    shared = SparkContext.getOrCreate().broadcast(table)

    def inferred(lists: pa.Array, values: pa.Array):
        word, count = lists.flatten().to_numpy(), values.flatten().to_numpy()
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        doc, word, count = doc[count != 0], word[count != 0], count[count != 0]
        sizes = np.bincount(doc, minlength=len(lists))
        rows = np.flatnonzero(sizes)
        gamma, _ = infer(word, count, sizes[rows], shared.value, alpha, np.tile(start, (len(rows), 1)))
        return rows, gamma, doc, word, count

    return inferred


def theta_table(model: LDAModel, vectors: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, theta, known)`` of every document, and the columns in ``keep``.

    Documents without a vocabulary word get the normalised document prior and ``known = false``;
    ``article_gate`` tells them apart before scoring.
    """
    alpha = [float(a) for a in model.estimatedDocConcentration()]
    prior = F.array(*[F.lit(a / sum(alpha)) for a in alpha])
    rows, inferred, k = vectors.select(key, *keep, _sparse("features").alias("_v")), _inferred(model), len(alpha)
    names = rows.columns

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                lists, values = (part.column("_v").field(name) for name in ("indices", "values"))
                known, gamma, *_ = inferred(lists, values)
                ends = np.zeros(part.num_rows + 1, np.int32)
                ends[known + 1] = k
                theta = pa.array((gamma / gamma.sum(axis=1, keepdims=True)).ravel(), pa.float64())
                none = np.ones(part.num_rows, bool)
                none[known] = False
                found = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), theta, mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], [*names[:-1], "theta"])

    form = T.StructType([*rows.schema.fields[:-1], T.StructField("theta", T.ArrayType(T.DoubleType()))])
    scored = rows.mapInArrow(shares, form)
    known = F.col("theta").isNotNull()
    return scored.select(key, *keep, F.coalesce("theta", prior).alias("theta"), known.alias("known"))


def _special():
    """``digamma`` and ``log gamma`` of positive arrays: eight steps up, then Stirling's series (errors under 1e-12).

    Made here, so that they travel with the tasks that use them.
    """
    def digamma(x):
        shift = sum(1.0 / (x + i) for i in range(8))
        x = x + 8.0
        y = 1.0 / (x * x)
        return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - shift

    def lgamma(x):
        shift = sum(np.log(x + i) for i in range(8))
        x = x + 8.0
        y = 1.0 / (x * x)
        series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
        return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift

    return digamma, lgamma


def perplexity(model: LDAModel, vectors: DataFrame, features: str = "features") -> DataFrame:
    """Per-word log bound (higher is better) and its negative, the log perplexity.

    The bound is Spark's (``LDAModel.logPerplexity``), which exponentiates the whole topic by word matrix and makes a dense
    vector of the vocabulary for every document. Here a document costs its inference and its own words. Documents
    without a word add nothing.
    """
    digamma, lgamma = _special()
    weights = model.topicsMatrix().toArray()                     # words by topics, bounded by the vocabulary
    alpha, eta = model.estimatedDocConcentration().toArray(), float(model.getOrDefault("topicConcentration"))
    per_topic = weights.sum(axis=0)
    expected = digamma(weights) - digamma(per_topic)
    topics_part = float(
        ((eta - weights) * expected).sum() + (lgamma(weights) - lgamma(np.float64(eta))).sum()
        + (lgamma(np.float64(eta * len(weights))) - lgamma(per_topic)).sum())
    shared, inferred = vectors.sparkSession.sparkContext.broadcast((expected, alpha)), _inferred(model)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, alpha = shared.value
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows, gamma, doc, word, count = inferred(part.column("indices"), part.column("values"))
                total = gamma.sum(axis=1)
                share = digamma(gamma) - digamma(total)[:, None]
                joint = share[np.searchsorted(rows, doc)] + expected[word]
                most = joint.max(axis=1) if len(joint) else np.empty(0)
                bound = (
                    (count * (most + np.log(np.exp(joint - most[:, None]).sum(axis=1)))).sum() + ((alpha - gamma) * share).sum()
                    + (lgamma(gamma) - lgamma(alpha)).sum() + (lgamma(alpha.sum()) - lgamma(total)).sum())
                yield pa.RecordBatch.from_pydict({"bound": [float(bound)], "tokens": [float(count.sum())]})

    rows = vectors.select(_sparse(features).alias("_v")).select("_v.indices", "_v.values")
    parts = rows.mapInArrow(bounds, "bound double, tokens double")
    documents_part, tokens = parts.agg(F.sum("bound"), F.sum("tokens")).first()
    value = -(documents_part + topics_part) / tokens if tokens else math.nan
    return vectors.sparkSession.createDataFrame(
        [(-value, value)], "log_bound_per_word double, log_perplexity double"
    )
