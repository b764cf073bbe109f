import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wartalens.functions import batches
from wartalens.operators import coherence, dictionary, document_topics, relevance, topics
from workload import views

EPS = 1e-12


def docs_of(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>")


def windows_of(lists, wanted, width):
    out = []
    for tokens in lists:
        if not set(tokens) & wanted:
            continue
        for start in range(max(1, len(tokens) - width + 1)):
            out.append(set(tokens[start:start + width]) & wanted)
    return out


def brute(windows, topic_terms):
    n = len(windows)
    p = lambda *ws: sum(all(w in win for w in ws) for win in windows) / n
    pmi = lambda a, b: math.log((p(a, b) + EPS) / (p(a) * p(b)))
    npmi = lambda a, b: pmi(a, b) / -math.log(p(a, b) + EPS)
    uci = np.mean([pmi(a, b) for a, b in itertools.permutations(topic_terms, 2)])
    mean_npmi = np.mean([npmi(a, b) for a, b in itertools.permutations(topic_terms, 2)])
    vectors = np.array([[npmi(a, b) for b in topic_terms] for a in topic_terms])
    total = vectors.sum(axis=0)
    cv = np.mean([v @ total / (np.linalg.norm(v) * np.linalg.norm(total)) for v in vectors])
    return {"c_uci": uci, "c_npmi": mean_npmi, "c_v": cv}


@pytest.mark.parametrize("width", [2, 5, 110])
def test_window_measures_equal_brute_force(spark, width):
    rng = random.Random(width)
    lists = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))] for _ in range(60)] + [["h"] * 30]
    lists += [["x", "y"], []]
    groups = {0: ["a", "b", "c"], 1: ["c", "b", "d", "e"]}
    wanted = {t for ts in groups.values() for t in ts}
    windows = windows_of(lists, wanted, width)
    docs = docs_of(spark, lists)
    for measure in ("c_v", "c_uci", "c_npmi"):
        got = {r["topic_id"]: r["coherence"] for r in
               coherence.coherence_of_lists(docs, groups, measure, window=width).collect()}
        for k, terms in groups.items():
            assert got[k] == pytest.approx(brute(windows, terms)[measure], abs=1e-9)


def test_all_models_and_measures_in_one_pass(spark):
    """Each model counts the windows of its own documents; the texts are scanned once."""
    rng = random.Random(8)
    lists = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 160))] for _ in range(40)] + [["k"] * 20, [], None]
    models = [{0: ["a", "b", "c"], 1: ["c", "b", "d", "e"]}, {0: ["b", "a"], 1: ["f", "g", "h"], 2: ["e", "c", "g"]}]
    docs = docs_of(spark, lists)
    counts = coherence.count_pairs(docs, models, [110, 10, None])
    assert plan_of(counts).count("Scan ExistingRDD\n") <= 1 and plan_of(counts).count("Generate (") == 1
    for topics, row in zip(models, coherence.coherence_of_models(docs, models)):
        got = row.first()
        wanted = {t for terms in topics.values() for t in terms}
        for measure, width in (("c_v", 110), ("c_uci", 10), ("c_npmi", 10)):
            windows = windows_of([x or [] for x in lists], wanted, width)
            mean = np.mean([brute(windows, terms)[measure] for terms in topics.values()])
            assert got[f"coherence_{measure}"] == pytest.approx(mean, abs=1e-9)
        alone = coherence.coherence_of_lists(docs, topics, "u_mass").agg(F.avg("coherence")).first()[0]
        assert got["coherence_u_mass"] == pytest.approx(alone, abs=1e-9)


def test_window_counts(spark):
    counts = lambda lists, width: {
        (r["topic_id"], r["a"], r["b"]): r["n"]
        for r in coherence.term_cooccurrence(docs_of(spark, lists), {0: ["a", "b"]}, width).collect()}
    assert counts([["a", "b", "a"]], 2) == {(-1, "", ""): 2, (-1, "a", "a"): 2, (-1, "b", "b"): 2, (0, "a", "b"): 2}
    assert counts([["a"]], 110) == {(-1, "", ""): 1, (-1, "a", "a"): 1}


def test_u_mass(spark):
    docs = docs_of(spark, [["a", "b"], ["a"], ["b", "c"]])
    got = coherence.coherence_of_lists(docs, {0: ["a", "b", "c"]}, "u_mass").first()["coherence"]
    assert got == pytest.approx(-9.537283, abs=1e-5)


def phi_of(spark, matrix):
    rows = [(k, f"w{i:02d}", float(p)) for k, row in enumerate(matrix) for i, p in enumerate(row) if p > 0]
    return spark.createDataFrame(rows, "topic_id int, term string, prob double")


def test_similarity_distance_and_diversity(spark):
    rng = np.random.default_rng(1)
    matrix = rng.random((3, 12))
    matrix[0, 5] = 0.0
    matrix /= matrix.sum(axis=1, keepdims=True)
    phi = phi_of(spark, matrix)
    cos = lambda p, q: p @ q / (np.linalg.norm(p) * np.linalg.norm(q))
    pairs = list(itertools.combinations(range(3), 2))
    values = [cos(matrix[a], matrix[b]) for a, b in pairs]
    row = topics.topic_similarity(phi).first()
    assert row["avg_topic_similarity"] == pytest.approx(np.mean(values))
    assert row["std_topic_similarity"] == pytest.approx(np.std(values))

    def kl(p, m):
        return sum(x * math.log(x / y) for x, y in zip(p, m) if x > 0)

    got = {(r["topic_a"], r["topic_b"]): r["distance"] for r in relevance.topic_distance(phi).collect()}
    for a, b in pairs:
        middle = (matrix[a] + matrix[b]) / 2
        assert got[(a, b)] == pytest.approx((kl(matrix[a], middle) + kl(matrix[b], middle)) / 2)
    one = topics.topic_similarity(phi.filter("topic_id = 0")).first()
    assert tuple(one) == (0.0, 0.0)


def test_diversity(spark):
    rows = [(k, f"w{i + 5 * k:02d}", 1.0 - i / 100) for k in range(2) for i in range(10)]
    phi = spark.createDataFrame(rows, "topic_id int, term string, prob double")
    assert topics.topic_diversity(phi).first()[0] == pytest.approx(0.75)


def test_affixes_and_short_words(spark):
    words = ["makan", "makna", "pekan", "abc"]
    rows = [(0, w, 0.4 - i / 10) for i, w in enumerate(words)] + [(1, "ab", 1.0)]
    phi = spark.createDataFrame(rows, "topic_id int, term string, prob double")
    got = {r["topic_id"]: (r["common_prefix"], r["common_suffix"]) for r in topics.topic_affixes(phi).collect()}
    assert got == {0: ("mak", "kan"), 1: (None, None)}


def theta_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, theta array<double>")


def test_document_topics(spark):
    theta = theta_of(spark, [[0.5, 0.25, 0.25], [0.0, 0.5, 0.5], [0.995, 0.005, 0.0]])
    entropy = [r["entropy"] for r in document_topics.document_entropy(theta).orderBy("doc_id").collect()]
    assert entropy[0] == pytest.approx(1.5) and entropy[1] == pytest.approx(1.0)
    assert [r["topic_id"] for r in document_topics.dominant_topic(theta).orderBy("doc_id").collect()] == [0, 1, 0]
    top = document_topics.topn_topics(theta).filter("doc_id = 2").collect()
    assert [(r["rank"], r["topic_id"]) for r in top] == [(1, 0)]
    counts = {r["topic_id"]: r["document_count"] for r in document_topics.dominant_topic_counts(theta).collect()}
    assert counts == {0: 2, 1: 1}
    active = {r["threshold"]: r["active_topics"] for r in document_topics.active_topics(theta).collect()}
    assert active == {0.01: 3, 0.05: 3, 0.10: 3}


def test_top_words_tie_by_first_occurrence(spark):
    docs = docs_of(spark, [["z", "a", "b", "a", "z", "c"], ["a", "b"]])
    rows = document_topics.document_top_words(docs, topn=3).collect()
    assert [(r["doc_id"], r["rank"], r["term"], r["n"]) for r in rows] == [(0, 1, "z", 2), (0, 2, "a", 2), (0, 3, "b", 1)]


def test_filter_extremes_and_bow(spark):
    docs = docs_of(spark, [["a", "b", "b"], ["a", "b"], ["a", "c"], ["a"]])
    vocab = dictionary.build_dictionary(docs, no_below=2, no_above=0.5)
    assert [tuple(r) for r in vocab.collect()] == [(0, "b", 2, 3)]
    assert sorted((r["doc_id"], r["tf"]) for r in dictionary.doc2bow(docs, vocab).collect()) == [(0, 2), (1, 1)]
    vectors = dictionary.bow_vectors(docs, ["c", "b"]).orderBy("doc_id").collect()
    assert vectors[0]["features"].toArray().tolist() == [0.0, 2.0]


def test_saliency_and_relevance(spark):
    matrix = np.array([[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]])
    weights = np.array([30.0, 10.0])
    phi = phi_of(spark, matrix)
    sizes = spark.createDataFrame([(0, 30.0), (1, 10.0)], "topic_id int, weight double")
    frequency = weights @ matrix
    p_term = frequency / frequency.sum()
    given = matrix / matrix.sum(axis=0)
    saliency = p_term * (given * np.log(given / (weights / weights.sum())[:, None])).sum(axis=0)
    got = {r["term"]: r["saliency"] for r in relevance.term_saliency(phi, sizes).collect()}
    for i in range(3):
        assert got[f"w{i:02d}"] == pytest.approx(saliency[i])
    rel = relevance.term_relevance(phi, sizes, lam=0.3, topn=1).orderBy("topic_id").collect()
    want = 0.3 * np.log(matrix) + 0.7 * np.log(matrix / p_term)
    assert [r["relevance"] for r in rel] == pytest.approx(want.max(axis=1).tolist())
    assert F is not None


@pytest.mark.parametrize("limit", [8, 8 * 2**20])
def test_terms_are_summed_over_slices_and_keep_their_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(batches, "SLICE_BYTES", limit)
    lists = [(1, ["b", "a", "b"]), (1, ["b"]), (None, ["a", "é"]), (2, []), (3, None), (4, ["x"])]
    docs = spark.createDataFrame(lists, "doc_id long, tokens array<string>").coalesce(1)
    frequencies = dictionary.doc_frequency(docs)
    assert sorted(map(tuple, frequencies.collect())) == [("a", 2, 2), ("b", 2, 3), ("x", 1, 1), ("é", 1, 1)]
    vocab = spark.createDataFrame([(0, "b"), (1, "a"), (2, "é")], "term_id long, term string")
    found = dictionary.doc2bow(docs, vocab)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(
        map(str, [(1, 1, "a", 1), (1, 0, "b", 2), (1, 0, "b", 1), (None, 1, "a", 1), (None, 2, "é", 1)]))
    nested = dictionary.doc2bow(docs.select(F.struct("doc_id").alias("doc"), "tokens"), vocab, key="doc")
    assert nested.columns == ["doc", "term_id", "term", "tf"] and nested.filter("doc.doc_id = 1").count() == 3
    assert "MapInArrow" in plan_of(frequencies) and "Generate" not in plan_of(found)


@pytest.mark.parametrize("limit", [8, 8 * 2**20])
def test_documents_of_a_key_are_counted_together(spark, monkeypatch, limit):
    """A slice gives one row for each key and term, whatever the number of documents; sums stay."""
    monkeypatch.setattr(batches, "SLICE_BYTES", limit)
    lists = [("x", ["b", "a", "b"]), ("y", ["a"]), (None, ["b"]), ("x", ["a", "zz"]), ("x", None), (None, ["b", "b"]), ("y", [])]
    docs = spark.createDataFrame(lists, "lang string, tokens array<string>").coalesce(1)
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "term_id long, term string")
    found = dictionary.doc2bow(docs, vocab, key="lang", together=True)
    summed = {(r["lang"], r["term_id"], r["term"]): r["tf"] for r in found.groupBy("lang", "term_id", "term").agg(F.sum("tf").alias("tf")).collect()}
    assert summed == {("x", 0, "a"): 2, ("x", 1, "b"): 2, ("y", 0, "a"): 1, (None, 1, "b"): 3}
    assert found.count() == (4 if limit > 8 else 6)


def test_topic_sizes_read_the_words_of_the_documents_once(spark, monkeypatch):
    asked = []
    counted = views.doc2bow
    monkeypatch.setattr(views, "doc2bow", lambda *args, **options: asked.append(options.get("key", "doc_id")) or counted(*args, **options))
    rows = [(1, "x", ["a", "a", "b"]), (2, "y", ["b", "c", "none"]), (2, "x", ["a"]), (3, "y", []), (4, "y", ["c"])]
    model = views.Surrogate.__new__(views.Surrogate)
    model.docs = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>")
    model.vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "term_id long, term string")
    model.languages = ["x", "y"]
    phi = {"a": (3 / 4, 0), "b": (1 / 4, 1 / 3), "c": (0, 2 / 3)}
    words = {1: ["a", "a", "b"], 2: ["b", "c", "a"], 4: ["c"]}
    expected = [0.0, 0.0]
    for terms in words.values():
        shares = [sum(phi[t][i] for t in terms) for i in range(2)]
        expected = [e + len(terms) * round(s / sum(shares), 9) for e, s in zip(expected, shares)]
    assert {r["topic_id"]: r["weight"] for r in model.sizes.collect()} == pytest.approx(dict(enumerate(expected)))
    assert sorted(asked) == ["doc_id", "lang"]
