import json
import os
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wartalens.operators import lda
from wartalens.operators.dictionary import bow_vectors
from wartalens.plans.evaluate import evaluate, rebuild_corpus
from wartalens.plans.score import Scorer, score_json
from wartalens.plans.train import TrainOptions, train
from wartalens.sources.articles import read_articles
from wartalens.streaming.score_stream import stream_score

THEMES = [
    ["harga", "pasar", "saham", "rupiah", "bank", "ekonomi", "investor", "modal"],
    ["gol", "liga", "pemain", "klub", "wasit", "stadion", "turnamen", "pelatih"],
]


def planted(n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(THEMES[i % 2]) for _ in range(40)]
        rows.append((i, f"portal{i % 4}", f"Judul {i}", f"2025-0{6 + i % 2}-15 08:00:00", f"https://x.id/{i}", " ".join(words), 240))
    return rows


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(
        planted(), "article_id long, portal string, title string, released string, url string, content string, content_len int"
    ).withColumn("released", F.to_timestamp("released"))


@pytest.fixture(scope="module")
def store(spark, articles, tmp_path_factory):
    options = TrainOptions(ks=(2, 3), no_below=3, no_above=0.9, passes=8, min_count=10_000)
    return train(articles, str(tmp_path_factory.mktemp("run")), options)


def test_stored_run(store):
    report = store.table("coherence_report").collect()
    assert sorted(r["K"] for r in report) == [2, 3]
    best = max(report, key=lambda r: (r["coherence_cv"], -r["grid_pos"]))
    assert store.best_k() == best["K"]
    assert store.table("bigrams").count() == 0 and store.table("vocab").count() >= 12


def test_planted_topics_are_found(spark, articles, store):
    theta = Scorer.load(store, 2).theta(articles).collect()
    assert len(theta) == 120
    sides = {}
    for row in theta:
        assert sum(row["theta"]) == pytest.approx(1.0)
        sides.setdefault(row["doc_id"] % 2, set()).add(row["theta"].index(max(row["theta"])))
    assert all(len(s) == 1 for s in sides.values()) and sides[0] != sides[1]


def test_phi_sums_to_one(store):
    sums = lda.phi_table(store.model(3), store.table("vocab")).groupBy("topic_id").agg(F.sum("prob").alias("s")).collect()
    assert len(sums) == 3 and all(r["s"] == pytest.approx(1.0) for r in sums)


def test_same_seed_same_topics_whatever_the_input_order(spark):
    rows = [(i, r[5].split()) for i, r in enumerate(planted(60))]
    terms = sorted({w for t in THEMES for w in t})
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, tokens array<string>").repartition(3)
        model = lda.train_lda(lda.training_vectors(bow_vectors(docs, terms), 60), 60, num_topics=2, passes=3)
        found.append([round(x, 9) for x in model.topicsMatrix().toArray().ravel()])
    assert found[0] == found[1]


def test_more_passes_fit_better(spark):
    docs = spark.createDataFrame([(i, r[5].split()) for i, r in enumerate(planted(60))], "doc_id long, tokens array<string>")
    vectors = bow_vectors(docs, sorted({w for t in THEMES for w in t}))
    prepared = lda.training_vectors(vectors, 60)
    scores = [lda.perplexity(lda.train_lda(prepared, 60, 2, passes), vectors).first() for passes in (1, 20)]
    assert scores[1]["log_bound_per_word"] > scores[0]["log_bound_per_word"]
    assert scores[0]["log_perplexity"] == -scores[0]["log_bound_per_word"]


def test_updates_do_not_grow_with_the_documents(monkeypatch):
    asked = []

    class Recorded:
        def __init__(self, **given):
            asked.append((given["maxIter"], given["subsamplingRate"]))

        def fit(self, vectors):
            return None

    monkeypatch.setattr(lda, "LDA", Recorded)
    sizes = (100, 4_000, 50_000, 3_000_000)
    for n in sizes:
        lda.train_lda(None, n, passes=10, chunksize=2000)
    assert [updates for updates, _ in asked] == [10, 20, 20, 20]
    # ten passes of documents are drawn at every size
    assert all(updates * rate == pytest.approx(10) for updates, rate in asked)


def test_priors_and_update_bound(spark):
    prior = lda.asymmetric_prior(5)
    assert sum(prior) == pytest.approx(1.0) and prior == sorted(prior, reverse=True)


def test_documents_without_vocabulary_get_the_prior(spark, store):
    odd = spark.createDataFrame([(1, "xyzzy plugh"), (2, "harga pasar saham"), (3, None)], "article_id long, content string")
    rows = {r["doc_id"]: r for r in Scorer.load(store, 2).theta(odd).collect()}
    assert {k: r["known"] for k, r in rows.items()} == {1: False, 2: True, 3: False}
    assert rows[1]["theta"] == pytest.approx(lda.asymmetric_prior(2)) and rows[3]["theta"] == rows[1]["theta"]


def test_layout_follows_documents_not_cores(spark):
    vectors = bow_vectors(spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>"), ["a"])
    sizes = (0, 1, 501, 40_000, 4_000_000)
    assert [lda.training_vectors(vectors, n).rdd.getNumPartitions() for n in sizes] == [1, 1, 2, 64, 200]


def test_scoring_uses_the_text_options_of_the_run(spark, tmp_path):
    from wartalens.sources.tables import ModelStore

    run = ModelStore(spark, str(tmp_path / "run"))
    run.save_text_options(["pemerintah"], {"makanan": "santap"})
    run.save_table("stopwords", spark.createDataFrame([("di",)], "word string"))
    none = spark.createDataFrame([], "left_word string, right_word string, n_ab long, n_a long, n_b long, score double")
    run.save_table("bigrams", none)
    run.save_table("trigrams", none)
    docs = spark.createDataFrame([(1, "pemerintah makanan di harga pasar")], "article_id long, content string")
    expected = ["pemerintah", "santap", "harga", "pasar"]
    assert rebuild_corpus(docs, run).first()["tokens"] == expected
    scorer = Scorer(None, [], ["di"], none, none, **run.text_options())
    assert scorer.tokens(docs).first()["tokens"] == expected


def test_a_stored_run_is_not_overwritten(articles, store):
    with pytest.raises(FileExistsError):
        train(articles, store.path)


def test_score_json(spark, articles, store):
    row = score_json(Scorer.load(store, 2).theta(articles), topn=1).filter("doc_id = 0").first()
    topics = json.loads(row["topics"])["topics"]
    assert len(topics) == 1 and topics[0]["prob"] > 0.5


def test_stream_equals_batch(spark, articles, store, tmp_path):
    from wartalens.operators.document_topics import topn_topics

    scorer = Scorer.load(store)
    arrived = str(tmp_path / "in")
    columns = ["article_id", "content"]
    articles.select(*columns).filter("article_id < 70").write.parquet(os.path.join(arrived, "a"))
    articles.select(*columns).filter("article_id >= 70").write.parquet(os.path.join(arrived, "b"))
    stream = spark.readStream.schema("article_id long, content string").parquet(os.path.join(arrived, "*"))
    query = stream_score(stream, scorer, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    key = lambda r: (r["doc_id"], r["rank"], r["topic_id"], round(r["prob"], 9))
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(key, topn_topics(scorer.theta(articles)).collect()))


def test_stream_drops_later_copies_and_restarts(spark, articles, store, tmp_path):
    """A copy in a later batch and, after a restart from the checkpoint, in a later run; the gate's status on each row."""
    scorer = Scorer.load(store)
    arrived, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "article_id long, url string, content string"
    body = articles.filter("article_id = 0").first()["content"]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        stream_score(stream, scorer, out, state).awaitTermination()
        return {r["doc_id"]: r["status"] for r in spark.read.parquet(out).collect()}

    assert arrive([(1, "u1", body), (2, "u2", "harga pasar")]) == {1: "ok", 2: "too_few_tokens"}
    seen = arrive([(3, "u1", body), (4, None, body), (5, "u3", "xyzzy plugh " * 40), (6, None, None)])
    assert seen == {1: "ok", 2: "too_few_tokens", 4: "ok", 5: "no_vocabulary", 6: "too_few_tokens"}
    assert set(arrive([(7, "u2", body), (8, "u3", body), (9, "u4", body), (10, None, body)])) == {1, 2, 4, 5, 6, 9, 10}
    rows = spark.read.parquet(out)
    assert rows.filter("status IN ('too_few_tokens', 'no_vocabulary')").filter("topic_id IS NOT NULL").count() == 0
    assert rows.filter("doc_id = 9 AND rank = 1").count() == 1


def test_rebuild_equals_stored_tokens(articles, store):
    key = lambda r: (r["doc_id"], tuple(r["tokens"]))
    assert sorted(map(key, rebuild_corpus(articles, store).collect())) == sorted(map(key, store.table("tokens").collect()))


def test_evaluate(articles, store):
    tables = evaluate(articles, store)
    metrics = {r["metric"]: r["value"] for r in tables["model_metrics"].collect()}
    assert metrics["num_topics"] == store.best_k()
    assert {"coherence_c_v", "coherence_u_mass", "topic_diversity", "log_perplexity", "avg_topic_concentration"} <= set(metrics)
    trends = tables["temporal_topic_trends"].collect()
    assert [r["month"] for r in sorted(trends, key=lambda r: r["month"])] == ["2025-06", "2025-07"]
    assert sum(r["document_count"] for r in tables["dominant_topics"].collect()) == 120


def test_topic_map_of_a_stored_run(articles, store):
    """Proportions by hand from theta and known words; the tables cover every topic, term and pair."""
    tables = evaluate(articles, store, 3)
    terms = {r["term"] for r in store.table("vocab").collect()}
    lengths = {r["doc_id"]: sum(t in terms for t in r["tokens"]) for r in store.table("tokens").collect()}
    weights = [0.0] * 3
    for row in Scorer.load(store, 3).theta(articles).collect():
        for topic, share in enumerate(row["theta"]):
            weights[topic] += share * lengths[row["doc_id"]]
    got = {r["topic_id"]: r["proportion"] for r in tables["topic_proportions"].collect()}
    assert [got[k] for k in range(3)] == pytest.approx([w / sum(weights) for w in weights])
    assert {r["term"] for r in tables["term_saliency"].collect()} == terms
    assert sorted((r["topic_a"], r["topic_b"]) for r in tables["topic_distance"].collect()) == [(0, 1), (0, 2), (1, 2)]
    assert {r["topic_id"] for r in tables["term_relevance"].collect()} == {0, 1, 2}


def test_article_keys_that_are_no_numbers(spark):
    from wartalens.sources.articles import conform

    rows = conform(spark.createDataFrame([("a-1", "x"), ("a-2", "y"), ("a-1", "z"), ("12", "w"), (None, "v")], "article_id string, content string"))
    keys = {r["content"]: r["article_id"] for r in rows.collect()}
    assert keys["x"] == keys["z"] != keys["y"] and keys["w"] == 12 and keys["v"] is None and None not in (keys["x"], keys["y"])


def test_sampled_training_corpus(spark, articles, tmp_path):
    options = TrainOptions(ks=(2,), sample=40, no_below=2, no_above=1.0, passes=1, min_count=10_000)
    assert train(articles, str(tmp_path / "s"), options).table("tokens").count() == 40


def test_read_articles_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'title,content,released,content_len\n'
        '"A ""kutip""","baris satu\nbaris dua",2025-06-01 10:00:00,120\n'
        'B,NaN,31/12/2025,n/a\n'
        'C,teks,besok,7.0\n', encoding="utf-8")
    rows = read_articles(spark, str(path)).orderBy("title").collect()
    assert [r["title"] for r in rows] == ['A "kutip"', "B", "C"]
    assert rows[0]["content"] == "baris satu\nbaris dua" and rows[1]["content"] is None
    assert [r["content_len"] for r in rows] == [120, None, 7]
    assert str(rows[1]["released"]) == "2025-12-31 00:00:00" and rows[2]["released"] is None
    assert rows[0]["portal"] is None and len({r["article_id"] for r in rows}) == 3


def test_stopword_files(spark, tmp_path):
    from wartalens.sources.stopwords import build_stopwords, load_stopword_list

    path = tmp_path / "w.txt"
    path.write_text("Demikian, melihat,\nrata-rata, , melihat\n", encoding="utf-8")
    words = lambda mode: sorted(r["word"] for r in load_stopword_list(spark, str(path), mode).collect())
    assert words("comma") == ["demikian", "melihat", "rata-rata"]
    assert words("line") == ["demikian, melihat,", "rata-rata, , melihat"]
    built = build_stopwords(["  Satu ", "", None])
    assert {"satu", "yang", "wib", "jum'at"} <= set(built) and "" not in built


def test_perplexity_is_sparks_without_its_matrix_per_document(spark, monkeypatch):
    rows = [(i, Vectors.sparse(40, {(i * 7 + j * j) % 40: 1.0 + j % 3 for j in range(i % 9)})) for i in range(60)]
    rows.append((60, Vectors.dense([float(j % 4) for j in range(40)])))
    vectors = spark.createDataFrame(rows, ["doc_id", "features"])
    model = lda.train_lda(vectors, 61, num_topics=3, passes=2)
    spark_value = model.logPerplexity(vectors)

    def refuse(*_):
        raise AssertionError("the whole topic matrix is exponentiated for every document")

    monkeypatch.setattr(type(model), "logPerplexity", refuse)
    row = lda.perplexity(model, vectors).first()
    assert row["log_perplexity"] == pytest.approx(spark_value, rel=1e-3)
    assert row["log_bound_per_word"] == -row["log_perplexity"]


def small_vectors(spark):
    """Repeated, empty and long documents; a dense vector, and counts that are no whole numbers."""
    rows = [(i, Vectors.sparse(40, {(i * 7 + j * j) % 40: 1.0 + (j * i) % 300 for j in range(i % 9)})) for i in range(80)]
    rows += [(80, Vectors.dense([float(j % 4) for j in range(40)])), (81, Vectors.sparse(40, [3, 5], [0.0, 2.5])), (82, Vectors.sparse(40, [], []))]
    return spark.createDataFrame(rows + rows[:20], ["doc_id", "features"])


def test_documents_are_fitted_in_batches(spark, monkeypatch):
    """Spark's loop over single documents is not taken; topics are found, and one update's draws are whole."""
    def refuse(*_):
        raise AssertionError("documents are fitted one by one")

    monkeypatch.setattr(lda.SparkLDA, "_fit", refuse)
    docs = spark.createDataFrame([(i, r[5].split()) for i, r in enumerate(planted(60))], "doc_id long, tokens array<string>")
    terms = sorted({w for t in THEMES for w in t})
    model = lda.train_lda(lda.training_vectors(bow_vectors(docs, terms), 60), 60, num_topics=2, passes=10)
    found = {frozenset(terms[i] for i in row["termIndices"]) for row in model.describeTopics(8).collect()}
    assert found == {frozenset(theme) for theme in THEMES}
    fitted = lda.fit_grid(bow_vectors(docs, terms), 60, (2, 3), passes=10)
    assert [(k, m.vocabSize()) for k, m, _ in fitted] == [(2, 16), (3, 16)]
    assert (fitted[0][1].topicsMatrix().toArray() == model.topicsMatrix().toArray()).all()


def test_one_update_adds_every_drawn_word(spark):
    """The sums of an update are the words drawn: with all weights alike, each word's sum is its count over its document's draws."""
    import numpy as np

    packed = lda.packed_documents(small_vectors(spark).coalesce(1))
    weights, alpha = np.ones((3, 40)), np.ones(3)
    sums = lda.LDA._sums(packed, weights, alpha, 1.0, [42, 1])
    sizes = np.frombuffer(packed.first()["sizes"], np.int32)
    drawn = np.random.default_rng([42, 1, 0, 0]).poisson(1.0, len(sizes))
    expected = np.zeros(40)
    for times, row in zip(drawn, small_vectors(spark).coalesce(1).collect()):
        expected += times * row["features"].toArray()
    assert len(sizes) == 103 and sums.sum(axis=0) == pytest.approx(expected)
    assert lda.LDA._sums(packed, weights, alpha, 0.0, [42, 1]) is None


def test_packed_documents_hold_every_count(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lda, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lda, "BLOCK_ENTRIES", 20)
    vectors = small_vectors(spark).repartition(3)
    got = []
    for block in lda.packed_documents(vectors).collect():
        sizes, words = np.frombuffer(block["sizes"], np.int32), np.frombuffer(block["words"], np.int32)
        counts = np.frombuffer(block["counts"], np.uint8 if len(block["counts"]) == len(words) else np.float64)
        assert block["size"] == 40 and len(sizes) <= 7 and sizes.sum() == len(words) and (len(sizes) == 1 or len(words) <= 20)
        for size, end in zip(sizes, np.cumsum(sizes)):
            got.append(tuple(zip(words[end - size:end].tolist(), counts[end - size:end].tolist())))
    rows = [r["features"].toArray() for r in vectors.collect()]
    assert sorted(got) == sorted(tuple((int(i), float(x[i])) for i in np.flatnonzero(x)) for x in rows)


def test_shares_are_sparks_and_scored_in_batches(spark, monkeypatch):
    vectors = small_vectors(spark)
    model = lda.train_lda(vectors, 103, num_topics=3, passes=3)
    key = lambda r: (r["doc_id"], r["theta"])
    by_spark = sorted((r["doc_id"], r["topicDistribution"].toArray().tolist()) for r in model.transform(vectors).collect())

    def refuse(*_):
        raise AssertionError("documents are scored one by one")

    monkeypatch.setattr(type(model), "transform", refuse)
    rows = lda.theta_table(model, vectors).collect()
    assert {r["doc_id"] for r in rows if not r["known"]} == {i for i, theta in by_spark if not any(theta)}
    for (a, mine), (b, theirs) in zip(sorted(map(key, rows)), by_spark):
        assert a == b and (not any(theirs) or mine == pytest.approx(theirs, abs=2e-3))


def test_phi_table_is_the_described_topics(spark):
    model = lda.train_lda(small_vectors(spark), 103, num_topics=3, passes=1)
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(39)] + [(50, "beyond"), (None, "none")], "term_id long, term string")
    got = {(r["topic_id"], r["term_id"]): (r["term"], r["prob"]) for r in lda.phi_table(model, vocab).collect()}
    assert set(got) == {(k, i) for k in range(3) for i in range(39)}
    for row in model.describeTopics(40).collect():
        for i, prob in zip(row["termIndices"], row["termWeights"]):
            assert i == 39 or got[row["topic"], i] == (f"w{i}", pytest.approx(prob))
