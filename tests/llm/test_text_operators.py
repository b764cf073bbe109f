"""Decontamination (4), language (6), toxicity (7), shards (9), quality rules (10), the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wartalens.llm import decontaminate, language_id, quality_rules, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, content in items:
        own = WORD.findall((content or "").translate(LOWER))
        size = min(13, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                found.add(str(item))
                hit.update(range(i, i + size))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, "Brown fox JUMPS over the lazy dog near the river bank in the early morning"), (2, "again"), (3, None), (4, " - "),
    (5, "中文"), (5, "中文"), (None, "one"), (6, "lazy dog near the river bank in the early morning light again and on"),
]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_contamination(spark, awkward, texts, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    column = decontaminate.scan_column(awkward, bench, block_bytes=block_bytes)
    rows = awkward.select("doc_id", "text", column.alias("hit")).collect()
    known = [x for x in ITEMS if x[0] is not None]
    for r in rows:
        assert (r["hit"]["n_words"], r["hit"]["n_hit"], r["hit"]["items"]) == brute_hits(r["text"], known), r["doc_id"]
    assert len(rows) == len(texts)


def test_contaminated_go_and_spans_go(spark, awkward):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontaminate.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 11, 12, None}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(awkward, bench).filter("doc_id < 9").collect()}
    assert cut[1] == "the quick  light" and cut[3] == "the quick  light " and cut[4] is None and cut[8] == "One"


def test_contamination_without_benchmark(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(awkward, none).count() == awkward.count()
    assert decontaminate.decontaminate(empty, none).count() == 0


def test_language(spark, awkward, empty):
    found = queries.op6(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()
    assert list(found.held_out) == [zlib.crc32(str(d).encode()) % 3 == 1 for d in found.doc_id]
    profiles = language_id.fit(language_id.learnable(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.identify(awkward, profiles).collect()}
    assert {d for d, unknown in rows if unknown} == {4, 5, 6, 11, None} and (7, False) in rows
    kept = language_id.keep_languages(awkward, profiles)
    assert kept.columns == awkward.columns and kept.count() == 10
    assert language_id.fit(empty) == {} and language_id.identify(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(awkward, {}).collect()} == {"und"}


def test_language_vectors_bundle_trigrams():
    v = language_id.Vectors()
    both, one, two = v.bundle(["abc xyz", "abc", "xyz"])
    # one trigram over the space is all that joins the words
    assert np.abs(both - one - two).sum() > 0 and np.allclose(v.bundle(["ABC"])[0], one)
    assert not v.bundle([None, "", "12 -"]).any()


def test_block_max_search_is_exact():
    draw = random.Random(3)
    rows = []
    for _ in range(700):
        numbers = tuple(sorted(draw.sample(range(30), draw.randint(1, 5))))
        raw = np.asarray([draw.random() + 0.1 for _ in numbers])
        rows.append((numbers, tuple((raw / np.linalg.norm(raw)).round(9).tolist())))
    index = toxicity.BlockMaxIndex(rows, 30, block=16)
    opened = 0
    for numbers, weights in rows[:80]:
        mine = dict(zip(numbers, weights))
        every = [(round(sum(mine.get(t, 0.0) * w for t, w in zip(*r)), 9), i) for i, r in enumerate(rows)]
        want = sorted(((s, i) for s, i in every if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        got = index.search(numbers, weights, 10)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-8)
        opened += index.n_blocks
    assert index.opened < opened


def test_words_of_a_slice_are_looked_up_together(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 40)
    texts = ["Straße naïve naïvely x", None, "", "hate hateful HATEFULLY", " , ", "the\nend the", "hate \ud800 \u0130stanbul"]
    names = sorted({t for x in texts for w in toxicity.words(x) for t in toxicity.word_terms(w)} - {"x"})
    scorer = toxicity.Scorer(toxicity.Model(terms={t: i for i, t in enumerate(names)}))
    for text, counts in zip(texts, scorer.counts(texts), strict=True):
        terms = [t for w in toxicity.words(text) for t in toxicity.word_terms(w)]
        assert counts.tolist() == [terms.count(t) for t in names]
    assert [len(c) for c in toxicity.Scorer(toxicity.Model()).counts(["a b", None])] == [0, 0]


def test_toxicity(spark, awkward, empty):
    draw = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = [draw.choice(words) for _ in range(40)]
        if bad:
            text[draw.randrange(40)] = draw.choice(["nasty", "vileword", "vileness", "vilely"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (3, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert np.mean([scored[i]["predicted"] == t for i, t in marks if scored[i]["held_out"]]) > 0.95
    assert all(scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    toxic = next(r for r in scored.values() if r["predicted"])
    assert toxic["neighbours"] and toxic["terms"]
    odd = toxicity.score_documents(awkward, model).collect()
    assert len(odd) == awkward.count() and not any(r["predicted"] for r in odd) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_documents(docs, nothing).collect()} <= {0, 1}
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels)).count() == 0


def test_shards(spark, awkward, texts, empty):
    rows = sharding.sharded(awkward).collect()
    assert len(rows) == len(texts) and sharding.sharded(empty).count() == 0
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = sorted(repr((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t in texts)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == sizes


def test_shards_are_contiguous_and_even(spark):
    rows = sharding.sharded(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values("doc_id")
    total, upto = rows["size"].sum(), rows["size"].cumsum()
    assert list(rows.shard) == list(np.minimum((2 * upto - rows["size"]) * 8 // (2 * total), 7))
    assert abs(rows.groupby("shard")["size"].sum() - total / 8).max() <= rows["size"].max()


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(awkward, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality_rules.with_statistics(awkward).select("doc_id", *names).collect()
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr((d, *brute_quality(t))) for d, t in texts)


def test_quality_rules(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 0), (1, None)], "doc_id bigint, quality int")
    rows = quality_rules.quality_rules(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(not r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.quality_rules(empty, labels).count() == 0
    found = queries.op10(spark, "/root/testdata/sf0.01").toPandas().merge(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    judged = found[~found.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.95


def test_decision_list_covers_and_prunes():
    cuts = {"a": [1.0, 2.0], "b": [5.0]}
    cells = [((0, 0), 0, 50, 0, 20), ((1, 0), 0, 40, 0, 20), ((2, 0), 30, 0, 15, 0), ((2, 1), 2, 30, 1, 20), ((0, 1), 1, 60, 0, 30)]
    rules = quality_rules.cover(cells, cuts, ("a", "b"))
    assert len(rules) == 1
    assert {(c.feature, c.above, c.threshold) for c in rules[0].conditions} == {("a", True, 2.0), ("b", False, 5.0)}


def test_pipeline(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(step(spark, docs, SF), name)
        assert after.columns == docs.columns
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    result = corpus_pipeline.run(spark, SF)
    assert result.count() == sizes[-1]
    for table in (awkward, empty):
        for name, step in corpus_pipeline.STAGES:
            table = corpus_pipeline.stage(step(spark, table, SF), name)


def test_curve_pools_falling_rates():
    votes, marks = np.asarray([0.0] * 8 + [.2] * 4 + [.4] * 4 + [.9] * 4), np.asarray([0] * 8 + [1, 1, 0, 0, 1, 0, 0, 0] + [1] * 4)
    at, rate = toxicity.calibrated(votes, marks.astype(float))
    assert at == pytest.approx([0, .3, .9]) and rate == pytest.approx([.5 / 9, 3.5 / 9, 4.5 / 5])


def test_toxicity_by_plain_loops(spark):
    """Fit and scores against the definition: all frequent terms, cosine with every example, leave-one-out curve."""
    draw = random.Random(11)
    stems = ["nord", "sued", "berg", "talwasser", "himmel", "haus", "garten", "strasse"]
    word = lambda bad: draw.choice(["grimwort", "grimmig", "grimzahn"] if bad and draw.random() < .3 else stems) + draw.choice("abcdef")
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(draw.randint(5, 40)))) for i in range(150)]
    rows += [(150, rows[1][1]), (151, None), (152, ""), (153, "12 !")]
    marks = {i: int(i % 4 == 0) for i, _ in rows} | {150: 1}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(marks.items()), "doc_id bigint, toxic int"), least_share=0.05)
    taught = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5:
            first, mark = taught.get(t or "", (i, 0))
            taught[t or ""] = min(first, i), max(mark, marks[i])

    def terms(text):
        out = Counter()
        for w in WORD.findall((text or "").lower()):
            out.update([w, *("^" + w[:k] for k in (4, 5, 6, 7) if len(w) > k)])
        return out

    held = Counter(t for text in taught for t in terms(text))
    known = {t: n for t, n in held.items() if n >= max(2, int(np.ceil(0.05 * len(taught))))}
    assert set(model.terms) == set(known)

    def vector(text):
        raw = {t: c * (np.log((1 + len(taught)) / (1 + known[t])) + 1e-3) for t, c in terms(text).items() if t in known}
        length = np.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length for t, x in raw.items()}

    examples = [(vector(t), first, mark) for t, (first, mark) in taught.items() if vector(t)]

    def vote(own, without=None):
        near = sorted(((sum(w * other.get(t, 0.0) for t, w in own.items()), mark) for other, first, mark in examples
                       if first != without), key=lambda x: -x[0])[:toxicity.NEIGHBOURS]
        total = sum(s * s for s, _ in near)
        return sum(s * s * mark for s, mark in near) / total if total else 0.0

    votes = np.asarray([vote(own, first) for own, first, _ in examples])
    curve = toxicity.calibrated(votes, np.asarray([float(m) for *_, m in examples]))
    assert np.all(np.diff(curve[0]) > 0) and np.all(np.diff(curve[1]) >= 0)
    assert np.allclose(model.curve[0], curve[0], atol=1e-4) and np.allclose(model.curve[1], curve[1], atol=1e-4)
    for r in toxicity.score_documents(docs, model).collect():
        own = vector(dict(rows)[r["doc_id"]])
        want = 0.999 * np.interp(vote(own), *curve) + 0.001 * vote(own) if own else model.rate
        assert r["score"] == pytest.approx(want, abs=2e-3)
