"""Near duplicates (2) against all pairs."""

import random

import numpy as np
import pytest

from wartalens.llm import minhash_dedup as dedup


def word_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """Component and set size per row; equal sets of any key are linked."""
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [key]
        least = min(keys, default=None)
        out.append((key, len(sets[i]), least, key == least))
    return sorted(map(repr, out))


def answered(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_awkward(awkward, texts):
    assert answered(dedup.link(awkward)) == brute(texts)


def test_empty(empty):
    assert dedup.link(empty).count() == 0
    assert dedup.keep_one(empty).columns == empty.columns


def near_copies(seed, groups=6, size=14, length=80):
    draw = random.Random(seed)
    rows, key = [], 0
    for g in range(groups):
        base = [f"w{draw.randint(0, 4000)}" for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 3, 4, 5])):
                words[draw.randrange(length)] = f"n{draw.randint(0, 9000)}"
            rows.append((key, " ".join(words)))
            key += 1
    return rows


def test_near_copies_equal_all_pairs(spark):
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert answered(dedup.link(df)) == brute(rows)


def test_blocks_lose_no_link(spark, monkeypatch):
    rows = near_copies(5, groups=2, size=40)
    monkeypatch.setattr(dedup, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert answered(dedup.link(df)) == brute(rows)


def test_keep_one(spark):
    rows = near_copies(9, groups=2, size=8)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, kept string")
    kept = {eval(r)[0] for r in brute(rows) if eval(r)[3]}
    got = dedup.keep_one(df)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == kept


def test_components_of_a_chain(spark):
    nodes = [bytes([i]) for i in range(40)]
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a binary, b binary")
    found = {bytes(r["fp"]): bytes(r["comp"]) for r in dedup.components(edges).collect()}
    assert found == {n: nodes[0] for n in nodes}


@pytest.mark.parametrize("shared", [75, 85, 95])
def test_sketch_bits_follow_similarity(shared):
    draw = np.random.default_rng(1)
    far = []
    for _ in range(40):
        values = draw.integers(0, 2**64, 200 - shared, dtype=np.uint64)
        common, a, b = values[:shared], values[shared:(200 - shared + shared) // 2], values[(200 - shared + shared) // 2:]
        one, two = (dedup.odd_sketch(dedup.samples(np.concatenate([common, x]))).view(np.uint64) for x in (a, b))
        far.append(int(np.bitwise_count(one ^ two).sum()))
    assert max(far) <= dedup.MOST_BITS
