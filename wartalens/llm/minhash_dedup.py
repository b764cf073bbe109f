"""Near-duplicates by banded MinHash, odd sketches and exact confirmation.

Per text: the set of distinct 5-word shingles as 64-bit hashes, 128 MinHash samples of it, 32
band keys of four samples each, and an odd sketch: the samples folded into a 256-bit parity bitmap,
so that the population count of two sketches' XOR tells how many samples differ.

1. Equal sets become one class with one representative; copies never meet again.
2. Representatives that share a band key are compared with the smallest one of the bucket (a star). Sketches drop
   the pairs far from the threshold, full sets confirm the rest; links are joined into components.
3. Inside the stars that still hold several components, members of different components are compared, block
   against block in bounded tasks that give back links only. Nothing is left uncompared, and no
   pair inside a component is compared again.
4. Links of both steps are joined into components, and every document gets the smallest key of its component.

A pair at the threshold shares no band with probability 5e-6; a sketch drops it beyond five
standard deviations. Every reported link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartalens.llm.common import free_name, prepare_python, quoted
from wartalens.session import stage

SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_WORDS = 4                      # 64-bit words of a sketch
#: XOR bits beyond which a pair is dropped: five standard deviations over the 50 expected at similarity 0.75
MOST_BITS = 92
PERCENT = 75                          # linked if 100 * intersection >= PERCENT * union
BLOCK = 128                           # members of one side of a comparison task
_MIX = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_random = np.random.default_rng(20)
_FLIP = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_SCALE = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles; fewer words are one shingle, none are none."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []       # bytes: A-Z and ASCII white space only
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not words:
        return hashes
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = out * _MIX[0] + hashes[i:n + i] * _MIX[i]
    return np.unique(mixed(out))


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def samples(values: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the random hash functions."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(values), 512):
        np.minimum(least, ((values[i:i + 512, None] ^ _FLIP) * _SCALE).min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as signed 64-bit words."""
    bits = mixed(least + np.arange(len(least), dtype=np.uint64) * _MIX[0]) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8)).view("<i8")


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * _MIX[1]
    for i in range(ROWS):
        keys = mixed(keys ^ (rows[:, i] * _MIX[i]))
    return keys.view(np.int64)


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n, fp, bands, sketch`` per row; without words ``n`` is 0 and the rest null."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, bands, sketches = [], [], [], []
            for i in range(0, batch.num_rows, 100):
                for content in batch.column(1).slice(i, 100).to_pylist():
                    values = shingles(content)
                    n.append(len(values))
                    if not len(values):
                        fps.append(None), bands.append(None), sketches.append(None)
                        continue
                    least = samples(values)
                    fps.append(fingerprint(values)), bands.append(band_keys(least)), sketches.append(odd_sketch(least))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
            ], names=["doc_id", "n", "fp", "bands", "sketch"])

    narrow = docs.select(quoted(key).cast("bigint").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n bigint, fp binary, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """``fp, shingles`` of the classes in ``wanted (fp, first)``, from the text of one of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                sets = [(fp, shingles(t)) for t, fp in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                own = [(fp, s) for fp, s in sets if fingerprint(s) == fp]
                yield pa.RecordBatch.from_arrays([
                    pa.array([fp for fp, _ in own], pa.binary()),
                    pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64())),
                ], names=["fp", "shingles"])

    texts = docs.select(quoted(key).cast("bigint").alias("_key"), quoted(text).cast("string").alias("_text"))
    found = texts.join(wanted, F.col("_key").eqNullSafe(F.col("first"))).select("_text", "fp")
    # rows that repeat a key may give a class twice; equal sets are the same either way
    return found.mapInArrow(run, "fp binary, shingles array<bigint>")


def _match(probes: list[dict], builds: list[dict]) -> list[tuple[bytes, bytes]]:
    """Confirmed links between two blocks, one per probe and component of the other side."""
    bits = lambda side: np.asarray([r["sketch"] for r in side], np.int64).view(np.uint64)
    near = np.zeros((len(probes), len(builds)), np.int64)
    a, b = bits(probes), bits(builds)
    for w in range(SKETCH_WORDS):
        near += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    near = near <= MOST_BITS
    sizes = np.asarray([len(r["shingles"]) for r in builds], np.int64)
    every = np.concatenate([r["shingles"] for r in builds])
    owner = np.repeat(np.arange(len(builds)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for i in np.flatnonzero(near.any(axis=1)):
        mine = probes[i]["shingles"]
        low, high = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(builds))
        linked = near[i] & (100 * both >= PERCENT * (len(mine) + sizes - both))
        seen = {probes[i]["comp"]}
        for j in np.flatnonzero(linked):
            if builds[j]["comp"] not in seen:
                seen.add(builds[j]["comp"])
                out.append((probes[i]["fp"], builds[j]["fp"]))
    return out


def confirmed(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of comparison tasks ``task, side, fp, comp``: side 0 against side 1, components apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1] and (links := _match(sides[1], sides[0])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

        for batch in batches:
            lists, offsets = batch.column("shingles").values.to_numpy(), batch.column("shingles").offsets.to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("task", "side", "fp", "comp", "sketch")]
            for i, (number, side, fp, comp, sketch) in enumerate(zip(*columns, strict=True)):
                if number != task:
                    yield from done()
                    task, sides = number, ([], [])
                sides[side].append({
                    "fp": fp, "comp": comp, "sketch": sketch, "shingles": lists[offsets[i]:offsets[i + 1]].copy()})
        yield from done()

    rows = tasks.join(sets, "fp").select("task", "side", "fp", "comp", "sketch", "shingles")
    parted = rows.repartition("task").sortWithinPartitions("task")
    return parted.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``fp, comp``: the smallest node reachable over ``a, b`` links, by neighbours' minima and pointer jumps.

    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).select(F.col("a").alias("fp"), "comp"), "labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("_near"))
        lower = labels.join(near, labels["fp"] == near["a"]).select(
            "fp", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        lower = stage(lower, "labels")
        jump = lower.select(F.col("fp").alias("_at"), F.col("comp").alias("_next"))
        after = stage(
            lower.join(jump, lower["comp"] == jump["_at"]).select("fp", "_old", F.col("_next").alias("comp")), "labels")
        if after.filter("comp <> _old").isEmpty():
            return after.select("fp", "comp")
        labels = after.select("fp", "comp")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Null and empty texts have no shingles and are their own component. Rows that repeat a key stay
    rows of their own, judged by their text. A null key is never the smallest: a component of null keys
    only has a null id and keeps all its rows.
    """
    rows = stage(signatures(docs, text, key), "signatures")
    classes = stage(
        rows.filter("fp is not null").groupBy("fp").agg(
            F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes")
    buckets = classes.select("fp", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("fp").alias("head"), F.max("fp").alias("_last")).filter("head <> _last")
    stars = stage(
        buckets.join(heads.select("bucket", "head"), "bucket").filter("fp <> head").select("head", "fp").distinct(), "stars")

    sketches = classes.select("fp", "sketch")
    far = sum(
        (F.bit_count(F.col("sketch")[w].bitwiseXOR(F.col("_sketch")[w])) for w in range(1, SKETCH_WORDS)),
        F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("_sketch")[0])))
    close = (
        stars.join(sketches, "fp")
        .join(sketches.select(F.col("fp").alias("head"), F.col("sketch").alias("_sketch")), "head")
        .filter(far <= MOST_BITS).select("head", "fp")
    )
    members = stars.select("fp").union(stars.select("head")).distinct().join(classes.select("fp", "first"), "fp")
    sets = stage(full_sets(docs, members, text, key).dropDuplicates(["fp"]).join(sketches, "fp"), "full-sets")

    def blocks(column: str, count: str):
        return F.pmod(F.xxhash64(column), F.ceil(F.col(count) / BLOCK).cast("bigint"))

    # step 2: the head against blocks of its star
    close = stage(close, "close-pairs")
    sizes = close.groupBy("head").agg(F.count("*").alias("_n"))
    chunks = close.join(sizes, "head").select("head", "fp", blocks("fp", "_n").alias("_part"))
    task = F.xxhash64("head", "_part").alias("task")
    star_tasks = chunks.select(task, F.lit(1).alias("side"), "fp", F.col("fp").alias("comp")).unionByName(
        chunks.select("head", "_part").distinct().select(
            task, F.lit(0).alias("side"), F.col("head").alias("fp"), F.col("head").alias("comp")))
    links = stage(confirmed(star_tasks, sets), "star-links")
    found = components(links)

    # step 3: what is left between components of one star
    group = stars.unionByName(stars.select("head", F.col("head").alias("fp")).distinct())
    placed = stage(
        group.join(found, "fp", "left").select("head", "fp", F.coalesce("comp", "fp").alias("comp")), "placed")
    per_comp = placed.groupBy("head", "comp").agg(F.count("*").alias("_size"))
    open_stars = stage(
        per_comp.groupBy("head").agg(
            F.count("*").alias("_comps"), F.max(F.struct("_size", "comp")).alias("_most"), F.sum("_size").alias("_all")
        ).filter("_comps > 1").select(
            "head", F.col("_most.comp").alias("_main"), F.col("_most._size").alias("_inside"),
            (F.col("_all") - F.col("_most._size")).alias("_outside")),
        "open-stars")
    spots = placed.join(open_stars, "head").select(
        "head", "fp", "comp", (F.col("comp") == F.col("_main")).alias("_in"),
        F.ceil(F.col("_inside") / BLOCK).cast("bigint").alias("_ins"),
        F.ceil(F.col("_outside") / BLOCK).cast("bigint").alias("_outs"),
    ).withColumn("_own", F.pmod(F.xxhash64("fp"), F.when(F.col("_in"), F.col("_ins")).otherwise(F.col("_outs"))))
    # blocks outside the main component meet its blocks (kind 0) and each other (kind 1, the lower number as side 0)
    to = lambda kind, low, high, side: F.struct(
        F.lit(kind).alias("kind"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), F.lit(side).alias("side"))
    own = F.col("_own")
    inside = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_outs") - 1), lambda j: to(0, own, j, 0))
    with_main = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_ins") - 1), lambda i: to(0, i, own, 1))
    with_later = F.transform(F.sequence(own, F.col("_outs") - 1), lambda j: to(1, own, j, 0))
    with_earlier = F.transform(F.sequence(F.lit(0).cast("bigint"), own), lambda i: to(1, i, own, 1))
    dealt = spots.select(
        "head", "fp", "comp", F.explode(F.when(F.col("_in"), inside).otherwise(
            F.concat(with_main, with_later, with_earlier))).alias("t"))
    cross_tasks = dealt.select(F.xxhash64("head", "t.kind", "t.low", "t.high").alias("task"), "t.side", "fp", "comp")
    more = stage(confirmed(cross_tasks, sets), "cross-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    # step 4
    comps = classes.select("fp", "first").join(found, "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    comps = stage(comps, "class-components")
    ids = comps.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = stage(comps.join(ids, "comp").select("fp", "component_id"), "component-ids")
    return rows.select("doc_id", "n", "fp").join(of_class, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the smallest key; columns stay as they are.

    Judged by key: a key survives if any of its rows is kept. Null keys survive.
    """
    gone = link(docs, text, key).groupBy("doc_id").agg(F.bool_or("kept").alias("_any")).filter(
        "doc_id is not null and not _any")
    name = free_name(docs.columns, "_gone")
    gone = stage(gone.select(F.col("doc_id").alias(name)), "dropped-keys")
    return docs.join(gone, quoted(key) == F.col(name), "left_anti")
