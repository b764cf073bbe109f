"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of non-ASCII bytes, with A-Z lower-cased. A window is
13 consecutive words of a benchmark item; a shorter item is one window. The windows' hashes form a
sorted set that every executor gets. Documents are scanned in place: word hashes are combined
into window hashes, looked up in the set, and every hit is verified word by word. The set is
built in blocks of bounded size; a larger benchmark only means more blocks over the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.llm.common import prepare_python, quoted

WINDOW = 13
BLOCK_BYTES = 64 << 20                # text of benchmark items in one broadcast block
DELIMITERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:int,last:int>>"


def normalised_words(text: str | None) -> list[bytes]:
    """Words of a text; none for null."""
    return text.encode().translate(DELIMITERS).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` words: a polynomial of the word hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = hashes[:len(hashes) - size + 1].copy()
    for i in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i:len(hashes) - size + 1 + i]
    return out


class WindowSet:
    """Windows of some benchmark items: per length a sorted array of hashes, and where each occurs."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.items = [(item, words) for item, text in items if (words := normalised_words(text))]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for number, (_, words) in enumerate(self.items):
            length = min(size, len(words))
            found.setdefault(length, []).append((window_hashes(word_hashes(words), length), number))
        self.by_length = {}
        for length, parts in found.items():
            hashes = np.concatenate([p for p, _ in parts])
            owner = np.concatenate([np.full(len(p), n) for p, n in parts])
            start = np.concatenate([np.arange(len(p)) for p, _ in parts])
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = hashes[order], owner[order], start[order]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (first, one past the last) of all verified hits, and the items hit."""
        spans, hit = [], set()
        hashes = word_hashes(words)
        for length, (known, owner, start) in self.by_length.items():
            mine = window_hashes(hashes, length)
            low = np.searchsorted(known, mine)
            low[low == len(known)] = 0
            for at in np.flatnonzero(known[low] == mine) if len(known) else ():
                window = words[at:at + length]
                k = low[at]
                while k < len(known) and known[k] == mine[at]:
                    item, text = self.items[owner[k]]
                    if text[start[k]:start[k] + length] == window:
                        hit.add(item)
                        spans.append((int(at), int(at) + length))
                    k += 1
        return spans, hit


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text, brought to the driver one partition at a time."""
    block, used = [], 0
    rows = benchmark.select(quoted(item).cast("string").alias("i"), quoted(text).cast("string").alias("t"))
    for row in rows.filter("i is not null and t is not null").toLocalIterator():
        block.append((row["i"], row["t"]))
        used += len(row["t"].encode())
        if used >= limit:
            yield block
            block, used = [], 0
    if block:
        yield block


def scan_column(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> Column:
    """Struct ``n_words, n_hit, items, spans`` for the text of each document.

    Null or empty texts have no words. Items without an id, text or word are left out; repeated items
    count once. ``spans`` are merged word ranges, last exclusive. Executors hold one block of the
    benchmark at a time, of ``block_bytes`` of text (plus one item).
    """
    spark = docs.sparkSession
    prepare_python(spark)
    shared = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, item, item_text, block_bytes)]

    @F.pandas_udf(RESULT)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = WindowSet(shared[0].value) if len(shared) == 1 else None
        for series in texts:
            words = [normalised_words(t) for t in series]
            spans, hit = [[] for _ in words], [set() for _ in words]
            for block in shared:
                windows = only or WindowSet(block.value)
                for i, w in enumerate(words):
                    if w:
                        more, items = windows.scan(w)
                        spans[i] += more
                        hit[i] |= items
                if only is None:                        # one block in memory at a time; it is read again from local disk
                    vars(block).pop("_value", None)
            whole = [merged(s) for s in spans]
            yield pd.DataFrame({
                "n_words": [len(w) for w in words],
                "n_hit": [sum(b - a for a, b in s) for s in whole],
                "items": [sorted(h) for h in hit],
                "spans": [[{"first": a, "last": b} for a, b in s] for s in whole],
            })

    return scan(quoted(text).cast("string"))


def contaminated(found: Column) -> Column:
    """The rule: some word hit, and at least a twentieth of the words."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents that are not contaminated; rows and columns unchanged."""
    return docs.filter(~contaminated(scan_column(docs, benchmark, text, **options)))


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cut in zip(texts, spans, strict=True):
        if text is None or cut is None or not len(cut):
            out.append(text)
            continue
        raw = text.encode()
        plain = np.frombuffer(raw.translate(DELIMITERS), np.uint8) != 32
        edge = np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kept, at = [], 0
        for span in cut:
            kept.append(raw[at:begins[span["first"]]])
            at = ends[span["last"] - 1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with the words of every hit cut out of the text; other columns unchanged."""
    found = scan_column(docs, benchmark, text, **options)
    return docs.withColumn(text, F.pandas_udf(_without, "string")(quoted(text).cast("string"), found["spans"]))
