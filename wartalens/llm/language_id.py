"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the first one
rotated twice, the second once, the third as it is, multiplied element by element. A text's vector
bundles (adds up) the vectors of all its trigrams, a language's prototype the vectors of its
documents at length 1. The nearest prototype by cosine is the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.llm.common import prepare_python, quoted

DIMENSIONS = 1024
TRAINING_ROWS = 20_000                # expected number of labelled documents that prototypes are fitted on
KEPT_TRIGRAMS = 40_000                # vectors an executor keeps
GROUP = 64                            # texts bundled by one matrix product
SLICE = 8192                          # trigrams in one matrix product
SHARPNESS = 30.0                      # cosines to scores
UNKNOWN = "und"
SPACE = 32


class Vectors:
    """Trigram vectors, made when first seen and kept within a bound."""

    def __init__(self):
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.empty((KEPT_TRIGRAMS, DIMENSIONS), np.int8)
        self.is_letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) >= KEPT_TRIGRAMS:
                self.letter.clear()
            bits = np.random.default_rng([17, code]).integers(0, 2, DIMENSIONS, np.int8)
            self.letter[code] = 2 * bits - 1
        return self.letter[code]

    def of(self, trigrams: np.ndarray) -> np.ndarray:
        """Vectors of distinct trigrams, at most ``SLICE`` of them."""
        keys = trigrams.tolist()
        places = [self.place.get(k, -1) for k in keys]
        if (missing := [i for i, p in enumerate(places) if p < 0]):
            if len(self.place) + len(missing) > KEPT_TRIGRAMS:
                self.place.clear()
                missing, places = list(range(len(keys))), [-1] * len(keys)
            for i in missing:
                key, row = keys[i], len(self.place)
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.rows[row] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
                self.place[key] = places[i] = row
        return self.rows[places]

    def trigrams(self, text: str | None) -> np.ndarray:
        """Trigrams of the lower-cased letters, runs of anything else being one space; none without a letter."""
        if not text:
            return np.empty(0, np.int64)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        letter = self.is_letter[codes]
        if not letter.any():
            return np.empty(0, np.int64)
        codes = np.where(letter, codes, SPACE)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.concatenate([[SPACE], codes[keep], [SPACE]])
        return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: the sum of its trigram vectors; zeros without a letter."""
        each = [self.trigrams(t) for t in texts]
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        distinct, inverse = np.unique(np.concatenate(each), return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), [len(e) for e in each])
        for low in range(0, len(distinct), SLICE):
            part = distinct[low:low + SLICE]
            own = (inverse >= low) & (inverse < low + len(part)) if len(distinct) > SLICE else slice(None)
            cells = owner[own] * len(part) + inverse[own] - low
            counts = np.bincount(cells, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
            out += counts.astype(np.float32) @ self.of(part).astype(np.float32)
        return out


_vectors: list[Vectors] = []


def vectors() -> Vectors:
    if not _vectors:
        _vectors.append(Vectors())
    return _vectors[0]


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _groups(texts: list) -> Iterator[tuple[int, list]]:
    """Slices of at most ``GROUP`` texts and about a million characters."""
    start, used = 0, 0
    for i, text in enumerate(texts):
        used += len(text or "")
        if i + 1 - start == GROUP or used > 1 << 20 or i + 1 == len(texts):
            yield start, texts[start:i + 1]
            start, used = i + 1, 0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        training_rows: int = TRAINING_ROWS) -> dict[str, list[float]]:
    """Prototype per language from rows with a language and a letter; null languages are left out.

    Fitted on a sample of about ``training_rows`` rows drawn by a hash of the key (all, if fewer). Sums are made
    per partition and then per language and element, so the driver gets one vector a language.
    """
    prepare_python(labelled.sparkSession)
    known = labelled.select(
        quoted(key).cast("string").alias("key"), quoted(text).cast("string").alias("text"),
        quoted(lang).cast("string").alias("lang"),
    ).filter("lang is not null")
    total = known.count()
    share = min(1.0, training_rows / total) if total else 1.0
    drawn = known.filter(F.pmod(F.xxhash64("key", F.lit("profile")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), object)
            for start, group in _groups(batch.column(0).to_pylist()):
                rows = unit(vectors().bundle(group))
                own = langs[start:start + len(group)]
                for name in set(own):
                    add = rows[own == name].sum(axis=0, dtype=np.float64)
                    total[name] = total[name] + add if name in total else add
        if total:
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(list(total), pa.string()),
                "vector": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64())),
            })

    parts = drawn.select("text", "lang").mapInArrow(sums, "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(
        F.sum("value").alias("value"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("v"))
    return {r["lang"]: r["v"] for r in found.orderBy("lang").collect() if any(r["v"])}


def predict_column(text: Column, profiles: dict[str, list[float]]) -> Column:
    """Struct ``lang_pred, score`` of a text: ``und`` and 0 if it is null, has no letter, or no language is known."""
    names = sorted(profiles)
    matrix = unit(np.asarray([profiles[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)).astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            langs, scores = [], []
            for _, group in _groups(series.tolist()):
                rows = unit(vectors().bundle(group))
                if not names:
                    langs += [UNKNOWN] * len(group)
                    scores += [0.0] * len(group)
                    continue
                cosines = (rows @ matrix.T).astype(np.float64)
                best = cosines.argmax(axis=1)
                weight = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                seen = rows.any(axis=1)
                langs += [names[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)]
                scores += np.where(seen, 1.0 / weight.sum(axis=1), 0.0).tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict(text.cast("string"))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(quoted(key).cast("string").cast("binary")) % 3 == 1


def learnable(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that profiles may be learned from; a null key is never held out."""
    return docs.filter(~F.coalesce(held_out(key), F.lit(False)))


def identify(docs: DataFrame, profiles: dict[str, list[float]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, repeated keys and nulls included."""
    prepare_python(docs.sparkSession)
    narrow = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"))
    found = narrow.withColumn("found", predict_column(F.col("text"), profiles))
    return found.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")


def keep_languages(docs: DataFrame, profiles: dict[str, list[float]], accepted: list[str] | None = None,
                   text: str = "text") -> DataFrame:
    """Rows in an accepted language (any learned one by default); ``und`` is rejected. Columns stay as they are."""
    prepare_python(docs.sparkSession)
    return docs.filter(predict_column(quoted(text), profiles)["lang_pred"].isin(sorted(accepted or profiles)))
