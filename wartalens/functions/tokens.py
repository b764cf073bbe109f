"""Token arrays: splitting, stopwords, stemming. All in-row, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column
from wartalens.functions.batches import arrow_column
from wartalens.functions.stemming import AFFIXES, MIN_SYLLABLES, RULES, stem_word
from wartalens.functions.text import strip_noise

KNOWN_WORDS = 200_000         # words a task remembers with their stems


def tokenize(text: Column | str) -> Column:
    """Whitespace tokens of at least two characters, letters only."""
    return F.filter(
        F.split(as_column(text), r"\s+"),
        lambda t: (F.length(t) > 1) & t.rlike(r"^\p{L}+$"),
    )


def remove_stopwords(tokens: Column | str, stopwords: Iterable[str]) -> Column:
    """Drop listed words, keep order and repeats (the list becomes one hash set)."""
    words = sorted(set(stopwords))
    if not words:
        return as_column(tokens)
    return F.filter(as_column(tokens), lambda t: ~t.isin(words))


def stem_tokens(
    tokens: Column | str,
    protected: Iterable[str] = (),
    overrides: Mapping[str, str] | None = None,
) -> Column:
    """Stem every token; ``protected`` words stay, ``overrides`` win over the rules.

    A large override table belongs in :func:`wartalens.operators.preprocess.stem_with_table`.
    """
    kept = sorted(set(protected))
    table = dict(overrides or {})

    def one(t: Column) -> Column:
        stem = stem_word(t)
        if table:
            pairs = [F.lit(part) for item in sorted(table.items()) for part in item]
            stem = F.when(t.isin(sorted(table)), F.element_at(F.create_map(*pairs), t)).otherwise(stem)
        return F.when(t.isin(kept), t).otherwise(stem) if kept else stem

    return F.transform(as_column(tokens), one)


def _kept_stems(words: Iterable[str], protected: Iterable[str], overrides: Mapping[str, str] | None) -> Callable[[Column], Column]:
    """Tokens of a text after :func:`strip_noise`: its runs of ASCII letters as :func:`tokenize`,
    :func:`remove_stopwords`, :func:`stem_tokens` and :func:`remove_stopwords` in turn leave them.

    All four look at one token alone, so a slice of texts applies them to its distinct tokens, and a task
    remembers what became of them. Bytes that are no letters become spaces in one pass over the slice.
    """
    letters = bytes(b if chr(b).isascii() and chr(b).isalpha() else 32 for b in range(256))
    stopwords, kept, given = frozenset(words), frozenset(protected), dict(overrides or {})
    needed, rules, most = (AFFIXES, MIN_SYLLABLES), list(RULES), KNOWN_WORDS

    def prepare():
        tried = [re.compile(pattern) for pattern in needed]
        chain = [(re.compile(pattern), replacement) for pattern, replacement in rules]
        known: dict[str, str | None] = {}

        def outcome(token: str) -> str | None:
            if len(token) < 2 or token in stopwords:
                return None
            stem = token
            if token not in kept:
                if token in given:
                    stem = given[token]
                elif all(pattern.search(token) for pattern in tried):
                    for pattern, replacement in chain:
                        stem = pattern.sub(replacement, stem)
            return None if stem in stopwords else stem

        def work(texts: pa.Array) -> pa.Array:
            texts = texts.cast(pa.string())
            starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
            data = texts.buffers()[2].slice(starts[0], starts[-1] - starts[0]).to_pybytes() if starts[-1] else b""
            plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(starts - starts[0]), pa.py_buffer(data.translate(letters)))
            split = pc.ascii_split_whitespace(plain)
            coded = split.flatten().dictionary_encode()
            if len(known) > most:
                known.clear()
            listed = coded.dictionary.to_pylist()
            for token in listed:
                if token not in known:
                    known[token] = outcome(token)
            stems = pa.array([known[token] for token in listed], pa.string())
            codes = coded.indices.to_numpy(zero_copy_only=False)
            stays = stems.is_valid().to_numpy(zero_copy_only=False)[codes]
            ends = np.cumsum(split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            offsets = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems.take(pa.array(codes[stays])))

        return work

    return arrow_column(prepare, "array<string>")


def preprocess_text(
    text: Column | str,
    stopwords: Iterable[str],
    protected: Iterable[str] = (),
    overrides: Mapping[str, str] | None = None,
    **clean_options: bool,
) -> Column:
    """Clean, tokenise, drop stopwords, stem, drop stopwords again."""
    return _kept_stems(stopwords, protected, overrides)(strip_noise(text, **clean_options))
