"""Token counts under a unigram vocabulary, by dynamic programming over a shared trie.

The pre-tokens of a task's texts go into one trie. A node holds the best score of any segmentation
of its prefix and the number of tokens of that segmentation; both follow from its ancestors, so a
prefix shared by many pre-tokens is scored once. A pre-token's count is the one at its last node.
The trie starts anew beyond a bound, which changes no result.

Scores: the vocabulary file has ranks and no probabilities, so a token of rank r gets the
logarithm of a Zipf probability, 1 / (r + 1) divided by the sum over all ranks. Of segmentations with the
same score the one with fewer tokens counts.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wartalens.llm.bpe import LETTERS, PIECES, REMEMBERED_CUTS, Memory, space_ends
from wartalens.llm.common import prepare_python, quoted

NODES = 400_000                       # nodes of a trie
LONGEST = 256                         # bytes of a pre-token that goes into the trie; longer ones are scored alone
ONE_PIECE = 1 << 40                   # a count of pieces and one of tokens in one integer


def unigram_scores(path: str) -> dict[bytes, float]:
    """Log probability per token of a file with one ``base64 rank`` pair a line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    total = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - total for token, r in ranks.items()}


def extend(piece: bytes, scores: list[float], counts: list[int], vocabulary: dict[bytes, float], longest: int) -> None:
    """Append score and count of the prefix one byte longer than those given."""
    end = len(scores)
    best, fewest = -math.inf, 0
    for start in range(max(0, end - longest), end):
        value = vocabulary.get(piece[start:end])
        if value is not None:
            total = scores[start] + value
            if total > best or total == best and counts[start] + 1 < fewest:
                best, fewest = total, counts[start] + 1
    scores.append(best)
    counts.append(fewest)


class Trie:
    """Prefixes of pre-tokens with the forward score and count of each."""

    def __init__(self, vocabulary: dict[bytes, float]):
        self.vocabulary, self.longest = vocabulary, max(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.score, self.count = [0.0], [0]

    def tokens(self, piece: bytes) -> int:
        """Tokens of the best segmentation; 0 if there is none."""
        if len(piece) > LONGEST:
            scores, counts = [0.0], [0]
            while len(scores) <= len(piece):
                extend(piece, scores, counts, self.vocabulary, self.longest)
            return counts[-1]
        if len(self.child) > NODES:
            self.clear()
        node, scores, counts = 0, [0.0], [0]
        for byte in piece:
            following = self.child[node].get(byte)
            if following is None:
                extend(piece, scores, counts, self.vocabulary, self.longest)
                following = self.child[node][byte] = len(self.child)
                self.child.append({})
                self.score.append(scores[-1])
                self.count.append(counts[-1])
            else:
                scores.append(self.score[following])
                counts.append(self.count[following])
            node = following
        return self.count[node]


class Counter:
    """Pre-tokens and tokens of texts; counts of pieces between spaces are remembered within a bound."""

    def __init__(self, vocabulary: dict[bytes, float]):
        import regex

        self.trie = Trie(vocabulary)
        self.pieces = regex.compile(PIECES).findall
        self.of_cut = Memory(self._cut, REMEMBERED_CUTS)

    def _pieces(self, text: str) -> int:
        return sum(ONE_PIECE + self.trie.tokens(p.encode()) for p in self.pieces(text))

    def _cut(self, cut: str) -> int:
        if space_ends(cut):
            return 0
        return ONE_PIECE + self.trie.tokens(b" " + cut.encode()) if LETTERS(cut) else self._pieces(" " + cut)

    def count(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        first, *cuts = text.split(" ")
        found = list(map(self.of_cut.__getitem__, cuts))
        total = self._pieces(text) if space_ends(first) or 0 in found else self._pieces(first) + sum(found)
        return divmod(total, ONE_PIECE)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(unigram_scores(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_pieces, n_tokens)`` of every whole text; null and empty texts have none.

    Rows that repeat a key or have a null key stay as they are; other columns are not read. No shuffle.
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            found = [count(t) for i in range(0, batch.num_rows, 100) for t in batch.column(1).slice(i, 100).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())],
                names=["key", "n_pieces", "n_tokens"])

    narrow = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", narrow.schema["key"].dataType),
        T.StructField("n_pieces", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)
