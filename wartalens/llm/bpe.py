"""Byte-level BPE by backtracking, and decoding through an offset table.

Encoding never replays merges. Per piece of text, an Aho-Corasick automaton gives the longest
vocabulary token at every byte. The encoder walks left to right, takes the longest token that is
compatible with the one before it, falls back to the token's longest proper prefix in the
vocabulary, and steps back when no prefix fits; a position proved dead is never tried again, so the
work is linear in the piece. Two neighbours are compatible when merging their joined bytes would
leave the boundary between them alone; the answers are kept in a table.

The result is the one the reference tokenizer library gives for the same vocabulary file, with
special tokens of the file recognised in the text. Texts are cut at single spaces between visible
characters, where the pre-tokenizer always cuts, and the ids of each cut piece are remembered in a
table of bounded size.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wartalens.llm.common import prepare_python, quoted

WHITE = "\t-\r \x85\xa0  -     　"
PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
LETTERS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+").fullmatch     # surely one piece
WHITE_SPACE = frozenset(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
REMEMBERED_CUTS = 200_000             # entries of one generation of a memory; two generations live
REMEMBERED_PIECES = 100_000
REMEMBERED_PAIRS = 300_000            # answers whether two tokens may stand together; full, the table starts anew


class Memory(dict):
    """``key -> make(key)`` with bounded size: full, it becomes the old generation and starts anew."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def space_ends(cut: str) -> bool:
    """Empty, or white space at an end: such a piece may not be looked at alone."""
    return not cut or cut[0] in WHITE_SPACE or cut[-1] in WHITE_SPACE


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        self.ids = {spell(token): number for token, number in content["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for token, number in self.ids.items():
            self.bytes[number] = token
        for text, number in self.special.items():
            self.bytes[number] = text.encode()
        self.made: dict[int, int] = {}                   # token -> rank of the merge that makes it
        self.halves: dict[int, tuple[int, int]] = {}     # token -> the two tokens merged
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = (spell(m) for m in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.ids[left], self.ids[right]
            whole = self.ids[left + right]
            self.rank[pair] = rank
            if whole not in self.made:
                self.made[whole], self.halves[whole] = rank, pair


class Encoder:
    """Exact BPE ids of texts."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.vocabulary = v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for token, number in v.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), number))
        self.automaton.make_automaton()
        self.prefix = [-1] * v.size
        for token, number in v.ids.items():
            for end in range(len(token) - 1, 0, -1):
                if (shorter := v.ids.get(token[:end])) is not None:
                    self.prefix[number] = shorter
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.of_piece = Memory(lambda piece: packed(self.encode_piece(piece.encode())), REMEMBERED_PIECES)
        self.of_cut = Memory(self._cut, REMEMBERED_CUTS)

    def forget(self) -> None:
        """Drop what was learned from texts. Workers outlive a stage, and these tables should not."""
        self.fits.clear()
        self.of_piece.forget()
        self.of_cut.forget()

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both keeps the boundary between them."""
        return self._boundary_kept(left, right, 1 << 60)

    def _boundary_kept(self, left: int, right: int, before: int) -> bool:
        """No merge ranked under ``before`` crosses the boundary.

        Seen backwards in time, the left token is its right halves, the right token its left
        halves. Each pair that once touched at the boundary would have merged if its merge
        ranks before the merge that used up one of the two; of equal ranks the leftmost goes first.
        """
        made, halves, rank = self.vocabulary.made, self.vocabulary.halves, self.vocabulary.rank
        while True:
            if rank.get((left, right), before) < before:
                return False
            born_left, born_right = made.get(left, -1), made.get(right, -1)
            if born_left < 0 and born_right < 0:
                return True
            if born_left > born_right:
                left, before = halves[left][1], born_left
            else:
                right, before = halves[right][0], born_right + 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.ids.get(piece)
        if whole is not None and self._reachable(whole):
            return [whole]
        longest = [-1] * (len(piece) + 1)
        reach = [0] * len(piece)
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, token
        sizes, prefix, fits = self.vocabulary.bytes, self.prefix, self.fits
        alive = [True] * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else -1
            while token >= 0:
                if alive[at + len(sizes[token])]:
                    if last < 0:
                        break
                    known = fits.get((last, token))
                    if known is None:
                        known = self.compatible(last, token)
                        if len(fits) >= REMEMBERED_PAIRS:
                            fits.clear()
                        fits[(last, token)] = known
                    if known:
                        break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at += len(sizes[token])
                token = longest[at] if at < len(piece) else -1
            else:
                alive[at] = False
                if not out:
                    raise ValueError("no tokenisation: a byte is missing from the vocabulary")
                token = out.pop()
                at -= len(sizes[token])
        return out

    def _reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes gives back the token."""
        if token not in self.vocabulary.halves:
            return len(self.vocabulary.bytes[token]) == 1
        key = (token, -1)
        if key not in self.fits:
            left, right = self.vocabulary.halves[token]
            self.fits[key] = (
                self._reachable(left) and self._reachable(right)
                and self._boundary_kept(left, right, self.vocabulary.made[token])
            )
        return self.fits[key]

    def _cut(self, cut: str) -> bytes:
        """Ids of a piece after a space; empty if it has white space at an end (see ``_plain``)."""
        if space_ends(cut):
            return b""
        if LETTERS(cut):
            return packed(self.encode_piece(b" " + cut.encode()))
        return b"".join(map(self.of_piece.__getitem__, self.pieces(" " + cut)))

    def _plain(self, text: str) -> bytes:
        first, *cuts = text.split(" ")
        if not space_ends(first):
            found = list(map(self.of_cut.__getitem__, cuts))
            if all(found):
                return b"".join([*map(self.of_piece.__getitem__, self.pieces(first)), *found])
        return b"".join(map(self.of_piece.__getitem__, self.pieces(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for a null or empty text."""
        if not text:
            return np.empty(0, "<u4")
        if self.specials is None or not self.specials.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts, at = [], 0
        for match in self.specials.finditer(text):
            if match.start() > at:
                parts.append(self._plain(text[at:match.start()]))
            parts.append(np.asarray([self.vocabulary.special[match.group()]], "<u4").tobytes())
            at = match.end()
        if at < len(text):
            parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), "<u4")


class Decoder:
    """Ids to text: one byte pool and the offset of every token in it."""

    def __init__(self, vocabulary: Vocabulary):
        self.pool = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in vocabulary.bytes])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.pool[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, tuple[Encoder, Decoder]] = {}


def tools(path: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a vocabulary file, built once per Python process."""
    if path not in _loaded:
        vocabulary = Vocabulary(path)
        _loaded[path] = Encoder(vocabulary), Decoder(vocabulary)
    return _loaded[path]


def list_array(rows: list[np.ndarray], kind: str = "i4") -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).astype(kind) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids array<int>, decoded string)`` of every whole text.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat a key or have a
    null key stay as they are; other columns are not read. ``path`` names the vocabulary file on
    every machine. No shuffle; memory is bounded by the batch and the tables of pieces.
    """
    prepare_python(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = tools(path)
        try:
            for batch in batches:
                for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                    ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), list_array(ids), pa.array([decoder.decode(i) for i in ids], pa.string())],
                        names=["key", "ids", "decoded"],
                    )
        finally:
            encoder.forget()
            pa.default_memory_pool().release_unused()

    narrow = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", narrow.schema["key"].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
    ])
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)
