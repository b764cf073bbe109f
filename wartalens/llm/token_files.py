"""Token ids as flat binary files with 64-bit document offsets.

Layout of one folder: per range of keys ``part-NNNNN.bin`` holds the ids of its documents one after
the other as little-endian unsigned integers (16 bit if the vocabulary allows, else 32), and
``part-NNNNN.idx`` three arrays: ``n + 1`` offsets and ``n`` keys (little-endian 64-bit), then ``n``
bytes that are 1 where the key is null. Offsets count ids from the start of the part; the part's
base in the whole corpus is the prefix sum of the totals of the parts before it. Both files are
memory-mapped by readers.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wartalens.llm.bpe import REMEMBERED_PIECES, WHITE_SPACE, Memory, packed, space_ends
from wartalens.llm.common import prepare_python, quoted
from wartalens.session import new_path, stage

READ_DOCS = 4096                      # documents per batch on reading back
SLICE_BYTES = 8 << 20                 # text encoded at a time
REMEMBERED_CUTS = 1_000_000           # distinct cuts whose ids a process remembers
REMEMBERED_BYTES = 256 << 20          # and their text at most
WHITE = "".join(WHITE_SPACE)
SPACE_LETTER = "\u0120"               # how byte-level vocabularies spell a space


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Cuts:
    """Ids of cuts that follow a space, looked up by number; starts anew when it holds ``limit`` cuts or ``most_bytes`` of text.

    Cuts stay Arrow strings, known ones are found by Arrow's hash table. New cuts are encoded all at once, as one
    text of words with spaces between: only the first token of a cut begins with a space. Cuts with white space at
    an end may not be looked at alone and have number 0, which has no ids.
    """

    def __init__(self, library, limit: int, most_bytes: int = REMEMBERED_BYTES):
        self.library, self.limit, self.most_bytes = library, limit, most_bytes
        size = library.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([str(library.id_to_token(i)).startswith(SPACE_LETTER) for i in range(size)])
        self._empty()

    def _empty(self) -> None:
        self.known, self.number = pa.array([], pa.string()), np.empty(0, np.int64)      # cuts, and the number of each
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)       # the ids of cut i end at ends[i]

    def numbers(self, cuts: pa.StringArray) -> np.ndarray:
        """Numbers of different cuts."""
        if len(self.known) + len(cuts) > self.limit or self.known.nbytes + cuts.nbytes > self.most_bytes:
            self._empty()
        place = pc.fill_null(pc.index_in(cuts, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            place[new] = len(self.known) + np.arange(np.count_nonzero(new))
            self._learn(cuts.filter(pa.array(new)))
        return self.number[place]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.StringArray) -> None:
        whole = pc.and_(pc.equal(pc.utf8_trim(new, characters=WHITE), new), pc.not_equal(new, "")).to_numpy(zero_copy_only=False)
        sound = new.filter(pa.array(whole))
        ids, begins = np.empty(0, "<u4"), np.empty(0, np.int64)
        if len(sound):
            spaced = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(sound)], pa.int32()), sound), " ")[0].as_py()
            ids, = self._ids([" " + spaced])
            begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(sound) or (len(sound) and begins[0] != 0):         # a special token took a space along
            each = self._ids([" " + cut for cut in sound.to_pylist()])
            ids = np.concatenate(each)
            begins = np.cumsum([0, *map(len, each)])[:-1]
        numbers = np.zeros(len(new), np.int64)
        numbers[whole] = len(self.ends) + np.arange(len(sound))
        if len(sound):
            self.ends = np.append(self.ends, len(self.flat) + np.append(begins[1:], len(ids)))
        self.known, self.number = pa.concat_arrays([self.known, new]), np.append(self.number, numbers)
        self.flat = np.append(self.flat, ids)


class LibraryEncoder:
    """Ids from the ``tokenizers`` library.

    A text is cut at single spaces between visible characters, where a byte-level pre-tokenizer
    without added prefix space always cuts too. Arrow cuts the texts of a batch and numbers their distinct
    cuts; the library encodes the cuts not seen before (:class:`Cuts`), and NumPy puts the ids of
    all texts together. Texts with other white space around spaces, or with text of a special token, go
    to the library whole, as do all texts for tokenizers of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        self.byte_level = parts["normalizer"] is None and parts["post_processor"] is None and parts["model"]["type"] == "BPE" and (
            parts["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cuts = Cuts(self.library, REMEMBERED_CUTS)
        self.of_first = Memory(lambda cut: b"" if space_ends(cut) else self._ids(cut), REMEMBERED_PIECES)

    def _ids(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; a null text is empty."""
        texts = pc.fill_null(texts, "")
        if not self.byte_level:
            return joined_ids([self._ids(text) for text in texts.to_pylist()])
        cuts = pc.split_pattern(texts, " ")
        numbered = cuts.flatten().dictionary_encode()
        kind, n_cuts = numbered.indices.to_numpy().astype(np.int64), cuts.value_lengths().to_numpy().astype(np.int64)
        text_of = np.repeat(np.arange(len(texts)), n_cuts)
        first = np.cumsum(n_cuts) - n_cuts
        later = np.ones(len(kind), bool)
        later[first] = False
        distinct = numbered.dictionary
        own = np.zeros(len(distinct), bool)             # cuts that stand after a space somewhere
        own[kind[later]] = True
        numbers = np.zeros(len(distinct), np.int64)
        numbers[own] = self.cuts.numbers(distinct.filter(pa.array(own)))
        piece = numbers[kind]

        whole = np.zeros(len(texts), bool)              # texts for the library
        whole[text_of[later & (piece == 0)]] = True
        for special in self.specials:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        starts = distinct.take(pa.array(kind[first])).to_pylist()
        heads = [b""] * len(texts)
        for i, cut in enumerate(starts):
            if not whole[i]:
                heads[i] = self.of_first[cut]
                whole[i] = not heads[i]
        for i in np.flatnonzero(whole).tolist():
            heads[i] = self._ids(texts[i].as_py()) if len(starts[i]) or n_cuts[i] > 1 else b""

        # pieces: the known cuts, then the beginning of each text; a text encoded whole has that one only
        ends = self.cuts.ends
        piece[later & whole[text_of]] = 0
        piece[first] = len(ends) + np.arange(len(texts))
        sizes = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, heads), np.int64, len(heads)) // 4])
        flat = np.concatenate([self.cuts.flat, np.frombuffer(b"".join(heads), "<u4")])
        taken = sizes[piece]
        upto = np.cumsum(taken)
        shift = (np.cumsum(sizes) - sizes)[piece] - (upto - taken)
        ids = flat[np.repeat(shift, taken) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.bincount(text_of, taken, len(texts)).astype(np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text."""
        return self(pa.array([text], pa.string()))[0]


def joined_ids(each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4


def one_by_one(encode: Callable[[str | None], np.ndarray]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """An encoder of Arrow arrays from one of single texts."""
    return lambda texts: joined_ids([encode(text).astype("<u4").tobytes() for text in texts.to_pylist()])


def by_bytes(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def _write_part(folder: str, number: int, kind: str, groups: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Write one part; both files appear under their names only when complete, so a retry is safe.

    ``groups`` gives keys, ids and ids per document of consecutive documents.
    """
    system, root = _at(folder)
    system.create_dir(root, recursive=True)
    name = f"{root}/part-{number:05d}"
    draft = f"{root}/.{number:05d}-{uuid.uuid4().hex}"
    keys, nulls, lengths = [], bytearray(), [np.zeros(1, np.int64)]
    with system.open_output_stream(f"{draft}.bin") as out:
        for own, ids, sizes in groups:
            out.write(np.ascontiguousarray(ids, kind).data)
            keys.append(pc.fill_null(own, 0).to_numpy())
            nulls += own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            lengths.append(sizes)
    offsets = np.cumsum(np.concatenate(lengths))
    keys = np.concatenate(keys)
    with system.open_output_stream(f"{draft}.idx") as out:
        out.write(offsets.astype("<i8").tobytes())
        out.write(np.asarray(keys, "<i8").tobytes())
        out.write(bytes(nulls))
    for end in ("bin", "idx"):
        system.move(f"{draft}.{end}", f"{name}.{end}")
    return len(keys), int(offsets[-1])


def write_token_files(
    docs: DataFrame, folder: str, make_encoder: Callable[[], Callable],
    vocabulary_size: int, end_id: int = 0, text: str = "text", key: str = "doc_id", parts: int | None = None, by_batch: bool = False,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files in ascending key order.

    ``make_encoder()`` runs on the executors; what it returns turns a text into its ids or, ``by_batch``, an
    Arrow array of texts into all ids and the number of each text. Returns the manifest, one row per part:
    ``part, n_docs, n_tokens, base``. Null keys come first; rows that repeat a key stand
    together, ordered by a hash of the text. A null or empty text is its end id alone. An empty
    table gives an empty manifest. Ranges are cut on key, text hash and row, so one key may hold any
    share of the rows. The driver sees no row of it.
    """
    prepare_python(docs.sparkSession, 1000)
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder() if by_batch else one_by_one(make_encoder())
        batches = (b for b in batches if b.num_rows)
        if (head := next(batches, None)) is None:
            return

        def groups() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
            for batch in chain([head], batches):
                for a, b in by_bytes(batch.column(1)):
                    part = batch.slice(a, b - a)
                    ids, sizes = encode(part.column(1))
                    ended = np.full(len(ids) + len(sizes), end_id, kind)
                    ended[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                    yield part.column(0), ended, sizes + 1

        number = TaskContext.get().partitionId()
        n_docs, n_tokens = _write_part(folder, number, kind, groups())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([number], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()),
            "n_tokens": pa.array([n_tokens], pa.int64()),
        })

    narrow = docs.select(
        quoted(key).cast("bigint").alias("key"), quoted(text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("hash", F.xxhash64("text"))
    order = ["key", "hash", "row"]
    ranged = narrow.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    written = ranged.select("key", "text").mapInArrow(run, "part int, n_docs bigint, n_tokens bigint")
    totals = stage(written, "token-parts")
    # one row per part: the prefix sum may stand in one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stage(totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-bases")


def _mapped(system: fs.FileSystem, path: str) -> np.ndarray:
    if isinstance(system, fs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(path).read_buffer(), np.uint8) if os.path.getsize(path) else np.empty(0, np.uint8)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)


def read_token_files(
    spark: SparkSession, folder: str, manifest: DataFrame, vocabulary_size: int, with_ids: bool = False
) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` on request).

    ``start`` counts all ids before the document. The checksum is taken over the ids as
    little-endian unsigned 32-bit integers.
    """
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wartalens.llm.bpe import list_array

        system, root = _at(folder)
        for batch in batches:
            for part in batch.to_pylist():
                n, name = part["n_docs"], f"{root}/part-{part['part']:05d}"
                ids, index = _mapped(system, f"{name}.bin").view(kind), _mapped(system, f"{name}.idx")
                offsets, keys = index[:8 * n + 8].view("<i8"), index[8 * n + 8:16 * n + 8].view("<i8")
                null = index[16 * n + 8:].astype(bool)
                for i in range(0, n, READ_DOCS):
                    j = min(n, i + READ_DOCS)
                    own = [ids[offsets[k]:offsets[k + 1]] for k in range(i, j)]
                    columns = {
                        "doc_id": pa.array(keys[i:j], pa.int64(), mask=null[i:j]),
                        "start": pa.array(offsets[i:j] + part["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[i:j + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = list_array(own, "i8")
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    # one part each, dealt evenly: the manifest has one row per part
    parts = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return parts.mapInArrow(run, schema + (", ids array<bigint>" if with_ids else ""))


def token_files(
    docs: DataFrame, path: str, vocabulary_size: int = 50257, end_id: int = 0,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Write the corpus with the library's vocabulary file ``path`` and read it back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    manifest = write_token_files(docs, folder, lambda: library_encoder(path), vocabulary_size, end_id, text, key, by_batch=True)
    return read_token_files(spark, folder, manifest, vocabulary_size)
