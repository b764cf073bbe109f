"""Token counts (1), token files (5), BPE (8) against the tokenizer library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from wartalens.llm import bpe, queries, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    draw = random.Random(7)
    letters = "ab cdEFG  \n\t'sré0²12Ⅷ½,.!-_<|>x\x1c\x85\xa0　中文字😀éßñ́"
    return [
        "", "<|endoftext|>", "a<|endoftext|> b", "  a  b ", "I'll don't 've", "a \x1cb", "\x00 \x7f", "x" * 3000,
        *("".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)),
        *("".join(chr(draw.randint(1, 0x2FFF)) for _ in range(draw.randint(0, 30))) for _ in range(500)),
    ]


def test_backtracking_equals_library(library):
    encoder, decoder = bpe.tools(PATH)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_library_encoder_equals_library(library):
    encode = token_files.library_encoder(PATH).encode
    for text in odd_texts():
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_stays_within_its_bound():
    made = []
    memory = bpe.Memory(lambda k: made.append(k) or k * 2, 3)
    assert [memory[k] for k in (1, 2, 3, 4, 1, 5, 6, 7, 1)] == [2, 4, 6, 8, 2, 10, 12, 14, 2]
    assert len(memory) <= 3 and len(memory.old) <= 3


def test_cuts_hold_bounded_text(library):
    cuts = token_files.Cuts(library, 1000, most_bytes=4000)
    for i in range(40):
        words = [f"{'long' * 20}{i}", f"w{i}", "same", " x", "a<|endoftext|>"]
        numbers = cuts.numbers(pa.array(words))
        assert numbers[3] == 0 and cuts.known.nbytes < 4000 and len(cuts.known) < 5 * 40
        for word, number in zip(words, numbers):
            ids = library.encode(" " + word, add_special_tokens=False).ids if number else []
            assert cuts.flat[cuts.ends[number - 1] if number else 0:cuts.ends[number]].tolist() == ids


def test_tables_of_pairs_are_bounded_and_can_be_dropped(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    encoder = bpe.Encoder(bpe.Vocabulary(PATH))
    before = encoder.encode(texts := " ".join(filter(None, odd_texts()))).tolist()
    assert 0 < len([k for k in encoder.fits if k[1] >= 0]) <= 50
    encoder.forget()
    assert not encoder.fits and not encoder.of_cut and not encoder.of_piece
    assert encoder.encode(texts).tolist() == before


def test_decoder_replaces_broken_bytes(library):
    ids = library.encode("中", add_special_tokens=False).ids[:1]
    assert bpe.tools(PATH)[1].decode(np.asarray(ids)) == library.decode(ids)


def test_bpe_digests(spark, awkward, texts, library):
    rows = queries.bpe_digests(bpe.encode_decode(awkward, PATH)).collect()
    want = []
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_token_files(spark, awkward, texts, library):
    rows = token_files.token_files(awkward, PATH).collect()
    assert len(rows) == len(texts)
    ids = {(d, t): library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts}
    want = sorted(repr((d, len(ids[d, t]), zlib.crc32(np.asarray(ids[d, t], "<u4").tobytes()))) for d, t in texts)
    assert sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))


def test_token_files_of_wide_ids(spark, awkward):
    folder = token_files.new_path(spark, "wide")
    make = lambda: lambda text: np.asarray([70_000, len(text or "")], "<u4")
    manifest = token_files.write_token_files(awkward, folder, make, 100_000, end_id=5, parts=3)
    rows = token_files.read_token_files(spark, folder, manifest, 100_000, with_ids=True).collect()
    assert len(rows) == awkward.count() and all(r["ids"][0] == 70_000 and r["ids"][2] == 5 for r in rows)


def test_empty_tables(spark, empty):
    assert token_files.token_files(empty, PATH).count() == 0
    assert bpe.encode_decode(empty, PATH).count() == 0
    assert token_counts.token_counts(empty, RANKS).count() == 0


def plain_count(piece: bytes, vocabulary, longest) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        best.append(max((best[s][0] + vocabulary[piece[s:end]], best[s][1] - 1)
                        for s in range(max(0, end - longest), end) if piece[s:end] in vocabulary))
    return -best[-1][1]


def test_token_counts(spark, awkward, texts):
    vocabulary = token_counts.unigram_scores(RANKS)
    longest = max(map(len, vocabulary))
    assert abs(sum(map(np.exp, vocabulary.values())) - 1) < 1e-6
    pieces = regex.compile(bpe.PIECES).findall
    known = {}
    want = []
    for doc, text in texts:
        found = pieces(text or "")
        for p in found:
            if p not in known:
                known[p] = plain_count(p.encode(), vocabulary, longest)
        want.append(repr((doc, len(found), sum(known[p] for p in found))))
    rows = token_counts.token_counts(awkward, RANKS).collect()
    assert sorted(repr(tuple(r)) for r in rows) == sorted(want)


def test_trie_starts_anew(monkeypatch):
    vocabulary = token_counts.unigram_scores(RANKS)
    words = [b" alpha", b" alphabet", b" alp", b" beta", b" alphabetic"] * 2
    want = [plain_count(w, vocabulary, 130) for w in words]
    monkeypatch.setattr(token_counts, "NODES", 8)
    trie = token_counts.Trie(vocabulary)
    assert [trie.tokens(w) for w in words] == want
