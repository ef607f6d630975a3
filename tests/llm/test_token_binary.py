import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modgauge.llm import token_binary as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return op.Encoder(f.read())


def expected(library, rows):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(docs, rows, library):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op.round_trip(docs).collect()]
    assert sorted(got) == sorted(expected(library, rows))


def test_edges(edge, empty, library):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op.round_trip(edge).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(expected(library, edge.collect()), key=key)
    assert op.round_trip(empty).count() == 0


def test_encoder_equals_library(encoder, library):
    r = random.Random(4)
    bits = ["a", "the", "Word", "'s", "'ll", "''", "1", "2025", "³", "é", "ß", "日本", "🙂", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "‍", "﻿", ".", "...", "<|endoftext|>", "<|", "|>", "-", "_", "\x00", "́", "०", "ǅ", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(6000)] + ["", " ", "  ", "a b", " a", "a ", "\n a"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for t, w in zip(texts, want, strict=True):
        assert encoder(t).tolist() == w, repr(t)


def test_encoder_on_long_runs_and_without_order(encoder, library):
    for t in ("a" * 300_000, " " * 200_000, "x" + "\n" * 5000 + "y", "\u3000" * 999 + " b", "1" * 5000, "ab<|endoftext|>cd", "日本" * 20_000, "?! " * 10_000):
        assert encoder(t).tolist() == library.encode(t, add_special_tokens=False).ids
    with open(PATH) as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    other = op.Encoder(json.dumps(spec).encode())
    assert other.fast is None and other("the word").tolist() == Tokenizer.from_str(json.dumps(spec)).encode("the word").ids


@pytest.mark.parametrize("n", [0, 1, op.BLOCK_IDS - 1, op.BLOCK_IDS, op.BLOCK_IDS + 1, 3 * op.BLOCK_IDS + 7])
def test_chunk_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    a, b, c = op.unpack(op.pack(np.array([-1, 5]), np.array([n - n // 2, n // 2]), ids))
    assert a.tolist() == [-1, 5] and b.sum() == n and np.array_equal(c, ids)


def test_largest_ids_round_trip():
    ids = np.array([0, 1, 2**31, 2**32 - 1], np.uint32)
    assert np.array_equal(op.unpack(op.pack(np.array([3]), np.array([4]), ids))[2], ids)
    with pytest.raises(ValueError):
        op.unpack(b"XXXX" + bytes(16))


def test_index_covers_the_file(docs):
    chunks = op.write(docs, PATH)
    rows = sorted(chunks.drop("data").collect(), key=lambda r: (r.shard, r.chunk))
    at = {}
    for r in rows:
        assert r.first_id == at.get(r.shard, 0)
        at[r.shard] = r.first_id + r.n_ids
    assert sum(r.n_docs for r in rows) == docs.count()
