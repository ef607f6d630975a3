import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modgauge.llm import bpe as op

sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(op.word_vocabulary(), "rb") as f:
        return op.Bpe(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_whole_table(docs, rows, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.digests(docs).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in rows}


def test_edges(edge, empty, library):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.digests(edge).collect()), key=key)
    assert got == sorted(((r.doc_id, *expected(library, r.text)) for r in edge.collect()), key=key)
    assert op.digests(empty).count() == 0


def test_encode_and_decode_equal_the_library(own, library):
    r = random.Random(3)
    bits = ["a", "THE", "running", "'s", "'LL", "don't", "1", "23", "³", "½", "É", "ß", "Σ", "ΣΑΣ", "日本", "🙂", "‍", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "　", ".", "!?", "<|endoftext|>", "<|startoftext|>", "<|", "-", "_", "\x00", "́", "é", "İ", "ǅ", "ﬁ", "한", "하", " "]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def brute_merge(own, word):
    """Again and again the leftmost pair of lowest rank, by a plain search."""
    pair = {int(k): (int(r), int(own.made[r])) for k, r in zip(own.pairs, own.rank, strict=True)}
    ids = [int(own.inner[b]) for b in word[:-1]] + [int(own.final[word[-1]])]
    while True:
        ranked = [(pair[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in pair]
        if not ranked:
            return ids
        _, i = min(ranked)
        ids[i : i + 2] = [pair[ids[i] << 32 | ids[i + 1]][1]]


def test_segment_tree_equals_plain_search(own):
    r = random.Random(5)
    words = [bytes(r.choice(b"aeinrst") for _ in range(n)) for n in [*range(1, 40), 64, 65, 200] for _ in range(6)] + [b"a" * 500, b"ab" * 100]
    assert own.merged(words) == [brute_merge(own, w) for w in words]


def test_ids_column(docs, library):
    some = docs.where("doc_id < 20")
    got = {r.doc_id: r.ids for r in op.encoded(some, op.word_vocabulary(), with_ids=True).collect()}
    assert got == {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in some.collect()}
