"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

Leaf i of a word's tree holds the rank of the pair that starts at symbol i, joined with i, so that the root
is the leftmost pair of lowest rank. A merge changes three leaves, and their ancestors are taken anew, until
the root is empty. The trees of many words stand in one array and step together.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of

NONE = np.int64(2**62)
#: Cells of trees that step together, and chunks kept by a worker (as many again may wait to be forgotten).
CELLS, CACHED = 1 << 21, 300_000
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
BREAK, ODD = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    return [letters.get(b) or chr(256 + sum(x not in letters for x in range(b))) for b in range(256)]


class Bpe:
    """A vocabulary with word ends: normalises to NFC, single spaces and lower case, and cuts words before merging."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.pairs = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.pairs.tolist()], np.int64)
        self.made = np.zeros(max(self.rank, default=-1) + 1, np.int64)
        self.made[self.rank] = [pairs[k][1] for k in self.pairs.tolist()]
        self.known: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it can't merge; ids below 0 stand for no symbol."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == key), self.rank[at], NONE)

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, given as its bytes."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, members in by_size.items():
            step = max(1, CELLS >> bits + 1)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._step([words[i] for i in some], bits), strict=True):
                    out[i] = ids
        return out

    def _step(self, words: list[bytes], bits: int) -> list[list[int]]:
        leaves, n = 1 << bits, len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        symbol = np.full((n, leaves + 1), -1, np.int64)
        symbol[:, :leaves] = np.where(np.arange(leaves) < lengths[:, None], self.inner[raw], -1)
        row = np.arange(n)
        symbol[row, lengths - 1] = self.final[raw[row, lengths - 1]]
        after = np.broadcast_to(np.arange(1, leaves + 2), (n, leaves + 1)).copy()
        after[:, leaves] = leaves
        before = np.broadcast_to(np.arange(-1, leaves), (n, leaves + 1)).copy()
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        rank = self.ranks(symbol[:, :leaves].ravel(), symbol[:, 1:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank < NONE, rank << bits | np.arange(leaves), NONE)
        for level in range(bits - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            node = i + leaves
            tree[r, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while len(row := row[tree[row, 1] < NONE]):
            root = tree[row, 1]
            left = root & leaves - 1
            right = after[row, left]
            symbol[row, left] = self.made[root >> bits]
            symbol[row, right] = -1
            beyond, ahead = after[row, right], before[row, left]
            after[row, left], before[row, beyond] = beyond, left
            put(row, right, NONE)
            found = self.ranks(symbol[row, left], symbol[row, beyond])
            put(row, left, np.where(found < NONE, found << bits | left, NONE))
            if (some := ahead >= 0).any():
                r, i = row[some], ahead[some]
                found = self.ranks(symbol[r, i], symbol[r, left[some]])
                put(r, i, np.where(found < NONE, found << bits | i, NONE))
        kept = symbol >= 0
        flat, ends = symbol[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def chunks(self, text: str) -> list[str]:
        """Normalised runs between white space; special tokens of the raw text stand by themselves."""
        if self.cut and "<|" in text and self.cut.search(text):
            out = []
            for i, part in enumerate(self.cut.split(text)):
                out += [f" {part}"] if i % 2 else self.chunks(part)  # no other chunk has a space
            return out
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in BREAK.split(text) if x] if ODD.search(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Keep what the unknown chunks encode to: number of ids, ids in decimals, tokens."""
        if len(self.known) + len(chunks) > CACHED:  # what is not used again before the next time is forgotten then
            self.old, self.known = self.known, {}
        missing = [x for x in chunks if x not in self.known]
        self.known.update((x, self.old[x]) for x in missing if x in self.old)
        new = [x for x in missing if x not in self.old]
        cut = [[] if x[0] == " " else [x] if x.isalpha() else PIECE.findall(x) for x in new]
        pieces = list({p for ps in cut for p in ps})
        ids = dict(zip(pieces, self.merged([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        token = self.token
        for chunk, ps in zip(new, cut, strict=True):
            got = [self.special[chunk[1:]]] if chunk[0] == " " else [i for p in ps for i in ids[p]]
            self.known[chunk] = (len(got), " ".join(map(str, got)), " ".join([token[i] for i in got]))

    def encode_decode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, the ids in decimals, and the text they decode to."""
        cut = [self.chunks(t or "") for t in texts]
        need: set[str] = set()
        for chunks in cut:
            need.update(chunks)
        self.learn(need)
        out = []
        for chunks in cut:
            got = [x for x in map(self.known.__getitem__, chunks) if x[0]]
            out.append((sum(x[0] for x in got), " ".join([x[1] for x in got]), " ".join([x[2] for x in got])))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_decode([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special ones included, as a vocabulary without a decoder gives them."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@cache
def loaded(content: bytes) -> Bpe:
    return Bpe(content)


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null texts count as empty and have no ids; so do blank ones. Rows that repeat a document are encoded
    each. The vocabulary file is read on the driver and goes to the executors with the tasks.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for at, part in parts_of(batch.column(1)):
                rows = bpe.encode_decode(part)
                columns = [batch.column(0).slice(at, len(part)), pa.array([x[0] for x in rows], pa.int64()), pa.array([sha(x[1]) for x in rows]), pa.array([sha(x[2]) for x in rows])]
                if with_ids:
                    columns.append(pa.array([np.array(x[1].split(), np.int32) for x in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame) -> DataFrame:
    """Contract of op7 with the production vocabulary.

    Null, empty and blank texts have no ids and decode to nothing. Repeated rows and ties are encoded one by one; an
    empty table gives no row; other columns are ignored.
    """
    return encoded(docs, word_vocabulary())
