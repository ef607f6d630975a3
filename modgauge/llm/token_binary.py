"""Token ids as a binary file: bit-plane shuffling, zstandard for each plane, and a chunk index.

A file is a table of chunks in ascending doc_id order. A chunk holds whole documents and is bytes of its own:

    b"BPL1", then little-endian u32: documents, ids, planes a block (bits of the largest id), ids a block
    doc_ids (i64 each), ids a document (u32 each)
    for each block, for each plane from bit 0: u32 length of the compressed plane
    the compressed planes, in the same order

A block is a fixed number of ids, the last one padded with zeros; plane b of it holds bit b of all its ids.
Next to the bytes stand the shard, the chunk's number, its ids and the shard's ids before it: the index,
which is read without the bytes.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import parts_of, stored

END = 0
#: Stands for a null doc_id, which comes first in the order.
NO_ID = -(1 << 63)
BLOCK_IDS, CHUNK_IDS, LEVEL = 1 << 16, 1 << 18, 1
CHUNKS = "shard int, chunk int, n_docs int, n_ids long, first_id long, data binary"
#: The file's cutting of words that PIECE stands for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The same cutting with the commonest case first; no two cases but the last two begin alike, so their order is free.
PIECE = r" ?(?:\p{L}+|\p{N}+)|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a whole blank stretch of so many characters go to the library: looking back over a very long one fills tiktoken's stack.
BLANK = 500


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One chunk."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    parts = []
    for at in range(0, len(ids), BLOCK_IDS):
        block = np.zeros(BLOCK_IDS, np.uint32)
        block[: len(ids) - at] = ids[at : at + BLOCK_IDS]
        octets = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        for b in range(planes):
            parts.append(compress(np.packbits(octets[b >> 3] & np.uint8(1 << (b & 7)), bitorder="little").tobytes()))
    head = struct.pack("<4s4I", b"BPL1", len(doc_ids), len(ids), planes, BLOCK_IDS)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), np.array([*map(len, parts)], "<u4").tobytes(), *parts])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids a document, and all ids of a chunk."""
    magic, docs, n, planes, size = struct.unpack_from("<4s4I", data)
    if magic != b"BPL1":
        raise ValueError("not a chunk of bit planes")
    at = 20
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    blocks = -(-n // size)
    sizes = np.frombuffer(data, "<u4", blocks * planes, at := at + 4 * docs).tolist()
    at += 4 * blocks * planes
    ids, expand = np.zeros(blocks * size, np.uint32), zstandard.ZstdDecompressor().decompress
    for k, length in enumerate(sizes):
        block, b = divmod(k, planes)
        bits = np.unpackbits(np.frombuffer(expand(data[at : at + length], max_output_size=size // 8), np.uint8), bitorder="little")
        ids[block * size : (block + 1) * size] |= bits.astype(np.uint32) << np.uint32(b)
        at += length
    return doc_ids, lengths.astype(np.int64), ids[:n]


class Encoder:
    """Ids of texts by a byte-level vocabulary file of the tokenizers library, and equal to that library's.

    The library itself encodes texts that hold an added token or a long blank stretch, and all texts where the
    file's merges aren't in the order of their ids. All others go through tiktoken with the file's own vocabulary,
    which needs no cache of words and so no memory that grows with the corpus.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        self.added = [t["content"] for t in spec["added_tokens"]]
        byte = {x: b for b, x in enumerate(byte_letters())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.fast = None
        if spec["pre_tokenizer"] == BYTE_LEVEL and not spec["normalizer"] and merged == [*range(256, 256 + len(merged))]:
            ranks = {bytes(byte[x] for x in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        odd = self.fast is None or any(map(text.__contains__, self.added)) or any(text[i : i + BLANK].isspace() for i in range(0, len(text), BLANK))
        return np.array(self.whole(text) if odd else self.fast.encode_ordinary(text), np.uint32)


@cache
def encoder(content: bytes) -> Encoder:
    return Encoder(content)


def write(docs: DataFrame, path: str) -> DataFrame:
    """Encode, append the end id to each document, and store the chunks; returns the stored table.

    Documents are dealt by range of doc_id and sorted, so that shards follow one another and chunks follow
    one another within a shard. A task that runs again writes the same shard, and only one run's files stay.
    """
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(content.value)
        chunk, first, held, size = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for _, x in held], np.int64)
            data = pack(np.array([d for d, _ in held], np.int64), lengths, np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "n_docs": len(held), "n_ids": size, "first_id": first, "data": data}], schema=SCHEMA)

        for batch in batches:
            for at, part in parts_of(batch.column(1)):
                for doc, ids in zip(batch.column(0).slice(at, len(part)).to_pylist(), map(encode, part), strict=True):
                    held.append((doc, np.append(ids, np.uint32(END))))
                    size += len(ids) + 1
                    if size >= CHUNK_IDS:
                        yield flush()
                        chunk, first, held, size = chunk + 1, first + size, [], 0
        if held:
            yield flush()

    dealt = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(run, CHUNKS), "token-ids", compression="none")


SCHEMA = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("data", pa.binary())])


def read(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored bytes.

    The shards' totals, a row each, place the shards; everything else is in the chunk itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, lengths, ids = unpack(data)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(first + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(np.full(len(ends), shard, np.int32))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    rows = chunks.select("shard", "first_id", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "shard").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Contract of op4: ids by byte_bpe_50k.json with id 0 at each end, written in doc_id order and read back.

    Null texts count as empty and hold the end id alone. Rows that repeat a doc_id follow one another, in order
    of their texts; rows without a doc_id come first of all. Empty tables store no chunk. Other columns are ignored.
    """
    import public_tokenizers

    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json")))
