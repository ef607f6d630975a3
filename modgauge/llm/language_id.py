"""Language identification by compression: the language whose text as a dictionary packs a text smallest.

Each language has a raw-content zstandard dictionary of sample text. A text is reduced to lower-case letters
and single spaces and compressed block by block with every dictionary; the least sum of bytes wins, and a
narrow margin is reported as a rejection.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of

#: Bytes of sample text a language (the dictionary), characters that one document may give to it, and characters of all languages.
DICTIONARY, SLICE, ALL_CHARS = 96 << 10, 20_000, 32 << 20
#: Characters compressed at once; whole texts are the sum of their blocks.
BLOCK, LEVEL = 4096, 9
#: Share of the best size by which the second must be larger, or the answer counts as rejected.
MARGIN = 0.01
UNKNOWN = "und"
#: All but letters and numbers that are no digits, and those numbers, which only texts beyond ASCII have.
OTHER, NUMBER = re.compile(r"[\W\d_]+"), regex.compile(r"[^\p{L} ]+")


def letters(text: str | None) -> str:
    """Lower-case letters in words divided by single spaces; empty where the text has no letter."""
    plain = OTHER.sub(" ", (text or "").lower())
    return " ".join((plain if plain.isascii() else NUMBER.sub(" ", plain)).split())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, chars: int = DICTIONARY) -> dict[str, str]:
    """Up to about chars characters of text for each language, from documents that may be learnt from.

    Documents of every length are drawn by a hash of doc_id, at a rate that follows from their language's characters; a
    long one gives SLICE characters from a place of that hash. The sample on the driver is bounded by ALL_CHARS, which many languages share
    alike, whatever the input. This is the classifier's only bound.
    """
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    size = F.length("text")
    piece = F.substring(F.col("text"), (F.floor(draw * F.greatest(size - SLICE, F.lit(0))) + 1).cast("int"), F.lit(SLICE))
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), piece.alias("text"), draw.alias("draw"))
    counts = usable.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).orderBy("lang").collect()
    if not counts:
        return {}
    chars = min(chars, ALL_CHARS // len(counts))
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 2.0 * chars / r["n"])])
    out: dict[str, list[str]] = {}
    for r in usable.where(F.col("draw") < F.element_at(rates, F.col("lang"))).orderBy("draw", "doc_id", "text").select("lang", "text").collect():
        parts = out.setdefault(r["lang"], [])
        if sum(map(len, parts)) < chars:
            parts.append(letters(r["text"]))
    for r in counts:  # a language of few documents may have drawn none
        if not "".join(out.get(r["lang"], [])):
            out[r["lang"]] = [letters(x["text"]) for x in usable.where(F.col("lang") == r["lang"]).orderBy("draw", "doc_id", "text").limit(20).collect()]
    return {k: " ".join(v) for k, v in sorted(out.items())}


@cache
def compressors(samples: tuple[tuple[str, str], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, text in samples:
        content = zstandard.ZstdCompressionDict(text.encode()[-DICTIONARY:].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def identify(text: str | None, packers: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """Language, score and whether the margin is wide enough. Ties go to the language first by code point."""
    plain = letters(text)
    if not plain or not packers:
        return UNKNOWN, 0.0, False
    blocks = [plain[i : i + BLOCK].encode("utf-8", "replace") for i in range(0, len(plain), BLOCK)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in packers]
    best = min(sizes)
    score = 1.0 / sum(2.0 ** min(0.0, float(best - s)) for s in sizes)
    second = sorted(sizes)[1] if len(sizes) > 1 else 2 * best
    return packers[sizes.index(best)][0], score, second - best >= MARGIN * best


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, confident; only text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = compressors(sent.value)
        for batch in batches:
            got = [identify(t, packers) for _, part in parts_of(batch.column(2)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "confident"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")


def languages(docs: DataFrame) -> DataFrame:
    """Contract of op1: doc_id, held_out, lang_pred, score (and confident, false where the margin is narrow).

    Null texts and texts without a letter (of Unicode's category L) are "und" with score 0, as is everything where no language can be learnt.
    Documents without a lang are predicted too. Repeated rows are predicted one by one; an empty table gives no row.
    Ties go to the language first by code point. Other columns are ignored.
    """
    return predict(docs, sample(docs))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
