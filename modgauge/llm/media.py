"""Media columns: signature sniffing with an Aho-Corasick automaton, format validators, and carving.

The automaton finds every magic number of a byte string in one pass; a validator of the format then walks
its structure and gives the length, or refuses. What begins at byte 0 corrects the declared type, what lies
further in is carved.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, stored

UNKNOWN = "application/octet-stream"
UNIT, RATE = 64, 8000


END_MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06")
#: What begins an update of a PDF file after its end mark.
_UPDATE = re.compile(rb"\s*(?:\d+\s+\d+\s+obj|xref\b|%(?!%EOF|PDF-))")


class Ends:
    """Where end marks stand, found in the same pass as the magic bytes, so that no validator searches to the end."""

    def __init__(self, raw: bytes):
        self.raw, self.places = raw, {mark: [] for mark in END_MARKS}

    def add(self, mark: bytes, at: int) -> None:
        self.places[mark].append(at)

    def after(self, mark: bytes, at: int) -> Iterator[int]:
        places = self.places[mark]
        for i in range(bisect.bisect_left(places, at), len(places)):
            yield places[i]

    @cached_property
    def archives(self) -> dict[int, int]:
        """End of each ZIP archive by its start, which follows from the sizes in its end record."""
        out, raw = {}, self.raw
        for at in self.places[b"PK\x05\x06"]:
            if at + 22 <= len(raw):
                size, start, note = struct.unpack_from("<IIH", raw, at + 12)
                base = at - size - start
                if base >= 0 and at + 22 + note <= len(raw) and raw[base + start : base + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    out[base] = at + 22 + note
        return out


def _riff(b: memoryview) -> tuple[str, int] | None:
    form = bytes(b[8:12])
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(form)
    if not kind or len(b) < 20:
        return None
    end = 8 + int.from_bytes(b[4:8], "little")
    at, seen = 12, set()
    if end > len(b):
        return None
    while at + 8 <= end:
        seen.add(bytes(b[at : at + 4]))
        at += 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        at += at & 1
    ok = at == end and (kind != "audio/wav" or {b"fmt ", b"data"} <= seen)
    return (kind, end) if ok else None


def _png(b: memoryview) -> tuple[str, int] | None:
    at, first = 8, True
    while at + 12 <= len(b):
        n, tag = int.from_bytes(b[at : at + 4], "big"), bytes(b[at + 4 : at + 8])
        if at + 12 + n > len(b) or first and tag != b"IHDR" or zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return None
        at, first = at + 12 + n, False
        if tag == b"IEND":
            return "image/png", at
    return None


def _gif(b: memoryview) -> tuple[str, int] | None:
    if len(b) < 14:
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 128 else 0
    at = 13 + table(b[10])
    while at < len(b):
        tag = b[at]
        if tag == 0x3B:
            return "image/gif", at + 1
        if tag == 0x21:
            at += 2
        elif tag == 0x2C and at + 10 < len(b):
            at += 11 + table(b[at + 9])
        else:
            return None
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return None


def _jpeg(b: memoryview) -> tuple[str, int] | None:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF or b[at + 1] < 0xC0:
            return None
        tag = b[at + 1]
        if tag == 0xD9:
            return "image/jpeg", at + 2
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if tag == 0xDA:  # entropy-coded data up to the next marker
            raw = b.obj
            base = len(raw) - len(b)
            while True:
                at = raw.find(b"\xff", base + at) - base
                if at < 0 or at + 1 >= len(b):
                    return None
                if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
            if b[at + 1] == 0xD9:
                return "image/jpeg", at + 2
    return None


def _bmp(b: memoryview) -> tuple[str, int] | None:
    if len(b) < 54:
        return None
    size, _, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, 2)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    ok = planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) and width > 0 and height and (b[30] or start + rows <= size)
    return ("image/bmp", size) if ok else None


def _pdf(b: memoryview, ends: Ends) -> tuple[str, int] | None:
    """To the end of the last update: after an end mark another object, table or comment goes on with the file."""
    if not (bytes(b[5:6]).isdigit() and bytes(b[6:7]) == b"."):
        return None
    base, length = len(b.obj) - len(b), 0
    for at in ends.after(b"%%EOF", base):
        if not length and next(ends.after(b"startxref", base), at) >= at:
            return None
        if length and not _UPDATE.match(b.obj, base + length, at):
            break
        length = at + 5 - base
    return ("application/pdf", length) if length else None


def _gzip(b: memoryview) -> tuple[str, int] | None:
    d, at = zlib.decompressobj(31), 0
    try:
        while not d.eof and at < len(b):
            d.decompress(b[at : at + 65536])
            at += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(at, len(b)) - len(d.unused_data)) if d.eof else None


def _zip(b: memoryview, ends: Ends) -> tuple[str, int] | None:
    base = len(b.obj) - len(b)
    end = ends.archives.get(base)
    return ("application/zip", end - base) if end else None


def _crc_table(bits: int, poly: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x >> bits - 1 else x << 1) & (1 << bits) - 1
        out.append(x)
    return out


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_frame(b: memoryview, at: int) -> tuple[int, int] | None:
    """(bytes of the header, samples) of a frame that begins at a place, by its header's own checksum."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 2] & 15 == 15 or not b[at + 2] >> 4 or b[at + 3] & 1 or b[at + 3] >> 4 > 10:
        return None
    size, rate, lead = b[at + 2] >> 4, b[at + 2] & 15, b[at + 4]
    n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if n == 1 and lead >= 0x80 or n > 7:
        return None
    more = (1 if size == 6 else 2 if size == 7 else 0), (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    end = at + 4 + n + sum(more)
    if end >= len(b):
        return None
    crc = 0
    for x in b[at:end]:
        crc = CRC8[crc ^ x]
    given = int.from_bytes(b[at + 4 + n : at + 4 + n + more[0]], "big") + 1
    samples = 192 if size == 1 else 144 << size if size < 6 else given if size < 8 else 1 << size
    return (end + 1 - at, samples) if crc == b[end] else None


def _flac(b: memoryview) -> tuple[str, int] | None:
    """Walk the metadata blocks, then the frames: each ends where its checksum comes to zero and the next header or the last sample is due."""
    if len(b) < 42 or b[4] & 127 or int.from_bytes(b[5:8], "big") != 34 or not int.from_bytes(b[18:21], "big") >> 4:
        return None
    total, at, last = int.from_bytes(b[21:26], "big") & (1 << 36) - 1, 4, 0
    while not last:
        if at + 4 > len(b):
            return None
        last, at = b[at] & 128, at + 4 + int.from_bytes(b[at + 1 : at + 4], "big")
    if at > len(b):
        return None
    done = 0
    while (head := _flac_frame(b, at)) and not (total and done >= total):
        crc, end = 0, None
        for i in range(at, len(b)):
            crc = CRC16[crc >> 8 ^ b[i]] ^ crc << 8 & 0xFFFF
            if not crc and i - at > head[0] + 1 and (total and done + head[1] >= total or i + 1 == len(b) or _flac_frame(b, i + 1) or not total):
                end = i + 1
                break
        if end is None:
            return None
        done, at = done + head[1], end
    return ("audio/flac", at) if done >= total else None


def _ogg(b: memoryview) -> tuple[str, int] | None:
    """Pages until every stream that began has ended and no other begins."""
    at, running = 0, set()
    while at + 27 <= len(b) and bytes(b[at : at + 4]) == b"OggS" and b[at + 4] == 0:
        flags, stream, n = b[at + 5], bytes(b[at + 14 : at + 18]), b[at + 26]
        if at and not running and not flags & 2:
            break
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            return None
        running.add(stream)
        if flags & 4:
            running.discard(stream)
        at = end
    return ("audio/ogg", at) if at else None


def _mp4(b: memoryview) -> tuple[str, int] | None:
    at, seen = 0, set()
    while at + 8 <= len(b):
        n, tag = int.from_bytes(b[at : at + 4], "big"), bytes(b[at + 4 : at + 8])
        if n < 8 or at + n > len(b) or not tag.isalnum():
            break
        seen.add(tag)
        at += n
    return ("video/mp4", at) if {b"ftyp", b"moov"} <= seen else None


#: magic bytes: (bytes of the file before them, validator, whether it asks for end marks)
SIGNATURES = {
    b"RIFF": (0, _riff, False), b"\x89PNG\r\n\x1a\n": (0, _png, False), b"GIF87a": (0, _gif, False), b"GIF89a": (0, _gif, False), b"\xff\xd8\xff": (0, _jpeg, False), b"BM": (0, _bmp, False),
    b"%PDF-": (0, _pdf, True), b"\x1f\x8b\x08": (0, _gzip, False), b"PK\x03\x04": (0, _zip, True), b"fLaC": (0, _flac, False), b"OggS": (0, _ogg, False), b"ftyp": (4, _mp4, False),
}


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, (ahead, check, asks) in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (len(magic) + ahead - 1, check, asks))
    for mark in END_MARKS:
        found.add_word(mark.decode("latin-1"), (len(mark) - 1, mark, None))
    found.make_automaton()
    return found


def sniff(media: bytes | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type and length of what begins at byte 0, and (type, offset, length) of media further in.

    Embedded media are taken leftmost first and don't overlap; nothing is carved from inside another's bytes,
    but a container at byte 0 may hold some. Null and unknown bytes are UNKNOWN with length 0.
    """
    raw, kind, length, inside, free = media or b"", UNKNOWN, 0, [], 1
    view, hits, ends = memoryview(raw), [], Ends(raw)
    for end, (back, what, asks) in automaton().iter(raw.decode("latin-1")):
        if asks is None:
            ends.add(what, end - back)
        else:
            hits.append((end - back, what, asks))
    for start, check, asks in hits:
        if start < 0 or 0 < start < free:
            continue
        if found := check(view[start:], ends) if asks else check(view[start:]):
            if start == 0:
                kind, length = found
            else:
                inside.append((found[0], start, found[1]))
                free = start + found[1]
    return kind, length, inside


def sniffed(df: DataFrame, column: str, declared: str, key: str = "doc_id") -> DataFrame:
    """For each row: media_type, corrected (the declared type was another), media_length, and embedded with carved bytes."""
    schema = f"{key} long, media_type string, corrected boolean, media_length long, embedded array<struct<type:string,offset:long,data:binary>>"
    kinds = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, said = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            got = [sniff(m) for m in media]
            carved = [[{"type": t, "offset": a, "data": m[a : a + n]} for t, a, n in g[2]] for m, g in zip(media, got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[0] != s for g, s in zip(got, said, strict=True)], pa.bool_()), pa.array([g[1] for g in got], pa.int64()), pa.array(carved, kinds)], [key, "media_type", "corrected", "media_length", "embedded"])

    return df.select(F.col(key).cast("long"), column, declared).mapInArrow(run, schema)


def wav(samples: bytes) -> bytes:
    """8-bit mono samples as a WAVE file; an even number of them."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def wav_samples(media: bytes) -> bytes:
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    return media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")]


def bmp(samples: bytes) -> bytes:
    """8-bit grey pixels, UNIT a row from the top, as a BMP file."""
    start, rows = 54 + 1024, len(samples) // UNIT
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(samples), 0, start, 40, UNIT, -rows, 1, 8, 0, len(samples), 2835, 2835, 256, 0)
    return head + bytes(x for g in range(256) for x in (g, g, g, 0)) + samples


def bmp_samples(media: bytes) -> bytes:
    start, width, height = struct.unpack_from("<I", media, 10)[0], *struct.unpack_from("<ii", media, 18)
    return media[start : start - width * height]


def png(samples: bytes) -> bytes:
    """8-bit grey pixels, UNIT a row, as a PNG file."""
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    rows = np.zeros((len(samples) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def png_samples(media: bytes) -> bytes:
    at, data = 8, []
    while media[at + 4 : at + 8] != b"IEND":
        n = int.from_bytes(media[at : at + 4], "big")
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, UNIT + 1)[:, 1:].tobytes()


#: Types a payload may be stored as, with writer and reader.
STORED = {"audio/wav": (wav, wav_samples), "image/bmp": (bmp, bmp_samples), "image/png": (png, png_samples)}


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared and media of each document: its padded bytes as 8-bit samples or pixels.

    A checksum of the payload picks the format, and the type that is declared, which is wrong for two of three.
    """
    kinds = [*STORED]

    def one(raw: bytes) -> tuple[int, str, bytes]:
        payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")
        told, kind = divmod(zlib.crc32(payload), len(kinds))
        return len(raw), kinds[told % len(kinds)], STORED[kinds[kind]][0](payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts_of(batch.column(1)):
                rows = [one((t or "").encode("utf-8", "surrogatepass")) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def features(table: DataFrame) -> DataFrame:
    """Digests and features of stored media: the declared type and the one sniffed, and what is embedded.

    The sniffed type and not the declared one picks the reader of the samples.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"

    def one(declared: str, media: bytes) -> tuple:
        kind, length, inside = sniff(media)
        if kind not in STORED:
            raise ValueError(f"stored media declared as {declared} is {kind}")
        payload = STORED[kind][1](media)
        feature = f"{declared}->{kind};bytes={length};bits=8;samples={len(payload)};sum={int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))};embedded=" + ",".join(f"{t}@{a}+{k}" for t, a, k in inside)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, kind != declared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for at, media in parts_of(batch.column(3)):
                rows = [one(d, m) for d, m in zip(batch.column(2).slice(at, len(media)).to_pylist(), media, strict=True)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(media)), batch.column(1).slice(at, len(media)), *columns], [c.split()[0] for c in schema.split(", ")])

    return table.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Contract of op9: texts stored as WAVE, BMP or PNG media in a table, read back, sniffed and measured.

    Beside the contract's columns stand media_type, as sniffed, and corrected, where another type was declared.
    Null texts count as empty; an empty payload is 64 zero bytes. Equal texts give equal values, and rows that
    repeat a document give a row each. An empty table stores nothing. Other columns are ignored.
    """
    return features(stored(with_media(docs), "media", compression="zstd"))
