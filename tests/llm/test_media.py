import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest

from modgauge.llm import media as op


def png():
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello " * 50)
    return out.getvalue()


JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s", 8, b"moov")
OGG = b"OggS\0\x06" + bytes(8) + bytes(12) + b"\x01\x03abc"
SAMPLES = {"image/png": png(), "image/gif": gif(), "image/bmp": bmp(), "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 999), "image/jpeg": JPEG, "application/pdf": PDF, "video/mp4": MP4, "audio/ogg": OGG, "audio/wav": op.wav(bytes(range(64)))}


@pytest.mark.parametrize("kind", SAMPLES)
def test_types_lengths_and_carving(kind):
    raw = SAMPLES[kind]
    assert op.sniff(raw)[:2] == (kind, len(raw))
    assert op.sniff(raw + b"trailing")[1] == len(raw)
    assert op.sniff(b"noise\x89PNG BM GIF89a" + raw + b" more")[2] == [(kind, 19, len(raw))]
    assert op.sniff(raw[:-1])[1] in (0, len(raw) - 1)


def test_broken_structure_is_refused():
    bad = bytearray(png())
    bad[40] ^= 1
    assert op.sniff(bytes(bad)) == (op.UNKNOWN, 0, [])
    assert op.sniff(None) == op.sniff(b"") == (op.UNKNOWN, 0, [])


def test_media_inside_media_is_carved_once():
    inner = png() + gif()
    assert [t for t, _, _ in op.sniff(op.wav(inner + b"\0" * (len(inner) % 2)))[2]] == ["image/png", "image/gif"]


def test_sniffed_corrects_declared_types(spark):
    rows = [(1, bytearray(png()), "image/jpeg"), (2, bytearray(gif()), "image/gif"), (3, None, None), (4, bytearray(b"xx" + png()), "image/png")]
    got = {r.doc_id: r for r in op.sniffed(spark.createDataFrame(rows, "doc_id long, media binary, declared string"), "media", "declared").collect()}
    assert (got[1].media_type, got[1].corrected, got[2].corrected) == ("image/png", True, False)
    assert got[3].media_type == op.UNKNOWN and bytes(got[4].embedded[0].data) == png()


def crc(data, bits, poly):
    x = 0
    for byte in data:
        x ^= byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x >> bits - 1 & 1 else x << 1) & (1 << bits) - 1
    return x


def flac(frames=3, known=True):
    """Silent 8-bit mono frames of 192 samples in constant subframes."""
    total = 192 * frames if known else 0
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((8000 << 44) | (0 << 41) | (7 << 36) | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x14, 0x02, k])
        body = head + bytes([crc(head, 8, 0x07)]) + b"\x00" + bytes([k + 1])
        out += body + crc(body, 16, 0x8005).to_bytes(2, "big")
    return out


def page(stream, flags):
    return b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<I", stream) + bytes(8) + b"\x01\x03abc"


@pytest.mark.parametrize("known", [True, False])
def test_flac_is_walked_to_its_end(known):
    raw = flac(3, known)
    assert op.sniff(raw)[:2] == ("audio/flac", len(raw))
    kind, length, inside = op.sniff(b"x" + raw + png())
    assert [x[0] for x in inside] == ["audio/flac", "image/png"] and inside[0][2] == len(raw)
    broken = bytearray(raw)
    broken[-5] ^= 1
    assert op.sniff(bytes(broken))[1] in (0, len(flac(2, known)))


def test_updated_pdf_and_streams_of_ogg():
    more = PDF + b"\n2 0 obj\nendobj\nxref\nstartxref\n50\n%%EOF"
    assert op.sniff(more + b"\nplain text %%EOF")[1] == len(more)
    assert [x[2] for x in op.sniff(b"--" + PDF + b"\n" + PDF)[2]] == [len(PDF), len(PDF)]
    two = page(1, 2) + page(2, 2) + page(1, 4) + page(2, 0) + page(2, 4)
    assert op.sniff(two)[1] == len(two) and op.sniff(two + page(3, 2) + page(3, 4))[1] == len(two) + 2 * len(page(3, 2)) and op.sniff(two + page(3, 0))[1] == len(two)


def test_zip_that_holds_a_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", zipped())
    raw = out.getvalue()
    assert op.sniff(raw)[:2] == ("application/zip", len(raw)) and op.sniff(b"12" + raw + png())[2][0] == ("application/zip", 2, len(raw))


def test_repeated_magic_takes_one_pass():
    began = time.perf_counter()
    op.sniff(b"%PDF-1.4 " * 40_000 + b"PK\x03\x04" * 40_000)
    assert time.perf_counter() - began < 5


def read(media):
    """Samples of a stored file by readers of its own: the wave module, or rows of a BMP or PNG."""
    if media[:4] == b"RIFF":
        with wave.open(io.BytesIO(media)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            return w.readframes(w.getnframes())
    if media[:2] == b"BM":
        return media[-(len(media) - 1078) :]
    size = struct.unpack(">I", media[33:37])[0]
    pixels = zlib.decompress(media[41 : 41 + size])
    return b"".join(pixels[i + 1 : i + 65] for i in range(0, len(pixels), 65))


def test_whole_table(docs, rows):
    got = {r.doc_id: r for r in op.round_trip(docs).collect()}
    media = {r.doc_id: r for r in op.with_media(docs).collect()}
    for r in rows:
        g, raw, m = got[r.doc_id], (r.text or "").encode(), bytes(media[r.doc_id].media)
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert read(m) == payload
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        kind = {b"RI": "audio/wav", b"BM": "image/bmp", b"\x89P": "image/png"}[m[:2]]
        assert (g.media_type, g.corrected) == (kind, media[r.doc_id].declared != kind) and g.feature.startswith(f"{media[r.doc_id].declared}->{kind};bytes={len(m)};")
    assert {g.media_type for g in got.values()} == {*op.STORED} and {g.corrected for g in got.values()} == {True, False}
    assert len({(r.text, got[r.doc_id].feature) for r in rows}) == len({r.text for r in rows})


def test_edges(edge, empty):
    got = op.round_trip(edge).collect()
    assert len(got) == edge.count() and {r.payload_bytes for r in got if r.doc_id in (1, 2)} == {64}
    assert op.round_trip(empty).count() == 0
