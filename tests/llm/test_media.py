import gzip
import hashlib
import struct
import time
import zlib

import pytest

from textloom.llm import media

DOCS = "doc_id long, text string, media string, n_bytes string"


def png():
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4xy12\xff\x0045\xff\xd0z\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(36) + b"abcd"
OGG = b"OggS\0\4" + bytes(20) + b"\2\1\2xyz"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s4s", 12, b"mdat", b"abcd")
PDF = b"%PDF-1.4\nstartxref\n9\n%%EOF"
WHOLE = {"png": png(), "gif": GIF, "jpeg": JPEG, "bmp": BMP, "ogg": OGG, "mp4": MP4, "pdf": PDF, "gzip": gzip.compress(b"abc" * 99), "wav": media.wav(b"abc")}


@pytest.mark.parametrize("kind", WHOLE)
def test_structure_decides(kind):
    signs, blob = media.automaton(), WHOLE[kind]
    assert media.true_type(blob, "text/plain", signs)[0] == kind
    assert (media.Found(kind, 5, 5 + len(blob)), blob) in media.carve(b"junk " + blob + (b"" if kind == "mp4" else b" more"), signs)
    assert media.true_type(blob[:-1], "text/plain", signs)[0] == "text/plain"


def test_embedded_media_is_carved_from_a_payload():
    kind, within = media.true_type(media.wav(b"ab" + GIF + png() + b"z"), None, media.automaton())
    assert kind == "wav" and [x.kind for x in within] == ["gif", "png"]


def test_digest(spark):
    texts = ["", None, "plain text", "é" * 96, "RIFF BM GIF89a", "x" * 100_000, "plain text"]
    rows = {r.doc_id: r for r in media.media_digest(spark.createDataFrame([(i, t, "m", None) for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        n, payload = media.padded(t)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (n, len(payload), len(payload) + 44) and len(payload) % 192 == 0 < len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest() and r.feature.startswith("wav;")
    assert rows[2][1:] == rows[6][1:] and len(rows) == 7
    assert media.media_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_many_starts_without_an_end_take_one_pass():
    signs, blob = media.automaton(), b"%PDF-" * 40_000 + b"startxref %%EOF"
    began = time.monotonic()
    assert len(media.sniff(blob, signs)) == 40_000 and media.sniff(blob[:-1], signs) == []
    assert time.monotonic() - began < 2
