"""Media columns: what bytes are, by their signatures and structure rather than by what they are said to be.

Aho-Corasick finds every magic number in one pass. A validator for each format then follows the structure from there and
gives the length, or nothing if the structure doesn't hold; found spans correct declared types, and those that lie within
other bytes are carved out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import pieces
from textloom.shared import stored

UNIT = 192
RATE = 8000
# Fixed values of public formats: magic bytes, and where they stand in a file.
MAGIC = {
    b"RIFF": ("wav", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"BM": ("bmp", 0),
    b"fLaC": ("flac", 0),
    b"OggS": ("ogg", 0),
    b"%PDF-": ("pdf", 0),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"ftyp": ("mp4", 4),
}


class Found(NamedTuple):
    kind: str
    start: int
    end: int


def _wav(b: bytes, at: int) -> int | None:
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, seen = at + 12, set()
    while pos + 8 <= end <= len(b):
        tag, size = struct.unpack_from("<4sI", b, pos)
        seen.add(tag)
        pos += 8 + size + size % 2
    return end if pos == end and {b"fmt ", b"data"} <= seen else None


def _png(b: bytes, at: int) -> int | None:
    pos = at + 8
    while pos + 12 <= len(b):
        size, tag = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or (pos == at + 8) != (tag == b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        pos += 12 + size
        if tag == b"IEND":
            return pos
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) - at < 14:
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        marker, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or not 0xC0 <= marker <= 0xFE:
            return None
        pos += 2 + size
        if marker == 0xDA:  # the coded image goes on to a marker that is neither stuffing nor a restart
            while 0 <= (pos := b.find(b"\xff", pos)) < len(b) - 1:
                if b[pos + 1] == 0xD9:
                    return pos + 2
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            if pos < 0:
                return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) - at < 26:
        return None
    size, reserved, offset, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not reserved and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= size <= len(b) - at else None


def _flac(b: bytes, at: int) -> int | None:
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, size = b[pos] & 127, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind, size) != (0, 34) or pos + 4 + size > len(b):
            return None
        last, pos, first = b[pos] & 128, pos + 4 + size, False
        if last:
            return len(b)  # frames have no length: the stream has the rest
    return None


def _ogg(b: bytes, at: int) -> int | None:
    pos = at
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\0":
        table = b[pos + 27 : pos + 27 + b[pos + 26]]
        end = pos + 27 + len(table) + sum(table)
        if end > len(b):
            return None
        pos = end
        if b[pos - len(table) - sum(table) - 22] & 4:
            return pos
    return None


def _pdf(at: int, marks: dict[str, list[int]]) -> int | None:
    """Up to the first end mark that follows, if a reference to the cross references stands before it."""
    end, start = bisect_left(marks["%%EOF"], at), bisect_left(marks["startxref"], at)
    if end == len(marks["%%EOF"]) or start == len(marks["startxref"]):
        return None
    end = marks["%%EOF"][end]
    return end + 5 if marks["startxref"][start] < end else None


def _gzip(b: bytes, at: int) -> int | None:
    unzip, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not unzip.eof:  # the contents are dropped piece by piece
            tail = b[pos : pos + 65536]
            unzip.decompress(tail, 1 << 20)
            while unzip.unconsumed_tail:
                unzip.decompress(unzip.unconsumed_tail, 1 << 20)
            pos += len(tail)
    except zlib.error:
        return None
    return pos - len(unzip.unused_data) if unzip.eof else None


def _mp4(b: bytes, at: int) -> int | None:
    pos, tags = at, set()
    while pos + 8 <= len(b):
        size, tag = struct.unpack_from(">I4s", b, pos)
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
        if size < 8 or pos + size > len(b) or not tag.isalnum():
            break
        tags.add(tag)
        pos += size
    return pos if {b"ftyp", b"mdat"} <= tags or {b"ftyp", b"moov"} <= tags else None


VALIDATORS = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "flac": _flac, "ogg": _ogg, "gzip": _gzip, "mp4": _mp4}
MARKS = ("%%EOF", "startxref")  # of PDF files, found in the same pass as the magic numbers


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for magic, (kind, offset) in MAGIC.items():
        made.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + offset))
    for mark in MARKS:
        made.add_word(mark, (mark, len(mark) - 1))
    made.make_automaton()
    return made


def sniff(blob: bytes, signs: ahocorasick.Automaton) -> list[Found]:
    """Every span of ``blob`` whose structure holds, in order of start, those within others included."""
    found, magic, marks = [], [], {m: [] for m in MARKS}
    for last, (kind, back) in signs.iter(blob.decode("latin-1")):
        if kind in marks:
            marks[kind].append(last - back)
        elif last >= back:
            magic.append((kind, last - back))
    for kind, at in magic:
        if end := _pdf(at, marks) if kind == "pdf" else VALIDATORS[kind](blob, at):
            found.append(Found(kind, at, end))
    return sorted(found, key=lambda x: (x.start, -x.end))


def true_type(blob: bytes, declared: str | None, signs: ahocorasick.Automaton) -> tuple[str | None, list[Found]]:
    """The type that the structure at the start shows (else the declared one, null included), and the media within."""
    found = sniff(blob, signs)
    whole = next((x for x in found if x.start == 0), None)
    return (whole.kind if whole else declared), [x for x in found if x is not whole]


def carve(blob: bytes, signs: ahocorasick.Automaton) -> list[tuple[Found, bytes]]:
    return [(x, blob[x.start : x.end]) for x in sniff(blob, signs)]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def wav(samples: bytes) -> bytes:
    """A mono WAV file of 8-bit samples; an odd number of them gets the pad byte of its chunk."""
    body = struct.pack("<4s4sIHHIIHH4sI", b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(blob: bytes) -> bytes:
    """The data chunk of a WAV file that ``sniff`` confirmed."""
    pos = 12
    while True:
        tag, size = struct.unpack_from("<4sI", blob, pos)
        if tag == b"data":
            return blob[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        made = [padded(t) for t in piece["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([wav(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])


DIGEST = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signs = automaton()
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            blob = batch.column("media")[i].as_py()
            kind, within = true_type(blob, "application/octet-stream", signs)
            if kind != "wav":
                raise ValueError("stored media is no whole WAV file")
            data = samples(blob)
            wave = np.frombuffer(data, np.uint8)
            level = np.sqrt(np.mean(np.square(wave.astype(np.float32) - 128), dtype=np.float64))
            crossings = np.count_nonzero(np.diff(wave > 127))
            feature = f"{kind};rate={RATE};samples={len(data)};rms={level:.3f};crossings={crossings};embedded={len(within)}"
            rows.append((batch.column("doc_id")[i].as_py(), batch.column("n_bytes")[i].as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) or [()] * len(DIGEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, DIGEST.values(), strict=True)], list(DIGEST))


def store_media(docs: DataFrame) -> DataFrame:
    """Texts as WAV files in a binary column: doc_id, n_bytes, media. Null texts count as empty and hold one unit of blanks;
    rows that repeat stay as many; very long texts are stored whole; other columns are left out, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as media in a written table, read it back, sniff it, and digest what was read.

    Nulls, empty texts, repeated rows and clashing extra columns are as for ``store_media``; an empty table gives no rows."""
    kept = stored(store_media(docs), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return kept.mapInArrow(_digest, schema)
