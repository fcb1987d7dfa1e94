"""Removing bytes of long strings that start anywhere else, by refining buckets of sampled suffixes.

Bucket-pointer refinement sorts all suffixes on the bucket identifiers of later offsets; that would move 16 bytes for every
byte of text and round. Here suffixes are sampled at anchors and refined by digests of the bytes themselves instead.

A string of ``LENGTH`` bytes holds one anchor that its bytes alone decide: of its first ``SPAN`` places the one whose q-gram
hash is least, leftmost of equals. Every start of a string so belongs to one anchor, and equal strings to anchors with equal
surroundings. Suffixes are bucketed at their anchors by the ``LENGTH - SPAN + 1`` bytes that follow, which all strings of an
anchor contain; a bucket of one is done with. Buckets are then refined: first by what surrounds the anchor as far as any of
its strings reach, which settles whole and near copies, then, for one suffix of each kind in buckets of several kinds, by
blocks of starts (all of a block's strings repeat if what they span together does; none does if what they share doesn't),
and last by single starts in blocks that neither settles. Each refinement reuses the buckets that the one before left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.shared import discard, stored

LENGTH = 400
SPAN = 192
GRAM = 32
BLOCK = 16
PIECE = 1 << 20
BROADCAST_VALUES = 4_000_000


class Anchors:
    """Of one piece of bytes that holds whole documents: the anchors and the first and last start that belong to each."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, span: int):
        self.at = self.first = self.last = np.zeros(0, np.int64)
        n, gram = len(data), min(GRAM, length - span + 1)
        if n < length:
            return
        h = _mixed(data)
        for step in _doublings(gram):  # hashes of longer grams from those of shorter ones
            h = h[: len(h) - step[1]] * step[2] + h[step[1] :]
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        key = (h ^ h >> np.uint64(32)) & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
        least = _least(key, span)
        starts = np.arange(n - length + 1)
        least = (least[: len(starts)] & np.uint64((1 << 24) - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(end)), end - start)[: len(starts)]
        whole = starts + length <= end[doc]
        starts, least, doc = starts[whole], least[whole], doc[whole]
        if not len(starts):
            return
        edge = np.flatnonzero((np.diff(least) != 0) | (np.diff(doc) != 0)) + 1
        first = np.r_[0, edge]
        self.at, self.first, self.last = least[first], starts[first], starts[np.r_[edge - 1, len(starts) - 1]]


def _doublings(gram: int) -> list[tuple[int, int, np.uint64]]:
    steps, have = [], 1
    while have < gram:
        step = min(have, gram - have)
        steps.append((have, step, np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64))))
        have += step
    return steps


def _mixed(data: np.ndarray) -> np.ndarray:
    table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    table = (table ^ table >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return table[data]


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` in a row, over blocks read from both sides."""
    n = len(key)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _short(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of rows whose ``text`` (as bytes) comes to ``PIECE`` together, or of one larger row."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        held, size = {n: [] for n in cols}, 0
        for i in range(batch.num_rows):
            raw = (cols["text"][i].as_py() or "").encode("utf-8", "surrogatepass")
            if held["text"] and size + len(raw) > PIECE:
                yield held
                held, size = {n: [] for n in cols}, 0
            for n in cols:
                held[n].append(raw if n == "text" else cols[n][i].as_py())
            size += len(raw)
        if held["text"]:
            yield held


def _strips(texts: list[bytes], length: int):
    """Joined documents with their bounds, and the range of starts to report; a document longer than a piece comes in strips
    that overlap far enough for the anchors of the range to be what they are in the whole."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        for lo in range(0, len(texts[0]) - length + 1, PIECE):
            base = max(0, lo - length)
            part = texts[0][base : lo + PIECE + 2 * length]
            yield base, part, np.zeros(1, np.int64), np.array([len(part)]), lo - base, lo - base + PIECE
    else:
        end = np.cumsum([len(t) for t in texts])
        yield 0, b"".join(texts), np.r_[0, end[:-1]], end, 0, int(end[-1])


SUFFIXES = "row long, at long, first long, last long, near long, wide long"


def _suffixes(length: int, span: int):
    """Of every anchor: its document and place, the first and last start that are its own, a hash of what follows it in all of
    its strings (near) and one of all that any of them could reach (wide)."""
    common = length - span + 1

    def run(batches):
        for piece in _documents(batches):
            rows = [[] for _ in range(6)]
            for base, data, start, end, low, high in _strips(piece["text"], length):
                found = Anchors(np.frombuffer(data, np.uint8), start, end, length, span)
                doc = np.searchsorted(end, found.first, "right")
                mine = (found.first >= low) & (found.first < high)
                for a, f, z, d in zip(*(x[mine].tolist() for x in (found.at, found.first, found.last, doc)), strict=True):
                    s, e = int(start[d]), int(end[d])
                    lo = max(a - span + 1, s)
                    shift = base - s
                    rows[0].append(piece["row"][d])
                    rows[1].append(a + shift)
                    rows[2].append(f + shift)
                    rows[3].append(z + shift)
                    rows[4].append(_short(data[a : a + common]))
                    rows[5].append(_short(b"%d " % (a - lo) + data[lo : min(a + length, e)]))
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["row", "at", "first", "last", "near", "wide"])

    return run


def _contexts(length: int, span: int):
    """For the anchors asked for in each document: the bytes that their strings could reach, and where the anchor is in them."""
    names = ["row", "at", "first", "last", "n", "lo", "context"]

    def run(batches):
        for piece in _documents(batches):
            rows = [[] for _ in names]
            for row, text, asked in zip(piece["row"], piece["text"], piece["asked"], strict=True):
                for q in asked:
                    at = q >> 24
                    first = at - (q >> 12 & 0x7FF)
                    last = at - (q & 0xFFF)
                    lo = max(0, at - span + 1)
                    for r, v in zip(rows, (row, at, first, last, 1 + (q >> 23 & 1), lo, text[lo : at + length]), strict=True):
                        r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary() if n == "context" else pa.int64()) for n, r in zip(names, rows, strict=True)], names)

    return run


def _blocks(length: int):
    """Blocks of starts of each context: a digest of what the strings of a block span together (null where the document ends
    before that) and one of what all of them share."""
    names = ["row", "at", "n", "block", "spanned", "shared"]

    def run(batches):
        for batch in batches:
            rows = [[] for _ in names]
            for r in batch.to_pylist():
                at, text = r["at"] - r["lo"], r["context"]
                for b in range((r["at"] - r["last"]) // BLOCK, (r["at"] - r["first"]) // BLOCK + 1):
                    near, far = at - b * BLOCK, at - b * BLOCK - BLOCK + 1
                    spanned = _digest(b"%d " % b + text[far : near + length]) if far >= 0 and near + length <= len(text) else None
                    shared = text[near : far + length] if near >= 0 else None
                    for c, v in zip(rows, (r["row"], r["at"], r["n"], b, spanned, _digest(b"%d " % b + shared)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in ("spanned", "shared") else pa.int64()) for n, c in zip(names, rows, strict=True)], names)

    return run


def _starts(length: int):
    """Single starts of the blocks asked for, with a digest of each one's string."""
    names = ["row", "at", "n", "back", "string"]

    def run(batches):
        for batch in batches:
            rows = [[] for _ in names]
            for r in batch.to_pylist():
                for b in r["blocks"]:
                    lo, hi = max(b * BLOCK, r["at"] - r["last"]), min((b + 1) * BLOCK - 1, r["at"] - r["first"])
                    for back in range(lo, hi + 1):
                        s = r["at"] - back - r["lo"]
                        for c, v in zip(rows, (r["row"], r["at"], r["n"], back, _digest(b"%d " % back + r["context"][s : s + length])), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "string" else pa.int64()) for n, c in zip(names, rows, strict=True)], names)

    return run


def _repeated(rows: DataFrame, by: str) -> DataFrame:
    """Values of ``by`` that stand for two suffixes or more; written, as a join where they are counted would hold a common
    value's rows in one task."""
    return stored(rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum("n").alias("members")).where("members > 1").select(by), "repeated")


def repeated_spans(docs: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """row, lo, hi: spans of bytes of ``docs`` (row, text) that strings of ``length`` bytes with a second start cover.

    Spans of a row may overlap, and together cover exactly those bytes. Rows that share ``row`` must have the same text."""
    suffixes = stored(docs.mapInArrow(_suffixes(length, span), SUFFIXES), "suffixes")
    shared = _repeated(suffixes.select("near", F.lit(1).alias("n")), "near")
    bucketed = stored(suffixes.join(shared, "near"), "buckets")
    discard(suffixes, shared)
    kinds = stored(bucketed.groupBy("near", "wide").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "first", "last")).alias("one")), "kinds")
    whole = bucketed.join(kinds.where("n > 1").select("near", "wide"), ["near", "wide"])
    covers = whole.select("row", (F.col("at") - span + 1).alias("lo"), (F.col("at") + length).alias("hi"))

    mixed = kinds.groupBy("near").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("near")
    mixed = stored(mixed, "mixed")
    one = kinds.join(mixed, "near").select("one.*", F.when(F.col("n") > 1, 1).otherwise(0).cast("long").alias("more"))
    # A request in one number: place, whether others are like it, and how far before it its first and last start lie.
    packed = F.shiftleft("at", 24).bitwiseOR(F.shiftleft("more", 23)).bitwiseOR(F.shiftleft(F.col("at") - F.col("first"), 12)).bitwiseOR(F.col("at") - F.col("last"))
    asked = stored(one.groupBy("row").agg(F.collect_list(packed).alias("asked")), "asked")
    held = docs.join(_small(asked, "asked"), "row")
    contexts = stored(held.mapInArrow(_contexts(length, span), "row long, at long, first long, last long, n long, lo long, context binary"), "contexts")

    blocks = stored(contexts.mapInArrow(_blocks(length), "row long, at long, n long, block long, spanned binary, shared binary"), "blocks")
    open_ = blocks.where("n = 1")
    full = open_.join(_repeated(blocks, "spanned"), "spanned").select("row", "at", "block")
    covers = covers.union(full.select("row", (F.col("at") - (F.col("block") + 1) * BLOCK + 1).alias("lo"), (F.col("at") - F.col("block") * BLOCK + length).alias("hi")))

    doubtful = open_.join(full.distinct(), ["row", "at", "block"], "left_anti").join(_repeated(blocks, "shared"), "shared").select("shared").distinct()
    doubtful = stored(doubtful, "doubtful")
    unsure = blocks.join(doubtful, "shared")  # with those already covered, whose strings are second starts to others
    unsure = unsure.groupBy("row", "at").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    starts = contexts.join(unsure, ["row", "at"]).select("row", "at", "first", "last", "n", "lo", "context", "blocks")
    starts = stored(starts.mapInArrow(_starts(length), "row long, at long, n long, back long, string binary"), "starts")
    single = starts.where("n = 1").join(_repeated(starts, "string"), "string")
    return covers.union(single.select("row", (F.col("at") - F.col("back")).alias("lo"), (F.col("at") - F.col("back") + length).alias("hi")))


def _small(table: DataFrame, values: str) -> DataFrame:
    """A hint to broadcast a stored table whose rows and lists of longs come to few values; with more, the join shuffles."""
    n = table.agg(F.coalesce(F.sum(F.size(values) + 4), F.lit(0))).first()[0]
    return F.broadcast(table) if n <= BROADCAST_VALUES else table


KEPT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Spans clipped to ``n`` bytes, as maximal runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, a), min(n, b)) for a, b in spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a row as the bounds of its runs, in one list."""
    for batch in batches:
        runs = [[x for run in merged([(s["lo"], s["hi"]) for s in spans.as_py()], 1 << 62) for x in run] for spans in batch.column("spans")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(runs, pa.list_(pa.int64()))], ["row", "runs"])


def _cut(with_bytes: bool):
    names = [n for n in KEPT if with_bytes or n != "kept"]

    def run(batches):
        for piece in _documents(batches):
            rows = []
            for doc_id, text, bounds in zip(piece["doc_id"], piece["text"], piece["runs"], strict=True):
                runs = merged(list(zip(*[iter(bounds or [])] * 2, strict=True)), len(text))
                kept = b"".join(text[a:b] for a, b in zip([0, *(hi for _, hi in runs)], [*(lo for lo, _ in runs), len(text)], strict=True))
                rows.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[list(KEPT).index(n)] for r in rows], KEPT[n]) for n in names], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, with_bytes: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_bytes`` the kept bytes.

    Removed is each byte that a ``length``-byte string covers which also starts elsewhere in the given texts, the same
    document included. A null text counts as empty; texts shorter than ``length`` lose nothing. Rows that repeat are each
    other's copies, so all of their strings have a second start; a null doc_id is kept. A row is known by the 64-bit hash of its id
    and text. Very long texts are read whole, in strips. Other columns are left out, whatever their names; an empty table
    gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = repeated_spans(texts.select("row", "text"), length, span)
    per_row = stored(spans.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).mapInArrow(_runs, "row long, runs array<bigint>"), "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return texts.join(_small(per_row, "runs"), "row", "left").select("doc_id", "text", "runs").mapInArrow(_cut(with_bytes), schema)
