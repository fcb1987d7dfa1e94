"""SimHash fingerprints of texts, and the groups that they form at a few differing bits.

Fingerprints within ``radius`` bits agree in full on at least one of ``radius + 1`` blocks of bits, so each distinct one
is dealt out once for every block. A block value with more than ``BUCKET`` fingerprints is dealt out again by blocks of its
remaining bits, up to ``DEPTH`` blocks in all (31 bits or more), and what then meets is compared in pieces of bounded size
however much it is. Within a bucket fingerprints are sorted by Gray rank and indexed in a hierarchy whose nodes hold the bits that all below them share: node pairs that differ
in more than ``radius`` shared bits are pruned whole. A bucket gives the links of a spanning forest, never all pairs; the
forests are joined into components over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import pieces
from textloom.llm.components import connected_components
from textloom.shared import stored

RADIUS = 4
WORDS = 4
SEED = 42
BUCKET = 1024
DEPTH = 3
LEAF, FAN = 16, 4
PIECE = 4096


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of the ``WORDS``-word shingles of a text, repeats included; zero without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    whole = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.r_[0, end[:-1] + 1][:n].tolist()
    stop = end[min(len(words), WORDS) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(whole[a:b], SEED) for a, b in zip(start, stop, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        found = np.array([fingerprint(t) for t in piece["text"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a long with the fingerprint's bits) of every row; a null text has fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints by Gray rank, under nodes that hold the value of the bits which all below them share."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # shared bits and their values, leaves' parents first
        ones, any_ = self.fps, self.fps
        size = LEAF
        while True:
            at = np.arange(0, len(ones), size)
            ones, any_ = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)
            self.levels.append((ones | ~any_, ones))
            if len(ones) == 1:
                break
            size = FAN

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in ``fps`` of all pairs at most ``radius`` bits apart, each once, in pieces of bounded size."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > PIECE:
                todo += [(level, a[i : i + PIECE], b[i : i + PIECE]) for i in range(0, len(a), PIECE)]
            elif level:
                shared, value = self.levels[level - 1]
                a, b = self._below(a, b, FAN, len(shared))
                near = np.bitwise_count((value[a] ^ value[b]) & shared[a] & shared[b]) <= radius
                todo.append((level - 1, a[near], b[near]))
            elif len(a):
                a, b = self._below(a, b, LEAF, len(self.fps))
                near = (a != b) & (np.bitwise_count(self.fps[a] ^ self.fps[b]) <= radius)
                yield a[near], b[near]

    @staticmethod
    def _below(a: np.ndarray, b: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = (x.ravel() for x in np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij"))
        a, b = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
        keep = (a <= b) & (b < n)
        return a[keep], b[keep]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints: those that are linked to another, and each one's root in its group; roots are left out."""
    index = GrayIndex(fps)
    root = np.arange(len(fps))
    for a, b in index.pairs(radius):
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root != (after := root[root])).any():
                root = after
    member = np.flatnonzero(root != np.arange(len(root)))
    return index.fps[member], index.fps[root[member]]


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close(last: bool):
            """Forests of the buckets that have ended; the last one may go on in the next batch."""
            nonlocal kept, size
            keys, fps = (np.concatenate(x) for x in zip(*kept, strict=True))
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            stop = len(keys) if last else (int(edges[-1]) if len(edges) else 0)
            bounds = [0, *edges.tolist(), len(keys)]
            out = [forest(fps[lo:hi].view(np.uint64), radius) for lo, hi in zip(bounds, bounds[1:], strict=False) if hi - lo > 1 and hi <= stop]
            kept, size = [(keys[stop:], fps[stop:])], len(keys) - stop
            a, b = (np.concatenate(x) if out else np.zeros(0, np.uint64) for x in (zip(*out, strict=True) if out else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            kept.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy()))
            size += batch.num_rows
            if size > 50_000:
                yield close(last=False)
        if kept:
            yield close(last=True)

    return run


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps.fp`` whose components are those of all pairs within ``radius`` bits."""
    found, depth = None, 0
    rest = {0: list(range(64))}  # bits not yet agreed on, by the path of blocks taken
    rows = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    while True:
        parts = radius + 1
        blocks = {p: _blocks(bits, parts) for p, bits in rest.items()}
        masks = F.array(*[F.lit(_mask(blocks[p][i])).cast("long") for p in sorted(blocks) for i in range(parts)])
        dealt = rows.select("fp", "path", "key", F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("i"))
        dealt = dealt.select("fp", (F.col("path") * parts + F.col("i")).alias("path"), "key")
        dealt = dealt.select("fp", "path", F.xxhash64("path", "key", F.col("fp").bitwiseAND(masks[F.col("path")])).alias("key"))
        rest = {p * parts + i: [b for b in bits if b not in blocks[p][i]] for p, bits in rest.items() for i in range(parts)}
        large = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"), "large")
        depth += 1
        more = depth < DEPTH and not large.isEmpty()
        ended = dealt.join(large, "key", "left_anti") if more else dealt
        links = ended.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_forests(radius), "a long, b long")
        found = links if found is None else found.union(links)
        if not more:
            return found
        rows = stored(dealt.join(large, "key", "left_semi"), "split")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the group) of every row of ``docs``.

    Null and texts without words have fingerprint zero, linked like any other. Rows with the same text share a fingerprint
    and so a group; a null doc_id is kept and never the smallest. Very long texts are read whole. Other columns are left out,
    whatever their names; an empty table gives no rows."""
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = stored(near_links(distinct, radius), "links")
    roots = connected_components(links)
    lows = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = stored(lows, "lows")
    lowest = stored(lows.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")  # joined where it was made, a large group would hold up one task
    groups = stored(lows.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "groups")
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
