"""One document of each group of near copies, by SimHash at a similarity of word shingles.

Fingerprints have ``BITS`` bits, so that the share of differing bits says how alike two sets of shingles are. At a similarity
of 0.8 some 15 % of the bits differ, far too many for blocks that agree in full; documents are dealt out by samples of a few
bits instead, as many bits as keep buckets small and as many samples as give two documents at the least similarity the wanted
chance to meet in one. Within a bucket fingerprints stand in Gray order under the hierarchical index of ``simhash``; what it
lets through is proposed, and every proposal is settled by the shingles themselves.

Each document is set against the smallest that it is proposed to first; of the other proposals only those between documents
that are not connected yet are settled, as no others change a group.

A document proposes its nearest few alone, and a long bucket is compared in runs. Documents that this leaves pairs of are
marked, and joined with each other exactly: two sets at the least similarity share one of their rarest shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrow import pieces
from textloom.llm.components import connected_components, joined_components
from textloom.llm.passages import SALTS, _Hashed, _mix
from textloom.llm.simhash import GrayIndex, gray_rank
from textloom.shared import discard, stored

WORDS, SIMILAR = 5, 0.8
BITS = 256
MEET = 0.98  # chance that two documents at the least similarity share a bucket
FULL = 256  # documents that a bucket holds on average, were they all unlike each other
NEAREST = 4  # documents of a bucket that a document is proposed to by distance, beside the smallest
RUN, OVERLAP = 4096, 64
HOT = 1 << 20
CACHE = 150_000
BROADCAST_ROWS = 500_000
BROADCAST_DROPS = 2_000_000  # of 8 bytes


def shingle_set(text: str, words: int, known: dict) -> np.ndarray:
    """Sorted different hashes of the ``words``-word shingles of a text, in lower case; of all its words where it has fewer."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(ws) - words + 1)
    total = np.full(n, min(len(ws), words), np.uint64)
    for j in range(min(words, len(ws))):
        total = total * np.uint64(0x100000001B3) + h[j : j + n]
    return np.unique(_mix(total))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits as 64-bit numbers: a bit is 1 if it is in more than half of the shingles' hashes; zero without shingles."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i : i + (1 << 14)]
        made = np.stack([_mix(part ^ np.uint64(SALTS[k])) for k in range(BITS // 64)], 1).astype("<u8")
        ones += np.unpackbits(made.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8").astype(np.uint64)


FP = [f"f{k}" for k in range(BITS // 64)]


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _Hashed()
        for piece in pieces(batches):
            if len(known) > CACHE:
                known.clear()
            fps = np.array([wide_fingerprint(shingle_set(t, words, known)) for t in piece["text"]], np.uint64).reshape(-1, len(FP)).view(np.int64)
            copy = [xxhash.xxh64_intdigest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) for t in piece["text"]]
            cols = [pa.array(piece["row"], pa.int64()), pa.array(np.array(copy, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "copy", *FP])

    return run


def plan(n: int, similar: float = SIMILAR, meet: float = MEET) -> tuple[int, int]:
    """Bits of a sample and number of samples for ``n`` documents. For two sets of equal size and Jaccard similarity s the
    cosine is 2s / (1 + s); a bit agrees with probability 1 - angle / pi."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, n) / FULL))))
    agree = (1 - math.acos(2 * similar / (1 + similar)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - meet) / math.log(1 - agree)))


def _samples(bits: int, samples: int) -> np.ndarray:
    """Masks of ``bits`` random bits for each sample, as rows of 64-bit numbers."""
    rng, out = np.random.default_rng(11), np.zeros((samples, BITS), np.uint8)
    for row in out:
        row[rng.choice(BITS, bits, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8").astype(np.uint64)


DEALT = ["key", "rank", *FP[1:], "row"]


def _dealt(masks: np.ndarray):
    """Key of each sample's bits, Gray rank of the fingerprint's first 64 bits, its other bits, and the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([batch.column(n).to_numpy().view(np.uint64) for n in FP], 1)
            rank, rows = gray_rank(fps[:, 0]).view(np.int64), batch.column("row").to_numpy()
            for t, mask in enumerate(masks):
                key = np.full(len(fps), t + 1, np.uint64)
                for k in range(len(FP)):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ (fps[:, k] & mask[k]))
                cols = [key.view(np.int64), rank, *(np.ascontiguousarray(fps[:, k]).view(np.int64) for k in range(1, len(FP))), rows]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], DEALT)

    return run


def radii(similar: float) -> tuple[int, int]:
    """Differing bits allowed in the first 64 bits and in all: three standard deviations above what is expected."""
    p = math.acos(2 * similar / (1 + similar)) / math.pi
    return tuple(math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p))) for n in (64, BITS))


def proposals(fps: np.ndarray, rows: np.ndarray, similar: float, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """For each of a run of fingerprints (rows of 64-bit numbers) its smallest and its ``nearest`` nearest documents within
    the radii, as pairs (a, b), a > b. Of equally near ones the smallest count. One with more partners than that also comes
    as (a, a): of any pair left out both do."""
    near, all_ = radii(similar)
    index = GrayIndex(fps[:, 0])
    fps, rows = fps[index.order], rows[index.order]
    met = []
    for a, b in index.pairs(near):
        apart = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64)
        met.append([x[apart <= all_] for x in (a, b, apart)])
    a, b, apart = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 3
    a, b, apart = np.r_[a, b], np.r_[b, a], np.r_[apart, apart]
    order = np.lexsort((rows[b], apart, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    low = rows.copy()
    np.minimum.at(low, a, rows[b])
    linked = np.unique(a)
    mine, partner = np.r_[rows[linked], rows[a[place < nearest]]], np.r_[low[linked], rows[b[place < nearest]]]
    keep = mine != partner
    many = rows[np.unique(a[place >= nearest])]
    return np.r_[np.maximum(mine, partner)[keep], many], np.r_[np.minimum(mine, partner)[keep], many]


def _proposed(similar: float):
    """Proposals of rows sorted by key and rank. A bucket is worked on in runs of ``RUN`` in Gray order, each with the last
    ``OVERLAP`` of the run before and the bucket's first document, so that a bucket of any size needs little memory; the
    documents of a bucket of several runs come as (a, a) too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * len(DEALT)
        head: list[np.ndarray] | None = None  # of the bucket that the held rows belong to, once it is longer than a run

        def bucket(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            rank, *others = (c.view(np.uint64) for c in cols[1:-1])
            return proposals(np.stack([rank ^ rank >> np.uint64(1), *others], 1), cols[-1], similar)

        def batch_of(found) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.r_[h, batch.column(n).to_numpy()] for h, n in zip(held, DEALT, strict=True)]
            found, at, n = [], 0, len(held[0])
            edges = np.r_[np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, n] if n else np.zeros(0, np.int64)
            for i, end in enumerate(edges.tolist()):
                open_ = batch is not None and i == len(edges) - 1
                while end - at > RUN or (not open_ and end > at):
                    stop = min(at + RUN, end)
                    if head is not None or stop < end:
                        found.append((held[-1][at:stop],) * 2)
                    if stop - at > 1 or head is not None:
                        part = [h[at:stop] for h in held]
                        found.append(bucket(part if head is None else [np.r_[x, y] for x, y in zip(head, part, strict=True)]))
                    if stop == end:
                        head, at = None, end
                        break
                    first = [h[at : at + 1] for h in held] if head is None else [x[:1] for x in head]
                    head = [np.r_[x, h[max(at, stop - OVERLAP) : stop]] for x, h in zip(first, held, strict=True)]
                    at = stop
                if open_:
                    break
            held = [h[at:] for h in held]
            yield batch_of(found)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashed()
        for piece in pieces(batches):
            if len(known) > CACHE:
                known.clear()
            made = [shingle_set(t, words, known).astype("<u8").tobytes() for t in piece["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(piece["row"], pa.int64()), pa.array(made, pa.binary())], ["row", "made"])

    return run


def _alike(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                mine, theirs = (np.frombuffer(batch.column(n)[i].as_py(), "<u8") for n in ("mine", "theirs"))
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                keep[i] = both >= similar * (len(mine) + len(theirs) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, shingle and size of the row's set, for every shingle of sets (row, made)."""
    for batch in batches:
        rows, made = batch.column("row").to_numpy(), batch.column("made")
        for lo in range(0, batch.num_rows, 256):
            sets = [np.frombuffer(v.as_py(), "<u8") for v in made[lo : lo + 256]]
            n = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[lo : lo + 256], n)), pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(n, n).astype(np.int32))], ["row", "shingle", "size"])


def _linked(proposed: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of ``proposed`` (a, b) whose ``sets`` (row, made) are alike."""
    both = proposed.join(sets.select(F.col("row").alias("a"), F.col("made").alias("mine")), "a")
    both = both.join(sets.select(F.col("row").alias("b"), F.col("made").alias("theirs")), "b").select("a", "b", "mine", "theirs")
    return stored(both.mapInArrow(_alike(similar), "a long, b long"), "links")


def crowded_links(texts: DataFrame, crowded: DataFrame, roots: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between all documents of ``crowded`` (row) that are alike and have other ``roots`` (node, root): exactly.

    A set of n has n - ceil(similar n) + 1 shingles that are the rarest in one order for all; of two sets that are alike
    these have one in common, the first of which leaves room for enough others. Shingles that only one document has, or
    only those of one root, need no join."""
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    sets = stored(texts.join(crowded, "row").mapInArrow(_sets(words), "row long, made binary"), "sets")
    each = stored(sets.mapInArrow(_each, "row long, shingle long, size int"), "each")
    common = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    by = Window.partitionBy("row")
    placed = each.join(common, "shingle").withColumns({"at": F.row_number().over(by.orderBy("n", "shingle")), "held": F.count(F.lit(1)).over(by)})
    placed = placed.withColumn("at", F.col("at") + F.col("size") - F.col("held"))  # after those that no other document has
    first = placed.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * F.lit(similar) - 1e-9) + 1)
    first = first.join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", "shingle", "size", "at", F.coalesce("root", "row").alias("root"))
    first = stored(first, "first")
    apart = first.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    first = stored(first.join(apart, "shingle"), "apart")
    mine, theirs = (first.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("row", "size", "at", "root")]) for side in "ab")
    room = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) + 1
    enough = room >= F.lit(similar / (1 + similar)) * (F.col("a_size") + F.col("b_size")) - 1e-6
    met = mine.join(theirs, "shingle").where((F.col("a_row") > F.col("b_row")) & (F.col("a_root") != F.col("b_root")) & enough)
    links = _linked(stored(met.select(F.col("a_row").alias("a"), F.col("b_row").alias("b")).distinct(), "proposed"), sets, similar)
    discard(sets, each, first)
    return links


def near_roots(texts: DataFrame, copies: DataFrame, words: int = WORDS, similar: float = SIMILAR, meet: float = MEET) -> tuple[DataFrame, DataFrame]:
    """node and root (the smallest node reachable) by links between documents of ``copies`` (row, fingerprint) whose shingle
    sets in ``texts`` (row, text) have a Jaccard similarity of ``similar`` or more: for each document those with the smallest
    and the nearest few of each bucket. Also the documents (row) that may have more links than these."""
    n = copies.count()
    split = None
    dealt = copies.mapInArrow(_dealt(_samples(*plan(n, similar, meet))), ", ".join(f"{c} long" for c in DEALT))
    if n > HOT:  # beyond this a bucket may be too much for one task; its parts still meet in the buckets of other samples
        dealt = stored(dealt, "dealt")
        hot = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot")
        parts = F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1))
        split = dealt.join(hot, "key").select(F.col("row").alias("a"), F.col("row").alias("b"))
        dealt = dealt.join(hot, "key", "left").select(F.xxhash64("key", F.pmod(F.xxhash64("row"), parts)).alias("key"), *DEALT[1:])
    proposed = dealt.repartition("key").sortWithinPartitions("key", "rank").mapInArrow(_proposed(similar), "a long, b long")
    proposed = stored((proposed if split is None else proposed.union(split)).distinct(), "proposed")
    crowded = stored(proposed.where("a = b").select(F.col("a").alias("row")), "crowded")
    proposed = proposed.where("a != b")
    needed = stored(proposed.select(F.col("a").alias("row")).union(proposed.select("b")).distinct(), "needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    sets = stored(texts.join(needed, "row").mapInArrow(_sets(words), "row long, made binary"), "sets")
    roots = connected_components(_linked(proposed.groupBy("a").agg(F.min("b").alias("b")), sets, similar))
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    rest = proposed.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    roots = joined_components(roots, _linked(stored(rest.select("a", "b"), "rest"), sets, similar))
    discard(sets)
    return roots, crowded


def near_groups(texts: DataFrame, words: int = WORDS, similar: float = SIMILAR, meet: float = MEET) -> DataFrame:
    """row and group (the smallest row that links lead to) of every row of ``texts`` (row, text); rows must differ."""
    sketches = stored(texts.mapInArrow(_sketches(words), "row long, copy long, " + ", ".join(f"{f} long" for f in FP)), "sketches")
    copies = stored(sketches.groupBy("copy", *FP).agg(F.min("row").alias("row")), "copies")
    roots, crowded = near_roots(texts, copies.select("row", *FP), words, similar, meet)
    if not crowded.isEmpty():
        more = crowded_links(texts, crowded, roots, words, similar)
        if not more.isEmpty():
            roots = joined_components(roots, more)
    known = copies.join(roots.withColumnRenamed("node", "row"), "row", "left").select("copy", *FP, F.coalesce("root", "row").alias("group"))
    return sketches.join(stored(known, "groups"), ["copy", *FP]).select("row", "group")


def one_of_each(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, meet: float = MEET) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when each group of near copies keeps one document.

    Two texts are near copies if the sets of their ``words``-word shingles (the whole text, if it has fewer words; lower case)
    have a Jaccard similarity of ``similar`` or more; groups are what such links connect. Texts without words, null among
    them, are copies of each other. A group keeps the row with the smallest doc_id, of several such rows the one whose text
    sorts first (null before all), then the first. Rows with a null id are set against each other alone: a group keeps one of
    those too. Very long texts are read whole; an empty table stays empty; other columns come through, whatever their names."""
    free = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    keyed = stored(docs.withColumn(free, F.monotonically_increasing_id()), "rows")
    texts = keyed.select(F.col(free).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    groups = near_groups(texts, words, similar, meet)
    ids = stored(keyed.select(F.col(free).alias("row"), F.col("doc_id").alias("id")).join(groups, "row"), "ids")
    lowest = stored(ids.where("id is not null").groupBy("group").agg(F.min("id").alias("id")), "lowest")
    firsts = ids.join(lowest, ["group", "id"]).select("group", "id", "row").union(ids.where("id is null").select("group", "id", "row"))
    firsts = stored(firsts, "firsts")
    sets = stored(firsts.groupBy("group", "id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")), "sets")
    shared = sets.where("n > 1").select(F.col("group").alias("g"), F.col("id").alias("i"))
    tied = firsts.join(shared, (F.col("group") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))).select("group", "id", "row")
    whole = keyed.select(F.col(free).alias("row"), F.col("text"))
    tied = tied.join(whole, "row").groupBy("group", "id").agg(F.min(F.struct("text", "row")).alias("first"))
    keep = sets.where("n = 1").select("row").union(tied.select("first.row"))
    drop = stored(ids.select("row").join(keep, "row", "left_anti"), "drop")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_DROPS else drop  # else the rows are shuffled
    return keyed.join(drop.withColumnRenamed("row", free), free, "left_anti").select(docs.columns)
