"""Phrases of words that belong together, mined from the bitmaps of where words stand.

Texts are dealt to shards. A shard keeps for each word the compressed bitmap of its places: the blocks of eight places that
hold it, with a mask. Pieces of a text lie one place apart, so that nothing reaches from one into the next. A phrase's
bitmap, shifted by a place and joined with a word's by AND, is the longer phrase's bitmap, and its bits are counted; phrases
are extended depth-first, a bundle of them at a time. Counts of all shards are summed by Spark.

Most pairs of words are rare, so a first pass sums pairs by hash alone, packed by ranges of hashes; only those that may be
frequent are counted, and extended, in the second pass. Hashes let too much through at worst: all counts are of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.shared import discard, stored

LEAST, LONGEST, ABSORB, TOP = 10, 3, 50, 2000
# Bytes of text in a shard, bytes for each range of hashes, phrases' places extended at a time, and bits of the filter of
# pairs that may be frequent: 16 MB however many there are.
SHARD, RANGE, BUNDLE, FILTER = 3_000_000, 1 << 19, 1 << 16, 1 << 27
SALTS, DEAL = 16, 20_000
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KINDS = np.zeros(256, np.uint8)
KINDS[list(BLANKS)], KINDS[list(PIECE_ENDS)] = 1, 2
END = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]")


class Index(NamedTuple):
    """The bitmaps of a shard: (word, block, mask) by word; by block the words, their masks and where a block's begin."""

    vocabulary: pa.Array
    word: np.ndarray
    block: np.ndarray
    mask: np.ndarray
    words_in: np.ndarray
    masks_in: np.ndarray
    begin: np.ndarray


def _bits(major: np.ndarray, minor: np.ndarray, width: int, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (major, minor < width) in order, with the mask of their bits."""
    key = np.sort((major * width + minor) * 8 + bit)
    cell = key >> 3
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    mask = np.bitwise_or.reduceat(np.left_shift(1, key & 7).astype(np.uint8), first)
    return cell[first] // width, cell[first] % width, mask


def indexed(text: bytes) -> Index | None:
    """The index of a shard's text, which is read in lower case of A to Z; none without words."""
    data = np.frombuffer(text.lower(), np.uint8)
    kind = KINDS[data]
    letter = kind == 0
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    if not len(begin):
        return None
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[letter]))]).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    piece = np.searchsorted(np.flatnonzero(kind == 2), begin)
    at = np.arange(len(begin)) + np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
    block, bit = at >> 3, at & 7
    blocks, known = int(block[-1]) + 2, len(words.dictionary)
    by_word = _bits(code, block, blocks, bit)
    held_by, words_in, masks_in = _bits(block, code, known, bit)
    starts = np.searchsorted(held_by, np.arange(blocks + 1))
    return Index(words.dictionary, *by_word, words_in, masks_in, starts)


def longer(index: Index, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases' bitmaps with one more word: phrase, word, block, mask, by phrase and word; then where each pair begins."""
    wide = mask.astype(np.uint16) << 1
    low, high = wide & 255, wide >> 8
    here, next_ = np.flatnonzero(low), np.flatnonzero(high)
    phrase = np.concatenate([phrase[here], phrase[next_]])
    block = np.concatenate([block[here], block[next_] + 1])
    mask = np.concatenate([low[here], high[next_]]).astype(np.uint8)
    n = index.begin[block + 1] - index.begin[block] if len(block) else np.zeros(0, np.int64)
    each = np.repeat(np.arange(len(block)), n)
    other = np.arange(len(each)) + np.repeat(index.begin[block] - (np.cumsum(n) - n), n)
    both = mask[each] & index.masks_in[other]
    hit = np.flatnonzero(both)
    each, other, both = each[hit], other[hit], both[hit]
    phrase, word, block = phrase[each], index.words_in[other], block[each]
    key = phrase * len(index.vocabulary) + word
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return phrase[order], word[order], block[order], both[order], first


def extend(index: Index, longest: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of word codes, and counts, of the phrases of 2 to ``longest`` words: depth-first, a bundle of phrases at a time.

    ``keep`` says of the pairs (last word but one, last word) which may be frequent; others are neither given nor extended."""

    def walk(codes, phrase, block, mask):
        for lo, hi in _bundles(phrase):
            p, word, b, m, first = longer(index, phrase[lo:hi], block[lo:hi], mask[lo:hi])
            if not len(first):
                continue
            rows = np.c_[codes[p[first]], word[first]]
            count = np.add.reduceat(np.bitwise_count(m).astype(np.int64), first)
            good = np.ones(len(first), bool) if keep is None else keep(rows[:, -2], rows[:, -1])
            if not good.any():
                continue
            yield rows[good], count[good]
            if rows.shape[1] < longest:
                own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
                stay = good[own]
                yield from walk(rows, own[stay], b[stay], m[stay])

    yield from walk(np.arange(len(index.vocabulary))[:, None], index.word, index.block, index.mask)


def _bundles(phrase: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole phrases of about ``BUNDLE`` entries."""
    lo = 0
    while lo < len(phrase):
        hi = len(phrase) if len(phrase) - lo <= BUNDLE else int(np.searchsorted(phrase, phrase[lo + BUNDLE], "left"))
        hi = hi if hi > lo else int(np.searchsorted(phrase, phrase[lo], "right"))
        yield lo, hi
        lo = hi


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of a shard's size at most, or up to the end of a longer piece."""
    lo = 0
    while len(text) - lo > SHARD and (end := END.search(text, lo + SHARD - 1)):
        yield text[lo : end.end()]
        lo = end.end()
    yield text[lo:]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language at a time, joined by ends of pieces; all that is held goes out once it comes to ``SHARD`` bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang, text in zip(langs, batch.column("text").cast(pa.binary()), strict=True):
            for part in _cut(text.as_py()):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= SHARD:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def pair_hash(vocabulary: pa.Array, lang: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of pairs of words from those of the words, other ones for each language."""
    seed = zlib.crc32(lang.encode())
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = own[a] * np.uint64(0x9E3779B97F4A7C15) + (own[b] << np.uint64(31) | own[b] >> np.uint64(33))
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    return of


def _place(hashed: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and 32 bits of a hash."""
    return (hashed & np.uint64(0xFFFFFFFF)) % np.uint64(ranges), (hashed >> np.uint64(32)).astype(np.uint32)


def _filter_bit(range_: np.ndarray, low: np.ndarray) -> np.ndarray:
    h = (range_.astype(np.uint64) << np.uint64(32) | low) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)) % np.uint64(FILTER)


def _strings(vocabulary: pa.Array, rows: np.ndarray) -> pa.Array:
    parts = [vocabulary.take(pa.array(rows[:, i])) for i in range(rows.shape[1])]
    return (pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]).cast(pa.string())


FIRST = "lang string, phrase string, f long, range long, packed binary"


def _first_pass(ranges: int):
    """Words with their counts, and pairs by hash: for each range the 32 bits and the count (255 at most) of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches):
            index = indexed(text)
            if index is None:
                continue
            first = np.searchsorted(index.word, np.arange(len(index.vocabulary)))
            f = np.add.reduceat(np.bitwise_count(index.mask).astype(np.int64), first)
            n = len(f)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), index.vocabulary.cast(pa.string()), pa.array(f), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["lang", "phrase", "f", "range", "packed"])
            hash_of, keys, counts = pair_hash(index.vocabulary, lang), [], []
            for rows, count in extend(index, 2):
                keys.append(hash_of(rows[:, 0], rows[:, 1]))
                counts.append(np.minimum(count, 255).astype(np.uint8))
            if not keys:
                continue
            range_, low = _place(np.concatenate(keys), ranges)
            order = np.argsort(range_, kind="stable")
            range_, low, count = range_[order], low[order], np.concatenate(counts)[order]
            cuts = np.flatnonzero(np.diff(range_)) + 1
            edges = [0, *cuts.tolist(), len(low)]
            packed = [low[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            n = len(packed)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(range_[edges[:-1]].astype(np.int64)), pa.array(packed, pa.binary())], ["lang", "phrase", "f", "range", "packed"])

    return run


def _frequent(least: int):
    """Bits of the filter for the pairs that reach ``least``; the rows of a range come one after another."""

    def summed(range_: int, held: list[bytes]) -> pa.RecordBatch:
        low = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 5) for b in held])
        count = np.concatenate([np.frombuffer(b, np.uint8, len(b) // 5, len(b) // 5 * 4) for b in held]).astype(np.int64)
        order = np.argsort(low)
        low, count = low[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        often = low[first][np.add.reduceat(count, first) >= min(least, 255)]
        bit = _filter_bit(np.full(len(often), range_), often)
        return pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for range_, packed in zip(batch.column("range").to_pylist(), batch.column("packed"), strict=True):
                if held and range_ != now:
                    yield summed(now, held)
                    held = []
                now = range_
                held.append(packed.as_py())
        if held:
            yield summed(now, held)

    return run


def _filter(first: DataFrame, least: int) -> np.ndarray:
    """The filter of pairs that may be frequent: ``FILTER`` bits at most come to the driver, whatever the corpus."""
    ranges = first.where("packed is not null").select("range", "packed").repartition("range").sortWithinPartitions("range")
    cells = ranges.mapInArrow(_frequent(least), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def _second_pass(ranges: int, filter_: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches):
            index = indexed(text)
            if index is None:
                continue
            hash_of = pair_hash(index.vocabulary, lang)

            def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                bit = _filter_bit(*_place(hash_of(a, b), ranges))
                return (filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

            for rows, count in extend(index, longest, keep):
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), _strings(index.vocabulary, rows), pa.array(np.full(n, rows.shape[1], np.int32)), pa.array(count)], ["lang", "phrase", "words", "f"])

    return run


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of all phrases of 1 to ``longest`` words that stand ``least`` times or more; and lang, n of all
    words. Both are written tables."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = min(max(size // RANGE, 1), 1 << 31)
    first = stored(texts.mapInArrow(_first_pass(ranges), FIRST), "first")
    words = stored(first.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    filter_ = _filter(first, least)
    discard(first)
    counted = texts.mapInArrow(_second_pass(ranges, filter_, longest), "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return stored(words.select("lang", "phrase", F.lit(1).alias("words"), "f").union(counted).where(F.col("f") >= least), "phrases"), totals


def _whole(c: str, digits: int) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def _score() -> Column:
    """floor(1000000 * a * a / (l * r)), exact: at most a million, as no part is rarer than the whole."""
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * _whole("a", 15) * _whole("a", 15), _whole("l", 15) * _whole("r", 15)).cast("long")


def _scored(counted: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of phrases at their lowest-scoring cut. A word is a part of many phrases, so the
    phrases of a word are dealt over ``SALTS`` keys."""
    w = F.split("phrase", " ")
    cuts = counted.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    for side, part in (("l", F.slice(w, 1, F.col("k"))), ("r", F.slice(w, F.col("k") + 1, F.col("words") - F.col("k")))):
        cuts = cuts.withColumn("part", F.array_join(part, " ")).withColumn("salt", F.when(F.contains("part", F.lit(" ")), 0).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")))
        every = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        parts = counted.select("lang", F.col("phrase").alias("part"), F.col("f").alias(side), F.explode(every).alias("salt"))
        cuts = cuts.join(parts, ["lang", "part", "salt"]).drop("part", "salt")
    best = cuts.withColumn("score", _score()).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def _stretch(words: Column, n: int, at: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def _absorbed(counted: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, most: the largest count of a longer candidate that holds the phrase."""
    w, each = F.split("phrase", " "), []
    for n in range(2, longest):
        inner = F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), partial(_stretch, w, n))
        each.append(counted.where(F.col("words") > n).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f"))
    if not each:
        return counted.limit(0).select("lang", "phrase", F.col("f").alias("most"))
    return reduce(DataFrame.union, each).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``longest`` words.

    A null language is ``und``, a null text has no words, nor has an empty one; very long texts are read whole, in parts that
    end where pieces do. Rows that repeat count each; ties go by a, then by the phrase's bytes; other columns are left out,
    whatever their names; an empty table gives no rows."""
    counted, totals = count_phrases(docs, least, longest)
    rows = _scored(counted).join(_absorbed(counted, longest), ["lang", "phrase"], "left")
    kept = stored(rows.where(F.col("most").isNull() | (100 * F.col("most") < absorb * F.col("a"))).drop("most", "words"), "kept")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best, rows = kept, kept.count()
    while True:  # a language's rows are ranked in deals, whose best are ranked again in a tenth as many, and so on
        deals = rows // DEAL + 1
        best = best.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(deals)))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
        if deals == 1:
            break
        rows = min(rows // 10, deals * top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
