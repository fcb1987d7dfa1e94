"""Dictionaries of any size looked up in texts: which phrases stand in a text, and the first of them by the dictionary's order.

A chain of conditions grows with the dictionary, and its texts are searched once for each phrase. Here every phrase is known
by its anchor: its first 1, 2, 3, 4, 8, 16 or 32 characters, whichever is the longest that it has. A text's stretches of these
lengths are hashed in one pass, those that may be an anchor by a filter of fixed size meet the dictionary in a join, and the
phrase is compared with what stands there. Common anchors are dealt over several keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.shared import stored

ANCHORS = (1, 2, 3, 4, 8, 16, 32)
#: Phrases up to this length count as whole words only.
WORD_LENGTH = 3
FILTER, SALTS, EMIT = 1 << 24, 8, 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def anchor_length(n: int) -> int:
    return max(a for a in ANCHORS if a <= n)


def hashes(text: str) -> dict[int, np.ndarray]:
    """For each anchor length the hashes of the stretches of that length, by place; longer ones are made from shorter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = (code + np.uint64(1)) * ODD
    one ^= one >> np.uint64(31)
    out, factor = {1: one}, ODD
    n = len(one)
    for a in (2, 4, 8, 16, 32):
        half = out[a // 2]
        m = n - a + 1
        if m < 1:
            break
        out[a] = half[:m] * factor + half[a // 2 : a // 2 + m]
        factor = factor * factor * ODD + np.uint64(2 * a + 1)
        if a == 2 and n > 2:
            out[3] = out[2][: n - 2] * (ODD + np.uint64(6)) + one[2:]
    return {a: h for a, h in out.items()}


@lru_cache(65_536)
def is_word(c: str) -> bool:
    """Whether a character belongs to words, marks included."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍"


def whole(text: str, start: int, end: int) -> bool:
    """Whether word boundaries lie at both ends of a stretch."""
    left = start > 0 and is_word(text[start - 1])
    right = end < len(text) and is_word(text[end])
    return left != is_word(text[start]) and right != is_word(text[end - 1])


def _anchored(phrases: DataFrame) -> DataFrame:
    """phrase, value, ord with the anchor's length and hash; phrases in lower case, each with its first value."""
    low = phrases.select(F.lower("phrase").alias("phrase"), "value", "ord").where("phrase is not null and phrase != '' and value is not null")
    first = low.groupBy("phrase").agg(F.min(F.struct("ord", "value")).alias("m")).select("phrase", "m.ord", "m.value")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hashed = [], []
            with np.errstate(over="ignore"):
                for p in batch.column("phrase").to_pylist():
                    a = anchor_length(len(p))
                    size.append(a)
                    hashed.append(hashes(p[:a])[a][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(np.array(hashed, np.uint64).view(np.int64))], [*batch.schema.names, "size", "anchor"])

    return first.mapInArrow(run, f"{kinds}, size int, anchor long")


def _bit(anchor: np.ndarray, size: int) -> np.ndarray:
    h = (anchor ^ np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) % np.uint64(FILTER)


def _filter(phrases: DataFrame) -> np.ndarray:
    """A bit for every anchor: of a fixed size, whatever the dictionary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, size = batch.column("anchor").to_numpy().view(np.uint64), batch.column("size").to_numpy()
            with np.errstate(over="ignore"):
                bit = np.concatenate([_bit(anchor[size == a], a) for a in ANCHORS])
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    cells = phrases.select("anchor", "size").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def found(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """key, phrase, value, ord of every phrase that stands in a text in lower case, once each; those of up to ``WORD_LENGTH``
    characters as whole words.

    ``phrases`` has phrase, value and ord (of equal phrases the lowest ord counts); empty ones and nulls are left out. Null
    and empty texts hold none; very long texts are read whole; rows that share a key count as one text's."""
    known = stored(_anchored(phrases), "phrases")
    filter_, longest = _filter(known), known.agg(F.coalesce(F.max(F.length("phrase")), F.lit(0))).first()[0]
    texts = docs.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text is not null and text != ''")
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, rows):
            at, size, anchor, there = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(size, pa.int32()), pa.array(np.array(anchor, np.uint64).view(np.int64)), pa.array(there, pa.string())], ["key", "size", "anchor", "there"])

        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                t, seen = batch.column("text")[i].as_py(), set()
                with np.errstate(over="ignore"):
                    for a, h in hashes(t).items():
                        bit = _bit(h, a)
                        for place in np.flatnonzero(filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).tolist():
                            if a <= WORD_LENGTH and not whole(t, place, place + a):
                                continue
                            there = t[place : place + (a if a <= WORD_LENGTH else longest if a == ANCHORS[-1] else 2 * a - 1)]
                            if there not in seen:
                                seen.add(there)
                                rows.append((i, a, h[place], there))
                if len(rows) > EMIT:
                    yield out(batch.column("key"), rows)
                    rows = []
            if rows:
                yield out(batch.column("key"), rows)

    hits = texts.mapInArrow(run, f"key {kind}, size int, anchor long, there string")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("key", "there"), F.lit(SALTS)).cast("int"))
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hits.join(dealt, ["size", "anchor", "salt"]).where(F.startswith("there", "phrase"))
    return met.select("key", "phrase", "value", "ord").distinct()


def first_match(docs: DataFrame, key: str, text: str, phrases: DataFrame, default: str = "") -> DataFrame:
    """key, value of the first phrase by the dictionary's order that stands in each text; ``default`` where none does."""
    best = found(docs, key, text, phrases).groupBy("key").agg(F.min(F.struct("ord", "value")).alias("m"))
    keys = docs.select(F.col(key).alias("key"))
    return keys.join(best, "key", "left").select(F.col("key").alias(key), F.coalesce("m.value", F.lit(default)).alias("value"))


def tags(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """key, tags: the distinct values of the phrases in each text, in order."""
    each = found(docs, key, text, phrases).groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("tags"))
    return docs.select(F.col(key).alias("key")).join(each, "key", "left").select(F.col("key").alias(key), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def dictionary(spark, rules: list[tuple[str, str | list[str]]]) -> DataFrame:
    """phrase, value, ord of a fixed list: (phrase, value) pairs, or (value, phrases) as rules for tags have them."""
    rows = [(p, v) if isinstance(v, str) else (w, p) for p, v in rules for w in ([p] if isinstance(v, str) else v)]
    return spark.createDataFrame([(p, v, i) for i, (p, v) in enumerate(rows)], "phrase string, value string, ord long")


def numbered(phrases: DataFrame, order: str) -> DataFrame:
    """A table of (phrase, value) with an ord by its own order, without gathering it: ranks within ranges, then their starts."""
    ranged = stored(phrases.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_p": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}), "ranged")
    within = ranged.withColumn("_r", F.col("_n") - F.shiftleft(F.col("_p").cast("long"), 33))
    sizes = within.groupBy("_p").agg(F.max("_r").alias("_m")).withColumn("_start", F.sum(F.col("_m") + 1).over(Window.orderBy("_p")) - F.col("_m") - 1)  # a row for each range
    return within.join(F.broadcast(sizes), "_p").select(*phrases.columns, (F.col("_start") + F.col("_r")).alias("ord"))
