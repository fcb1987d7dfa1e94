"""Regular expressions over many texts by an inverted index of trigrams.

Every text's distinct trigrams, in one case, are kept in compressed postings: for each trigram and block of texts the texts
of the block that hold it. A planner works out from a pattern which trigrams a match must have, as a formula of ANDs and ORs;
the postings of those trigrams alone are read, the formula is worked out block by block, and the pattern itself is tried on
the texts that are left. A pattern that requires no trigram is tried on all texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom.shared import stored

# Texts of a block, folders of postings, folders of texts at most, blocks of a task that writes.
BLOCK, BUCKETS, FOLDERS, BLOCKS_EACH = 4096, 64, 1024, 256
# Bounds of the planner: strings that a part of a pattern may stand for, members of a class, copies of a repeat, trigrams asked.
STRINGS, CLASS, COPIES, ASKED = 32, 12, 8, 48
#: What Java's and Python's syntax read differently: such patterns are not planned.
UNPLANNED = re.compile(r"&&|\[[^\]\\]*(?:\\.[^\]\\]*)*\[|\\b\{|\\[0-9GQEzZRXhHvVkpPNux]|\(\?[a-zA-Z]*-?[a-zA-Z]*[xdU]|\(\?<[a-zA-Z]|\{,")
Plan = bool | str | tuple


def _letters() -> dict[int, int]:
    """Characters outside ASCII that a comparison without case takes for another one, with the one they are kept as."""
    out = {0x130: ord("i")}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1F000))):
        upper = c.upper()
        upper = upper if len(upper) == 1 else c
        lower = upper.lower()
        if len(lower) == 1 and lower != c:
            out.setdefault(ord(c), ord(lower))
    return out


class Folder:
    """Texts in one case, character by character; made where it is used."""

    def __init__(self) -> None:
        self.letters: dict[int, int] = {}

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        self.letters = self.letters or _letters() | {i: i + 32 for i in range(65, 91)}
        return text.translate(self.letters)


def trigrams(folded: str) -> set[str]:
    return {folded[i : i + 3] for i in range(len(folded) - 2)}


def _and(plans: list[Plan]) -> Plan:
    parts = [p for p in dict.fromkeys(plans) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(plans: list[Plan]) -> Plan:
    parts = list(dict.fromkeys(plans))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


class _Reader:
    """Reads a parsed pattern from left to right, with the strings that its last part may have stood for."""

    def __init__(self) -> None:
        self.fold, self.needs, self.strings = Folder(), [], {""}

    def flush(self) -> None:
        self.needs.append(_or([_and(sorted(trigrams(s))) for s in sorted(self.strings)]))
        self.strings = {""}

    def join(self, strings: set[str]) -> None:
        if len(self.strings) * len(strings) > STRINGS or max(map(len, self.strings)) > 64:
            # the ends of what was read stay, as far as trigrams reach over to what follows
            ends = {s[-2:] for s in self.strings}
            self.flush()
            self.strings = ends if len(ends) * len(strings) <= STRINGS else {""}
        self.strings = {a + b for a, b in product(self.strings, strings)} if len(strings) <= STRINGS else {""}

    def read(self, parsed) -> None:
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                self.join({self.fold(chr(value))})
            elif name == "IN" and (members := self.members(value)):
                self.join(members)
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            elif name == "SUBPATTERN":
                self.read(value[-1])
            elif name == "ATOMIC_GROUP":
                self.read(value)
            elif name == "BRANCH":
                self.branch([of(p) for p in value[1]])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                self.repeat(*value)
            else:
                self.flush()

    def members(self, items) -> set[str] | None:
        out: set[str] = set()
        for op, value in items:
            if str(op) == "LITERAL":
                out.add(self.fold(chr(value)))
            elif str(op) == "RANGE" and value[1] - value[0] < 2 * CLASS:
                out |= {self.fold(chr(c)) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if 0 < len(out) <= CLASS else None

    def branch(self, parts: list[tuple[set[str] | None, Plan]]) -> None:
        strings = [s for s, _ in parts]
        if all(s is not None for s in strings) and len(set().union(*strings)) <= STRINGS:
            self.join(set().union(*strings))
        else:
            self.flush()
            self.needs.append(_or([p for _, p in parts]))

    def repeat(self, least: int, most: int, inner) -> None:
        strings, plan = of(inner)
        if strings is not None and (least, most) == (0, 1):
            self.join(strings | {""})
        elif strings is not None and least and len(strings) ** min(least, COPIES) <= STRINGS:
            for _ in range(min(least, COPIES)):
                self.join(strings)
            if most != least or least > COPIES:
                self.flush()
                self.join(strings)  # the last copy stands before what follows
        else:
            self.flush()
            if least:
                self.needs.append(plan)


def of(parsed) -> tuple[set[str] | None, Plan]:
    """The few strings that a part of a pattern stands for, or none; and what a match of it requires."""
    reader = _Reader()
    reader.read(parsed)
    strings = reader.strings if not reader.needs else None
    reader.flush()
    return strings, _and(reader.needs)


def required(pattern: str) -> Plan:
    """What a text that matches the pattern, in any case, must have: a trigram, ("and", ...) or ("or", ...); True: nothing."""
    if UNPLANNED.search(pattern):
        return True
    try:
        return of(re._parser.parse(pattern))[1]
    except (re.error, RecursionError, OverflowError):
        return True


def holds(plan: Plan, grams: set[str]) -> bool:
    if isinstance(plan, str):
        return plan in grams
    return plan is True or (all if plan[0] == "and" else any)(holds(p, grams) for p in plan[1:])


def asked(plan: Plan) -> list[str]:
    return [] if plan is True else [plan] if isinstance(plan, str) else list(dict.fromkeys(g for p in plan[1:] for g in asked(p)))


def eased(plan: Plan, most: int = ASKED) -> Plan:
    """The plan with ``most`` trigrams at most: of long ANDs every so many are asked, wide ORs ask for nothing."""
    if len(asked(plan)) <= most:
        return plan
    if plan[0] == "or":
        parts = [eased(p, max(most // (len(plan) - 1), 1)) for p in plan[1:]]
        return _or(parts) if len(plan) - 1 <= most else True
    grams = [p for p in plan[1:] if isinstance(p, str)]
    rest = [p for p in plan[1:] if not isinstance(p, str)]
    grams = grams[:: -(-len(grams) // most)] if grams else []
    return _and([*grams, *(eased(p, max(most // (2 * len(rest)), 1)) for p in rest)]) if len(rest) <= most // 4 else _and(grams or [True])


def packed(places: np.ndarray, size: int) -> bytes:
    """Sorted places below ``size``: bits where that is shorter, else 16 bits each."""
    if 2 * len(places) <= size // 8:
        return b"p" + places.astype("<u2").tobytes()
    bits = np.zeros(size, np.uint8)
    bits[places] = 1
    return b"b" + np.packbits(bits).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    """Whether each of ``size`` texts is among the places."""
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=size).astype(bool)
    out = np.zeros(size, bool)
    out[np.frombuffer(data, "<u2", offset=1)] = True
    return out


def codes(folded: str) -> np.ndarray:
    """A number for each distinct trigram of a text, in order of the trigrams: 21 bits a character."""
    c = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def gram_of(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a block, once its last text is seen; texts come by block and place."""
    fold, now, held = Folder(), None, []

    def out() -> pa.RecordBatch:
        size, made = len(held), np.concatenate(held)
        order = np.argsort(made, kind="stable")
        made, places = made[order], np.repeat(np.arange(size), [len(x) for x in held])[order]
        first = np.flatnonzero(np.r_[True, made[1:] != made[:-1]][: len(made)])
        grams = [gram_of(x) for x in made[first].tolist()]
        data = [packed(places[lo:hi], size) for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(made)], strict=False)]
        n = len(grams)
        return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams], pa.int32()), pa.array(grams, pa.string()), pa.array([now] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(data, pa.binary())], ["bucket", "gram", "block", "size", "data"])

    for batch in batches:
        for block, text in zip(batch.column("block").to_pylist(), batch.column("text"), strict=True):
            if block != now:
                if held:
                    yield out()
                now, held = block, []
            held.append(codes(fold(text.as_py() or "")))
    if held:
        yield out()


class TextIndex(NamedTuple):
    """A written index: texts (folder, block, place, key, text) and postings (bucket, gram, block, size, data)."""

    path: str
    spark: SparkSession
    folders: int
    kind: str

    def texts(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}, text string, block long, place int, folder int").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, block long, size int, data binary, bucket int").parquet(f"{self.path}/postings")


def build(docs: DataFrame, key: str, path: str, text: str = "text") -> TextIndex:
    """Writes the index of ``docs``. Rows that repeat stay as many; null texts match nothing; very long texts are indexed whole.

    Texts are dealt to blocks by hash of key and text, and copies beyond a block's measure by a random number, so no key is hot."""
    spark = docs.sparkSession
    blocks = docs.count() // (BLOCK // 2) + 1
    folders = min(FOLDERS, blocks)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "text", "row"), F.lit(blocks)))
    dealt = rows.drop("row").withColumn("folder", F.pmod("block", F.lit(folders)).cast("int")).repartition("folder").sortWithinPartitions("folder", "block", "key", "text")
    dealt.mapInArrow(_numbered(dealt.columns), StructType([*dealt.schema.fields, StructField("place", IntegerType())])).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/texts")
    index = TextIndex(path, spark, folders, docs.schema[key].dataType.simpleString())
    texts = index.texts().select("block", "place", "text").repartition("block").sortWithinPartitions("block", "place")
    made = texts.mapInArrow(_postings, "bucket int, gram string, block long, size int, data binary")
    made = made.repartition("bucket", F.floor(F.col("block") / BLOCKS_EACH)).sortWithinPartitions("bucket", "gram", "block")
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark.range(1).select(F.lit(folders).alias("folders"), F.lit(index.kind).alias("kind")).write.mode("overwrite").parquet(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(path, spark, *spark.read.parquet(f"{path}/meta").first())


def _numbered(names: list[str]):
    """Places within blocks; the rows of a block come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = None, 0
        for batch in batches:
            places = []
            for block in batch.column("block").to_pylist():
                place = place + 1 if block == now else 0
                now = block
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32())], [*names, "place"])

    return run


def candidates(index: TextIndex, plan: Plan) -> DataFrame:
    """block, place of the texts for which the plan holds. A group has a posting of one block for each trigram asked."""
    grams = asked(plan)
    buckets = sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams})
    found = index.postings().where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    by_block = found.groupBy("block", "size").agg(F.collect_list(F.struct("gram", "data")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, places = [], []
            for row in batch.to_pylist():
                held = {h["gram"]: unpacked(h["data"], row["size"]) for h in row["held"]}
                none = np.zeros(row["size"], bool)

                def judge(p: Plan) -> np.ndarray:
                    if isinstance(p, str):
                        return held.get(p, none)  # noqa: B023
                    return (np.logical_and if p[0] == "and" else np.logical_or).reduce([judge(x) for x in p[1:]])

                at = np.flatnonzero(judge(plan))
                blocks.append(np.full(len(at), row["block"]))
                places.append(at)
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks), pa.int64()), pa.array(np.concatenate(places), pa.int32())], ["block", "place"])

    return by_block.select("block", "size", "held").mapInArrow(run, "block long, place int")


def search(index: TextIndex, pattern: str) -> DataFrame:
    """key, text of the texts that the pattern matches somewhere, in any case of any script."""
    match = F.col("text").rlike(f"(?iu){pattern}")
    plan = eased(required(pattern))
    if plan is True:
        return index.texts().where(match).select("key", "text")
    maybe = stored(candidates(index, plan), "candidates")
    opened = [r.f for r in maybe.select(F.pmod("block", F.lit(index.folders)).cast("int").alias("f")).distinct().collect()]  # FOLDERS at most
    held = index.texts().where(F.col("folder").isin(opened) if opened else F.lit(False))
    return held.join(maybe, ["block", "place"], "left_semi").where(match).select("key", "text")


def measured(index: TextIndex, pattern: str) -> dict[str, int]:
    """What a search reads: trigrams asked, postings read and their bytes, texts tried, of how many."""
    plan = eased(required(pattern))
    total = index.texts().count()
    if plan is True:
        return {"grams": 0, "postings": 0, "bytes": 0, "texts": total, "of": total}
    read = index.postings().where(F.col("gram").isin(asked(plan))).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("b")).first()
    return {"grams": len(asked(plan)), "postings": read.n, "bytes": read.b, "texts": candidates(index, plan).count(), "of": total}
