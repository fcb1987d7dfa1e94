"""The state of content hashes at scale: new texts meet only the ranges of hashes that may hold one of theirs.

Hashes lie in ranges by their first digits, a folder each. Beside them a Bloom filter is kept for each range. A run reads the
filters, opens the ranges in which a filter lets one of its hashes through, and joins with those; the state of others is not
read. Filters are written before hashes, so a run that dies on the way only lets a little more through."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.shared import stored

BITS_EACH, PROBES, RANGE_ROWS, MOST_RANGES = 12, 6, 50_000, 65_536


def _bits(hashes: list[str], size: int) -> np.ndarray:
    """Places of each hash in a filter of ``size`` bits: two halves of its digits, added up."""
    a = np.array([int(h[8:20], 16) for h in hashes], np.uint64)
    b = np.array([int(h[20:32], 16) | 1 for h in hashes], np.uint64)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


class HashState(NamedTuple):
    spark: SparkSession
    path: str
    ranges: int
    size: int  # bits of a range's filter

    def range_of(self, column: str = "hash"):
        return F.floor(F.conv(F.substring(column, 1, 8), 16, 10).cast("long") * self.ranges / F.lit(1 << 32)).cast("int")

    def hashes(self) -> DataFrame:
        return self.spark.read.schema("hash string, owner_filename string, range int").parquet(f"{self.path}/hashes")

    def filters(self) -> DataFrame:
        return self.spark.read.schema("bits binary, range int").parquet(f"{self.path}/filters")

    def maybe(self, found: DataFrame) -> DataFrame:
        """hash of those that the filters let through: all that the state holds, and a few others."""
        size = self.size

        def ask(key, asked, kept):
            if not asked.num_rows or not kept.num_rows:
                return pa.table({"hash": pa.array([], pa.string())})
            bits = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in kept["bits"]]))
            hit = bits[_bits(asked["hash"].to_pylist(), size)].all(1)
            return pa.table({"hash": asked["hash"].filter(pa.array(hit))})

        asked = found.select("hash").where("hash is not null").distinct().withColumn("range", self.range_of())
        return asked.groupBy("range").cogroup(self.filters().groupBy("range")).applyInArrow(ask, "hash string")

    def known(self, found: DataFrame) -> DataFrame:
        """hash, owner_filename of those hashes of ``found`` that the state holds; other ranges' folders are not opened."""
        maybe = stored(self.maybe(found), "maybe")
        opened = sorted(r.r for r in maybe.select(self.range_of().alias("r")).distinct().collect())  # ``ranges`` at most
        held = self.hashes().where(F.col("range").isin(opened) if opened else F.lit(False))
        return held.join(maybe, "hash", "left_semi").groupBy("hash").agg(F.min("owner_filename").alias("owner_filename"))

    def add(self, owners: DataFrame) -> None:
        """Hashes with their owners, none of which the state holds: filters of their ranges first, then the hashes."""
        new = stored(owners.where("hash is not null").select("hash", "owner_filename", self.range_of().alias("range")), "new")
        size = self.size

        def fill(key, rows):
            bits = np.zeros(size, np.uint8)
            bits[_bits(rows["hash"].to_pylist(), size).ravel()] = 1
            return pa.table({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "range": pa.array([key[0].as_py()], pa.int32())})

        made = new.groupBy("range").applyInArrow(fill, "bits binary, range int")
        made.write.mode("append").partitionBy("range").parquet(f"{self.path}/filters")
        new.repartition("range").write.mode("append").partitionBy("range").parquet(f"{self.path}/hashes")

    def dedup(self, docs: DataFrame, content: str, file: str, order: list) -> DataFrame:
        """``docs`` with hash, owner and status, as ``corpus.dedup_by_content`` gives them under the whole state; the owners
        of new texts are added to the state."""
        hashed = stored(docs.withColumn("hash", T.content_hash(content)), "hashed")
        first = hashed.groupBy("hash").agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(file).alias("file"))).alias("first"))
        owners = first.select("hash", F.col("first.file").alias("file")).join(self.known(hashed), "hash", "left")
        owners = stored(owners.select("hash", F.coalesce("owner_filename", "file").alias("owner"), F.col("owner_filename").isNull().alias("new")), "owners")
        self.add(owners.where("new").select("hash", F.col("owner").alias("owner_filename")))
        return hashed.join(owners.drop("new"), "hash").withColumn("status", F.when(F.col(file) == F.col("owner"), "ok").otherwise("dup"))

    def share_passed(self, found: DataFrame) -> float:
        """Of hashes that the state doesn't hold, the share that the filters let through."""
        asked, passed = found.select("hash").distinct().count(), self.maybe(found).count()
        held = self.known(found).count()
        return (passed - held) / max(asked - held, 1)


def create(spark: SparkSession, path: str, expected: int, state: DataFrame | None = None) -> HashState:
    """An empty state, or one of the rows of ``state`` (hash, owner_filename), for about ``expected`` hashes in the end."""
    ranges = min(max(expected // RANGE_ROWS, 1), MOST_RANGES)
    size = max(expected * BITS_EACH // ranges, 1024) // 8 * 8
    made = HashState(spark, path, ranges, size)
    spark.createDataFrame([(ranges, size)], "ranges int, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    empty = spark.createDataFrame([], "hash string, owner_filename string, range int")
    empty.write.mode("overwrite").parquet(f"{path}/hashes")
    spark.createDataFrame([], "bits binary, range int").write.mode("overwrite").parquet(f"{path}/filters")
    if state is not None:
        made.add(state)
    return made


def open_state(spark: SparkSession, path: str) -> HashState:
    return HashState(spark, path, *spark.read.parquet(f"{path}/about").first())
