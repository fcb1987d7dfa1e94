"""Joins of strings that are alike by indel ratio: 200 * common subsequence / sum of lengths.

A ratio of t per cent needs a common subsequence of t / 200 of both lengths, and so as many letters in common, each counted
as often as it occurs. With letters numbered by occurrence a string is a set, of which two alike ones share at least that many
members; so the rarest few members of both, which are all but one less of the least share, have one in common. Strings meet in
a join on those, within classes of length that can be alike; letters in common are counted before the ratio is worked out.
Nothing is lost. Equal strings are compared once, and common members are dealt over several keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fuzzy import ratio
from textloom.shared import stored

SALTS = 8


def members(text: Column | str) -> Column:
    """The letters of a string, each with the number of its occurrence: "aba" gives a1, b1, a2."""
    c = F.split(text, "")
    return F.transform(c, lambda x, i: F.concat(x, F.size(F.filter(F.slice(c, 1, i + 1), lambda y: y == x)).cast("string")))


def _strings(df: DataFrame, column: str) -> DataFrame:
    """The distinct strings with their members; empty ones are alike to each other alone and are left to the end."""
    return df.select(F.col(column).alias("s")).where("s is not null and s != ''").distinct().withColumns({"n": F.length("s"), "m": members(F.col("s"))})


def _classes(least: float) -> float:
    """Strings that are alike differ in length by this factor at most."""
    return (200 - least) / least


def _rare(strings: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """s, n, m with each of the rarest members: all but (fewest in common with any string that is alike) - 1."""
    each = strings.select("s", "n", F.explode("m").alias("member")).join(counts, "member")
    order = F.array_sort(F.collect_list(F.struct("often", "member")))
    few = F.col("n") - F.ceil(F.col("n") * (least / (200 - least)) - 1e-9) + 1
    rare = each.groupBy("s", "n").agg(order.alias("o")).select("s", "n", F.explode(F.slice("o", 1, few.cast("int"))).alias("e"))
    return rare.select("s", "n", F.col("e.member").alias("member"))


def candidates(left: DataFrame, a: str, right: DataFrame, b: str, least: float) -> DataFrame:
    """a, b: pairs of strings, not empty, that share a rare member, whose lengths allow ``least`` and whose letters do.

    All pairs that reach ``least`` are among them."""
    if not 0 < least <= 100:
        raise ValueError("least is a share of 100")
    x, y = stored(_strings(left, a), "left"), stored(_strings(right, b), "right")
    counts = stored(x.select("m").union(y.select("m")).select(F.explode("m").alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("often")), "members")
    step = math.log(_classes(least)) if least < 100 else 0.0
    length_class = F.floor(F.log(F.col("n").cast("double")) / step).cast("int") if step > 1e-6 else F.col("n")
    near = F.array(*[length_class + i for i in ((-1, 0, 1) if step > 1e-6 else (0,))])
    one = _rare(x, counts, least).withColumns({"class": length_class, "salt": F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int")})
    two = _rare(y, counts, least).select(F.col("s").alias("t"), F.col("n").alias("k"), "member", F.explode(near).alias("class")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lengths = 200 * F.least("n", "k") >= least * (F.col("n") + F.col("k")) - 1e-6
    met = one.join(two, ["member", "class", "salt"]).where(lengths).select("s", "t", "n", "k").distinct()
    both = met.join(x.select("s", "m"), "s").join(y.select(F.col("s").alias("t"), F.col("m").alias("o")), "t")
    letters = 200 * F.size(F.array_intersect("m", "o")) >= least * (F.col("n") + F.col("k")) - 1e-6
    return both.where(letters).select(F.col("s").alias("a"), F.col("t").alias("b"))


def alike(left: DataFrame, a: str, right: DataFrame, b: str, least: float = 80) -> DataFrame:
    """a, b, score of the pairs of distinct strings of two tables whose ratio is ``least`` or more.

    Nulls are like nothing; an empty string is like an empty one alone, at 100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [ratio(p, q) for p, q in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], ["a", "b", "score"])

    pairs = stored(candidates(left, a, right, b, least), "pairs")  # written, so that costly pairs are dealt evenly
    found = pairs.repartition("a", "b").mapInArrow(run, "a string, b string, score double").where(F.col("score") >= least)
    none = left.where(F.col(a) == "").select(F.lit("").alias("a")).distinct().join(right.where(F.col(b) == "").select(F.lit("").alias("b")).distinct(), F.col("a") == F.col("b"))
    return found.union(none.select("a", "b", F.lit(100.0).alias("score")))


def fuzzy_join(left: DataFrame, a: str, right: DataFrame, b: str, least: float = 80) -> DataFrame:
    """Rows of both tables whose strings are alike, with their score; columns of the right table under new names where they clash."""
    pairs = alike(left, a, right, b, least).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("score").alias("_score"))
    other = right.select(*[F.col(c).alias(f"right_{c}" if c in left.columns else c) for c in right.columns], F.col(b).alias("_b"))
    out = left.withColumn("_a", F.col(a)).join(pairs, "_a").join(other, "_b").drop("_a", "_b")
    return out.withColumnRenamed("_score", "score" if "score" not in out.columns else "fuzzy_score")
