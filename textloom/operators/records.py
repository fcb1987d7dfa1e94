"""The table of document chunks as an administrator sees it: counts, search, pages, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import col

PAGE, MOST = 20, 100
EDITABLE = ("content", "school", "source_file", "source_url", "source_title", "tags", "chunk_id", "total_chunks")


def stats(docs: DataFrame, school: str = "school") -> DataFrame:
    """school, n for each school; rows without one count only to the total, under a null school."""
    named = F.when(F.col(school) != "", F.col(school))
    return docs.groupBy(named.alias("school")).agg(F.count(F.lit(1)).alias("n"))


def totals(docs: DataFrame, school: str = "school") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.when(F.col(school) != "", F.col(school))).alias("schools"))


def search(docs: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns matches the pattern, in any case of any script."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(col(c).rlike(f"(?iu){pattern}"), F.lit(False))
    return docs.where(hit)


def page(docs: DataFrame, key: str, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of the rows, the newest key first."""
    size = min(max(size, 1), MOST)
    return docs.orderBy(F.desc(key)).offset((max(number, 1) - 1) * size).limit(size)


def page_count(docs: DataFrame, size: int = PAGE) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.floor((F.col("total") + size - 1) / size))


def lookup(docs: DataFrame, key: str, value) -> DataFrame:
    return docs.where(F.col(key) == value)


def found(docs: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """id, status, row for each ``asked`` (id, as text): 400 for what can be no key, 404 for what no row has, else 200."""
    rows = docs.select(F.col(key).alias("_key"), F.struct(*docs.columns).alias("row"))
    out = asked.select("id", F.col("id").try_cast(docs.schema[key].dataType).alias("_id")).join(rows, F.col("_id") == F.col("_key"), "left")
    return out.select("id", F.when(F.col("_id").isNull(), 400).when(F.col("row").isNull(), 404).otherwise(200).alias("status"), "row")


def update(docs: DataFrame, key: str, value, changes: dict) -> DataFrame:
    """Editable fields of a row changed to those given and not null; the embedding stays."""
    for name, new in changes.items():
        if name in EDITABLE and new is not None:
            given = F.array(*[F.lit(x) for x in new]) if isinstance(new, list) else F.lit(new)
            docs = docs.withColumn(name, F.when(F.col(key) == value, given.cast(docs.schema[name].dataType)).otherwise(F.col(name)))
    return docs


def delete(docs: DataFrame, key: str, value) -> DataFrame:
    return docs.where(~F.col(key).eqNullSafe(value))


def insert(docs: DataFrame, row: dict) -> DataFrame:
    """``docs`` and a new row; its content is required, and what it lacks is null."""
    if not row.get("content"):
        raise ValueError("content is required")
    new = docs.sparkSession.createDataFrame([tuple(row.get(n) for n in docs.columns)], docs.schema)
    return docs.unionByName(new)


def merge_embeddings(docs: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """``docs`` with the embeddings of ``made`` (key, embedding) where it has one."""
    new = made.select(key, F.col("embedding").alias("_new"))
    return docs.join(new, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(docs.columns)
