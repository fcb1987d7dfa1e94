"""Pages deep in a sorted table: a table in ranges of its key, and how many rows each of its files holds.

``offset`` sorts all that comes before a page. Here the rows are sorted once and the counts of files say where page n lies,
so a page opens the file that holds it, or the two that it spans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.records import MOST, PAGE

FILE_ROWS = 100_000


class PagedTable(NamedTuple):
    spark: SparkSession
    path: str
    key: str

    def _counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def total(self) -> int:
        return self._counts().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def files(self, number: int = 1, size: int = PAGE) -> list[tuple[str, int]]:
        """The files that hold a page, with the number of rows before each; read off the counts, a row a file."""
        size = min(max(size, 1), MOST)
        first = (max(number, 1) - 1) * size
        rows = self._counts().where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).orderBy("before").collect()
        return [(r.file, r.before) for r in rows]

    def page(self, number: int = 1, size: int = PAGE) -> DataFrame:
        """A page of the rows, the newest key first: as ``records.page`` gives it."""
        held, size = self.files(number, size), min(max(size, 1), MOST)
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not held:
            return self.spark.createDataFrame([], schema)
        skip = (max(number, 1) - 1) * size - held[0][1]
        return self.spark.read.schema(schema).parquet(*[f for f, _ in held]).orderBy(F.desc(self.key)).offset(skip).limit(size)


def write_paged(docs: DataFrame, path: str, key: str, file_rows: int = FILE_ROWS) -> PagedTable:
    """Writes the rows in falling order of the key, ``file_rows`` to a file or so; keys are unique and not null.

    The starts of files are summed over a table with a row for each file."""
    spark, parts = docs.sparkSession, docs.count() // file_rows + 1
    docs.repartitionByRange(parts, F.desc(key)).sortWithinPartitions(F.desc(key)).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    counts = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top"))
    counts.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("top"))) - F.col("n")).drop("top").coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return PagedTable(spark, path, key)


def open_paged(spark: SparkSession, path: str, key: str) -> PagedTable:
    return PagedTable(spark, path, key)
