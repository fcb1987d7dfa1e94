"""Tables changed by key without writing them anew: buckets by hash of the key, and versions that readers see whole.

A change rewrites the buckets that hold its keys, into a folder of its own version. A manifest names the version of every
bucket; it is one file, written last. Readers take the newest manifest, so a run that dies on the way leaves the old version."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shared import stored

BUCKETS = 256
MANIFEST = "bucket int, version long"


class KeyedTable(NamedTuple):
    spark: SparkSession
    path: str
    key: str
    buckets: int
    columns: str  # the schema

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> tuple[int, dict[int, int]]:
        """The newest version, and the version of each bucket that has rows: a row for each bucket comes to the driver."""
        rows = self.spark.read.schema(f"{MANIFEST}, v long").parquet(f"{self.path}/manifest")
        newest = rows.agg(F.max("v")).first()[0]
        return newest, {r.bucket: r.version for r in rows.where(F.col("v") == newest).collect() if r.bucket >= 0}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, of some buckets or of all."""
        _, at = self.versions()
        return self._of({b: v for b, v in at.items() if only is None or b in only})

    def lookup(self, keys: list) -> DataFrame:
        """The rows of a few keys; other buckets are not opened."""
        kind = self.spark.createDataFrame([], self.columns).schema[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"k {kind.simpleString()}").select(self.bucket("k").alias("b")).distinct()
        return self.read([r.b for r in wanted.collect()]).where(F.col(self.key).isin(keys))

    def _of(self, at: dict[int, int]) -> DataFrame:
        reader = self.spark.read.schema(self.columns)
        if not at:
            return self.spark.createDataFrame([], self.columns)
        return reader.parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(at.items())])

    def _write(self, rows: DataFrame, version: int, kept: dict[int, int]) -> dict[int, int]:
        """Rows into a version's folder, then the manifest: ``kept`` and what was written."""
        dealt = rows.withColumn("bucket", self.bucket(self.key)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        made = self.spark.read.schema(f"{self.columns}, bucket int").parquet(f"{self.path}/data/version={version}").select("bucket").distinct().collect()
        at = kept | {r.bucket: version for r in made}
        self._publish(version, at)
        return at

    def _publish(self, version: int, at: dict[int, int]) -> None:
        rows = [(b, v) for b, v in sorted(at.items())] or [(-1, version)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def change(self, changes: DataFrame, replace: list[str] | None = None, insert: bool = True, delete: DataFrame | None = None) -> list[int]:
        """Applies rows by key and gives the buckets that were written.

        Of a key that the table has, the columns ``replace`` (all that both have, unless given) take the new values that
        aren't null; a new key is inserted. Keys of ``delete`` go, whatever ``changes`` says. Keys of ``changes`` are unique
        and not null."""
        version, at = self.versions()
        fields = [f.name for f in self.spark.createDataFrame([], self.columns).schema]
        changes = stored(changes.where(F.col(self.key).isNotNull()), "changes")
        gone = stored(delete.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "gone") if delete is not None else None
        keys = changes.select(self.key) if gone is None else changes.select(self.key).union(gone)
        touched = sorted(r.b for r in keys.select(self.bucket(self.key).alias("b")).distinct().collect())  # ``buckets`` at most
        if not touched:
            return []
        new = [c for c in fields if c in changes.columns and c != self.key]
        old = self._of({b: at[b] for b in touched if b in at})
        mine = changes.select(self.key, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_changed"))
        both = old.withColumn("_held", F.lit(True)).join(mine, self.key, "full" if insert else "left")
        changed = [c for c in new if replace is None or c in replace]

        def value(c: str) -> Column:
            if c not in new:
                return F.col(c)
            held = F.coalesce(f"_new_{c}", c) if c in changed else F.col(c)
            return F.when(F.col("_held"), held).otherwise(F.col(f"_new_{c}")).alias(c)

        rows = both.select(*[value(c) for c in fields])
        if gone is not None:
            rows = rows.join(gone, self.key, "left_anti")
        self._write(rows, version + 1, {b: v for b, v in at.items() if b not in touched})
        return touched

    def vacuum(self) -> int:
        """Deletes the folders of buckets that the newest manifest doesn't name; how many. No reader may be on an old version."""
        _, at = self.versions()
        held = self.spark.read.schema(f"{self.columns}, version long, bucket int").parquet(f"{self.path}/data").select("version", "bucket").distinct().collect()
        old = [(r.version, r.bucket) for r in held if at.get(r.bucket) != r.version]
        for version, bucket in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={version}/bucket={bucket}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        return len(old)


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
    """Writes ``df`` as the first version. Keys are unique; rows with a null key are kept and never changed."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = KeyedTable(df.sparkSession, path, key, buckets, columns)
    df.sparkSession.createDataFrame([(key, buckets, columns)], "key string, buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    table._write(df, 0, {})
    return table


def open_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, *spark.read.parquet(f"{path}/about").first())
