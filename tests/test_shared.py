import os

from pyspark.sql import functions as F

from textloom.shared import CLEANUP, stored


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for d in blocks.localDirs() for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    out = stored(rows, "rows")
    assert not shuffle_files(spark) - before and out.count() == 100
    assert spark.conf.get(CLEANUP, None) == was
