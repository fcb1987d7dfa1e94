import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
sys.path.remove(sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2] + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("textloom") is None).collect() == [True]
text = "license terms " + " ".join(f"w{i}" for i in range(300))
spark.createDataFrame([(i, text + " " + str(i), "en", f"s{i % 3}", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(sys.argv[2] + "/documents.parquet")
spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(sys.argv[2] + "/labels.parquet")
spark.createDataFrame([(1, "none of these words stands in any document at all")], "item_id long, text string").write.parquet(sys.argv[2] + "/benchmark.parquet")
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        rows = query(spark, sys.argv[2]).count()
        assert rows or name == "op1_decontamination", name
print("all ran")
"""


def test_python_runs_where_executors_lack_the_package(tmp_path):
    """Functions and what they refer to travel by value."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONSAFEPATH": "1"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
