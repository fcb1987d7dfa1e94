"""Tables changed by key, hash states, deep pages, counts in the same job, batches for a model."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, pages, records
from textloom.shared import table
from textloom.sources import hash_state, keyed

SF = "/root/testdata/sf0.001"


def files(path):
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def docs(spark):
    rows = [(i, f"content {i}", None if i % 3 else [1.0, float(i)], "s") for i in range(400)] + [(None, "no key", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, content string, embedding array<float>, school string")


def rows_of(df):
    return sorted(map(str, df.select("doc_id", "content", "embedding", "school").collect()))


def test_changes_equal_whole_rewrites_and_write_few_buckets(spark, tmp_path, docs):
    made = keyed.create(docs, f"{tmp_path}/t", "doc_id", 32)
    before = files(f"{tmp_path}/t/data")
    new = spark.createDataFrame([(4, [9.0]), (7, [8.0])], "doc_id long, embedding array<float>")
    touched = made.change(new)
    assert len(touched) <= 2 and rows_of(made.read()) == rows_of(records.merge_embeddings(docs, new, "doc_id"))
    after = files(f"{tmp_path}/t/data")
    assert sum(after.values()) - sum(before.values()) < 0.2 * sum(before.values())
    edit = spark.createDataFrame([(5, "changed", None, "x"), (900, "fresh", None, "y")], docs.schema)
    made.change(edit, replace=["content"], delete=spark.createDataFrame([(8,), (12345,)], "doc_id long"))
    want = records.delete(records.update(records.merge_embeddings(docs, new, "doc_id"), "doc_id", 5, {"content": "changed"}), "doc_id", 8)
    assert rows_of(keyed.open_table(spark, f"{tmp_path}/t").read()) == rows_of(want.union(edit.where("doc_id = 900")))
    assert [r.content for r in made.lookup([5]).collect()] == ["changed"] and made.lookup([8]).collect() == []
    assert made.change(new.limit(0)) == [] and made.vacuum() > 0 and made.read().count() == 401


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, docs, monkeypatch):
    made = keyed.create(docs, f"{tmp_path}/t", "doc_id", 8)
    want = rows_of(made.read())

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(keyed.KeyedTable, "_publish", die)
    with pytest.raises(RuntimeError):
        made.change(spark.createDataFrame([(4, [9.0])], "doc_id long, embedding array<float>"))
    assert rows_of(made.read()) == want
    monkeypatch.undo()
    made.change(spark.createDataFrame([(4, [9.0])], "doc_id long, embedding array<float>"))
    assert [r.embedding for r in made.lookup([4]).collect()] == [[9.0]]


def test_a_table_can_lose_all_rows(spark, tmp_path, docs):
    made = keyed.create(docs.where("doc_id < 3"), f"{tmp_path}/t", "doc_id", 4)
    made.change(docs.limit(0), delete=docs.select("doc_id"))
    assert made.read().collect() == []


def test_hash_state_gives_the_rows_of_the_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_state, "RANGE_ROWS", 200)
    r = random.Random(1)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    old = spark.createDataFrame([(md5(f"text {i}"), f"old{i}.md") for i in range(6000)], "hash string, owner_filename string")
    state = hash_state.create(spark, f"{tmp_path}/state", 8000, old)
    new = [(i, f"text  {r.choice([r.randrange(60), 10_000 + r.randrange(40)])}", f"{i}.md") for i in range(80)] + [(80, "text 3", "old3.md"), (81, None, "n.md"), (82, "", "e.md")]
    docs = spark.createDataFrame(new, "doc_id long, text string, file string")
    want = corpus.dedup_by_content(docs, "text", "file", [F.col("doc_id")], old)
    got = hash_state.open_state(spark, f"{tmp_path}/state").dedup(docs, "text", "file", [F.col("doc_id")])
    cols = ["doc_id", "hash", "owner", "status"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    again = state.dedup(docs, "text", "file", [F.col("doc_id")])
    assert sorted(map(str, again.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_hash_state_reads_few_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_state, "RANGE_ROWS", 100)
    hashes = lambda a, b: spark.range(a, b).select(F.md5(F.col("id").cast("string")).alias("hash"), F.lit("f").alias("owner_filename"))
    state = hash_state.create(spark, f"{tmp_path}/state", 10_000, hashes(0, 10_000))
    assert state.ranges == 100 and state.known(hashes(0, 500)).count() == 500
    assert 0 < state.share_passed(hashes(20_000, 40_000)) < 0.02
    opened = state.maybe(hashes(50_000, 50_050).union(hashes(3, 5))).select(state.range_of().alias("r")).distinct().count()
    assert 1 <= opened <= 6


def test_deep_pages(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    made = pages.write_paged(docs, f"{tmp_path}/p", "doc_id", file_rows=17)
    r = random.Random(3)
    assert made.total() == docs.count()
    for number, size in [(1, 20), (10, 20), (11, 20), (0, 5), (3, 1000), *((r.randrange(1, 60), r.randrange(1, 25)) for _ in range(15))]:
        assert made.page(number, size).collect() == records.page(docs, "doc_id", number, size).collect()
        assert len(made.files(number, 17)) <= 3
    assert len(made.files(5, 5)) <= 2


def test_counts_come_with_the_write(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    deduped = corpus.dedup_by_content(docs, "text", "file", [F.col("doc_id")])
    counts = corpus.write_counted(deduped, f"{tmp_path}/out", F.col("doc_id") % 50 == 7)
    want = {r.status: r.n for r in corpus.status_counts(deduped.where("doc_id % 50 != 7")).collect()}
    assert counts == {**{"ok": 0, "dup": 0}, **want, "err": 4} and spark.read.parquet(f"{tmp_path}/out").count() == counts["ok"]


def test_batches_for_a_model(spark, tmp_path):
    """Bounds hold, each text is asked once, and rows get their own vectors."""
    log = f"{tmp_path}/log"

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def model(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)} {max(map(len, texts)) * len(texts)}\n")
            return np.array([[len(t), sum(map(ord, t)) % 1000] for t in texts])

        return model

    r = random.Random(2)
    rows = [(i, "x" * r.choice([0, 3, 50, 700, 3000]) + str(i), None if i % 10 else [0.0, 0.0]) for i in range(3000)] + [(3000, None, None), (3001, "y" * 40_000, None)]
    chunks = spark.createDataFrame(rows, "id long, content string, embedding array<float>").repartition(2)
    got = {x.id: x.embedding for x in corpus.embed_in_batches(chunks, load, F.col("content")).collect()}
    assert got == {i: e or [float(len(t or "")), float(sum(map(ord, t or "")) % 1000)] for i, t, e in rows}
    lines = open(log).read().split("\n")[:-1]
    asked = [tuple(map(int, x.split())) for x in lines if x != "load"]
    assert lines.count("load") <= 4 and sum(n for n, _ in asked) == sum(e is None for *_, e in rows)
    assert all(n <= 32 and (size <= 16_384 or n == 1) for n, size in asked)
    assert [len(b) for b in corpus.batches_of(np.array([5, 5, 5]), 2, 10)] == [2, 1]
