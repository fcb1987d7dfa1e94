import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import vector_index as vi
from textloom.shared import table


def frame(spark, x, keys=None):
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(keys if keys is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain(x, asked, limit):
    """Ids of the best rows by cosine, ties by id."""
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    score = np.round(u[asked] @ u.T, 9)
    return {q: np.lexsort((np.arange(len(x)), -s))[:limit].tolist() for q, s in zip(asked, score, strict=True)}


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r.rank)):
        out.setdefault(r.query, []).append(r.key)
    return out


def recall(found, want):
    return np.mean([len({*found.get(q, [])} & {*w}) / len(w) for q, w in want.items()])


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(50, dim))[rng.integers(0, 50, n)] + 0.6 * rng.normal(size=(n, dim))


def test_exact_search_in_blocks(spark, monkeypatch):
    x = clustered(900, 24)
    x[100:130] = x[100]
    monkeypatch.setattr(vi, "PART_ROWS", 200)
    monkeypatch.setattr(vi, "BLOCK", 7)
    df, asked = frame(spark, x), list(range(0, 900, 20))
    assert got(vi.search_all(df, df.where("vec_id % 20 = 0"), "vec_id", "vec_id", 5)) == plain(x, asked, 5)


@pytest.mark.parametrize("n,dim", [(20_000, 32)])
def test_recall_on_made_data(spark, tmp_path, n, dim):
    x = clustered(n, dim)
    df = frame(spark, x).repartition(4)
    index = vi.build(df, "vec_id", f"file://{tmp_path}/index", sample=8192)
    asked = list(range(0, n, 200))
    found = vi.search(vi.open_index(spark, f"file://{tmp_path}/index"), df.where("vec_id % 200 = 0"), "vec_id", 10)
    assert recall(got(found), plain(x, asked, 10)) >= 0.95
    assert len(index.model.centres) > 50 and index.table(spark).count() == n


def test_only_near_cells_are_read(spark, tmp_path):
    x = clustered(6000, 16)
    df = frame(spark, x)
    index = vi.build(df, "vec_id", f"file://{tmp_path}/index")
    found = vi.search(index, df.where("vec_id = 3"), "vec_id", 10, probe=4)
    assert found.count() == 10
    opened = [p for p in index.table(spark).inputFiles()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and len(opened) >= len(index.model.centres)


def test_recall_on_the_table(spark, tmp_path):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    index = vi.build(rows, "vec_id", f"file://{tmp_path}/index")
    asked = rows.where("vec_id % 20 = 0")
    want = got(vi.search_all(rows, asked, "vec_id", "vec_id"))
    assert recall(got(vi.search(index, asked, "vec_id")), want) >= 0.95


def test_a_hot_cell_is_dealt_in_parts_and_blocks(spark, tmp_path, monkeypatch):
    """Most rows are one vector and ask from one cell: no group has more than its bound, and ties go by key."""
    monkeypatch.setattr(vi, "PART_ROWS", 100)
    monkeypatch.setattr(vi, "BLOCK", 10)
    x = np.concatenate([np.tile([[1.0, 2, 3, 4]], (900, 1)), np.random.default_rng(3).normal(size=(100, 4))])
    df = frame(spark, x)
    index = vi.build(df, "vec_id", f"file://{tmp_path}/index", cells=8)
    assert max(index.parts.values()) >= 9
    found = got(vi.search(index, df.where("vec_id < 60"), "vec_id", 3))
    assert found == {q: [0, 1, 2] for q in range(60)}
    sizes = index.table(spark).groupBy("cell", "part").count().agg(F.max("count")).first()[0]
    assert sizes < 200


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [0.0, 1.0]), (7, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vi.build(df, "vec_id", f"file://{tmp_path}/index")
    assert got(vi.search(index, df, "vec_id", 2)) == {1: [1, 7], 6: [6, 7], 7: [7, 1]}
    assert {q: k for q, k in got(vi.search_all(df, df, "vec_id", "vec_id", 2)).items() if q != 5} == {1: [1, 7], 6: [6, 7], 7: [7, 1]}
    assert vi.search(index, df.limit(0), "vec_id").collect() == []
    with pytest.raises(ValueError):
        vi.build(df.limit(0), "vec_id", f"file://{tmp_path}/none")


def test_far_cells_give_only_what_may_be_a_candidate(spark, tmp_path, monkeypatch):
    """The same rows as if all cells were scanned at once, and far fewer on the way."""
    df = frame(spark, clustered(3000, 16))
    index = vi.build(df, "vec_id", f"file://{tmp_path}/index", cells=40)
    passed, best = [], vi._best

    def counted(scored, limit, score="score"):
        if score == "near":
            passed.append(scored.count())
        return best(scored, limit, score)

    monkeypatch.setattr(vi, "_best", counted)
    found = {}
    for first in (40, 4):
        passed.clear()
        monkeypatch.setattr(vi, "FIRST", first)
        found[first] = got(vi.search(index, df.where("vec_id % 50 = 0"), "vec_id", 5, probe=40, candidates=20)), sum(passed)
    assert found[4][0] == found[40][0] and found[4][1] < found[40][1] / 2
