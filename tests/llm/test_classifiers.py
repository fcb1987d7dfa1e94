import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import labelled, quality, toxicity
from textloom.shared import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, quality_score string, label int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("scores,label,parts,held,least", [(quality.quality_scores, "quality", 3, 1, 0.97), (toxicity.toxicity_scores, "toxic", 4, 2, 0.93)])
def test_held_out_accuracy(spark, scores, label, parts, held, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r for r in scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1
    test = [(rows[x.doc_id].predicted, x[label]) for x in labels.collect() if rows[x.doc_id].held_out]
    assert len(test) > 50 and np.mean([p == y for p, y in test]) >= least


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_edges(spark, scores):
    docs = spark.createDataFrame([(1, None, "q", 1), (1, "", "q", 1), (None, "x", "q", 1), (2, "word " * 50_000, "q", 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(2, 1, 1), (None, 0, 0), (1, None, None), (2, 1, 1)], LABELS)
    for labels in (none, one):
        rows = scores(docs, labels).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert scores(docs.limit(0), none).collect() == []


def test_keep_good_returns_the_same_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and docs.count() * 0.7 < kept.count() < docs.count()


def test_grammar():
    insults, machine = {"idiot": 2.0}, toxicity.composed()
    score = lambda t: toxicity.clause_score(t.split(), insults, machine)
    assert score("an idiot") == 2.0 and score("nothing here") == 0
    assert score("you are an idiot") == 3.0 > score("you are not an idiot") > score("he said she is not an idiot") > 0
    assert score("i will hurt you") == toxicity.THREAT_WEIGHT and score("hurt feelings all over you") == 0
    assert (toxicity.traits(["", "fine. Fine!"], insults) == 0).all()


@pytest.mark.parametrize("few", [labelled.BROADCAST_ROWS, 100])
def test_all_labelled_rows_are_learned_from(spark, few):
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    want = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(n))
    assert want > 24_000 and labelled.training_rows(docs, labels, "quality", 3, 1, few).count() == want


def test_all_pairs_are_ranked(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = labelled.training_rows(docs, labels, "quality", 3, 1).toPandas()
    x, y = quality.measures(rows["text"]), rows["label"].to_numpy()
    made = quality.train(docs, labels)
    assert np.allclose(made.mean, x.mean(0)) and np.allclose(made.scale, x.std(0) + 1e-6)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    pairs = (z[y == 1][:, None] - z[y == 0]).reshape(-1, quality.MEASURES)
    weigh = np.full(len(pairs), quality.PAIRS / len(pairs))

    def at(w):
        sums = labelled.slopes(pairs, np.ones(len(pairs)), w, weigh)
        return sums[0], sums[1:]

    want = labelled.newton(quality.MEASURES, at, 1.0)
    assert np.abs(made.weights - want).max() < 2e-3 * np.abs(want).max()
    assert made.cut == pytest.approx(np.quantile(made(x), ((y == 0).sum() + 1) / (len(y) + 2)), abs=1e-9)


def test_quantile_of_counted_ranges(spark):
    values = np.r_[np.random.default_rng(1).normal(size=3000), np.full(2000, 0.25), np.full(500, 3.0)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    for q in (0, 0.1, 0.37, 0.5, 0.75, 0.999, 1):
        assert labelled.quantile(rows, "v", q, most=20) == pytest.approx(np.quantile(values, q), abs=1e-12)
