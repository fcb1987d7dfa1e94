import pytest

from textloom.llm.mixing import mixed, mixing_weights, rake

DOCS = "doc_id long, text string, lang string, source string, tokens long, w long"


def docs(spark, n=3000):
    return spark.createDataFrame([(i, "w " * (5 + i % 40) + ("license terms" if i % 7 == 0 else ""), "en" if i // 9 % 3 else None, f"s{min(i % 9, 4)}", 1, 2) for i in range(n)], DOCS)


def test_expected_shares_meet_targets(spark):
    target = spark.createDataFrame([(f"s{i}", 0.2) for i in range(5)] + [("absent", 3.0)], "value string, share double")
    rows = mixing_weights(docs(spark), targets={"source": target}).collect()
    assert len(rows) == 3000 and max(r.probability for r in rows) == pytest.approx(1) and min(r.probability for r in rows) > 0
    share, total = {}, 0
    for r in rows:
        share[r.source] = share.get(r.source, 0) + r.probability * r.tokens
        total += r.probability * r.tokens
    assert all(v / total == pytest.approx(0.2, abs=1e-4) for v in share.values())
    taken = sum(r.tokens for r in rows if r.sampled)
    assert taken == pytest.approx(total, rel=0.1)
    assert {r.topic for r in rows} == {"legal", "other"}


def test_rake_against_plain_loops(spark):
    table = {("a", "x"): 3.0, ("a", "y"): 1.0, ("b", "x"): 2.0, ("b", "y"): 6.0, (None, "y"): 0.0}
    to = {"p": {"a": 0.7, "b": 0.3}, "q": {"x": 0.2, "y": 0.8}}
    w = dict(table)
    for _ in range(200):
        for i, d in enumerate("pq"):
            for v, share in to[d].items():
                s = sum(x for k, x in w.items() if k[i] == v)
                w = {k: x * share / s if k[i] == v else x for k, x in w.items()}
    cells = spark.createDataFrame([(*k, v, 1) for k, v in table.items()], "p string, q string, tokens double, docs int")
    got = rake(cells, {d: spark.createDataFrame(list(m.items()), "value string, share double") for d, m in to.items()}, rounds=200)
    assert {(r.p, r.q): round(r.w, 5) for r in got.collect()} == {k: round(v, 5) for k, v in w.items()}


def test_edges(spark):
    odd = spark.createDataFrame([(None, None, None, None, 1, 1), (1, "", "en", "s", 1, 1), (1, "", "en", "s", 1, 1), (2, "w " * 100_000, "en", "s", 1, 1)], DOCS)
    rows = {(r.doc_id, r.tokens, r.probability) for r in mixing_weights(odd).collect()}
    assert rows == {(None, 0, 1.0), (1, 0, 1.0), (2, 100_000, 1.0)}
    kept = mixed(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert mixing_weights(odd.limit(0)).collect() == []


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_rake_in_one_task_and_over_the_cluster(spark, one_task):
    cells = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 2.0), (None, "y", 4.0)], "p string, q string, tokens double")
    to = {"p": spark.createDataFrame([("a", 0.5), ("b", 0.2), (None, 0.3)], "value string, share double"), "q": spark.createDataFrame([("x", 0.4), ("y", 0.6)], "value string, share double")}
    got = {(r.p, r.q): r.w for r in rake(cells, to, one_task=one_task).collect()}
    for i, want in ((0, {"a": 0.5, "b": 0.2, None: 0.3}), (1, {"x": 0.4, "y": 0.6})):
        assert {v: pytest.approx(sum(w for k, w in got.items() if k[i] == v), abs=1e-5) for v in want} == want


def test_targets_that_cannot_be_met_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 3.0), ("b", "y", 1.0)], "p string, q string, tokens double")
    to = {"p": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"), "q": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "value string, share double")}
    with pytest.warns(UserWarning, match="raking stopped"):
        assert rake(cells, to, rounds=4).count() == 2


def test_columns_of_any_name_come_through(spark):
    rows = docs(spark, 500).selectExpr("*", "1 as chosen", "'p' as probability", "'t' as topic", "2 as mixing_0", "3 as c_source", "4 as r")
    kept = mixed(rows)
    assert kept.columns == rows.columns
    want = {r.doc_id for r in mixing_weights(docs(spark, 500)).collect() if r.sampled}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < 500
