import random

import pytest

from textloom.functions.fuzzy import ratio
from textloom.operators import fuzzy_join as fj


def words(n, seed, letters="aeionrstlqxé"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(1, 16))) for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        w = list(r.choice(base))
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = r.choice(letters)
        out.add("".join(w))
    return sorted(out)


def frame(spark, strings, name):
    return spark.createDataFrame([(s,) for s in strings], f"{name} string")


@pytest.mark.parametrize("least,n", [(80, 2000), (70, 300), (85, 400), (93, 300), (100, 300)])
def test_equal_to_all_pairs(spark, least, n):
    x, y = words(n, 1), words(n, 2)
    got = {(r.a, r.b): r.score for r in fj.alike(frame(spark, x, "p"), "p", frame(spark, y, "q"), "q", least).collect()}
    want = {}
    for a in x:
        for b in y:
            if 200 * min(len(a), len(b)) >= least * (len(a) + len(b)) and (s := ratio(a, b)) >= least:
                want[a, b] = s
    assert got == want and want


def test_few_pairs_are_compared(spark):
    x, y = words(1500, 3, "abcdefghijklmnopqrstuvwxyz"), words(1500, 4, "abcdefghijklmnopqrstuvwxyz")
    met = fj.candidates(frame(spark, x, "p"), "p", frame(spark, y, "q"), "q", 80).count()
    assert met < 0.02 * len(x) * len(y)


def test_rows_come_back_whole_and_odd_ones_count(spark):
    left = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, None), (4, ""), (5, "x" * 3000)], "id long, name string")
    right = spark.createDataFrame([("hallo", 1), ("", 2), (None, 3), ("x" * 2900, 4), ("zzz", 5)], "name string, score int")
    rows = sorted((r.id, r.right_name[:5], r.score, round(r.fuzzy_score, 3)) for r in fj.fuzzy_join(left, "name", right, "name", 75).collect())
    assert rows == [(1, "hallo", 1, 80.0), (2, "hallo", 1, 80.0), (4, "", 2, 100.0), (5, "xxxxx", 4, round(200 * 2900 / 5900, 3))]
    assert fj.alike(left.limit(0), "name", right, "name").collect() == []
    with pytest.raises(ValueError):
        fj.alike(left, "name", right, "name", 0)


def test_one_string_in_most_rows(spark):
    left = frame(spark, ["common"] * 3000 + ["comon", "rare"], "p")
    assert sorted((r.a, r.b) for r in fj.alike(left, "p", left, "p", 80).collect()) == [("common", "common"), ("common", "comon"), ("comon", "common"), ("comon", "comon"), ("rare", "rare")]
