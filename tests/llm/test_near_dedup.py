import numpy as np
import pytest

from textloom.llm import near_dedup
from textloom.llm.near_dedup import near_groups, one_of_each, plan, proposals, shingle_set, wide_fingerprint
from textloom.llm.passages import _Hashed
from textloom.shared import table

SF = "/root/testdata/sf0.01"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, similar=0.8):
    """Smallest key that links of ``similar`` or more lead to; by all pairs that share a shingle."""
    sets, by = {k: grams(t) for k, t in texts.items()}, {}
    for k, s in sets.items():
        for g in s or {()}:
            by.setdefault(g, []).append(k)
    root = {k: k for k in texts}
    find = lambda v: v if root[v] == v else find(root[v])
    pairs = {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[:i]}
    links = 0
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if not x or len(x & y) >= similar * len(x | y):
            links += texts[a] != texts[b]
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: find(k) for k in texts}, links


def test_groups_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    want, links = brute_groups(texts)
    got = {r.row: r.group for r in near_groups(table(spark, SF, "documents").select(near_dedup.F.col("doc_id").alias("row"), "text")).collect()}
    assert links >= 10 and all(want[k] == want[g] for k, g in got.items())  # no link that isn't one
    apart = {k for k in texts if want[k] != k and got[k] == k}
    assert len(apart) <= 0.02 * sum(want[k] != k for k in texts)


def test_recall_at_the_least_similarity(spark):
    """Pairs with a similarity just above 0.8 among many other texts, and a large group of near copies."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts, pairs = [], 0
    for _ in range(150):
        a = words(200)
        b = list(a)
        for at in range(10, 200, 60):
            b[at] = "edit"
        assert 0.8 <= len(grams(" ".join(a)) & grams(" ".join(b))) / len(grams(" ".join(a)) | grams(" ".join(b))) < 0.85
        texts += [a, b]
        pairs += 1
    base = words(300)
    for _ in range(1500):
        mine = list(base)
        mine[int(rng.integers(0, 300))] = words(1)[0]
        texts.append(mine)
    texts += [words(int(rng.integers(1, 100))) for _ in range(700)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string")
    got = {r.row: r.group for r in near_groups(rows).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.95 * pairs
    assert all(got[i] == 300 for i in range(300, 1800)) and all(got[i] == i for i in range(1800, 2500))


def test_recall_where_texts_share_most_words(spark):
    """Every text has three quarters of its words from one passage: unrelated ones are alike at 0.6 and crowd the buckets."""
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    common, texts, pairs = words(170), [], []
    for _ in range(150):
        a = common + words(50)
        b = list(a)
        for at in rng.choice(len(a), 4, replace=False):
            b[at] = words(1)[0]
        x, y = grams(" ".join(a)), grams(" ".join(b))
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append(len(texts))
        texts += [a, b]
    texts += [common + words(50) for _ in range(5700)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string")
    got = {r.row: r.group for r in near_groups(rows).collect()}
    assert sum(got[i + 1] == i for i in pairs) >= 0.95 * len(pairs) > 140
    assert all(got[i] == i for i in range(300, len(texts)))


def test_long_buckets_are_worked_on_in_runs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 100)
    base = [f"w{i}" for i in range(200)]
    rows = spark.createDataFrame([(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(200)] + [(200, "else")], "row long, text string")
    got = {r.row: r.group for r in near_groups(rows).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 200: 200}


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**10])
def test_plan_keeps_the_chance_to_meet(n):
    bits, samples = plan(n)
    agree = (1 - np.arccos(2 * 0.8 / 1.8) / np.pi) ** bits
    assert 1 - (1 - agree) ** samples >= 0.98 and samples < 700


def test_fingerprint_distance_tells_similarity():
    known = _Hashed()
    a, b = "".join(f"w{i} " for i in range(500)), "".join(f"w{i} " for i in range(490)) + "x y z"
    fps = [wide_fingerprint(shingle_set(t, 5, known)) for t in (a, b, b[100:])]
    apart = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert apart(fps[0], fps[0]) == 0 and apart(fps[0], fps[1]) < 30
    assert not wide_fingerprint(shingle_set(" \n", 5, known)).any()
    assert [set(x.tolist()) for x in proposals(np.array(fps[:2]), np.array([7, 3]), 0.8)] == [{7}, {3}]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_one_row_of_each_group(spark, monkeypatch, broadcast):
    monkeypatch.setattr(near_dedup, "BROADCAST_DROPS", broadcast)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", broadcast)
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, a), (2, a), (3, b), (4, b), (1, b), (5, "one two"), (7, "Three  four"), (7, "three four"), (None, "five"), (None, "five"), (None, None), (9, ""), (8, " \n"), (6, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row_0 string, group long")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (1, b), (5, "one two"), (7, "Three  four"), (None, "five"), (None, None), (8, " \n"), (6, rows[-1][1])]
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    assert one_of_each(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [{"NEAREST": 1, "RUN": 8, "OVERLAP": 1}, {"HOT": 50, "RUN": 4096}])
def test_no_link_is_left_out_where_buckets_are_crowded(spark, monkeypatch, limits):
    """Unlike texts with one long passage in common fill all buckets, and a chain leads through each of a few families."""
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    common, texts = words(170), []
    for _ in range(20):
        own = words(50)
        for i in range(6):
            texts.append(" ".join(common + words(3 * i) + own[3 * i :]))
    texts += [" ".join(common + words(50)) for _ in range(180)]
    want, links = brute_groups(dict(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert {r.row: r.group for r in near_groups(rows).collect()} == want and links >= 100


def test_proposals_within_a_group_are_not_settled_again(spark, monkeypatch):
    settled, linked = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda proposed, *more: settled.append(proposed.count()) or linked(proposed, *more))
    family = [" ".join("other" if k == i + 7 else f"w{k}" for k in range(200)) for i in range(120)]
    rows = spark.createDataFrame(list(enumerate(family)), "row long, text string")
    assert {r.group for r in near_groups(rows).collect()} == {0}
    assert sum(settled) < 2 * len(family)  # over four for each document, were all proposals settled
