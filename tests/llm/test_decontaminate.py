import random
import re
from itertools import combinations

import pytest

from textloom.llm.decontaminate import LEAST, MASKS, WHOLE, WINDOW, anchored_seeds, contaminated, decontaminated, masks_of, seeds
from textloom.shared import table

DOCS = "doc_id long, text string, item_id long, w string"
ITEM = "the quick brown fox jumps over a lazy dog while seven wizards quietly box up five dozen large jugs of bright purple liquor tonight"


def fill(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def docs(spark):
    words = ITEM.split()
    swapped = " ".join("swap" if i % 9 == 4 else w for i, w in enumerate(words))
    texts = [
        f"{fill(50, 'a')} {ITEM} {fill(9, 'b')}",
        f"{fill(5, 'c')} {swapped}",
        f"{ITEM[: len(ITEM) // 3]} {fill(30, 'd')}",
        "",
        None,
        ITEM.upper().replace(" ", " -- "),
        fill(20_000, "e"),
        "short item of only nine words stands right here now",
        " ".join(reversed(words)),
    ]
    return spark.createDataFrame([(i, t, 5, "w") for i, t in enumerate(texts)] + [(0, texts[0], 5, "w"), (None, ITEM, 1, "w")], DOCS)


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short item of only nine words stands right here"), (3, None), (None, ITEM), (1, ITEM)], "item_id long, text string")


def test_passages(spark):
    got = {(r.doc_id, r.item_id, r.shift) for r in contaminated(docs(spark), items(spark)).collect()}
    assert got == {(0, 1, 50), (1, 1, 5), (5, 1, 0), (7, 2, 0)}
    kept = decontaminated(docs(spark), items(spark))
    assert kept.columns == ["doc_id", "text", "item_id", "w"]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 3), (False, 4), (False, 6), (False, 8)]  # the row without an id has the passage as well


def test_empty(spark):
    assert contaminated(docs(spark).limit(0), items(spark)).collect() == []
    assert contaminated(docs(spark), items(spark).limit(0)).collect() == []


@pytest.mark.parametrize("least,window", [(16, 20)])
def test_against_every_shift(spark, least, window):
    d, b = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    words = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    want = set()
    for item in b.collect():
        x = words(item.text)
        for doc in d.collect():
            y = words(doc.text)
            where = {}
            for j, w in enumerate(y):
                where.setdefault(w, []).append(j)
            shifts = {}
            for i, w in enumerate(x):
                for j in where.get(w, []):
                    shifts.setdefault(j - i, []).append(i)
            for hit in shifts.values():
                if any(sum(s <= i < s + window for i in hit) >= least for s in hit):
                    want.add((doc.doc_id, item.item_id))
    assert {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()} == want and want


def lost(n):
    """Ways to replace as many of ``n`` words as are allowed that leave no mask a seed."""
    picked = [sum(1 << j for j, c in enumerate(m) if c == "1") << k for m in MASKS + masks_of(n, MASKS) for k in range(n - len(m) + 1)]
    ways = [sum(1 << x for x in c) for c in combinations(range(n), n * (WINDOW - LEAST) // WINDOW if n >= WHOLE else 0)]
    return sum(all(w & p for p in picked) for w in ways), len(ways)


def test_masks_lose_no_substitution():
    assert lost(WINDOW) == (0, 4845)
    assert {n: lost(n)[0] for n in range(1, WINDOW) if lost(n)[0]} == {}


@pytest.mark.parametrize("block", [10, 10**6])
def test_short_items_with_words_replaced(spark, block):
    lengths = (3, 10, 11, 12, 15, 16, 17)
    items = spark.createDataFrame([(n, fill(n, f"i{n}w")) for n in lengths], "item_id long, text string")
    rows, want = [], set()
    for n in lengths:
        for k in range(0, 4):
            for way in list(combinations(range(n), k))[:: 1 if k < 3 else 7]:
                if k <= (n * (WINDOW - LEAST) // WINDOW if n >= WHOLE else 0):
                    want.add((len(rows), n))
                rows.append((len(rows), " ".join(["before", *("other" if i in way else w for i, w in enumerate(fill(n, f"i{n}w").split())), "after"])))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items, block=block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_blocks_and_shuffles_agree(spark, block):
    short = spark.createDataFrame([(4, "nine words"), (5, "Only nine -- words STANDS right"), (6, "no such words here"), (7, "... !")], "item_id long, text string")
    both = items(spark).union(short)
    got = {(r.doc_id, r.item_id, r.shift, r.matched) for r in contaminated(docs(spark), both, block=block).collect()}
    assert got == {(0, 1, 50, 24), (1, 1, 5, 21), (5, 1, 0, 24), (7, 2, 0, 9), (7, 4, 4, 2), (7, 5, 3, 5)}
    kept = decontaminated(docs(spark).selectExpr("*", "1 as key", "2 as shift"), both, block=block)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8] and kept.columns == ["doc_id", "text", "item_id", "w", "key", "shift"]


def test_seeds_of_texts_are_made_only_near_what_the_benchmark_has(spark):
    some = random.Random(5)
    text = lambda n: " ".join(some.choice("abcdefghij") for _ in range(n))
    made = {n: text(n) for n in (1, 2, 5, 10, 12, 15, 16, 30)}
    items = spark.createDataFrame([*made.items()], "item_id long, text string")
    texts = [(i, f"{text(i % 7)} {made[[*made][i % 8]][i // 16 :]} {text(i % 5)}") for i in range(200)] + [(200, fill(5_000, "v")), (201, "")]
    for few, least in (([1, 2, 5, 10, 12, 15, 16], 1), ([10, 12, 15, 16], 3)):
        held = items.where(items.item_id.isin([*few, 30]))
        there = spark.createDataFrame(texts, "key long, text string")
        known = seeds(held, "item_id", "text", MASKS, few, items=True).select("seed").distinct()
        rows = lambda made: sorted(map(tuple, made.join(known, "seed").select("key", "seed", "at").collect()))
        got = anchored_seeds(there, held, MASKS, few, 10**6)
        assert rows(got) == rows(seeds(there, "key", "text", MASKS, few)) != []
        assert got.where("key >= 200").isEmpty() and anchored_seeds(there, held, MASKS, few, least) is None
