import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, f long, n int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, absorb, top):
    """Every stretch of words counted in a dictionary."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k) > 2}
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        if any(len(k) > len(w) + 1 and k[0] == lang and 100 * b >= absorb * a and any(list(k[i : i + len(w)]) == w for i in range(1, len(k) - len(w) + 1)) for k, b in found.items()):
            continue
        cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, (left, right) = min((1_000_000 * a * a // (x * y), k, (x, y)) for k, (x, y) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOCS) if rows else spark.createDataFrame([], DOCS)
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


def made(seed, docs, words):
    r = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\r\n", "? "]
    text = lambda: "".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(0, 60)))
    return [(i, text(), r.choice(["en", "fr", None, "und"]), "x", 1, 2) for i in range(docs)]


@pytest.mark.parametrize("longest,absorb,top", [(3, 50, 2000), (4, 30, 7), (2, 50, 3)])
def test_against_plain_counts(spark, longest, absorb, top):
    rows = made(longest, 60, ["a", "A", "b", "c", "Éa", "éa", "d\x00", " ", "don't"])
    rows += [(None, None, "en", None, None, None), (1, "", None, "", 0, 0), (1, "a b " * 3000, "en", "", 0, 0), (1, "a b " * 3000, "en", "", 0, 0)]
    assert mined(spark, rows, longest=longest, absorb=absorb, top=top) == plain(rows, 10, longest, absorb, top)


def test_pieces_shards_and_blocks(spark, monkeypatch):
    """Tiny shards and bundles, and texts longer than a shard: the same counts."""
    rows = made(9, 50, ["x", "y", "zz", "w" * 40]) + [(1, "x y zz. " * 900, "en", "", 0, 0)]
    want = plain(rows, 10, 3, 50, 2000)
    for name, value in (("SHARD", 300), ("BUNDLE", 8), ("RANGE", 64)):
        monkeypatch.setattr(phrases, name, value)
    assert mined(spark, rows) == want


def test_empty_and_rare(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, "a b " * 9, "en", "", 0, 0), (2, None, None, "", 0, 0)]) == []
    assert [r[2:6] for r in mined(spark, [(1, "a b. " * 10, "en", "", 0, 0)])] == [("a b", 10, 10, 10)]


def test_a_common_word_in_all_rows(spark):
    rows = [(i, "the " * 40 + f"the w{i % 7} x", "en", "", 0, 0) for i in range(300)]
    assert mined(spark, rows) == plain(rows, 10, 3, 50, 2000)


def test_scores_are_exact(spark):
    a, left, right = 987_654_321_098_765, 987_654_321_098_766, 999_999_999_999_999
    df = spark.createDataFrame([(a, left, right), (10, 10, 10)], "a long, l long, r long")
    assert [r.s for r in df.select(phrases._score().alias("s")).collect()] == [1_000_000 * a * a // (left * right), 1_000_000]
    assert Decimal(a) * a > 2**64


def test_a_filter_that_passes_all_changes_nothing(spark, monkeypatch):
    rows = made(3, 40, ["a", "b", "c"])
    want = plain(rows, 10, 3, 50, 2000)
    monkeypatch.setattr(phrases, "_filter", lambda *_: np.full(phrases.FILTER // 64, ~np.uint64(0)))
    assert mined(spark, rows) == want


def test_counts_are_of_all_documents(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("p q").alias("text"), F.lit("en").alias("lang"))
    assert [(r.phrase, r.a, r.n) for r in phrases.collocations(df).collect()] == [("p q", 1000, 2000)]


def test_ranks_over_many_deals(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i % 40} v{i % 30}." for _ in range(12)) + f" w{i % 40} u{i % 50} " * 12, ["en", "fr"][i % 7 > 0], "", 0, 0) for i in range(600)]
    monkeypatch.setattr(phrases, "DEAL", 5)
    assert mined(spark, rows, top=4) == plain(rows, 10, 3, 50, 4)
