import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import dictionaries as d
from textloom.functions import queries as Q
from textloom.functions.text import detect_tags
from textloom.operators import lookup


def plain(texts, phrases):
    """Every phrase against every text."""
    out = {}
    for k, t in texts:
        t = (t or "").lower()
        hits = []
        for p, v, o in phrases:
            p = p.lower()
            at = t.find(p)
            while p and at >= 0:
                if len(p) > 3 or lookup.whole(t, at, at + len(p)):
                    hits.append((o, v, p))
                    break
                at = t.find(p, at + 1)
        out[k] = hits
    return out


def frames(spark, texts, phrases):
    return spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(phrases, "phrase string, value string, ord long")


def test_equal_to_the_chain_of_conditions(spark):
    r = random.Random(3)
    words = [w for w, _ in d.PROGRAMS] + ["ngành", "AI?", "aix", "pr.", "iot,", "Kế Toán", "xai", "CNTT2", "thông", "tin", "éai", "_ai"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 6)))) for i in range(300)] + [(300, None)]
    docs = spark.createDataFrame(texts, "k long, text string")
    got = {x.k: x.value for x in lookup.first_match(docs, "k", "text", lookup.dictionary(spark, d.PROGRAMS)).collect()}
    want = {x.k: x.v for x in docs.select("k", Q.program_of(F.coalesce("text", F.lit(""))).alias("v")).collect()}
    assert got == want and len(set(got.values())) > 8


def test_tags_equal_the_rules(spark):
    r = random.Random(4)
    words = [w for _, ws in d.DOCUMENT_TAGS for w in ws] + ["điểm", "xét", "chuẩn", "HỌC PHÍ"]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 5)))) for i in range(200)], "k long, text string")
    got = {x.k: x.tags for x in lookup.tags(docs, "k", "text", lookup.dictionary(spark, d.DOCUMENT_TAGS)).collect()}
    want = {x.k: x.tags for x in docs.select("k", detect_tags("text", d.DOCUMENT_TAGS).alias("tags")).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_a_hundred_thousand_phrases(spark):
    r = random.Random(5)
    part = lambda: "".join(r.choice("abcdeé ") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 20, 33, 70])))
    texts = [(i, "".join(r.choice("abcdeÉ ") for _ in range(r.randrange(0, 400)))) for i in range(60)]
    phrases = [(part(), f"v{i % 900}", i) for i in range(99_000)]
    phrases += [(t[a : a + n], f"w{i}", 99_000 + i) for i, (_, t) in enumerate(texts) for n in (6, 17, 40, 90) for a in [r.randrange(max(len(t) - n, 1))] if len(t) > n]
    docs, known = frames(spark, texts, phrases)
    got, first = {k: set() for k, _ in texts}, plain(texts, phrases)
    for x in lookup.found(docs, "k", "text", known).collect():
        got[x.key].add((x.ord, x.value, x.phrase))
    lowest = {}
    for p, v, o in phrases:
        lowest[p.lower()] = min(lowest.get(p.lower(), (o, v)), (o, v))
    assert got == {k: {(*lowest[p], p) for _, _, p in hits} for k, hits in first.items()}
    values = {x.k: x.value for x in lookup.first_match(docs, "k", "text", known).collect()}
    assert values == {k: min(hits, default=(0, ""))[1] for k, hits in first.items()}


@pytest.mark.parametrize("salts", [1, 8])
def test_hot_phrases_and_odd_rows(spark, monkeypatch, salts):
    monkeypatch.setattr(lookup, "SALTS", salts)
    texts = [(i, "common words here") for i in range(500)] + [(500, None), (501, ""), (None, "common")]
    docs, known = frames(spark, texts, [("common", "a", 5), ("COMMON", "b", 2), ("", "e", 0), (None, "n", 0), ("here", None, 0), ("words here", "c", 9)])
    rows = lookup.first_match(docs, "k", "text", known).collect()
    assert len(rows) == 503 and sum(r.value == "b" for r in rows) == 500
    assert lookup.found(docs.limit(0), "k", "text", known).collect() == [] == lookup.found(docs, "k", "text", known.limit(0)).collect()


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("phrase")).withColumn("value", F.col("phrase"))
    rows = lookup.numbered(df, "phrase").collect()
    assert [r.phrase for r in sorted(rows, key=lambda r: r.ord)] == sorted(r.phrase for r in rows) and sorted(r.ord for r in rows) == list(range(1000))
