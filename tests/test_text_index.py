import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import text_index as ti
from textloom.shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit 120").fetchall()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return ti.build(table(spark, SF, "documents"), "doc_id", f"file://{tmp_path_factory.mktemp('text')}/index")


def made(r, texts):
    """A pattern of pieces of a text, with classes, choices, repeats and wildcards among them."""
    t = r.choice([t for t in texts if len(t) > 60])
    out = []
    for _ in range(r.randrange(1, 4)):
        at = r.randrange(len(t) - 12)
        bit = re.escape(t[at : at + r.randrange(1, 9)]).replace("\\\n", "\\n")
        form = r.randrange(9)
        other = re.escape(r.choice(texts)[:4] or "x").replace("\\\n", "\\n")
        out.append([bit, f"({bit}|{other})", f"(?:{bit})+", f"(?:{bit})?", f"(?:{bit}){{1,3}}", f"[{re.escape(t[at])}xyz]{bit}", f"{bit}.*", rf"{bit}\s*", rf"\b{bit}"][form])
    return "".join(out)


def test_plans_of_a_thousand_random_patterns_lose_no_match(texts):
    r, fold = random.Random(8), ti.Folder()
    grams = [ti.trigrams(fold(t)) for t in texts]
    planned = matched = 0
    for _ in range(1000):
        pattern = made(r, texts)
        plan = ti.eased(ti.required(pattern))
        planned += plan is not True
        for t, g in zip(texts, grams, strict=True):
            if re.search(pattern, t, re.I):
                matched += 1
                assert ti.holds(plan, g), pattern
    assert planned > 500 and matched > 1000


def test_plans():
    need = ti.required
    assert need("abcd") == ("and", "abc", "bcd") and need("ABC") == "abc" and need("ab") is True and need("") is True
    assert need("abc|xyz") == ("or", "abc", "xyz") and need("abc|x") is True and need("a.bc") is True
    assert need("(ab|cd)e") == ("or", "abe", "cde") and need("ab[cd]") == ("or", "abc", "abd")
    assert need("(abc)+d") == ("and", "abc", ("and", "abc", "bcd")) or ti.holds(need("(abc)+d"), {"abc", "bcd"})
    assert need("abc(?=q)def") == ("and", "abc", "bcd", "cde", "def") and need("ſtraſſe") == need("strasse")
    for odd in (r"\Qabc\E", "[a-z&&[^b]]abc", r"(?x)a b c", r"\p{L}abc", r"(abc)\1def", "abc(", r"\b{g}abc"):
        assert need(odd) is True
    assert len(ti.asked(ti.eased(need("a" * 10 + "".join(map(chr, range(97, 123))) * 9)))) <= ti.ASKED


@given(st.lists(st.integers(0, 4095), max_size=4000, unique=True), st.sampled_from([4096, 4100, 65_000]))
def test_postings_are_exact(places, size):
    places = np.array(sorted(places), np.int64)
    data = ti.packed(places, size)
    assert np.flatnonzero(ti.unpacked(data, size)).tolist() == places.tolist() and len(data) <= size // 8 + 2


@pytest.mark.parametrize("pattern", ["mit license", "rights.*reserved", "THE (ed|on)t?", "ÉAU", "[0-9]{5}", "zzzzqqq", r"(?:on|er){3}\w", "abc|d"])
def test_searches_equal_scans(spark, index, pattern):
    want = sorted(r.doc_id for r in table(spark, SF, "documents").where(F.col("text").rlike(f"(?iu){pattern}")).collect())
    assert sorted(r.key for r in ti.search(index, pattern).collect()) == want


def test_few_postings_and_texts_are_read(index):
    read = ti.measured(index, "mit license")
    assert 0 < read["grams"] <= 9 and read["texts"] < read["of"] / 4 and read["postings"] <= read["grams"] * 4
    assert ti.measured(index, "a.b")["texts"] == read["of"]


def test_odd_rows_and_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK", 8)
    rows = [(i, f"text number {i} İstanbul") for i in range(60)] + [(7, "text number 7 İstanbul")] * 40 + [(None, "number 7"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ti.build(df, "doc_id", f"file://{tmp_path}/index")
    index = ti.open_index(spark, f"file://{tmp_path}/index")
    assert index.folders > 4 and index.texts().count() == len(rows)
    assert sorted(str(r.key) for r in ti.search(index, "number 7").collect()) == ["7"] * 41 + ["None"]
    assert ti.search(index, "istanbul").count() == 100 == df.where(F.col("text").rlike("(?iu)istanbul")).count()
    empty = ti.build(df.limit(0), "doc_id", f"file://{tmp_path}/empty")
    assert ti.search(empty, "number").collect() == [] and ti.search(empty, ".").collect() == []


@given(st.lists(st.text(alphabet="abé\U0001f600İ ", max_size=12), max_size=8))
def test_postings_are_those_of_each_trigram(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([3] * len(texts), pa.int64()), pa.array(texts, pa.string())], ["block", "text"])
    fold, want = ti.Folder(), {}
    for i, t in enumerate(texts):
        for g in ti.trigrams(fold(t)):
            want.setdefault(g, []).append(i)
    got = [r for b in ti._postings(iter([batch])) for r in b.to_pylist()]
    assert [r["gram"] for r in got] == sorted(want)
    assert all(np.flatnonzero(ti.unpacked(r["data"], r["size"])).tolist() == want[r["gram"]] and (r["block"], r["size"]) == (3, len(texts)) for r in got)
