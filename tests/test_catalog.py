"""Every query runs on the smallest tables and agrees with its SQL where it has one."""

import os

import duckdb
import pytest

from textloom.plans import catalog, exchange, retrieval, tables  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    assert got


def test_messages_are_read_whole(spark, tmp_path):
    from textloom.functions import fuzzy

    lead = "xin chao " * 8
    said = ["xin chao", lead + "hoc phi bao nhieu", "z" * 40 + " cong nghe thong tin", "ok", "q" * 60, "asdf"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names = sorted({v for _, v in fuzzy.d.PROGRAMS})
    got = {r.turn: (r.intent, r.program) for r in catalog.QUERIES["message_intent"](spark, str(tmp_path)).collect()}
    squashed = [r.text for r in sorted(catalog.QUERIES["squash_repeats"](spark, str(tmp_path)).collect(), key=lambda r: r.turn)]
    assert got == {i: (fuzzy.intent_of(s), fuzzy.nearest(t.lower(), names)) for i, (s, t) in enumerate(zip(squashed, said, strict=True))}
    assert got[0][0] == "GREETING" and got[1][0] == "UNKNOWN"


def test_queries_on_open_entities_and_telephone_numbers(spark, tmp_path):
    texts = [(649, "the +1 (171) 555-2028 x"), (1, "2016 und 202024 license"), (2, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "<p>a&&&amp</p> &amp;quot; &copy;")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("clean_html", "detect_tags", "detect_year"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLE_SQL[name])
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name
