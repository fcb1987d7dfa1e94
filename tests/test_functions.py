import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import fuzzy, html, tables
from textloom.functions import links as L
from textloom.functions import queries as Q
from textloom.functions import text as T
from textloom.operators import corpus, crawl, records, retrieve
from textloom.sources import readers, sinks


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in rows.select("i", column).orderBy("i").collect()]


def fold(text, size=800, overlap=400, tail=400):
    out, held, old = [], [], 0
    for line in text.splitlines():
        held.append(line)
        if sum(map(len, held)) >= size:
            out.append("\n".join(held))
            k = next(k for k in range(1, len(held) + 1) if sum(map(len, held[-k:])) >= overlap or k == len(held))
            held, old = held[-k:], k
    if len(held) > old or (held and not out):
        rest = "\n".join(held)
        out = [*out[:-1], out[-1] + "\n" + rest] if out and sum(map(len, held)) <= tail else [*out, rest]
    return out


def test_chunks(spark):
    texts = ["", "one", "x" * 2000, "\n".join("y" * (i * 37 % 300) for i in range(60)), "a\r\nb\x0bc\x85d e\n\n", "z" * 400 + "\n" + "z" * 400 + "\nend", "\n".join(["w" * 100] * 30)]
    assert values(spark, texts, T.chunks("t")) == [fold(t) for t in texts]


def test_cleaning(spark):
    menu = "* [a](b)\n* c\n\n+ d\n- e\n* f\nBody text\n* Facebook\n\nmore"
    assert values(spark, [menu, "* a\n* b\n* c\n* d\nx", "x\n" * 9 + "© Copyright 2024", "© Copyright\n" + "x\n" * 9, None, ""], T.clean_content("t")) == [
        "Body text\nmore", "* a\n* b\n* c\n* d\nx", "\n".join("x" * 9), "© Copyright\n" + "\n".join("x" * 9), None, "",
    ]
    assert values(spark, [menu], F.array_join(T.drop_nav_block(T.split_lines("t")), "\n")) == ["Body text\n* Facebook\n\nmore"]
    assert values(spark, [" <b>x</b> a<=3 \t y​\n\n\n\nz "], T.clean_markup("t")) == ["x</b> a<=3 y\n\nz"]
    assert values(spark, ["&lt;p&gt;&nbsp;&eacute;"], html.unescape("t")) == ["<p> é"]


def test_headers_and_tags(spark):
    texts = ["[Tên]\n[URL: https://h/p]\n\nbody\n", "[URL: http://h]\nbody", "no header", "  [URL: http://h]\nxbody"]
    got = values(spark, texts, T.meta_header("t"))
    assert [tuple(r) for r in got[:3]] == [("body", "https://h/p", "Tên"), ("body", "http://h", ""), ("no header", "", "")]
    assert got[3].url == "http://h" and got[3].content.endswith("xbody") and got[3].content != "xbody"  # cut from the text with its blanks
    assert values(spark, ["Điểm CHUẨN 2024, học phí 2031 2015", "x"], T.detect_tags("t")) == [["2015", "2024", "diem_chuan", "hoc_phi"], []]
    assert values(spark, ["năm 2019 tầm nhìn 2030", "2014 2031", "a2024"], T.detect_year("t")) == [2030, None, None]
    assert values(spark, ["điểm hsa và HSA", "hsa", "điểm HSA (Đánh giá năng lực ĐHQGHN) hsa"], T.expand_acronyms("t")) == ["điểm HSA (Đánh giá năng lực ĐHQGHN) và HSA", "hsa", "điểm HSA (Đánh giá năng lực ĐHQGHN) hsa"]
    assert values(spark, ["ptit_x.md", "plain.txt"], T.school_of_file("t")) == ["ptit", "unknown"]
    whole = "[TITLE]\nT\n\n[URL]\nhttp://u\n\n[META]\nschool: s\ntags: a, 2023, 2040\nyear: \nhash: h\n\n---\n\nbody --- more\n"
    one, two = values(spark, [whole, "plain --- x"], T.chunk_file("t", F.lit("f-2019.md")))
    assert (one.title, one.url, one.school, one.tags, one.year, one.content) == ("T", "http://u", "s", ["a", "2023", "2040"], 2023, "body --- more")
    assert (two.title, two.tags, two.year, two.content) == (None, [], 2019, "plain --- x")


def test_questions(spark):
    assert values(spark, ["Điểm chuẩn ngành CNTT", "ai là", "mai", "pr?"], Q.program_of("t")) == ["Công nghệ thông tin", "Trí tuệ nhân tạo", "", "Quan hệ công chúng"]
    assert values(spark, ["okkkkk  Bạn", "Đường 2000"], Q.squash("t")) == ["ok ban", "duong 20"]
    assert values(spark, ["PTIT", "em chọn Bách Khoa!", "điểm chuẩn ptit", "zzz"], Q.is_school_selection("t")) == [True, True, False, False]
    assert values(spark, ["điểm chuẩn năm 2023 và 2024", "x20234"], Q.query_year("t")) == [2023, None]
    r = values(spark, ["REWRITE: a b\nHYDE: a long enough text", "nothing"], Q.parse_rewrite("t", F.lit("q")))
    assert [tuple(x) for x in r] == [("a b", "a long enough text"), ("q", "q")]
    assert values(spark, ["4, 2 and 5, not 10"], Q.parse_scores("t")) == [[4, 2, 5]]
    assert values(spark, ["Quota exceeded", "403", "?"], Q.error_kind("t")) == ["quota", "key", "connection"]
    assert [fuzzy.intent_of(x) for x in ("xin chao", "ok", "asdf", "hoc phi bao nhieu", "?", "dai hoc nao tot", "?!?!", "co!", "(ok)...")] == ["GREETING", "CONFIRM", "NONSENSE", "UNKNOWN", "NONSENSE", "UNKNOWN", "NONSENSE", "CONFIRM", "CONFIRM"]
    assert fuzzy.ratio("abcd", "abxd") == 75 and fuzzy.partial_ratio("abc", "xxabcxx") == 100 and fuzzy.common("", "a") == 0


def test_links(spark):
    assert values(spark, ["https://H.com/a/b/?q#f", "http://h"], L.normal_url("t")) == ["https://H.com/a/b", "http://h/"]
    assert values(spark, ["http://h/a/b", "http://h/ab", "http://h/a"], L.is_under("t", "/a/")) == [True, False, True]
    page = '<a href="/x/?p">1</a><a class=c href=\'y.PDF#z\'>2</a><a href="#t">3</a><a href="mailto:x">4</a><a href="http://other/q">5</a>'
    assert values(spark, [page], L.page_links(F.lit("http://h/d/e"), "t")) == [["http://h/x"]]
    assert values(spark, [page], L.file_links(F.lit("http://h/d/e"), "t")) == [["http://h/d/y.PDF"]]
    assert values(spark, ["../b"], L.joined(F.lit("http://h/d/e/f"), "t")) == ["http://h/d/b"]
    assert values(spark, ["a b/../ c!"], L.category_path("t")) == ["a_b/c"]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/1 </loc></url></urlset>'
    assert values(spark, [xml], L.sitemap_locs("t")) == [["http://h/1"]]
    assert crawl.flatten({"a": ["http://x", {"b": ["http://y", "no"]}], "c": "http://z"}) == [("http://x", "a"), ("http://y", "a/b")]


def test_tables_and_html():
    assert tables.table_sentences("| | |\n| Mã | Điểm |\n|---|:---:|\n| 1 | x |\n| 2 |\n| 3 | 4 | 5 |") == "Mã: 1, Điểm: không có dữ liệu\nMã: 2, Điểm: \nMã: 3, Điểm: 4; 5"
    assert tables.table_sentences("| a |") == "| a |" and tables.tables_in("x\n| a |\ny") == "x\n| a |\ny"
    assert tables.parse_row(["n", "7480201 7480202", "25,5 -", "TTNV", "20.1<=3"])[1] == {"code": "7480202", "scores": ["-", "-", "-", *["-"] * 6]}
    text, title = html.to_text(f"<title>T</title><nav>menu</nav><article><h1>H</h1><p>{'long ' * 40}<br>x <b>y</b></p><img src='i.png'><ul><li>a<li>b</ul></article><p>out", "http://h/d/")
    assert title == "T" and text.startswith("# H\n\nlong") and "**y**" in text and "http://h/d/i.png" in text and "menu" not in text and "out" not in text


def test_normalize_and_files(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/s_1.md").write_text("[T]\n[URL: http://u/1]\n\nHọc phí 2024\nxem chi tiết\n")
    (tmp_path / "in/a-b").mkdir()
    (tmp_path / "in/a-b/s_2.md").write_text("Học  phí 2024\n")
    (tmp_path / "in/.hidden.md").write_text("x")
    files = readers.text_files(spark, str(tmp_path / "in"))
    got = {r.path: r for r in corpus.normalize(files, root="root").collect()}
    assert set(got) == {"a/s_1.md", "a-b/s_2.md"} and got["a/s_1.md"].tags == ["2024", "a", "hoc_phi", "root"]
    assert got["a/s_1.md"].status == "ok" and got["a-b/s_2.md"].status == "dup" and got["a/s_1.md"].content == "Học phí 2024"
    out = corpus.normalized_file(corpus.normalize(files))
    assert sinks.write_texts(out, str(tmp_path / "out")) == 1
    head = "[TITLE]\nT\n\n[URL]\nhttp://u/1\n\n[META]\nschool: s\ntags: 2024,a,hoc_phi\nyear: 2024\nhash: "
    assert (tmp_path / "out/a/s_1.md").read_text().startswith(head) and (tmp_path / "out/a/s_1.md").read_text().endswith("\n\n---\n\nHọc phí 2024\n")
    (tmp_path / "links").mkdir()
    (tmp_path / "links/l.json").write_text('{"k": ["http://x"]}')
    assert [tuple(r) for r in readers.link_files(spark, str(tmp_path / "links")).collect()] == [("l", "http://x", "k")]
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>")
    assert readers.docx_text(blob.getvalue()) == "hi\n1 | "


def test_records_and_ranks(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s/" if i % 2 else "t", ["a", "b"] if i < 3 else ["a"], 2024, [float(i), 1.0], 1) for i in range(6)], "id int, content string, school string, tags array<string>, year int, embedding array<float>, rank int")
    assert [r.id for r in retrieve.vector_search(retrieve.prefilter(docs, "s", ["a"], 2024), [1.0, 0.0], "id", limit=3, threshold=0.9).collect()] == [5, 3]
    assert [r.id for r in retrieve.vector_search(docs, [1.0, 0.0], "id", limit=4, threshold=None, tags=["b"]).collect()] == [2]
    assert [r.id for r in retrieve.text_search(docs, "TEXT", "id", limit=2).collect()] == [0, 1]
    top = spark.createDataFrame([(i, f"c{i}", i == 3) for i in range(1, 6)], "pos int, content string, is_text_match boolean")
    assert [r.pos for r in retrieve.rerank(top, [1, 5, 2, 1, 3]).collect()] == [2, 5, 3]
    assert [r.pos for r in retrieve.rerank(top.drop("is_text_match"), [1, 2, 1, 1, 1]).collect()] == [2, 1, 3]
    assert retrieve.low_confidence(retrieve.rerank(top, [9])).first()[0] is True
    with pytest.raises(ValueError):
        records.insert(docs, {})
    assert records.insert(docs, {"id": 9, "content": "x"}).count() == 7 and records.page(docs, "id", 2, 4).count() == 2
    made = corpus.embed_backlog(docs.withColumn("embedding", F.when(F.col("id") > 0, F.col("embedding"))), lambda t: F.array(F.length(t).cast("float")))
    assert made.where("id = 0").first().embedding == [len("Năm: 2024\ntext 0")]
    assert [r.id for r in retrieve.dual_search(docs, [1.0, 0.0], [0.0, 1.0], "id", "s", ["a"], "text", 4).collect()][:3] == [1, 3, 5]


def test_open_entities(spark):
    names = ["amp", "copy", "quot"]
    assert values(spark, ["a&&&amp</title>", "&amp;quot; &quot;&copy;&copy", "&lt;&am", None], html.closed_entities("t", names)) == ["a&&&amp</title>", "&quot; \"©&copy", "&lt;&am", None]


def test_nearest_is_that_of_all_stretches():
    names = sorted({v for _, v in fuzzy.d.PROGRAMS})
    texts = ["", "a", "mar", "ket", "xx marketin", "ke toan va bao chi", "Kế toán " * 9, "tin Công nghệ thông", "khoa hoc du lieu " + "z" * 90 + " quan hệ công", "q" * 200]

    def plain(text):
        likes = [(fuzzy.partial_ratio(text, n), n) for n in names]
        return min((-x, n) for x, n in likes)[1] if max(likes)[0] >= 70 else ""

    assert [fuzzy.nearest(x, names) for x in texts] == [plain(x) for x in texts]


def test_python_functions_get_rows_in_small_groups(spark):
    """A pandas function would get thousands of long texts at once."""
    df = spark.range(1).select(F.lit("<p>a</p>").alias("t"), F.array(F.array(F.lit("1234567"))).alias("cells"))
    used = [T.clean_content("t"), T.chunks("t"), html.html_to_text("t", "t"), html.unescape("t"), tables.tables_to_text("t"), tables.table_records("cells"), Q.bare_letters("t"), fuzzy.intent("t"), fuzzy.nearest_program("t")]
    plan = df.select(*used)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_normalized_texts_are_worked_out_once(spark):
    from textloom.operators import corpus

    docs = spark.createDataFrame([("a/x_1.md", "one  text"), ("a/x_2.md", "one text"), ("b/x_3.md", None)], "path string, value string")
    made = corpus.normalize(docs)
    assert "BatchEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.path: r.status for r in made.collect()} == {"a/x_1.md": "ok", "a/x_2.md": "dup", "b/x_3.md": "ok"}


def test_white_space_is_found_without_a_search_of_the_whole_text(spark):
    texts = ["", " ", "\n\x1c  ", "a", " a \x1f b \n", "a\n", "\x85a\r\n\r\n", "a \x00", "​a 　", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", (T.strip("t") == "").alias("none"), T.blank("t").alias("blank"), T.rstrip("t").alias("right"), F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+$", "").alias("want"), T.content_hash("t").alias("hash"), F.md5(F.regexp_replace(T.strip("t"), r"(?U)[\s\x1c-\x1f]+", " ")).alias("whole")).collect()
    assert [(r.blank, r.right, r.hash) for r in rows] == [(r.none, r.want, r.whole) for r in rows]
