import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textloom import shared
from textloom.functions import html, ocr, tables
from textloom.functions import queries as Q
from textloom.functions import text as T
from textloom.operators import corpus, crawl, retrieve
from textloom.plans import catalog, chat
from textloom.plans import exchange as E
from textloom.sources import readers, sinks
from tests.test_functions import values

SF = "/root/testdata/sf0.001"


def test_tables_keep_the_line_end_that_follows():
    assert tables.tables_in("x\n| a | b |\n| 1 | 2 |\nend") == "x\na: 1, b: 2\n\nend"
    assert tables.tables_in("| a |\n | 1 |") == "a: 1\n" and tables.tables_in("a | b\n| c |\n\n| d |\n") == "a | b\n| c |\n\n| d |\n"
    assert [tables.score_of(x) for x in ("25,5", "–", "X", "20.1<=3", "1234", "abc", "TTNV")] == ["25.5", "-", "-", "20.1", "1234", "abc", "TTNV"]


def test_header_blocks_follow_the_steps(spark):
    df = spark.createDataFrame([("a/x.md", "s", ["b", "a"], None, "h", "ok", "body \n\n", "t", "u"), ("a/y.md", "s", [], 2020, "h", "dup", "", "t", "u")], "path string, school string, tags array<string>, year int, hash string, status string, content string, title string, url string")
    text = lambda *steps: [r.value for r in corpus.normalized_file(df, steps).collect()]
    meta = "[META]\nschool: s\ntags: b,a\nyear: \nhash: h\n\n"
    assert text("meta", "dedup") == ["[TITLE]\nt\n\n[URL]\nu\n\n" + meta + "---\n\nbody\n"]
    assert text("metadata") == [meta + "---\n\nbody\n"] and text("tables") == ["body\n"]


def test_score_table(spark):
    one = values(spark, ["7480201"], ocr.markdown_rows(F.array(F.struct(F.col("t").alias("code"), F.array_repeat(F.lit("-"), 9).alias("scores"))), "Title"))[0]
    assert one.splitlines()[:2] == ["", "## Title"] and one.splitlines()[3].startswith("| Ngành | Mã ngành |") and one.endswith("\n|  | 7480201 |" + " - |" * 9)
    assert values(spark, ["x"], ocr.generic_table(F.array(F.array(F.lit(" "), F.lit("only"))))) == ["only"]
    assert values(spark, ["x"], ocr.generic_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))))) == ["a | b\nc"]


def test_pictures_are_made_ready():
    rng = np.random.default_rng(2)
    flat = np.full((3, 2, 1), 77, np.uint8)
    assert (ocr.ready(flat) == 77).all() and ocr.ready(flat).shape == (6, 4)
    colors = rng.integers(100, 140, (20, 30, 3)).astype(np.uint8)
    gray = np.round(colors @ np.array([0.114, 0.587, 0.299]))
    strong = np.clip(2 * gray - round(gray.mean()), 0, 255)
    got = ocr.ready(colors).astype(float)
    assert got.shape == (40, 60) and abs(got.mean() - strong.mean()) < 1
    middle = got.reshape(20, 2, 30, 2).mean((1, 3))  # four new pixels stand for an old one
    assert np.corrcoef(middle.ravel(), strong.ravel())[0, 1] > 0.95


def test_bare_letters(spark):
    said = ["Trường ĐẠI học", "Trường".encode().decode() + " ñ É", "ệ ệ", "aaa\n\n\nbbb", None, ""]
    assert values(spark, said, Q.squash("t")) == ["truong dai hoc", "truong n e", "e e", "a b", None, ""]


def test_deep_pages_and_pieces_of_text():
    deep = "<div>" * 5000 + "end" + "</div>" * 5000
    assert html.to_text(deep, "http://h/") == ("end", "")
    spaced = "<article>" + "<p> x </p>\n" * 100 + "</article><p>outside</p>"
    assert "outside" in html.to_text(spaced, "http://h/")[0]  # 100 characters without the blanks between them
    assert "outside" not in html.to_text(spaced.replace(" x ", " xy "), "http://h/")[0]


class _Words(HTMLParser):
    """The words of a page without what is never shown."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words, self.length = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in (*html.d.HIDDEN_ELEMENTS, "title"):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += re.findall(r"\w+", data)
            self.length += len(data.strip())


def test_page_texts_have_the_words_of_their_articles(spark):
    got = {r.page_id: r for r in catalog.QUERIES["html_text"](spark, SF).collect()}
    for r in shared.table(spark, SF, "pages").collect():
        body, reader = re.search("(?s)<article>(.*?)</article>", r.html), _Words()
        reader.feed(body[1] if body else r.html)
        if reader.length <= 150:
            reader = _Words()
            reader.feed(r.html)
        assert re.findall(r"\w+", re.sub(r"\]\([^)]*\)", "]", got[r.page_id].text)) == reader.words


def test_question_boost_against_plain_loops(spark):
    from textloom.functions.fuzzy import partial_ratio

    asked = "the anhaat edonor"
    texts = {r.pos: r.content for r in E._fused(spark, SF).collect()}
    like = lambda s: len(s) >= 5 and bool(s.strip()) and (asked in s.lower() or s.lower() in asked or partial_ratio(asked, s.lower()) >= 75)
    want = {p: any(map(like, re.split(r"(?<=[.!?])\s+", t))) for p, t in texts.items()}
    assert {r.pos: r.boosted for r in catalog.QUERIES["question_boost"](spark, SF).collect()} == want


def test_program_by_likeness_where_no_keyword_stands(spark):
    assert chat.read_question(spark, "học phí ngành cong nghe thong tn ptit").program != ""
    assert chat.read_question(spark, "học phí CNTT").program == "Công nghệ thông tin"


def test_files_stay_in_their_folder(spark, tmp_path):
    for path in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="leads out"):
            sinks.write_texts(spark.createDataFrame([(path, "v")], "path string, value string"), str(tmp_path / "out"))
    assert sinks.write_texts(spark.createDataFrame([("a b/ü.md", "ü"), ("c", None)], "path string, value string"), str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a b/ü.md").read_text() == "ü" and (tmp_path / "out/c").read_text() == ""


def test_lines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\r\n", "a\rb\x0bc\x85", None]
    assert values(spark, texts, T.split_lines("t")) == [t if t is None else t.splitlines() for t in texts]


def test_sitemaps_and_links(spark):
    assert values(spark, ["Sitemap: http://h/a\nx\nsitemap:http://h/b \n"], crawl.robots_sitemaps("t")) == [["http://h/b", "http://h/a"]]
    assert values(spark, ["<a", "<urlset><loc> x </loc></urlset>", None], crawl.locations("t")) == [[], ["x"], []]
    assert values(spark, ["https://h.vn/a b/"], crawl.slug("t")) == ["h_vn__a_b"]


def test_scratch_tables_are_deleted(spark):
    with shared.scratch():
        kept = shared.stored(spark.range(3), "n")
        assert kept.count() == 3
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(kept.stored_at).count()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: {"spark.master": "yarn"}.get(name, default))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_overfetch_cuts_after_the_filters(spark):
    docs = spark.createDataFrame([(i, "s" if i >= 8 else "t", ["a"], 2024, [1.0, i / 10]) for i in range(12)], "id int, school string, tags array<string>, year int, embedding array<float>")
    assert [r.id for r in retrieve.overfetched(docs, [1.0, 0.0], "id", limit=2, school="s").collect()] == [8, 9]


def test_prompts_without_sources_or_history(spark):
    docs = spark.createDataFrame([(2, "b", None, None), (1, "a", "", "http://x"), (3, "c", "T", "")], "pos int, enriched string, source_title string, source_url string")
    text = retrieve.prompt(docs, "q?", layout="{history}|{context}|{sources}|{question}|{note}").first().prompt
    assert text == "(none)|[Nguồn 1]\na\n\n---\n\n[Nguồn 2]\nb\n\n---\n\n[Nguồn 3]\nc|- [Nguồn 1]: Nguồn (http://x)\n- [Nguồn 3]: T|q?|"
    none = retrieve.prompt(docs.limit(0), "q?", [("user", "hi"), ("bot", "yes")], layout="{history}|{context}|{sources}").first().prompt
    assert none == "Người dùng: hi\nTrợ lý: yes||(none)"


def test_pictures_stand_in_their_pages(spark):
    pages = spark.createDataFrame([("http://h/a", "<img src='x.png'>t<img data-src=\"/y.png\"><img>"), ("http://h/b", None), ("http://h/c", "<img src='x.png'>")], "url string, html string")
    texts = spark.createDataFrame([("http://h/a", "http://h/x.png", "1 < 2"), ("http://h/a", "http://h/y.png", "two\nlines"), ("http://h/b", "http://h/x.png", "z")], "url string, picture string, text string")
    got = {r.url: r.html for r in crawl.pictures_in_pages(pages, texts).collect()}
    assert got == {"http://h/a": "<p>1 &lt; 2</p>t<p>two\nlines</p><img>", "http://h/b": None, "http://h/c": "<img src='x.png'>"}


def test_files_are_listed_by_executors(spark, tmp_path):
    odd = {"a.md": b"x\r\ny\n", "b.txt": b"", "c.json": b"{}", ".d.md": b"x", "_e.md": b"x", "_f=1.md": b"x", "g +%20 é.md": b"\xef\xbb\xbfx", "h.md": "é\n".encode(), "i.MD": b"x", "in/k.md": b"deep", "in/n/n/l.txt": b"deeper", "in/_n/m.md": b"x", "in/__pycache__/o.md": b"x", ".in/p.md": b"x", "in.md/q.md": b"x", "k=1/r.md": b"x"}
    for name, value in odd.items():
        at = tmp_path / "in+put" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(value)
    (tmp_path / "none").mkdir()
    for pattern in ("*.{md,txt}", "*.md", "a.md", "?.md", "[a-h].{md,txt}", "none.md"):
        for root in (tmp_path / "in+put", f"file://{tmp_path}/in+put/", tmp_path / "none"):
            rows = readers.text_files(spark, str(root), pattern)
            assert rows.inputFiles() == []  # no record of each file in the driver
            want = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(str(root), wholetext=True)
            want = want.where("_metadata.file_path not like '%__pycache__%'").select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))), F.hex("value"))
            want = sorted(map(tuple, want.collect()))
            got = rows.select(F.element_at(F.split("path", "/"), -1), F.hex("value")).collect()
            assert sorted(map(tuple, got)) == want and (want or pattern == "none.md" or "none" in str(root))
    paths = {r.path for r in readers.text_files(spark, str(tmp_path / "in+put")).collect()}
    assert {"a.md", "in/k.md", "in/n/n/l.txt", "in.md/q.md", "k=1/r.md"} <= paths
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.text_files(spark, str(tmp_path / "absent"))
