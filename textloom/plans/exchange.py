"""Named queries on what goes in and out: files, fetched pages, states, edits; with the SQL that they agree with.

Fetches, pictures and models are columns of the caller's; here they are made up from the tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from textloom.functions import dictionaries as d
from textloom.functions import links as L
from textloom.functions import ocr
from textloom.functions import queries as Q
from textloom.functions import text as T
from textloom.functions.tables import table_to_text
from textloom.operators import corpus, crawl, records, retrieve, sessions
from textloom.plans import chat
from textloom.plans.catalog import _HASH, _NEAREST, _fused, _FUSED, _listed, _vector, query
from textloom.shared import shared_path, table
from textloom.sources import readers, sinks

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _files(spark, sf_dir):
    path = F.concat("lang", F.lit("/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("value"), "doc_id")


@query(f"select lang || '/' || source || '_' || doc_id || '.md' as path, md5('[META]' || chr(10) || 'school: ' || source || chr(10) || 'tags: ' || lang || chr(10) || 'year: ' || chr(10) || 'hash: ' || {_HASH} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(text, '\\s+$', '') || chr(10)) as body from documents where {_STRIP.format('text')} <> ''")
def written_files(spark, sf_dir):
    """Normalized files, one for each document in its own folder, read back."""
    docs = _files(spark, sf_dir).where(~T.blank("value"))
    school, tags = T.school_of_file(F.element_at(F.split("path", "/"), -1)), F.array(F.split_part("path", F.lit("/"), F.lit(1)))
    made = docs.select("path", school.alias("school"), tags.alias("tags"), F.lit(None).cast("int").alias("year"), T.content_hash("value").alias("hash"), F.lit("ok").alias("status"), F.col("value").alias("content"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    root = shared_path(spark, "files")
    sinks.write_texts(corpus.normalized_file(made, steps=("dedup",)), root)
    return readers.text_files(spark, root).select("path", F.md5("value").alias("body"))


@query("select true as found, count(*) as n, 0 as err from documents where doc_id = 1 union all select false, 0, 1")
def one_file(spark, sf_dir):
    root = shared_path(spark, "one")
    sinks.write_texts(_files(spark, sf_dir).where("doc_id = 1").select(F.lit("a/b.md").alias("path"), "value"), root)
    reports = []
    for name in ("a/b.md", "a/none.md"):
        rows, report = readers.one_file(spark, root, name)
        reports.append((report["ok"], rows.count(), report["stats"]["err"]))
    return spark.createDataFrame(reports, "found boolean, n long, err int")


@query("select lang as folder, count(*) as files from documents group by all")
def folder_counts(spark, sf_dir):
    return corpus.folder_counts(_files(spark, sf_dir))


@query("select doc_id, case lang when 'root' then 'root' else array_to_string(list_sort(['root', lang]), ',') end as tags from documents")
def folder_tags(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", F.array_join(T.folder_tags(F.lit("root"), "path"), ",").alias("tags"))


_DATED = "case when doc_id % 3 = 0 then 2021 when doc_id % 3 = 1 then 2023 else 2019 end"


@query(f"select doc_id, 'T ' || doc_id as title, 'http://u/' || doc_id as url, source as school, case when doc_id % 3 = 1 then 'a,2023' else 'a' end as tags, {_DATED}::int as year, {_STRIP.format('text')} as content from documents")
def chunk_metadata(spark, sf_dir):
    year, tags = F.when(F.col("doc_id") % 3 == 0, "2021").otherwise(""), F.when(F.col("doc_id") % 3 == 1, "a, 2023").otherwise("a")
    head = F.concat(F.lit("[TITLE]\nT "), "doc_id", F.lit("\n\n[URL]\nhttp://u/"), "doc_id", F.lit("\n\n[META]\nschool: "), "source", F.lit("\ntags: "), tags, F.lit("\nyear: "), year, F.lit("\nhash: h\n\n---\n\n"))
    made = table(spark, sf_dir, "documents").select("doc_id", T.chunk_file(F.concat(head, "text"), F.lit("f-2019.md")).alias("m"))
    return made.select("doc_id", "m.title", "m.url", "m.school", F.array_join("m.tags", ",").alias("tags"), "m.year", "m.content")


_STATE = f"select {_HASH} as hash, 'kept.md' as owner from documents where doc_id % 5 = 0 group by all"


@query(f"with s as ({_STATE}), h as (select doc_id, {_HASH} as hash from documents) select doc_id, case when owner is not null then 'dup' when doc_id = min(doc_id) over (partition by h.hash) then 'ok' else 'dup' end as status from h left join s using (hash)")
def dedup_with_state(spark, sf_dir):
    """Texts that a written state names belong to another file, whatever comes first here."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file")), shared_path(spark, "state")
    schema = "hash string, owner_filename string"
    assert readers.read_state(spark, at, schema).isEmpty()
    sinks.write_state(docs.where("doc_id % 5 = 0").select(T.content_hash("text").alias("hash"), F.lit("kept.md").alias("owner_filename")).distinct(), at)
    return corpus.dedup_by_content(docs, "text", "file", [F.col("doc_id")], readers.read_state(spark, at, schema)).select("doc_id", "status")


@query(f"select hash, min(doc_id)::varchar || '.md' as owner_filename from (select doc_id, {_HASH} as hash from documents) group by hash")
def hash_state(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    return corpus.hash_state(corpus.dedup_by_content(docs, "text", "file", [F.col("doc_id")]))


@query("select page_id, case when page_id % 2 = 0 then 'done' when page_id % 3 = 0 then 'failed' end as status from pages where page_id % 2 = 0 or page_id % 3 = 0")
def crawl_state(spark, sf_dir):
    """A state table written, changed by a later crawl and written in place."""
    pages, at = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key")), shared_path(spark, "crawled")
    sinks.write_state(pages.where("key % 6 = 0 or key % 3 = 0").withColumn("status", F.lit("failed")), at)
    sinks.write_state(crawl.crawled(readers.read_state(spark, at, "key long, status string"), pages.where("key % 2 = 0").withColumn("status", F.lit("done"))), at)
    return readers.read_state(spark, at, "key long, status string").select(F.col("key").alias("page_id"), "status")


@query("select vec_id, label, vec_id % 3 = 0 as embedded, case when vec_id % 2 = 0 then 'second' else 'first' end as load from embeddings union all select -1, null, false, 'third'")
def chunk_table(spark, sf_dir):
    """Rows appended in two loads after the table was cleared, one more inserted, and embeddings merged in by key."""
    at, rows = shared_path(spark, "chunks"), table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    sinks.append(rows.withColumn("load", F.lit("old")), at)
    sinks.replace(rows.where("vec_id % 2 = 1").withColumn("load", F.lit("first")), at)
    sinks.append(rows.where("vec_id % 2 = 0").withColumn("load", F.lit("second")), at)
    whole = records.insert(spark.read.parquet(at), {"vec_id": -1, "content": "new", "load": "third"})
    made = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id", "embedding")
    return records.merge_embeddings(whole, made, "vec_id").select("vec_id", "label", F.col("embedding").isNotNull().alias("embedded"), "load")


@query("select vec_id, case when vec_id % 4 = 0 then list_transform(embedding, lambda x: x)[1]::double else length('Năm: 2024' || chr(10) || 'text ' || vec_id)::double end as first from embeddings")
def embedded_backlog(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.col("embedding")).alias("embedding"), F.lit(2024).alias("year"), F.concat(F.lit("text "), "vec_id").alias("content"))
    return corpus.embed_backlog(rows, lambda t: F.array(F.length(t).cast("float"))).select("vec_id", F.col("embedding")[0].cast("double").alias("first"))


@query("select doc_id, lang, source from documents where doc_id = 17")
def doc_lookup(spark, sf_dir):
    return records.lookup(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 17)


@query("select id, case when try_cast(id as bigint) is null then 400 when doc_id is null then 404 else 200 end as status, source from (values ('17'), ('no id'), ('-5'), ('3')) t(id) left join documents on doc_id = try_cast(id as bigint)")
def doc_found(spark, sf_dir):
    asked = spark.createDataFrame([("17",), ("no id",), ("-5",), ("3",)], "id string")
    return records.found(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", asked).select("id", "status", "row.source")


_SITES = "select 'http://' || source || '.org/a/' as base_url, 'http://' || source || '.org/a/' || (doc_id % 7) as url from documents"


@query(f"select distinct replace(replace(replace(base_url, 'http://', ''), '/a/', '__a'), '.', '_') as source_id, url, 'urls' as category from ({_SITES})")
def link_documents(spark, sf_dir):
    """Found URLs written in three forms; the one for the link reader is read back."""
    docs, root = table(spark, sf_dir, "documents"), shared_path(spark, "links")
    base = F.concat(F.lit("http://"), "source", F.lit(".org/a/"))
    found = docs.select(base.alias("base_url"), F.concat(base, F.col("doc_id") % 7).alias("url"))
    broken = spark.range(1).select(F.lit("links/broken.json").alias("path"), F.lit('{"a": [').alias("value"))
    sinks.write_texts(crawl.link_documents(found).withColumnRenamed("text", "value").union(broken), root)
    return readers.link_files(spark, f"{root}/links")


@query(f"select path, n from (select replace(replace(replace(base_url, 'http://', ''), '/a/', '__a'), '.', '_') as slug, count(distinct url) as n from ({_SITES}) group by all), unnest([slug || '.txt', 'ex_' || slug || '.json']) as p(path)")
def link_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    base = F.concat(F.lit("http://"), "source", F.lit(".org/a/"))
    made = crawl.link_documents(docs.select(base.alias("base_url"), F.concat(base, F.col("doc_id") % 7).alias("url"))).where("path not like 'links/%'")
    n = F.when(F.endswith("path", F.lit(".txt")), F.size(F.split("text", "\n"))).otherwise(F.get_json_object("text", "$.count").cast("int"))
    return made.select("path", n.cast("long").alias("n"))


def _fetch(pages):
    """A made-up network: the body that the table has for a URL, with status 404 for every seventh page."""
    status = F.when(F.col("page_id") % 7 == 0, 404).otherwise(200)
    return lambda url: F.struct(status.alias("status"), F.col("page").alias("body"))


@query("select page_id, case when page_id % 5 = 0 then 'rendered' when page_id % 7 <> 0 then html end as html from pages")
def fetched_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("html", "page")
    rendered = lambda url: F.when(F.col("page_id") % 5 == 0, F.lit("rendered"))
    return crawl.fetched(pages, _fetch(pages), rendered).select("page_id", "html")


@query("select page_id from pages where page_id % 7 <> 0 and page_id % 4 <> 0")
def existing_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crawl.existing(pages, lambda url: F.when(F.col("page_id") % 4 == 0, None).when(F.col("page_id") % 7 == 0, 404).otherwise(301)).select("page_id")


@query("select event_id, event_id * 2 as twice from events where event_id % 7 <> 0 and event_id % 3 <> 0")
def fetched_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("http://h/"), "event_id").alias("url"))
    body = F.when(F.col("event_id") % 3 == 0, "{no json").otherwise(F.concat(F.lit('{"a": {"twice": '), F.col("event_id") * 2, F.lit("}}")))
    got = crawl.fetched_json(rows, lambda url: F.struct(F.when(F.col("event_id") % 7 == 0, 500).otherwise(200).alias("status"), body.alias("body")))
    return got.where("value is not null").select("event_id", F.try_variant_get("value", "$.a.twice", "long").alias("twice"))


@query("select 'http://h/' || doc_id || case when doc_id % 4 = 0 then '.pdf' else '' end as url, case when doc_id % 4 <> 0 and length(t) >= 150 then '[T' || doc_id || ']' || chr(10) || '[URL: http://h/' || doc_id || ']' || chr(10) || chr(10) || t end as text, case when doc_id % 4 <> 0 then 'http://h/f.pdf' else '' end as files from (select doc_id, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'), ' +', ' ', 'g')) as t from documents)")
def page_texts(spark, sf_dir):
    words = F.trim(F.regexp_replace(F.regexp_replace("text", "[^a-zA-Z]", " "), " +", " "))
    url = F.concat(F.lit("http://h/"), "doc_id", F.when(F.col("doc_id") % 4 == 0, ".pdf").otherwise(""))
    html = F.concat(F.lit("<html><title> T"), "doc_id", F.lit(" </title><body><nav>menu<a href='/f.pdf?x=1#y'>f</a></nav><div>"), words, F.lit("</div></body></html>"))
    made = crawl.page_texts(table(spark, sf_dir, "documents").select(url.alias("url"), html.alias("html")))
    return made.select("url", "text", F.array_join("files", ",").alias("files"))


@query("select 'http://h/p/' || n_nationkey as url from nation where n_nationkey < 20 union select 'http://h/p/r' || r_regionkey from region")
def sitemap_urls(spark, sf_dir):
    """A sitemap that robots.txt names, the usual index after it, and its parts; what comes after the index is not read."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    listed = lambda rows, c: F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc(c)), ""), F.lit("</urlset>"))
    named = r.agg(listed(r, F.concat(F.lit("http://h/p/r"), "r_regionkey", F.lit("/?x=1"))).alias("body")).select(F.lit("http://h/robots-map.xml").alias("url"), "body")
    index = n.where("n_nationkey < 2").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(loc(F.concat(F.lit("http://h/part"), "n_nationkey", F.lit(".xml")))), ""), F.lit("</sitemapindex>")).alias("body")).select(F.lit("http://h/sitemap.xml").alias("url"), "body")
    page = F.concat(F.when(F.col("n_nationkey") < 20, "http://h/p/").otherwise("http://h/other/"), F.col("n_nationkey"))
    parts = n.groupBy(F.concat(F.lit("http://h/part"), F.col("n_nationkey") % 2, F.lit(".xml")).alias("url")).agg(listed(n, page).alias("body"))
    late = n.agg(listed(n, F.concat(F.lit("http://h/p/late"), "n_nationkey")).alias("body")).select(F.lit("http://h/sitemap_index.xml").alias("url"), "body")
    broken = spark.range(1).select(F.lit("http://h/wp-sitemap.xml").alias("url"), F.lit("<no xml").alias("body"))
    bodies = named.union(index).union(parts).union(late).union(broken)
    return crawl.sitemap_urls(bodies, "http://h", "/p/", "User-agent: *\nSITEMAP: http://h/none.xml\nSitemap:  http://h/robots-map.xml \n")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _office(kind: str, i: int, word: str) -> bytes:
    """The least that a reader needs of a document or a sheet with two rows."""
    if kind == "docx":
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        return _zipped({"word/document.xml": f"<w:document {ns}><w:body><w:p><w:r><w:t>Page {i}</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell(word)}{cell(i)}</w:tr></w:tbl></w:body></w:document>"})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>{i}</v></c></row><row/><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    return _zipped({"xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S{i}"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {ns}><si><t>{word}</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})


@F.pandas_udf(BinaryType())
def office_file(kind: pd.Series, i: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([_office(k, n, w) if k in ("docx", "xlsx") else b"?" for k, n, w in zip(kind, i, word, strict=True)])


_KIND = "case doc_id % 3 when 0 then 'docx' when 1 then 'xlsx' else 'mp4' end"


@query(f"select 'http://h/' || doc_id || '.' || {_KIND} as url, case doc_id % 3 when 2 then 'video' else {_KIND} end as type, case doc_id % 3 when 0 then 'Page ' || doc_id || chr(10) || lang || ' | ' || doc_id when 1 then '## S' || doc_id || chr(10) || lang || ' | ' || doc_id || chr(10) || 'in' end as text from documents")
def attachments(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("docx"), F.lit("xlsx"), F.lit("mp4")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("http://h/"), "doc_id", F.lit("."), kind).alias("url"), office_file(kind, "doc_id", "lang").alias("content"))
    return readers.attachments(files)


_HEAD = "'| ' || array_to_string(['Ngành', 'Mã ngành', 'THPT', 'ĐGNL/TSA', 'SAT', 'ACT', 'HSA', 'SPT', 'APT', 'Kết hợp', 'TTNV'], ' | ') || ' |' || chr(10) || '|' || repeat('---|', 11)"
_CODE = "lpad((page_id % 1000)::varchar, 7, '7')"


@query(f"select page_id, array_to_string([{_CODE}, '25,5', 'x'], '|') as cells, {_HEAD} || chr(10) || '|  | ' || {_CODE} || ' | 25.5 | - | - | - | - | - | - | - | - |' as table from pages union all select page_id, 'other row', '' from pages")
def ocr_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(ocr.token_rows(_tokens(), F.lit(1000.0))).alias("row")).select("page_id", ocr.merged_cells("row").alias("cells"))
    return rows.withColumn("r", crawl.table_records(F.array("cells"))).select("page_id", F.array_join("cells", "|").alias("cells"), ocr.markdown_rows("r").alias("table"))


@query("select page_id, 4 as height, 6 as width, repeat(printf('%02X', page_id % 256), 24) as pixels from pages")
def prepared_pictures(spark, sf_dir):
    """Pictures of one color each, which neither contrast nor size changes."""
    data = F.unhex(F.repeat(F.lpad(F.hex(F.col("page_id") % 256), 2, "0"), F.lit(18)))
    picture = F.struct(F.lit(2).alias("height"), F.lit(3).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    made = table(spark, sf_dir, "pages").select("page_id", ocr.prepared(picture).alias("p"))
    return made.select("page_id", "p.height", "p.width", F.hex("p.data").alias("pixels"))


def _tokens():
    token = lambda cy, cx, text: F.struct(F.lit(float(cy)).alias("cy"), F.lit(float(cx)).alias("cx"), F.lit(10.0).alias("h"), text.alias("text"))
    code = F.lpad((F.col("page_id") % 1000).cast("string"), 7, "7")
    return F.array(token(100, 10, code), token(104, 100, F.lit("25,5")), token(99, 200, F.lit("x")), token(300, 10, F.lit("other")), token(301, 24, F.lit("row")))


@query(f"select page_id, 'http://h/p/i' || page_id || '.png' as picture, case page_id % 3 when 0 then {_HEAD} || chr(10) || '|  | ' || {_CODE} || ' | 25.5 | - | - | - | - | - | - | - | - |' else '| some longer name | value |' || chr(10) || '|---|---|' || chr(10) || '| row | ' || page_id || ' |' end as text from pages where page_id % 3 <> 2")
def picture_texts(spark, sf_dir):
    """Pictures of pages read by a made-up recognizer: score tables, other tables, and text too short to keep."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h/p/"), "page_id").alias("url"), F.concat(F.lit("<img src='a.svg'><img src='data:x'><img alt='' data-src='i"), "page_id", F.lit(".png'>")).alias("html"))
    found = crawl.page_pictures(pages).withColumn("page_id", F.regexp_extract("picture", r"i(\d+)\.png", 1).cast("long"))
    token = lambda cy, cx, text: F.struct(F.lit(float(cy)).alias("cy"), F.lit(float(cx)).alias("cx"), F.lit(10.0).alias("h"), text.alias("text"))
    other = F.array(token(10, 10, F.lit("some longer name")), token(10, 300, F.lit("value")), token(90, 10, F.lit("row")), token(90, 300, F.col("page_id").cast("string")))
    part = F.col("page_id") % 3
    tokens = F.when(part == 0, _tokens()).when(part == 1, other).otherwise(F.array(token(1, 1, F.lit("short"))))
    read = crawl.picture_texts(found, lambda p: F.struct(F.lit(1000.0).alias("height"), tokens.alias("tokens")), lambda p: F.lit(9000))
    return read.select(F.regexp_extract("picture", r"i(\d+)\.png", 1).cast("long").alias("page_id"), "picture", "text")


@query(f"select page_id, '[' || url || ']' || chr(10) || '[URL: ' || url || ']' || chr(10) || chr(10) || '# ' || url || chr(10) || {_HEAD} || chr(10) || '|  | ' || {_CODE} || ' | 25.5 | - | - | - | - | - | - | - | - |' || chr(10) as text, 1 as rows from pages")
def picture_page(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("cells", F.array(F.array(F.lpad((F.col("page_id") % 1000).cast("string"), 7, "7"), F.lit("25,5"), F.lit("x"))))
    made = rows.select("page_id", ocr.table_page("url", F.lit(""), F.array(ocr.markdown_rows(crawl.table_records("cells")))).alias("p"))
    return made.select("page_id", "p.text", "p.rows")


@query("select doc_id, 'a: ' || lang || ', b: ' || source || chr(10) || 'a: ' || doc_id || ', b: không có dữ liệu' || chr(10) || 'a: 7, b: p; q' as text from documents")
def table_sentences(spark, sf_dir):
    rows = F.concat(F.lit("| | |\n| | a | b |\n|:---:|---|\n| "), "lang", F.lit(" | "), "source", F.lit(" |\n\n| "), "doc_id", F.lit(" | X |\n| 7 | p | q |\n"))
    return table(spark, sf_dir, "documents").select("doc_id", table_to_text(rows).alias("text"))


@query("select doc_id, case when source = '' then 'download' else 'f_' || source || '_.pdf' end as file, source || '/' || case lang when '' then '_' else lang end || '_x' as folder from documents where source <> ''")
def safe_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source <> ''")
    url, category = F.concat(F.lit("http://h/d/f%"), "source", F.lit("@.pdf?x")), F.concat(F.lit("/../"), "source", F.lit("/./"), "lang", F.lit(" $x!"))
    return docs.select("doc_id", L.download_name(url).alias("file"), L.category_path(category).alias("folder"))


@query("select school_id, case school_id when 'zzz' then 'zzz' end is null as known from (values ('ptit'), ('neu'), ('zzz')) t(school_id)")
def school_names(spark, sf_dir):
    asked, names = spark.createDataFrame([("ptit",), ("neu",), ("zzz",)], "school_id string"), chat.schools(spark)
    joined = asked.join(F.broadcast(names), "school_id", "left").withColumn("name", F.coalesce("name", "school_id"))
    return joined.select("school_id", (F.col("name") != F.col("school_id")).alias("known"))


@query("select conv_id, turn, substr(text, 1, 300) as rewrite, case when turn % 2 = 0 then 'a passage ' || turn else substr(text, 1, 300) end as hyde from (select conv_id, turn, regexp_replace(regexp_replace(text, '\\s', ' ', 'g'), '^ +| +$', '', 'g') as text from conversations) where text <> ''")
def rewrite_reply(spark, sf_dir):
    said = T.strip(F.regexp_replace("text", r"\s", " "))
    reply = F.concat(F.lit("REWRITE: "), "said", F.lit("\nHYDE: "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("a passage "), F.col("turn"))).otherwise("short"))
    rows = table(spark, sf_dir, "conversations").withColumn("said", said).where("said <> ''")
    return rows.select("conv_id", "turn", Q.parse_rewrite(reply, F.lit("q")).alias("p")).select("conv_id", "turn", "p.rewrite", "p.hyde")


def _any(words, text: str) -> str:
    return f"len(list_filter({_listed(words)}, lambda w: contains({text}, w))) > 0"


_SAID = "select conv_id, turn, ['Error: QUOTA exceeded ', '403 Forbidden, API key ', ''][turn % 3 + 1] || text as t from conversations"


@query(f"select conv_id, turn, case when {_any(d.QUOTA_ERRORS, 'lower(t)')} then 'quota' when {_any(d.KEY_ERRORS, 'lower(t)')} then 'key' else 'connection' end as kind from ({_SAID})")
def error_kinds(spark, sf_dir):
    said = F.concat(F.element_at(F.array(F.lit("Error: QUOTA exceeded "), F.lit("403 Forbidden, API key "), F.lit("")), (F.col("turn") % 3 + 1).cast("int")), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.error_kind(said).alias("kind"))


_LEADS = [f"{d.SCORE_WORDS[0].title()} ", f"{d.OTHER_YEARS[0]} ", f"{d.SCORE_WORDS[-1]} {d.OTHER_YEARS[-1]} ", ""]


@query(f"""select conv_id, turn, t || case when {_any(d.SCORE_WORDS, 'lower(t)')} then '{d.SCORE_BOOST}' else '' end || case when {_any(d.OTHER_YEARS, 'lower(t)')} then '{d.YEARS_BOOST}' else '' end as boosted
from (select conv_id, turn, {_listed(_LEADS)}[turn % 4 + 1] || text as t from conversations)""")
def boosted_questions(spark, sf_dir):
    asked = F.concat(F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (F.col("turn") % 4 + 1).cast("int")), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.boosted(asked).alias("boosted"))


@query("select conv_id, array_to_string(list(text order by turn)[-3:], '|') as history from conversations where conv_id <> 3 group by conv_id")
def read_history(spark, sf_dir):
    kept = sessions.cleared(table(spark, sf_dir, "conversations"), "conv_id", 3)
    whole = kept.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("h"))
    return whole.select("conv_id", F.array_join(sessions.read_history("h", 3), "|").alias("history"))


@query("select user_id from events group by user_id having epoch(max(ts)) < (select epoch(max(ts)) from events) - 3600")
def expired_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = float(events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).first()[0])
    last = events.groupBy("user_id").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("last_active"))
    return sessions.expired(last, now).select("user_id")


def _tagged(spark, sf_dir):
    tags = F.when(F.col("label") % 2 == 0, F.array(F.lit("a"), F.lit("hoc_phi"))).otherwise(F.array(F.lit("a")))
    school = F.when(F.col("vec_id") % 3 == 0, "s/").when(F.col("vec_id") % 3 == 1, " s").otherwise("t")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", F.col("vec_id").cast("string").alias("content"), school.alias("school"), tags.alias("tags"), (2020 + F.col("vec_id") % 2).cast("int").alias("year"))


_S, _Q1 = "vec_id % 3 <> 2", _NEAREST.replace("vec_id = 0", "vec_id = 1")


@query("select vec_id from embeddings where vec_id % 3 <> 2 and label % 2 = 0 and vec_id % 2 = 0")
def school_filter(spark, sf_dir):
    """A school with and without a slash, any of the tags, all of the tags, a year."""
    return retrieve.all_tags(retrieve.prefilter(_tagged(spark, sf_dir), "s", ["hoc_phi", "z"], 2020), ["hoc_phi", "a"]).select("vec_id")


def _list(near: str, where: str, tier: int, no: int, least: float = 0.55, n: int = 10) -> str:
    return f"select vec_id, {tier} as tier, {no} as l, row_number() over (order by s desc, vec_id) - 1 as r from (select * from ({near}) where {where} order by s desc, vec_id limit {n}) where s >= {least}"


def _merged(lists: list[str]) -> str:
    return f"with u as ({' union all '.join(f'({x})' for x in lists)}), f as (select *, row_number() over (partition by vec_id order by tier, r, l) as k from u), g as (select vec_id, (row_number() over (order by tier, r, l))::int as pos from f where k = 1) select vec_id, pos from g where pos <= 10"


_TEXT = "select vec_id, 0 as tier, 0 as l, row_number() over (order by vec_id) - 1 as r from (select vec_id from embeddings where {} and starts_with(vec_id::varchar, '1') order by vec_id limit 5)"


@query(_merged([_TEXT.format(_S), _list(_NEAREST, _S, 1, 0), _list(_Q1, _S, 1, 1)]))
def retrieve_fused(spark, sf_dir):
    found = retrieve.retrieve(_tagged(spark, sf_dir), _vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1), "vec_id", "s", ["a"], program="^1")
    return found.select("vec_id", "pos")


_FIRST = "select vec_id, 0 as tier, 0 as l, row_number() over (order by o, x, vec_id) - 1 as r from (({}) union all ({})) qualify r < 5"
_NARROW = f"{_S} and label % 2 = 0"


@query(_merged([
    _FIRST.format(f"select vec_id, 0 as o, 0.0 as x from embeddings where {_NARROW} and starts_with(vec_id::varchar, '1') order by vec_id limit 5", f"select vec_id, 1 as o, -s as x from (select * from ({_NEAREST}) where {_NARROW} order by s desc, vec_id limit 10) where s >= 0.45"),
    _list(_NEAREST, _S, 1, 0), _list(_Q1, _S, 1, 1),
]))
def dual_search(spark, sf_dir):
    found = retrieve.dual_search(_tagged(spark, sf_dir), _vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1), "vec_id", "s", ["hoc_phi"], program="^1")
    return found.select("vec_id", "pos")


@query(f"select vec_id, round(s, 6) as score from (select * from (select * from ({_NEAREST}) order by s desc, vec_id limit 50) where {_S} and vec_id % 2 = 0 order by s desc, vec_id limit 10) where s >= 0.55")
def overfetched_search(spark, sf_dir):
    found = retrieve.overfetched(_tagged(spark, sf_dir), _vector(spark, sf_dir, 0), "vec_id", school="s", year=2020, limit=10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(_FUSED + " select string_agg('[' || pos || '] ' || text, chr(10) || chr(10) order by pos) as context from g")
def answer_context(spark, sf_dir):
    return retrieve.context(_fused(spark, sf_dir), text="content")


@query(_FUSED + " select k, max(1 + length(text) % k) <= 2 as low_confidence from g, (values (1), (2), (3), (5)) t(k) group by k union all select 0, true")
def low_confidence(spark, sf_dir):
    """Whether the best score of a result list is low, for scores by the lengths of its texts, and without scores."""
    docs = _fused(spark, sf_dir)
    sizes = [r.n for r in docs.select("pos", F.length("content").alias("n")).orderBy("pos").collect()]  # a result list
    out = retrieve.low_confidence(retrieve.rerank(docs, None)).select(F.lit(0).alias("k"), "low_confidence")
    for k in (1, 2, 3, 5):
        out = out.union(retrieve.low_confidence(retrieve.rerank(docs, [1 + n % k for n in sizes])).select(F.lit(k).alias("k"), "low_confidence"))
    return out


_SOURCES = "select pos, text, case when doc_id % 3 = 0 then '' else 'T' || doc_id end as title, case when doc_id % 2 = 0 then 'http://h/' || doc_id else '' end as url from g"


@query(_FUSED + f""", s as ({_SOURCES}),
c as (select string_agg('[Nguồn ' || pos || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos) as context,
coalesce(string_agg('- [Nguồn ' || pos || ']: ' || case when title <> '' then title else 'Nguồn' end || case when url <> '' then ' (' || url || ')' else '' end, chr(10) order by pos) filter (url <> '' or title <> ''), '(none)') as sources from s),
h as (select coalesce(string_agg(case role when 'user' then 'Người dùng' else 'Trợ lý' end || ': ' || text, chr(10) order by turn), '(none)') as history from conversations where conv_id = 1 and turn < 3)
select replace(replace(replace(replace(replace('{retrieve.LAYOUT}', '{{note}}', '{retrieve.NOTE}'), '{{question}}', 'which one?'), '{{history}}', history), '{{sources}}', sources), '{{context}}', context) as prompt from c, h""")
def answer_prompt(spark, sf_dir):
    """What goes to a model: the fused texts with their sources after the first messages of a conversation."""
    docs = _fused(spark, sf_dir).withColumns({"source_title": F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T"), "doc_id")), "source_url": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://h/"), "doc_id"))})
    said = table(spark, sf_dir, "conversations").where("conv_id = 1 and turn < 3").orderBy("turn").collect()
    return retrieve.prompt(docs, "which one?", [(r.role, r.text) for r in said], unsure=True, text="content")


_PICTURED = "'<p>at</p><img alt=\"x\" src=\"/p' || page_id || '.png\"><IMG data-src=''q.svg''>' || case when page_id % 2 = 0 then '<img src=other.gif>' else '' end || coalesce(html, '')"


@query(f"""select page_id, replace({_PICTURED}, '<img alt="x" src="/p' || page_id || '.png">', case when page_id % 3 = 0 then '<p>read &lt;' || page_id || '&gt;</p>' else '<img alt="x" src="/p' || page_id || '.png">' end) as html from pages""")
def pictured_pages(spark, sf_dir):
    """Pages with the text of their pictures in the pictures' places."""
    html = F.concat(F.lit("<p>at</p><img alt=\"x\" src=\"/p"), "page_id", F.lit(".png\"><IMG data-src='q.svg'>"), F.when(F.col("page_id") % 2 == 0, "<img src=other.gif>").otherwise(""), F.coalesce("html", F.lit("")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h/"), "page_id", F.lit("/a")).alias("url"), html.alias("html"))
    texts = pages.where("page_id % 3 = 0").select("url", F.concat(F.lit("http://h/p"), "page_id", F.lit(".png")).alias("picture"), F.concat(F.lit("read <"), "page_id", F.lit(">")).alias("text"))
    return crawl.pictures_in_pages(pages, texts).select("page_id", "html")


@query("select 'http://h/' || doc_id || '.png' as url, 'image' as type, '| ' || lang || source || ' | ' || source || lang || ' |' || chr(10) || '|---|---|' || chr(10) || '| ' || source || lang || ' | ' || lang || source || ' |' as text from documents where doc_id % 2 = 0")
def attached_pictures(spark, sf_dir):
    """Attachments, pictures among them read by the caller's recognizer: here two rows of two cells from the row's own text."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    files = docs.select(F.concat(F.lit("http://h/"), "doc_id", F.lit(".png")).alias("url"), F.encode(F.concat_ws("|", "lang", "source"), "utf-8").alias("content"))

    def recognize(content):
        said = F.split(F.decode(content, "utf-8"), "[|]")
        token = lambda cy, cx, a, b: F.struct(F.lit(cy).alias("cy"), F.lit(cx).alias("cx"), F.lit(10.0).alias("h"), F.concat(said[a], said[b]).alias("text"))
        return F.struct(F.lit(1000.0).alias("height"), F.array(token(10.0, 10.0, 0, 1), token(10.0, 900.0, 1, 0), token(90.0, 10.0, 1, 0), token(90.0, 900.0, 0, 1)).alias("tokens"))

    return readers.attachments(files, recognize)
