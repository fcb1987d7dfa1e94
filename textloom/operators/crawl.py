"""Crawling as tables: frontier, pages, sitemaps, states. Whatever goes out to the network is a column of the caller's."""

from __future__ import annotations

import html as escape
import json
import re
from collections.abc import Callable
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from textloom.functions import ocr
from textloom.functions.html import LEAST, html_to_text
from textloom.functions.links import extension_of, file_links, hrefs, is_under, joined, normal_url
from textloom.functions.rows import by_row
from textloom.functions.tables import table_records
from textloom.shared import stored

LINK = t.StructType([t.StructField("url", t.StringType()), t.StructField("category", t.StringType())])


def bfs(edges: DataFrame, start: DataFrame, most: int = 500) -> DataFrame:
    """url and depth of what is reached from ``start`` (url) over ``edges`` (src, dst), level by level until nothing new is
    found or ``most`` are: the last level is cut by url. Every level is a written table."""
    seen = stored(start.select("url", F.lit(0).alias("depth")).distinct(), "level")
    frontier, depth = seen, 0
    while (n := seen.count()) < most:
        depth += 1
        found = frontier.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        found = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(found.orderBy("url").limit(most - n), "level")
        if frontier.isEmpty():
            break
        seen = stored(seen.union(frontier), "seen")
    return seen


def flatten(value, path: str = "") -> list[tuple[str, str]]:
    """URLs in lists anywhere in a nested value, with the keys that lead there; a bare string under a key is none."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flatten(v, f"{path}/{k}" if path else str(k))]
    if isinstance(value, list):
        return [x for v in value for x in ([(v, path)] if isinstance(v, str) and v.startswith("http") else flatten(v, path))]
    return []


@F.pandas_udf(t.ArrayType(LINK))
def flat_links(text: pd.Series) -> pd.Series:
    """The links of each JSON text; none for what is no JSON."""

    def one(value: str | None) -> list[dict]:
        try:
            return [{"url": u, "category": c} for u, c in flatten(json.loads(value))] if value else []
        except ValueError:
            return []

    return text.map(one)


def link_rows(files: DataFrame) -> DataFrame:
    """source_id, url, category of link files (path, value); files that are no JSON give nothing."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.select(stem.alias("source_id"), F.explode(flat_links("value")).alias("l")).select("source_id", "l.url", "l.category")


def outlinks(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.explode(hrefs("html")).alias("href"))


FETCHED = "struct<status:int,body:string>"
# What is never read as a page, where sitemaps lie, and how many parts of an index are followed.
NO_PAGES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".mp4", ".jpg", ".png"]
SITEMAPS = ["/wp-sitemap.xml", "/sitemap.xml", "/sitemap_index.xml"]
MOST_PARTS = 25
NO_PICTURES = [".svg", ".gif", ".ico", ".webp"]
LEAST_PICTURE = 5_000


def fetched(urls: DataFrame, fetch: Callable[[Column], Column], rendered: Callable[[Column], Column] | None = None) -> DataFrame:
    """``urls`` (url, ...) with html: what ``rendered`` gives for the URL, else the body that ``fetch`` gives with status 200.

    Both are the caller's, a UDF as a rule: ``fetch`` gives a struct of status and body, ``rendered`` a text."""
    plain = fetch(F.col("url")).cast(FETCHED)
    body = F.when(plain["status"] == 200, plain["body"])
    return urls.withColumn("html", body if rendered is None else F.coalesce(rendered(F.col("url")), body))


def existing(urls: DataFrame, status: Callable[[Column], Column]) -> DataFrame:
    """The URLs whose status is below 400; those that ``status`` (the caller's) has none for don't exist."""
    return urls.where(F.coalesce(status(F.col("url")) < 400, F.lit(False)))


def fetched_json(urls: DataFrame, fetch: Callable[[Column], Column]) -> DataFrame:
    """``urls`` with value, a variant: the body as JSON, null where there is none or it is no JSON."""
    return fetched(urls, fetch).withColumn("value", F.try_parse_json("html")).drop("html")


def page_texts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """url, text, files of ``pages`` (url, html): the page's text under its title and URL, null where it has fewer than
    ``least`` characters, and the files that it links to. Pages without HTML and URLs of files have no text and no files."""
    page = extension_of("url").isin(*NO_PAGES) | (F.coalesce(F.col("html"), F.lit("")) == "")
    rows = pages.select("url", F.when(~page, F.col("html")).alias("html")).withColumn("t", html_to_text("html", "url"))
    head = F.concat(F.when(F.col("t.title") != "", F.concat(F.lit("["), "t.title", F.lit("]\n"))).otherwise(""), F.lit("[URL: "), "url", F.lit("]\n\n"))
    text = F.when(F.col("html").isNotNull() & (F.length("t.text") >= least), F.concat(head, "t.text"))
    return rows.select("url", text.alias("text"), F.coalesce(file_links("url", "html"), F.array().cast("array<string>")).alias("files"))


def robots_sitemaps(robots: Column | str) -> Column:
    """The sitemaps that a robots.txt names, the last first."""
    named = F.regexp_extract_all(robots if isinstance(robots, Column) else F.col(robots), F.lit(r"(?im)^sitemap:([^\r\n]*)"), F.lit(1))
    return F.coalesce(F.reverse(F.transform(named, lambda x: F.trim(x))), F.array().cast("array<string>"))


@F.pandas_udf(t.ArrayType(t.StringType()))
def locations(xml: pd.Series) -> pd.Series:
    """Locations of a sitemap in the sitemap namespace, else those in none; none where it is no XML."""

    def one(text: str | None) -> list[str]:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return []
        named = [x.text.strip() for x in root.iter("{http://www.sitemaps.org/schemas/sitemap/0.9}loc") if x.text]
        return named or [x.text.strip() for x in root.iter("loc") if x.text]

    return xml.map(one)


def sitemap_urls(bodies: DataFrame, origin: str, base: str, robots: str = "") -> DataFrame:
    """url: normal URLs under ``base`` in the sitemaps of a site, from fetched ``bodies`` (url, body).

    Candidates are those that robots.txt names, the last first, and the usual places. The first that lists other sitemaps
    ends the search; the first ``MOST_PARTS`` of those are read too."""
    spark = bodies.sparkSession
    places = F.concat(robots_sitemaps(F.lit(robots)), F.array(*[F.lit(origin + p) for p in SITEMAPS]))
    candidates = spark.range(1).select(F.posexplode(places).alias("ord", "url"))  # a few rows
    found = bodies.join(F.broadcast(candidates), "url").select("ord", F.posexplode(locations("body")).alias("pos", "loc"))
    found = stored(found.withColumn("part", F.endswith(F.lower("loc"), F.lit(".xml"))), "candidates")
    first = F.broadcast(found.where("part").agg(F.min("ord").alias("first")))  # one row
    read = found.crossJoin(first).where(F.col("first").isNull() | (F.col("ord") <= F.col("first")))
    parts = read.where("part and ord = first").orderBy("pos").limit(MOST_PARTS).select(F.col("loc").alias("url")).distinct()
    below = bodies.join(F.broadcast(parts), "url").select(F.explode(locations("body")).alias("loc")).where(~F.endswith(F.lower("loc"), F.lit(".xml")))
    every = read.where("not part").select("loc").union(below)
    return every.where(is_under("loc", base)).select(normal_url("loc").alias("url")).distinct()


def slug(url: Column | str) -> Column:
    """The name under which a site's URLs are kept."""
    u = url if isinstance(url, Column) else F.col(url)
    bare = F.concat(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("_"), F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    return F.substring(F.regexp_replace(F.regexp_replace(bare, "^[/_]+|[/_]+$", ""), r"(?U)[^\w\-]", "_"), 1, 80)


def link_documents(urls: DataFrame, scope: str = "path") -> DataFrame:
    """path, text of the files that hold each site's URLs (base_url, url): lines, a record, and the form ``link_rows`` reads."""
    lists = urls.groupBy("base_url").agg(F.array_sort(F.collect_set("url")).alias("urls")).withColumns({"slug": slug("base_url"), "count": F.size("urls"), "scope": F.lit(scope)})
    record = F.to_json(F.struct("base_url", "urls", "count", "scope"))
    links = F.to_json(F.struct(F.struct("base_url", "scope", "count").alias("meta"), "urls"))
    forms = [("{}.txt", F.array_join("urls", "\n")), ("ex_{}.json", record), ("links/{}.json", links)]
    files = F.array(*[F.struct(F.concat(F.lit(n.split("{}")[0]), "slug", F.lit(n.split("{}")[1])).alias("path"), v.alias("text")) for n, v in forms])
    return lists.select(F.explode(files).alias("f")).select("f.path", "f.text")


def crawled(state: DataFrame, made: DataFrame) -> DataFrame:
    """The state table (key, status) after a crawl: a key's new status replaces its old one."""
    return made.select("key", "status").dropDuplicates(["key"]).union(state.select("key", "status").join(made.select("key"), "key", "left_anti"))


def page_pictures(pages: DataFrame) -> DataFrame:
    """url, picture of the pictures in ``pages`` (url, html) that may hold text: no drawings, icons or data."""
    src = F.regexp_extract_all("html", F.lit(r"""(?is)<img\s[^>]*?(?<![\w-])(?:data-)?src\s*=\s*["']([^"']+)["']"""), F.lit(1))
    found = pages.select("url", F.explode(F.array_distinct(src)).alias("src")).where(~F.startswith("src", F.lit("data:")))
    return found.select("url", joined("url", "src").alias("picture")).where(~extension_of("picture").isin(*NO_PICTURES))


def picture_texts(pictures: DataFrame, recognize: Callable[[Column], Column], size: Callable[[Column], Column] | None = None, least: int = LEAST_PICTURE) -> DataFrame:
    """url, picture, text: pictures read by the caller's ``recognize`` (a struct of the height and of tokens cy, cx, h, text).

    Pictures whose ``size`` in bytes is known and below ``least`` are left out, as are those whose text is too short."""
    if size is not None:
        pictures = pictures.where(F.coalesce(size(F.col("picture")), F.lit(0)).isin(0) | (size(F.col("picture")) >= least))
    rows = pictures.withColumn("o", recognize(F.col("picture"))).select("url", "picture", ocr.token_rows("o.tokens", "o.height").alias("rows"))
    cells = rows.select("url", "picture", F.transform("rows", lambda r: ocr.merged_cells(r)).alias("cells"))
    records = cells.withColumn("records", table_records("cells"))
    text = ocr.picture_text(ocr.markdown_rows("records"), ocr.generic_table("cells"))
    return records.select("url", "picture", text.alias("text")).where("text is not null")


IMAGE = re.compile(r"(?is)<img\b[^>]*>")
SOURCE = re.compile(r"""(?is)\s(?:data-)?src\s*=\s*["']([^"']+)["']""")


def pictures_in_pages(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """``pages`` (url, html) with paragraphs of text in the places of the pictures that ``texts`` (url, picture, text) has any
    for, so that what follows reads them as part of the page. Pictures of a page come together, pages do not."""
    known = texts.groupBy("url").agg(F.collect_list(F.struct("picture", "text")).alias("_read"))

    @by_row(t.StringType())
    def placed(base: str, page: str | None, found) -> str | None:
        if page is None or found is None:
            return page
        by = {r["picture"]: r["text"] for r in found}

        def text_of(m: re.Match) -> str:
            src = SOURCE.search(m[0])
            text = by.get(urljoin(base, escape.unescape(src[1].strip()))) if src else None
            return m[0] if text is None else f"<p>{escape.escape(text, quote=False)}</p>"

        return IMAGE.sub(text_of, page)

    return pages.join(known, "url", "left").withColumn("html", placed("url", "html", "_read")).select(pages.columns)
