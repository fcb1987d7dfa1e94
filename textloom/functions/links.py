"""Column functions on URLs and on the links in HTML."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import dictionaries as d
from textloom.functions.text import col, contains_any


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def normal_url(url: Column | str) -> Column:
    """Without fragment, query and trailing slashes; a bare host keeps one."""
    head = F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.concat(head, F.when(path == "", "/").otherwise(path))


def extension_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(path_of(url), r"[^/.][^/]*?(\.[^./]*)$", 1))


def content_type(url: Column | str, header: Column | str | None = None) -> Column:
    """image, video, audio, asset or a file's type by extension, else by the ``header`` (Content-Type) if given, else html."""
    e = extension_of(url)
    out = F.when(e.isin(*d.IMAGE_TYPES), "image").when(e.isin(*d.VIDEO_TYPES), "video").when(e.isin(*d.AUDIO_TYPES), "audio").when(e.isin(*d.ASSET_TYPES), "asset")
    out = out.when(e.isin(*d.FILE_TYPES), F.substr(e, F.lit(2)))
    if header is not None:
        h = F.lower(col(header))
        for kind in ("pdf", "image", "video", "audio"):
            out = out.when(F.contains(h, F.lit(kind)), kind)
    return out.otherwise("html")


def media_metadata(url: Column | str) -> Column:
    path = path_of(url)
    return F.struct(content_type(url).alias("type"), col(url).alias("url"), host_of(url).alias("domain"), path.alias("path"), F.regexp_extract(path, "[^/]*$", 0).alias("filename"))


def is_under(url: Column | str, base: str) -> Column:
    """The base path itself or below it; for the base '/' only the root."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    base = base.rstrip("/") or "/"
    return (path == base) | F.startswith(path, F.lit(base + "/"))


def file_name(source: Column | str, url: Column | str, suffix: str = "md") -> Column:
    path = F.regexp_replace(F.regexp_replace(path_of(url), "^/+|/+$", ""), "/", "_")
    safe = F.substring(F.regexp_replace(path, r"(?U)[^\w\-]", "_"), 1, 60)
    return F.concat(col(source), F.lit("_"), F.when(safe == "", "trangchu").otherwise(safe), F.lit("." + suffix))


def safe_segment(c: Column | str) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"(?U)[^\w\-]+", "_"), r"^[_\-]+|[_\-]+$", "")
    return F.when(safe == "", "_").otherwise(F.substring(safe, 1, 80))


def category_path(c: Column | str) -> Column:
    """Folders for a category of several parts; '_root' for none."""
    parts = F.filter(F.split(F.coalesce(col(c), F.lit("")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, safe_segment), "/")).otherwise("_root")


def download_name(url: Column | str) -> Column:
    name = F.regexp_replace(F.regexp_extract(path_of(url), "[^/]*$", 0), r"(?U)[^\w\-\.]", "_")
    return F.when(name == "", "download").otherwise(F.substring(name, 1, 100))


def hrefs(html: Column | str) -> Column:
    """Targets of the anchors of a page, in order, those that lead nowhere left out."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    found = F.transform(found, lambda h: F.trim(h))
    return F.filter(found, lambda h: ~((h == "") | F.startswith(h, F.lit("#")) | h.rlike("(?i)^(javascript|mailto):")))


def absolute(url: Column | str, href: Column | str) -> Column:
    """The full URL of an absolute, host-relative or plain path; dots are left to ``joined``."""
    h, u = col(href), col(url)
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)//[^/?#]*", 0)
    scheme = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    folder = F.regexp_extract(path_of(u), "^.*/", 0)
    plain = F.concat(head, F.when(folder == "", "/").otherwise(folder), h)
    return F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(head, h)).otherwise(plain)


@F.pandas_udf(StringType())
def joined(url: pd.Series, href: pd.Series) -> pd.Series:
    """Full resolution, for paths with dots."""
    return pd.Series([None if u is None or h is None else urljoin(u, h) for u, h in zip(url, href, strict=True)])


def page_links(url: Column | str, html: Column | str, scope: str = "domain", base: str = "/") -> Column:
    """Normal URLs that a page links to within a scope (domain, path or page), files and media left out, sorted."""
    u = col(url)
    links = F.transform(hrefs(html), lambda h: normal_url(absolute(u, h)))
    keep = lambda x: (host_of(x) == host_of(u)) & ~extension_of(x).isin(*d.SKIP_TYPES)
    if scope == "path":
        links = F.filter(links, lambda x: keep(x) & is_under(x, base))
    elif scope == "page":
        links = F.filter(links, lambda x: keep(x) & (x == normal_url(u)))
    else:
        links = F.filter(links, keep)
    return F.array_sort(F.array_distinct(links))


def file_links(url: Column | str, html: Column | str, types: list[str] = d.FILE_TYPES) -> Column:
    u = col(url)
    links = F.transform(hrefs(html), lambda h: F.regexp_extract(absolute(u, h), "^[^?#]*", 0))
    return F.array_sort(F.array_distinct(F.filter(links, lambda x: extension_of(x).isin(*types))))


def is_soft_404(html: Column | str, phrases: list[str] = d.SOFT_404) -> Column:
    return contains_any(F.lower(F.substring(col(html), 1, 3000)), phrases)


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def sitemap_locs(xml: Column | str) -> Column:
    return F.transform(F.xpath(col(xml), F.lit("//*[local-name()='loc']/text()")), lambda x: F.trim(x))
