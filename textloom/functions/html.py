"""HTML as text, by the standard library's parser."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from textloom.functions import dictionaries as d
from textloom.functions.rows import by_row

LEAST = 150
PAGE = StructType().add("text", StringType()).add("title", StringType())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BREAKS = {"p", "div", "article", "section", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Node:
    def __init__(self, tag: str, attrs: dict, up=None):
        self.tag, self.attrs, self.up, self.below = tag, attrs, up, []

    def all(self):
        """The node and those below it in document order; pages may nest deeper than Python calls can."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.below) if isinstance(x, _Node)]

    def texts(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo += reversed(x.below)

    def text(self) -> str:
        """Every piece of text without blanks around it."""
        return "".join(t.strip() for t in self.texts())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {})

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.below.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x and x.tag != tag:
            x = x.up
        if x:
            self.at = x.up or self.root

    def handle_data(self, data):
        self.at.below.append(data)


def _drop(root: _Node, tags: list[str]) -> None:
    for node in root.all():
        node.below = [x for x in node.below if isinstance(x, str) or x.tag not in tags]


def _content(root: _Node) -> _Node:
    """The first of the usual content elements that has more than ``LEAST`` characters."""
    chosen = [lambda n: n.tag == "article", lambda n: n.tag == "main", *(lambda n, c=c: c in n.attrs.get("class", "") for c in d.CONTENT_CLASSES)]
    for fits in chosen:
        node = next((n for n in root.all() if n is not root and fits(n)), None)
        if node and len(node.text()) > LEAST:
            return node
    return root


def _markdown(root: _Node, url: str) -> str:
    made: dict[int, str] = {}
    for node in reversed(list(root.all())):  # those below come before the node itself
        inner = "".join(re.sub(r"\s+", " ", x) if isinstance(x, str) else made.pop(id(x)) for x in node.below)
        made[id(node)] = _marked(node, inner, url)
    return made[id(root)]


def _marked(node: _Node, inner: str, url: str) -> str:
    """A node's own markdown around that of what is below it."""
    if node.tag == "img":
        src = node.attrs.get("src") or node.attrs.get("data-src") or ""
        return f"![{node.attrs.get('alt', '')}]({src if src.startswith('data:') else urljoin(url, src)})" if src else ""
    if node.tag == "br":
        return "\n"
    if node.tag == "a" and node.attrs.get("href"):
        return f"[{inner.strip()}]({node.attrs['href']})"
    if node.tag in ("b", "strong", "i", "em") and inner.strip():
        mark = "**" if node.tag in ("b", "strong") else "*"
        return f"{mark}{inner.strip()}{mark}"
    if node.tag in ("td", "th"):
        return f" {inner.strip()} |"
    if node.tag == "tr":
        rule = "\n|" + " --- |" * sum(isinstance(x, _Node) and x.tag == "th" for x in node.below)
        return f"\n|{inner.strip()}" + (rule if rule != "\n|" else "")
    if node.tag == "li":
        return f"\n* {inner.strip()}"
    if re.fullmatch("h[1-6]", node.tag):
        return f"\n\n{'#' * int(node.tag[1])} {inner.strip()}\n\n"
    return f"\n\n{inner}\n\n" if node.tag in BREAKS else inner


def to_text(page: str, url: str) -> tuple[str, str]:
    """A page's content as markdown, single blank lines between its parts, and its title."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    title = next((n.text() for n in tree.root.all() if n.tag == "title"), "")
    _drop(tree.root, [*d.HIDDEN_ELEMENTS, "title"])
    out: list[str] = []
    for x in (x.strip() for x in _markdown(_content(tree.root), url).splitlines()):
        if x or (out and out[-1]):
            out.append(x)
    return "\n".join(out).strip(), title


@by_row(PAGE)
def html_to_text(page: str | None, url: str | None) -> tuple[str, str]:
    return to_text(page or "", url or "")


@by_row(StringType())
def unescape(text: str | None) -> str | None:
    """All entities decoded."""
    return None if text is None else entities.unescape(text)


def closed_entities(c: Column | str, names: list[str]) -> Column:
    """The entities of these names decoded where they end in a semicolon. ``unescape`` also takes an open ``&amp`` for one, as
    browsers do; in a text that was escaped and then cut, that is a piece of one."""
    text = F.col(c) if isinstance(c, str) else c
    for name in [n for n in names if n != "amp"] + [n for n in names if n == "amp"]:  # else &amp;quot; would be decoded twice
        text = F.replace(text, F.lit(f"&{name};"), F.lit(html5[f"{name};"]))
    return text
