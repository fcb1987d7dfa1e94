"""Column functions that clean, tag and split documents. Every one gives null for null unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textloom.functions import dictionaries as d
from textloom.functions.rows import by_row

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
NAV = re.compile(r"[*+\-]\s*(?:\[.+\]\(.+\)|.{0,50})\s*$")
BULLET = re.compile(r"^[*+\-]\s*")
CHUNK, OVERLAP, TAIL = 800, 400, 400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), EDGES, "")


def blank(c: Column | str) -> Column:
    """Whether ``strip`` leaves nothing; it need not go through the whole text to know."""
    return ~col(c).rlike(r"(?U)[^\s\x1c-\x1f]")


def rstrip(c: Column | str) -> Column:
    """Without white space of any script at the end; only texts that have some there are searched."""
    return F.when(F.substring(col(c), -1, 1).rlike(r"(?U)[\s\x1c-\x1f]"), F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+$", "")).otherwise(col(c))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out once: functions over arrays work their arguments out anew at each mention."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def split_lines(c: Column | str) -> Column:
    """Lines by every line end that Unicode has, without an empty last one."""
    lines = F.split(F.regexp_replace(col(c), rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS)
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(lines)


def contains_any(c: Column | str, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(c), F.lit(w))
    return out


def first_match(c: Column | str, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose word the text contains."""
    out = None
    for word, value in rules:
        hit = F.contains(col(c), F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default))


def strip_blank_lines(c: Column | str) -> Column:
    return strip(F.array_join(F.filter(split_lines(c), lambda x: strip(x) != ""), "\n"))


def _nav_end(lines: Column) -> Column:
    """Start (from 0) and end of the first run of five or more menu lines that begins in the first 25 lines, as a struct.

    A fold over the lines carries the run so far: where it began, its length and the place behind its last line. Blank
    lines go on with a run; of runs that start later within the same lines none can be longer, so one pass will do."""
    is_nav = lambda s: s.rlike(r"(?U)^[*+\-]\s*(?:\[.+\]\(.+\)|.{0,50})\s*$")
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("run"), F.lit(0).alias("n"), F.lit(-1).alias("from"), F.lit(-1).alias("to"))

    def step(a: Column, line: Column) -> Column:
        s = strip(line)
        nav, blank = is_nav(s), s == ""
        begins = nav & (a["run"] < 0) & (a["i"] < 25)
        goes_on = (a["run"] >= 0) & (nav | blank)
        run = F.when(begins, a["i"]).when(goes_on, a["run"]).otherwise(-1)
        n = F.when(begins, 1).when(goes_on, a["n"] + nav.cast("int")).otherwise(0)
        found = (a["from"] < 0) & (n >= 5)
        grows = (a["from"] >= 0) & (a["from"] == run)
        return F.struct(
            (a["i"] + 1).alias("i"), run.alias("run"), n.alias("n"), F.when(found, run).otherwise(a["from"]).alias("from"), F.when(found | grows, a["i"] + 1).otherwise(a["to"]).alias("to")
        )

    return F.aggregate(lines, start, step)


def drop_nav_block(lines: Column) -> Column:
    def cut(ls: Column) -> Column:
        return bound(_nav_end(ls), lambda nav: F.when(nav["from"] >= 0, F.concat(F.slice(ls, F.lit(1), nav["from"]), F.slice(ls, nav["to"] + 1, F.size(ls)))).otherwise(ls))

    return bound(lines, cut)


def cut_footer(lines: Column, markers: list[str] = d.FOOTERS) -> Column:
    """Lines up to the first in the last 30 % that has a marker."""

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        first = F.floor(n * F.lit(0.7)).cast("int")
        place = F.array_min(F.transform(F.slice(ls, first + 1, n), lambda x, i: F.when(contains_any(x, markers), first + i)))
        return F.slice(ls, F.lit(1), F.coalesce(place, n))

    return bound(lines, cut)


def drop_junk_lines(lines: Column, junk: list[str] = d.JUNK) -> Column:
    bare = lambda x: strip(F.regexp_replace(strip(x), r"(?U)^[*+\-]\s*", ""))
    return F.filter(lines, lambda x: ~F.lower(bare(x)).isin(*junk))


def _cleaned(text: str, markers: list[str], junk: set[str]) -> str:
    lines, start, stop = text.splitlines(), 0, 0
    bare = [x.strip() for x in lines]
    for start in range(min(25, len(lines))):
        stop = start
        while stop < len(lines) and (NAV.match(bare[stop]) or (stop > start and not bare[stop])):
            stop += 1
        if sum(bool(bare[i]) for i in range(start, stop)) >= 5:
            bare = bare[:start] + bare[stop:]
            lines = lines[:start] + lines[stop:]
            break
    tail = int(len(lines) * 0.7)
    cut = next((i for i in range(tail, len(lines)) if any(m in lines[i] for m in markers)), len(lines))
    return "\n".join(x for x, b in zip(lines[:cut], bare, strict=False) if b and BULLET.sub("", b).strip().lower() not in junk).strip()


def clean_content(c: Column | str, markers: list[str] = d.FOOTERS, junk: list[str] = d.JUNK) -> Column:
    """Menu block, footer, junk and blank lines out, in one pass: as chained column functions each step would work out the
    lines of the step before several times over."""
    words = set(junk)

    @by_row(StringType())
    def cleaned(text: str | None) -> str | None:
        return None if text is None else _cleaned(text, markers, words)

    return cleaned(col(c))


def clean_markup(c: Column | str) -> Column:
    """Opening tags to blanks, odd blanks out, blanks and blank lines collapsed; entities have to be decoded before."""
    t = F.regexp_replace(col(c), r"<[\p{L}\p{N}_][^>]*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\xA0", " "), r"[\u200B\uFEFF]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(t)


def years_of(c: Column | str, low: int = 2015, high: int = 2030) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= low) & (y <= high))


def detect_year(c: Column | str, low: int = 2015, high: int = 2030) -> Column:
    return F.array_max(years_of(c, low, high))


def rule_tags(c: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """Tags, in the rules' order, whose words the lower-cased text contains."""
    low = F.lower(col(c))
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(tag)) for tag, words in rules]))


def detect_tags(c: Column | str, rules: list[tuple[str, list[str]]] = d.DOCUMENT_TAGS) -> Column:
    return F.array_sort(F.array_union(rule_tags(c, rules), F.transform(years_of(c), lambda y: y.cast("string"))))


def expand_acronyms(c: Column | str, acronyms: list[tuple[str, str]] = d.ACRONYMS, context: list[str] = d.ADMISSION_CONTEXT) -> Column:
    """The first whole-word occurrence of each acronym spelled out, in texts that speak of admission."""
    t = out = col(c)
    for short, full in acronyms:
        out = F.regexp_replace(out, rf"(?suU)^(?!.*\Q{full}\E)(.*?)(?i:\b{short}\b)", "$1" + full)
    return F.when(contains_any(F.lower(t), context), out).otherwise(t)


HEADER = r"(?U)^(?:\[([^\]]+)\]\s*\n)?\[URL:\s*(https?://\S+)\]\s*\n"


def meta_header(c: Column | str) -> Column:
    """Struct of content, url and title. The header's length is measured without leading white space but cut from the text
    with it, as existing corpora expect."""
    left = F.regexp_replace(col(c), r"(?U)^\s+", "")
    whole = F.regexp_extract(left, HEADER, 0)
    has = F.length(whole) > 0
    body = F.when(has, F.substr(col(c), F.length(whole) + 1)).otherwise(col(c))
    return F.struct(strip(body).alias("content"), F.when(has, F.regexp_extract(left, HEADER, 2)).otherwise("").alias("url"), F.when(has, strip(F.regexp_extract(left, HEADER, 1))).otherwise("").alias("title"))


def school_of_file(name: Column | str) -> Column:
    stem = F.regexp_replace(col(name), r"\.(md|txt)$", "")
    return F.when(F.contains(stem, F.lit("_")), F.split_part(stem, F.lit("_"), F.lit(1))).otherwise("unknown")


def folder_tags(root: Column | str, relative: Column | str) -> Column:
    """The root folder's name and each folder on the way to a file, sorted."""
    parts = F.split(col(relative), "/")
    return F.array_sort(F.array_union(F.array(col(root)), F.slice(parts, F.lit(1), F.size(parts) - 1)))


def content_hash(c: Column | str) -> Column:
    return F.md5(F.trim(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " ")))


def _chunked(text: str, size: int, overlap: int, tail: int) -> list[str]:
    lines = text.splitlines()
    out, start, new, total = [], 0, 0, 0  # lines from ``start`` on are held, those from ``new`` on are in no chunk yet
    for i, line in enumerate(lines):
        total += len(line)
        if total < size:
            continue
        out.append("\n".join(lines[start : i + 1]))
        held, start, new, total = start, i + 1, i + 1, 0
        while total < overlap and start > held:
            start -= 1
            total += len(lines[start])
    if new < len(lines):
        rest = "\n".join(lines[start:])
        if out and total <= tail:
            out[-1] += "\n" + rest
        else:
            out.append(rest)
    return out


def chunks(c: Column | str, size: int = CHUNK, overlap: int = OVERLAP, tail: int = TAIL) -> Column:
    """Overlapping chunks of whole lines: one ends once its lines come to ``size`` characters, the next starts with the
    shortest run of its last lines that come to ``overlap``. A short last piece joins the chunk before; '' has no chunks.

    One pass over the lines of a text: as a fold over an array each line would copy the lines held so far."""

    @by_row(ArrayType(StringType()))
    def cut(text: str | None) -> list[str] | None:
        return None if text is None else _chunked(text, size, overlap, tail)

    return cut(col(c))


def embedding_text(year: Column | str, content: Column | str) -> Column:
    """The stripped content, below a line with the year if there is one; a null content counts as empty."""
    text = F.coalesce(strip(content), F.lit(""))
    head = F.concat(F.lit("Năm: "), strip(col(year).cast("string")))
    return F.when(F.coalesce(strip(col(year).cast("string")), F.lit("")) == "", text).when(text == "", head).otherwise(F.concat(head, F.lit("\n"), text))


def chunk_file(c: Column | str, name: Column | str) -> Column:
    """A normalized file's header as a struct: title, url, school, tags, year, content. Without all of the header's marks
    the whole text is content. A year that is missing is taken from the tags, then from the file's name."""
    t = col(c)
    marked = F.contains(t, F.lit("[TITLE]")) & F.contains(t, F.lit("[URL]")) & F.contains(t, F.lit("[META]"))
    parts = F.split(t, "---", 2)
    head = parts[0]
    after = lambda n: F.when(marked, strip(F.regexp_extract(head, rf"(?m)^[ \t]*\[{n}\][ \t]*\r?\n([^\n]*)", 1)))
    meta = F.regexp_extract(head, r"\[META\][^\n]*\n((?:[^\n]*\n?){0,5})", 1)
    field = lambda n: F.when(marked, strip(F.regexp_extract(meta, rf"(?m)^[ \t]*{n}:([^\n]*)$", 1)))
    tags = F.coalesce(F.filter(F.transform(F.split(field("tags"), ","), strip), lambda x: x != ""), F.array().cast("array<string>"))
    latest = lambda xs: F.array_max(F.filter(F.transform(xs, lambda x: x.cast("int")), lambda y: (y >= 2015) & (y <= 2035)))
    inferred = F.coalesce(latest(F.filter(tags, lambda x: x.rlike(r"^\d{4}$"))), latest(F.regexp_extract_all(col(name), F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1))))
    given = F.coalesce(field("year"), F.lit(""))
    year = F.when(given.rlike(r"^\d{1,9}$"), given.cast("int")).when(given == "", inferred)
    body = F.when(marked & (F.size(parts) > 1), strip(parts[1])).otherwise(t)
    return F.struct(after("TITLE").alias("title"), after("URL").alias("url"), field("school").alias("school"), tags.alias("tags"), year.alias("year"), body.alias("content"))
