"""Column functions that read a user's question."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import dictionaries as d
from textloom.functions.rows import by_row
from textloom.functions.text import col, contains_any, rule_tags, strip

_FROM = "".join(letters for _, letters in d.ACCENTS)
_TO = "".join(base * len(letters) for base, letters in d.ACCENTS)


def fold_accents(c: Column | str) -> Column:
    return F.translate(F.lower(strip(c)), _FROM, _TO)


@by_row(StringType())
def bare_letters(text: str | None) -> str | None:
    """Lower case without combining marks, whether they stand alone or in a letter; no built-in function takes letters apart."""
    if text is None or text.isascii():
        return text and text.lower()
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text.lower())).replace("đ", "d")


def squash(c: Column | str) -> Column:
    """Bare letters, three or more of a character to one, blanks collapsed."""
    t = F.regexp_replace(bare_letters(col(c)), r"([^\n])\1{2,}", "$1")
    return strip(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+", " "))


def program_of(c: Column | str, programs: list[tuple[str, str]] = d.PROGRAMS) -> Column:
    """The first program whose keyword stands in the question; of three letters or fewer as a whole word. '' for none."""
    low, out = F.lower(col(c)), None
    for word, value in programs:
        hit = low.rlike(rf"(?U)\b{word}\b") if len(word) <= 3 else F.contains(low, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("")


def query_tags(c: Column | str, rules: list[tuple[str, list[str]]] = d.QUERY_TAGS) -> Column:
    return rule_tags(c, rules)


def query_year(c: Column | str) -> Column:
    found = F.regexp_extract(F.lower(col(c)), r"(?U)\b20\d{2}\b", 0)
    return F.when(found != "", found.cast("int"))


def school_of(c: Column | str, schools: list[tuple[str, str, list[str]]] = d.SCHOOLS) -> Column:
    """The first school with a keyword in the question, else the first that shares a whole word with one; null for none."""
    folded, out = fold_accents(c), None
    fold = lambda w: w.lower().translate(str.maketrans(_FROM, _TO))
    for school, _, words in schools:
        hit = contains_any(folded, [fold(w) for w in words])
        out = F.when(hit, school) if out is None else out.when(hit, school)
    own = F.split(folded, r"(?U)\s+")
    for school, _, words in schools:
        parts = sorted({p for w in words for p in fold(w).split()})
        out = out.when(F.arrays_overlap(own, F.array(*[F.lit(p) for p in parts])), school)
    return out


def is_school_selection(c: Column | str) -> Column:
    q = F.regexp_replace(strip(F.lower(col(c))), r"[!.,?]+$", "")
    words = F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")
    rest = F.filter(words, lambda w: ~w.isin(*d.SELECTION_FILLERS))
    return ~contains_any(q, d.QUESTION_PHRASES) & (F.size(words) <= 5) & school_of(c).isNotNull() & (F.size(rest) <= 3)


def is_score_query(c: Column | str) -> Column:
    return contains_any(F.lower(col(c)), d.SCORE_WORDS)


def boosted(c: Column | str) -> Column:
    q, low = col(c), F.lower(col(c))
    q = F.when(contains_any(low, d.SCORE_WORDS), F.concat(q, F.lit(d.SCORE_BOOST))).otherwise(q)
    return F.when(contains_any(low, d.OTHER_YEARS), F.concat(q, F.lit(d.YEARS_BOOST))).otherwise(q)


def search_limit(c: Column | str) -> Column:
    return F.when(is_score_query(c), 18).otherwise(10)


def parse_rewrite(reply: Column | str, question: Column | str) -> Column:
    """rewrite (300 characters at most) and hyde of a model's reply; the question where a part is missing or too short."""
    rewrite = strip(F.regexp_extract(col(reply), r"(?s)REWRITE:(.*?)(?:\nHYDE:|$)", 1))
    hyde = strip(F.regexp_extract(col(reply), r"(?s)HYDE:(.*)$", 1))
    rewrite = F.when(rewrite != "", F.substring(rewrite, 1, 300)).otherwise(col(question))
    return F.struct(rewrite.alias("rewrite"), F.when(F.length(hyde) >= 10, hyde).otherwise(rewrite).alias("hyde"))


def parse_scores(reply: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(reply), F.lit(r"\b([1-5])\b"), F.lit(1)), lambda s: s.cast("int"))


def error_kind(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.when(contains_any(low, d.QUOTA_ERRORS), "quota").when(contains_any(low, d.KEY_ERRORS), "key").otherwise("connection")
