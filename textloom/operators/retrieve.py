"""Retrieval: nearest vectors, text search, fusion of ranked lists, boosts, reranking and context for an answer."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import dictionaries as d
from textloom.functions.fuzzy import partial_likeness
from textloom.functions.queries import parse_scores
from textloom.functions.text import col

LIMIT, THRESHOLD, TAG_THRESHOLD, TEXT_SCORE = 6, 0.55, 0.45, 0.80
TEXT_LIMIT, KEY = 5, 200
KEEP, KEEP_SCORE, FALLBACK, FALLBACK_SCORE = 3, 2, 3, 8


def similarity(vector: Column | str, query: list[float]) -> Column:
    """(1 + cosine) / 2 with a query vector; null for vectors of another length or without direction."""
    v, norm = col(vector), math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(v) == len(query)) & (own > 0), (1 + dot / (own * norm)) / 2)


def same_school(column: Column | str, school: str) -> Column:
    return F.regexp_replace(F.trim(col(column)), "/+$", "") == school.strip().rstrip("/")


def prefilter(docs: DataFrame, school: str | None = None, tags: list[str] | None = None, year: int | None = None) -> DataFrame:
    """Rows of a school and a year with any of the tags; what isn't given doesn't filter."""
    if school:
        docs = docs.where(same_school("school", school))
    if tags:
        docs = docs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return docs if year is None else docs.where(F.col("year") == year)


def all_tags(docs: DataFrame, tags: list[str] | None) -> DataFrame:
    return docs.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0) if tags else docs


def vector_search(docs: DataFrame, query: list[float], key: str, vector: str = "embedding", limit: int = LIMIT, threshold: float | None = THRESHOLD, tags: list[str] | None = None) -> DataFrame:
    """The ``limit`` nearest rows by score, ties by key; only then those under the threshold or without all of the tags go.

    Filters on the rows belong before this: the top is taken in each partition and merged, nothing is sorted in full."""
    top = docs.withColumn("score", similarity(vector, query)).where("score is not null").orderBy(F.desc("score"), key).limit(limit)
    top = top if threshold is None else top.where(F.col("score") >= threshold)
    return all_tags(top, tags).drop(vector)


def overfetched(docs: DataFrame, query: list[float], key: str, vector: str = "embedding", limit: int = LIMIT, threshold: float | None = THRESHOLD, school: str | None = None, tags: list[str] | None = None, year: int | None = None) -> DataFrame:
    """``vector_search`` for stores that can't filter first: five times as many rows, then the filters, then the limit."""
    top = vector_search(docs, query, key, vector, limit * 5, None)
    top = prefilter(top, school, tags, year).orderBy(F.desc("score"), key).limit(limit)
    return all_tags(top if threshold is None else top.where(F.col("score") >= threshold), tags)


def text_search(docs: DataFrame, program: str, key: str, content: str = "content", limit: int = TEXT_LIMIT, score: float = TEXT_SCORE) -> DataFrame:
    """The first ``limit`` rows by key whose text matches the pattern ``program`` in any case, under a constant score."""
    hits = docs.where(F.col(content).rlike(f"(?iu){program}")).orderBy(key).limit(limit)
    return hits.withColumns({"score": F.lit(score), "is_text_match": F.lit(True)})


def fuse(priority: DataFrame, others: list[DataFrame], content: str = "content", rank: str = "rank", most: int = 10) -> DataFrame:
    """Ranked lists as one: half of the places at most to the priority list, the rest in turn by rank. The first of rows that
    share their first 200 characters stays. Lists have a rank from 0; the result has pos from 1."""
    tiers = priority.where(F.col(rank) < max(most // 2, 3)).withColumns({"_tier": F.lit(0), "_list": F.lit(0)})
    for i, df in enumerate(others):
        tiers = tiers.unionByName(df.withColumns({"_tier": F.lit(1), "_list": F.lit(i)}), allowMissingColumns=True)
    order = [F.col("_tier"), F.col(rank), F.col("_list")]
    first = tiers.withColumn("_n", F.row_number().over(Window.partitionBy(F.substring(content, 1, KEY)).orderBy(*order))).where("_n = 1")
    top = first.orderBy(*order).limit(most)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).drop("_tier", "_list", "_n")  # ``most`` rows


def boost_by_questions(docs: DataFrame, query: str, pos: str = "pos", least: float = 75) -> DataFrame:
    """Rows with a sample question like the query first, both parts in their order."""
    q = query.lower()
    asked = F.explode_outer("questions")
    each = docs.select(pos, asked.alias("s")).where((F.length("s") >= 5) & (F.trim("s") != "")).withColumn("s", F.lower("s"))
    like = F.contains(F.lit(q), F.col("s")) | F.contains(F.col("s"), F.lit(q)) | (partial_likeness(F.lit(q), F.col("s")) >= least)
    hit = each.where(like).select(pos).distinct().withColumn("boosted", F.lit(True))
    return docs.join(hit, pos, "left").withColumn("boosted", F.coalesce("boosted", F.lit(False))).orderBy(F.desc("boosted"), pos)


def rerank(docs: DataFrame, scores: list[int] | None, pos: str = "pos", score_query: bool = False) -> DataFrame:
    """Rows by score, those under 3 (2 for score questions) left out unless they matched as text; if none is left, the best 3 (8).

    ``scores`` are a scorer's for the rows in order of ``pos`` (from 1); another number of scores leaves the rows as they are,
    with null scores. Rows are a result list, so few."""
    n = docs.count()
    if scores is None or len(scores) != n:
        return docs.withColumn("rerank_score", F.lit(None).cast("int")).orderBy(pos)
    given = F.array(*[F.lit(s) for s in scores]) if scores else F.array().cast("array<int>")
    keep = F.col("rerank_score") >= (KEEP_SCORE if score_query else KEEP)
    text = F.coalesce(F.col("is_text_match"), F.lit(False)) if "is_text_match" in docs.columns else F.lit(False)
    ranked = docs.withColumn("rerank_score", F.get(given, F.row_number().over(Window.orderBy(pos)) - 1)).withColumn("_keep", keep | text)
    ranked = ranked.withColumns({"_any": F.max("_keep").over(Window.partitionBy()), "_n": F.row_number().over(Window.orderBy(F.desc("rerank_score"), pos))})
    return ranked.where(F.col("_keep") | (~F.col("_any") & (F.col("_n") <= (FALLBACK_SCORE if score_query else FALLBACK)))).orderBy("_n").drop("_keep", "_any", "_n")


def rerank_reply(docs: DataFrame, reply: str, pos: str = "pos", score_query: bool = False) -> DataFrame:
    spark = docs.sparkSession
    found = spark.range(1).select(parse_scores(F.lit(reply)).alias("s")).first().s
    return rerank(docs, list(found), pos, score_query)


def low_confidence(reranked: DataFrame) -> DataFrame:
    return reranked.agg((F.coalesce(F.max("rerank_score"), F.lit(0)) <= 2).alias("low_confidence"))


def year_of(date: Column | str, tags: Column | str) -> Column:
    """Of the source date, else the first tag that is a year; '' for none."""
    own = F.regexp_extract(F.coalesce(col(date).cast("string"), F.lit("")), r"(?U)\b(20\d{2})\b", 1)
    tagged = F.filter(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: t.rlike(r"^20\d{2}$"))
    return F.when(own != "", own).otherwise(F.coalesce(F.get(tagged, F.lit(0)), F.lit("")))


def doc_type(tags: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in d.DOC_TYPES for x in kv])
    named = F.filter(F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.element_at(known, t)), lambda x: x.isNotNull())
    return F.coalesce(F.get(named, F.lit(0)), F.lit(d.DOC_TYPE_DEFAULT))


def enrich(docs: DataFrame, pos: str = "pos", recency: bool = True) -> DataFrame:
    """Rows with doc_year, doc_type and the text that goes to a model, the latest first."""
    out = docs.withColumns({"doc_year": year_of("source_date", "tags"), "doc_type": doc_type("tags")})
    time = F.when(F.col("doc_year") != "", F.concat(F.lit("[Thời gian: "), "doc_year", F.lit("] "))).otherwise("")
    out = out.withColumn("enriched", F.concat(time, F.lit("[Loại: "), "doc_type", F.lit("] [Nội dung: "), "content", F.lit("]")))
    return out.orderBy(F.desc("doc_year"), F.desc(F.coalesce("source_date", F.lit(""))), pos) if recency else out.orderBy(pos)


def sources(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.withColumns({content: F.substring(content, 1, 200), "score": F.round("score", 4)})


def context(docs: DataFrame, pos: str = "pos", text: str = "enriched") -> DataFrame:
    """One row: the numbered texts of a result list."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return docs.agg(F.array_join(F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["t"])), "\n\n").alias("context"))


# How sources are named in an answer and who speaks in the history.
SOURCE, SOURCE_NAME, ROLES, PARTS = "[Nguồn {}]", "Nguồn", {"user": "Người dùng"}, "\n\n---\n\n"
OTHER_ROLE = "Trợ lý"
#: Our own wording around what a prompt holds; a caller may pass another with the same fields.
LAYOUT = """History:
{history}

Passages:
{context}

Sources:
{sources}

Question: {question}
{note}
Answer from the passages and name the source of each fact:"""
NOTE = "The passages fit the question badly: say so in place of an answer, and offer the latest year that there is.\n"
ABSENT = "(none)"


def prompt(docs: DataFrame, question: str, history: list[tuple[str, str]] | None = None, unsure: bool = False, pos: str = "pos", text: str = "enriched", layout: str = LAYOUT) -> DataFrame:
    """One row: what goes to a model for a result list: its texts under numbered labels, the labels' sources (rows without a
    title and a URL have none), the (role, message) pairs of the history, the question, and a note if the search was ``unsure``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"), F.coalesce("source_title", F.lit("")).alias("title"), F.coalesce("source_url", F.lit("")).alias("url"))))
    head, tail = SOURCE.split("{}")
    label = lambda i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(tail))

    def source(r: Column, i: Column) -> Column:
        named = F.concat(F.lit("- "), label(i), F.lit(": "), F.when(r["title"] != "", r["title"]).otherwise(SOURCE_NAME))
        return F.when(r["url"] != "", F.concat(named, F.lit(" ("), r["url"], F.lit(")"))).when(r["title"] != "", named)

    parts = F.array_join(F.transform(rows, lambda r, i: F.concat(label(i), F.lit("\n"), r["t"])), PARTS)
    named = F.array_join(F.filter(F.transform(rows, source), lambda x: x.isNotNull()), "\n")
    said = "\n".join(f"{ROLES.get(role, OTHER_ROLE)}: {message}" for role, message in history or []) or ABSENT
    fields = {"context": parts, "sources": F.when(named != "", named).otherwise(ABSENT), "history": F.lit(said), "question": F.lit(question), "note": F.lit(NOTE if unsure else "")}
    pieces = re.split(r"\{(\w+)\}", layout)
    return docs.agg(F.concat(*[fields[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces)]).alias("prompt"))


def ranked(docs: DataFrame, key: str) -> DataFrame:
    """A result list with its rank from 0."""
    return docs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def retrieve(docs: DataFrame, query: list[float], hyde: list[float], key: str, school: str | None = None, tags: list[str] | None = None, year: int | None = None, program: str = "", limit: int = 10) -> DataFrame:
    """Two vector searches, and a text search where the question names a program and a school, fused."""
    rows = prefilter(docs, school, tags, year)
    lists = [ranked(vector_search(rows, v, key, limit=limit, tags=tags).withColumn("is_text_match", F.lit(False)), key) for v in (query, hyde)]
    text = ranked(text_search(prefilter(docs, school, tags, year), program, key).drop("embedding"), key) if program and school else lists[0].limit(0)
    return fuse(text, lists, most=limit)


def dual_search(docs: DataFrame, query: list[float], hyde: list[float], key: str, school: str | None = None, tags: list[str] | None = None, program: str = "", limit: int = 10) -> DataFrame:
    """Like ``retrieve``, with a search among tagged rows at a lower threshold; text results, then tagged ones come first."""
    rows = prefilter(docs, school)
    lists = [ranked(vector_search(rows, v, key, limit=limit).withColumn("is_text_match", F.lit(False)), key) for v in (query, hyde)]
    first = lists[0].limit(0)
    if tags:
        narrow = [t for t in tags if t in ("diem_chuan", "hoc_phi", "chi_tieu")] or tags[:1]
        tagged = vector_search(prefilter(docs, school, tags), query, key, limit=limit, threshold=TAG_THRESHOLD).withColumn("is_text_match", F.lit(False))
        first = ranked(tagged, key)
        if program:
            text = text_search(prefilter(docs, school, narrow), program, key).drop("embedding")
            both = text.withColumn("_o", F.lit(0)).unionByName(tagged.withColumn("_o", F.lit(1)))
            first = both.withColumn("rank", F.row_number().over(Window.orderBy("_o", F.desc("score"), key)) - 1).drop("_o")
    return fuse(first, lists, most=limit)
