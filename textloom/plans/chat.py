"""A question from message to context: intent, school, filters, retrieval, boost, rerank, enrichment.

Models are the caller's functions: ``embed`` gives a text's vector, ``rewrite`` a question's reply with REWRITE and HYDE,
``score`` a reply with a number from 1 to 5 for each text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import dictionaries as d
from textloom.functions import queries as Q
from textloom.functions.fuzzy import intent, nearest_program
from textloom.operators import retrieve


class Question(NamedTuple):
    intent: str
    school: str | None
    chosen: bool
    text: str
    program: str
    tags: list[str]
    year: int | None
    limit: int
    about_scores: bool


def school_name(school: str | None) -> str | None:
    """The full name of a school, the id itself where it is unknown."""
    return next((name for i, name, _ in d.SCHOOLS if i == school), school)


def schools(spark: SparkSession) -> DataFrame:
    """school_id, name in their fixed order."""
    rows = [(i, s[0], s[1]) for i, s in enumerate(dict((s[0], s) for s in d.SCHOOLS).values())]
    return spark.createDataFrame(rows, "ord int, school_id string, name string").orderBy("ord").drop("ord")


def read_question(spark: SparkSession, message: str, sticky_school: str | None = None) -> Question:
    """What one message asks for; the school falls back to that of the session. One row, so it may come to the driver."""
    m, q = F.lit(message), Q.boosted(F.lit(message))
    row = spark.range(1).select(
        intent(Q.squash(m)).alias("intent"), Q.school_of(m).alias("school"), Q.is_school_selection(m).alias("chosen"), q.alias("text"),
        Q.program_of(m).alias("named"), nearest_program(m).alias("program"), Q.query_tags(q).alias("tags"), Q.query_year(q).alias("year"), Q.search_limit(m).alias("limit"), Q.is_score_query(m).alias("about_scores"),
    ).first()
    found = row.asDict()
    return Question(**found | {"program": found.pop("named") or row.program, "school": row.school or sticky_school, "tags": list(row.tags)})


def answer_context(
    docs: DataFrame, message: str, key: str, embed: Callable[[str], list[float]], rewrite: Callable[[str], str] | None = None, score: Callable[[str, list[str]], str] | None = None, sticky_school: str | None = None
) -> tuple[Question, DataFrame | None]:
    """The question and the enriched rows that would go to a model; no rows for greetings, nonsense and mere choices of a school."""
    spark = docs.sparkSession
    asked = read_question(spark, message, sticky_school)
    if asked.intent != "UNKNOWN" or asked.chosen or not asked.school:
        return asked, None
    reply = rewrite(asked.text) if rewrite else ""
    parsed = spark.range(1).select(Q.parse_rewrite(F.lit(reply), F.lit(asked.text)).alias("p")).first().p
    found = retrieve.retrieve(docs, embed(asked.text), embed(parsed.hyde), key, asked.school, asked.tags, asked.year, asked.program, asked.limit)
    found = retrieve.boost_by_questions(found, message) if "questions" in docs.columns else found
    if score and not asked.about_scores:
        texts = [r.content for r in found.select("pos", F.substring("content", 1, 800).alias("content")).orderBy("pos").collect()]
        found = retrieve.rerank_reply(found, score(message, texts))
    return asked, retrieve.enrich(found)
