"""Queries of the retrieval indexes, with the SQL of what they must find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import fuzzy_join, lookup, text_index, vector_index
from textloom.plans.catalog import query
from textloom.shared import shared_path, stored, table
from textloom.streaming import state

_ASKED = "select vec_id as query, embedding as asked from embeddings where vec_id % 20 = 0"


@query(f"""select query, vec_id, round(s, 6) as score, rank from (select query, vec_id, s, row_number() over (partition by query order by s desc, vec_id)::int as rank
from (select q.query, e.vec_id, (1 + list_cosine_similarity(e.embedding::double[], q.asked::double[])) / 2 as s from embeddings e, ({_ASKED}) q)) where rank <= 10""")
def vector_neighbours(spark, sf_dir):
    """The ten nearest of every twentieth vector, exactly."""
    rows = table(spark, sf_dir, "embeddings")
    found = vector_index.search_all(rows, rows.where("vec_id % 20 = 0"), "vec_id", "vec_id")
    return found.select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query()
def vector_index_neighbours(spark, sf_dir):
    """The same by the index, with its production parameters: all rows are in it."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.build(rows, "vec_id", shared_path(spark, "vector_index"))
    found = vector_index.search(index, rows.where("vec_id % 20 = 0"), "vec_id")
    return found.select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


# Patterns that the index serves from postings, among them one that it must try on all texts.
PATTERNS = ["mit licen[cs]e", r"(all|some) rights\s+reserved", "thing.*(tion|ung) ", "é(au|ch)x?e", r"[0-9]{4}"]
_MATCHED = " union all ".join(f"select {i} as pattern, doc_id from documents where regexp_matches(text, '{p}', 'i')" for i, p in enumerate(PATTERNS))


@query(_MATCHED)
def text_index_search(spark, sf_dir):
    """All texts that match each of a few patterns, by the trigram index."""
    index = text_index.build(table(spark, sf_dir, "documents"), "doc_id", shared_path(spark, "text_index"))
    found = [text_index.search(index, p).select(F.lit(i).alias("pattern"), F.col("key").alias("doc_id")) for i, p in enumerate(PATTERNS)]
    return reduce(DataFrame.union, found)


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_PAIRS = f"(select distinct w[i] || ' ' || w[i + 1] as phrase from (select w, unnest(range(1, len(w))) as i from (select {_WORDS} as w from benchmark)))"


def _words():
    return F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _pairs(spark, sf_dir):
    """Pairs of neighbouring words of the benchmark as a dictionary in their own order."""
    w = table(spark, sf_dir, "benchmark").select(_words().alias("w")).where("size(w) > 1")
    phrases = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))).alias("phrase")).distinct()
    return lookup.numbered(phrases.withColumn("value", F.col("phrase")), "phrase")


@query(f"select doc_id, coalesce(min(phrase), '') as value from documents left join {_PAIRS} on contains(lower(text), phrase) group by doc_id")
def lookup_first(spark, sf_dir):
    """The first of many phrases that stands in each document."""
    return lookup.first_match(table(spark, sf_dir, "documents"), "doc_id", "text", _pairs(spark, sf_dir))


@query(f"select conv_id * 1000 + turn as message, coalesce(array_to_string(list_sort(list(phrase) filter (phrase is not null)), ','), '') as tags from conversations left join {_PAIRS} on contains(lower(text), phrase) group by all")
def lookup_tags(spark, sf_dir):
    """All phrases in each message."""
    messages = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), "text")
    return lookup.tags(messages, "message", "text", _pairs(spark, sf_dir)).select("message", F.array_join("tags", ",").alias("tags"))


# The longest common subsequence by its table, a row for each letter of one word, as lists of numbers.
_COMMON = """list_reduce(list_concat([list_transform(range(len(y) + 1), lambda i: 0)], list_transform(range(1, len(x) + 1), lambda i: [ord(x[i])])),
lambda row, c: list_transform(range(1, len(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], case when k > 1 and ord(y[k - 1]) = c[1] then row[k - 1] + 1 else 0 end)))))[-1]"""


@query(f"""with w as (select distinct w as x from (select unnest({_WORDS}) as w from benchmark) where length(w) > 3),
p as (select a.x, b.x as y from w a join w b on a.x < b.x and 2 * least(length(a.x), length(b.x)) >= 0.8 * (length(a.x) + length(b.x)))
select x as a, y as b, round(s, 6) as score from (select x, y, 200.0 * {_COMMON} / (length(x) + length(y)) as s from p) where s >= 80""")
def fuzzy_words(spark, sf_dir):
    """Pairs of the benchmark's words that are alike."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(_words()).alias("w")).where("length(w) > 3")
    found = fuzzy_join.alike(words, "w", words, "w", 80)
    return found.where("a < b").select("a", "b", F.round("score", 6).alias("score"))


# Of each message a second-long turn of its conversation; what ends in "tion" is what the conversation is about from there on.
_EVENTS = r"select conv_id, turn, text, nullif(regexp_extract(text, '([A-Za-z]+tion)', 1), '') as about from conversations"


def _conversation(spark, sf_dir):
    """The events of all conversations: an entity before the message that names it."""
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    base = rows.select(F.col("conv_id").cast("string").alias("session"), F.timestamp_seconds(F.col("turn") + 1).alias("at"), "turn", "text", F.nullif(F.regexp_extract("text", r"([A-Za-z]+tion)", 1), F.lit("")).alias("about"))
    said = base.select("session", "at", (2 * F.col("turn") + 1).alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("text").alias("value"))
    named = base.where("about is not null").select("session", "at", (2 * F.col("turn")).alias("seq"), F.lit("entity").alias("kind"), F.lit("school").alias("name"), F.col("about").alias("value"))
    return said.union(named)


def _states(spark, sf_dir):
    """The events written as a few files, which the stream takes one by one."""
    events = stored(_conversation(spark, sf_dir), "events")
    stream = spark.readStream.schema(events.schema).parquet(events.stored_at)
    return state.run_to_end(state.session_states(stream, late="1 hour"), shared_path(spark, "sessions"))


@query(f"""select conv_id::varchar as session, count(*) as n, array_to_string(list(text order by turn)[-5:], '|') as history, coalesce(last(about order by turn) filter (about is not null), '') as about
from ({_EVENTS}) group by conv_id""")
def session_state_stream(spark, sf_dir):
    """The state that the streaming operator leaves for each conversation."""
    rows = state.latest(_states(spark, sf_dir))
    return rows.select("session", "n", F.array_join("history", "|").alias("history"), F.coalesce(F.element_at("entities", F.lit("school")), F.lit("")).alias("about"))


@query(f"select conv_id::varchar as session, turn, last_value(about ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as about from ({_EVENTS})")
def sticky_entity_stream(spark, sf_dir):
    """What each message is about, as the streaming operator tells it."""
    rows = _states(spark, sf_dir).where("event = 'message'")
    return rows.select("session", F.expr("seq div 2").alias("turn"), F.col("resolved").alias("about"))
