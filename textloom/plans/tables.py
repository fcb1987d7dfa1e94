"""Queries of keyed tables, hash states, pages and counted writes, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import corpus, pages
from textloom.plans.catalog import _HASH, query
from textloom.shared import shared_path, table
from textloom.sources import hash_state, keyed


@query("""select doc_id, case when doc_id % 50 = 7 then 'changed ' || doc_id else text end as text, source from documents where doc_id % 50 <> 9
union all select -1 - doc_id, lang, source from documents where doc_id % 100 = 3""")
def keyed_changes(spark, sf_dir):
    """Edits, deletions and new rows by key: only the buckets that hold them are written."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", "source")
    made = keyed.create(docs, shared_path(spark, "keyed"), "doc_id", 32)
    edits = docs.where("doc_id % 50 = 7").select("doc_id", F.concat(F.lit("changed "), "doc_id").alias("text"))
    made.change(edits, delete=docs.where("doc_id % 50 = 9"))
    new = table(spark, sf_dir, "documents").where("doc_id % 100 = 3").select((-1 - F.col("doc_id")).alias("doc_id"), F.col("lang").alias("text"), "source")
    made.change(new)
    return made.read()


@query(f"""with h as (select doc_id, {_HASH} as hash from documents), s as (select hash, min(doc_id) as owner from h where doc_id % 2 = 0 group by hash),
o as (select hash, min(doc_id) as first from h where doc_id % 2 = 1 group by hash)
select doc_id, hash, case when doc_id = coalesce(owner, first) then 'ok' else 'dup' end as status from h join o using (hash) left join s using (hash) where doc_id % 2 = 1""")
def hash_state_dedup(spark, sf_dir):
    """Odd documents against the state that the even ones left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("file"))
    even = corpus.T.content_hash("text")
    owners = docs.where("doc_id % 2 = 0").groupBy(even.alias("hash")).agg(F.min("doc_id").cast("string").alias("owner_filename"))
    state = hash_state.create(spark, shared_path(spark, "hash_state"), docs.count(), owners)
    return state.dedup(docs.where("doc_id % 2 = 1"), "text", "file", [F.col("doc_id")]).select("doc_id", "hash", "status")


@query("select number, doc_id, lang from (select doc_id, lang, (row_number() over (order by doc_id desc) - 1) // 20 + 1 as number from documents) where number in (1, 4, 7)")
def deep_pages(spark, sf_dir):
    """Pages of the documents, each from the file that holds it."""
    made = pages.write_paged(table(spark, sf_dir, "documents").select("doc_id", "lang"), shared_path(spark, "paged"), "doc_id")
    first, *rest = (made.page(n).select(F.lit(n).cast("long").alias("number"), "doc_id", "lang") for n in (1, 4, 7))
    for p in rest:
        first = first.union(p)
    return first


@query(f"""with h as (select source, doc_id % 10 = 9 as err, case when doc_id = min(doc_id) over (partition by {_HASH}) then 'ok' else 'dup' end as status from documents)
select count(*) filter (not err and status = 'ok') as ok, count(*) filter (not err and status = 'dup') as dup, count(*) filter (err) as err from h""")
def counted_run(spark, sf_dir):
    """What a run wrote, found twice and failed on, counted as it wrote."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    deduped = corpus.dedup_by_content(docs, "text", "file", [F.col("doc_id")])
    counts = corpus.write_counted(deduped, shared_path(spark, "run"), F.col("doc_id") % 10 == 9)
    return spark.createDataFrame([(counts["ok"], counts["dup"], counts["err"])], "ok long, dup long, err long")


def _letters():
    """A model in the place of a real one: how long a text is and how many of its letters are "e"."""
    return lambda texts: np.array([[len(t), t.count("e")] for t in texts])


@query("select doc_id, length(text)::bigint as letters, (length(text) - length(replace(text, 'e', '')))::bigint as es from documents")
def embedded_batches(spark, sf_dir):
    """Every document through a model in batches of bounded size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("array<float>").alias("embedding"))
    made = corpus.embed_in_batches(docs, _letters, F.col("text"))
    return made.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("letters"), F.get("embedding", F.lit(1)).cast("long").alias("es"))
