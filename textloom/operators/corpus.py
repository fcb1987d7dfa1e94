"""Preparing a corpus: content dedup, the normalization chain, chunks and the backlog of texts to embed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.html import unescape
from textloom.functions.tables import tables_to_text
from textloom.shared import stored

STEPS = ("meta", "clean_content", "clean_html", "tables", "metadata", "dedup", "synonyms")


def dedup_by_content(docs: DataFrame, content: str, file: str, order: list[Column], state: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """``docs`` with hash, owner and status ('ok' or 'dup').

    A text belongs to the file that ``state`` (hash, owner_filename) names, else to the first in ``order``; a row under its
    owner's name is no duplicate. Rows are grouped by hash with the least row of each taken before the shuffle, so a text
    that many rows share is no burden to one task. Both the owners and the rows need what ``docs`` works out; with ``keep``
    it is stored, else worked out twice."""
    hashed = docs.withColumn("hash", T.content_hash(content))
    hashed = stored(hashed, "hashed") if keep else hashed
    first = hashed.groupBy("hash").agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(file).alias("file"))).alias("first"))
    owners = first.select("hash", F.col("first.file").alias("first_file"))
    if state is not None:
        owners = owners.join(state.select("hash", "owner_filename"), "hash", "left")
        owners = owners.select("hash", F.coalesce("owner_filename", "first_file").alias("owner"))
    else:
        owners = owners.withColumnRenamed("first_file", "owner")
    return hashed.join(owners, "hash").withColumn("status", F.when(F.col(file) == F.col("owner"), "ok").otherwise("dup"))


def hash_state(deduped: DataFrame) -> DataFrame:
    return deduped.where("status = 'ok'").groupBy("hash").agg(F.min("owner").alias("owner_filename"))


def status_counts(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def write_counted(deduped: DataFrame, path: str, failed: Column | None = None) -> dict[str, int]:
    """Writes the rows that are no duplicates and gives how many were ok, dup and err: counted as they pass, in the same job.

    ``failed`` says which rows count as errors; those are not written."""
    err = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    seen = Observation("run")
    rows = deduped.withColumn("_err", err).observe(seen, count(~F.col("_err") & (F.col("status") == "ok"), "ok"), count(~F.col("_err") & (F.col("status") == "dup"), "dup"), count(F.col("_err"), "err"))
    rows.where(~F.col("_err") & (F.col("status") == "ok")).drop("_err").write.mode("overwrite").parquet(path)
    return seen.get


def normalize(docs: DataFrame, steps: tuple[str, ...] = STEPS, state: DataFrame | None = None, root: str = "") -> DataFrame:
    """The normalization chain over (path, value): filename, school, title, url, tags, year, hash, status, content.

    Steps not named are left out; the order is fixed. Paths are relative to ``root`` and sort by their parts."""
    parts = F.split("path", "/")
    df = docs.select("path", F.element_at(parts, -1).alias("filename"), F.coalesce("value", F.lit("")).alias("content")).withColumn("school", T.school_of_file("filename"))
    if "meta" in steps:
        df = df.withColumn("m", T.meta_header("content")).select("path", "filename", "school", "m.content", "m.url", "m.title")
    else:
        df = df.withColumns({"url": F.lit(""), "title": F.lit("")})
    if "clean_content" in steps:
        df = df.withColumn("content", T.clean_content("content"))
    if "clean_html" in steps:
        df = df.withColumn("content", T.clean_markup(unescape("content")))
    if "tables" in steps:
        df = df.withColumn("content", tables_to_text("content"))
    tags, year = F.array().cast("array<string>"), F.lit(None).cast("int")
    if "metadata" in steps:
        folders = T.folder_tags(F.lit(root), "path") if root else F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
        tags, year = F.array_sort(F.array_union(T.detect_tags("content"), folders)), T.detect_year("content")
    df = df.withColumns({"tags": tags, "year": year})
    if "dedup" in steps:
        df = dedup_by_content(df, "content", "filename", [F.split("path", "/")], state, keep=True)
    else:
        df = df.withColumns({"hash": T.content_hash("content"), "status": F.lit("ok")})
    if "synonyms" in steps:
        df = df.withColumn("content", T.expand_acronyms("content"))
    return df.select("path", "filename", "school", F.when(F.col("title") == "", F.col("filename")).otherwise(F.col("title")).alias("title"), "url", "tags", "year", "hash", "status", "content")


def normalized_file(df: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Path and text of each document that is no duplicate, under a header with what the chosen steps found."""
    meta = F.concat_ws(
        "\n",
        F.lit("[META]"),
        F.concat(F.lit("school: "), F.col("school")),
        F.concat(F.lit("tags: "), F.array_join("tags", ",")),
        F.concat(F.lit("year: "), F.coalesce(F.col("year").cast("string"), F.lit(""))),
        F.concat(F.lit("hash: "), F.col("hash")),
    )
    lines = [F.lit("[TITLE]"), F.col("title"), F.lit(""), F.lit("[URL]"), F.col("url"), F.lit("")] if "meta" in steps else []
    lines += [meta, F.lit("")] if "metadata" in steps or "dedup" in steps else []
    lines += [F.lit("---"), F.lit("")] if lines else []
    made = df.where("status = 'ok'").select("path", F.concat_ws("\n", *lines, "content").alias("value"))
    return made.select("path", F.concat(T.rstrip("value"), F.lit("\n")).alias("value"))


def chunk_rows(docs: DataFrame, content: str, keep: list[str], size: int = T.CHUNK, overlap: int = T.OVERLAP) -> DataFrame:
    """A row for each chunk with chunk_id from 1, total_chunks and a null embedding."""
    cut = docs.select(*keep, T.chunks(content, size, overlap).alias("c"))
    rows = cut.select(*keep, F.size("c").alias("total_chunks"), F.posexplode("c").alias("i", "content"))
    return rows.select(*keep, (F.col("i") + 1).alias("chunk_id"), "total_chunks", "content")


def backlog(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("embedding").isNull())


def embed_backlog(chunks: DataFrame, embed) -> DataFrame:
    """``chunks`` with embeddings where there were none; ``embed`` is a pandas UDF on a text, applied to those rows alone."""
    done = chunks.where(F.col("embedding").isNotNull())
    made = backlog(chunks).withColumn("embedding", embed(T.embedding_text("year", "content")))
    return done.unionByName(made.select(done.columns))


BATCH, PADDED, WINDOW_ROWS = 32, 16_384, 1024


def batches_of(lengths: np.ndarray, count: int = BATCH, padded: int = PADDED) -> list[np.ndarray]:
    """Rows in batches of ``count`` at most, by falling length, none of which comes to more than ``padded`` when its rows are
    made as long as its longest; a row longer than that is alone."""
    order, out, lo = np.argsort(-lengths, kind="stable"), [], 0
    while lo < len(order):
        n = max(1, min(count, padded // max(int(lengths[order[lo]]), 1)))
        out.append(order[lo : lo + n])
        lo += n
    return out


def embed_in_batches(chunks: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: Column, count: int = BATCH, padded: int = PADDED) -> DataFrame:
    """``chunks`` with embeddings where there were none. ``load`` makes a model (a function of a list of texts), once for each
    task, not for each batch; texts are taken in windows, sorted by length there, batched by count and by padded size, and
    come back in their order. Rows that have an embedding don't pass through Python."""
    done = chunks.where(F.col("embedding").isNotNull())
    asked = backlog(chunks).drop("embedding").withColumn("_text", F.coalesce(text, F.lit("")))
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for lo in range(0, whole.num_rows, WINDOW_ROWS):
                batch = whole.slice(lo, WINDOW_ROWS)
                model = model or load()
                texts = batch.column(names.index("_text")).to_pylist()
                made: list = [None] * len(texts)
                for rows in batches_of(np.array([len(t) for t in texts]), count, padded):
                    for i, v in zip(rows.tolist(), model([texts[i] for i in rows]), strict=True):
                        made[i] = np.asarray(v, np.float32)
                kept = [batch.column(i) for i, n in enumerate(names) if n != "_text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.list_(pa.float32()))], [*(n for n in names if n != "_text"), "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name != "_text")
    made = asked.mapInArrow(run, f"{fields}, embedding array<float>")
    return done.unionByName(made)


def unseen(frontier: DataFrame, state: DataFrame, key: str = "key", most: int | None = None) -> DataFrame:
    """Rows whose key is in no state table yet, the first ``most`` by key."""
    new = frontier.join(state.select(key), key, "left_anti")
    return new if most is None else new.orderBy(key).limit(most)


def last_of_each(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group; for groups whose size is bounded by what they are (a session, a document)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def folder_counts(files: DataFrame) -> DataFrame:
    """folder, files: the folders that hold files, '' for the top."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
