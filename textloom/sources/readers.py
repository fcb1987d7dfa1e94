"""Text, link and attachment files as DataFrames."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.links import content_type
from textloom.operators.crawl import link_rows, picture_texts


PLAIN = {"md", "txt", "json"}  # suffixes of files that Spark's reader doesn't unpack
FILE_BYTES, FILES = 4_000_000, 1000


def _local(spark: SparkSession, root: str) -> str | None:
    """The folder on disk that ``root`` names, where it is one on the disk that driver and executors share."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = files.makeQualified(path).toUri()
    return at.getPath() if at.getScheme() == "file" and files.exists(path) and files.getFileStatus(path).isDirectory() else None


def _walk(base: str, named: str, deep: bool):
    """path and folder (true or false) of what is in ``base`` and, if ``deep``, below the folders that come in."""

    def seen(name: str) -> bool:  # as Spark's readers skip names
        hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
        return not hidden or name.startswith(("_metadata", "_common_metadata"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool]]:
        todo = [p for b in batches for p in b.column("path").to_pylist()]
        while todo:
            at = todo.pop()
            with os.scandir(f"{base}/{at}") as entries:
                for e in entries:
                    if not seen(e.name):
                        continue
                    if e.is_dir():
                        if deep:
                            todo.append(f"{at}{e.name}/")
                        else:
                            yield f"{at}{e.name}/", True
                    elif e.is_file() and re.fullmatch(named, e.name):
                        yield f"{at}{e.name}", False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while some := list(islice(rows, 10_000)):
            paths, folders = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders)], ["path", "folder"])

    return run


def _contents(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())], ["path", "value"])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open(f"{base}/{path}", "rb") as file:
                    value = file.read()
                if not value:
                    continue  # as Spark's reader does
                rows.append((path, value))
                size += len(value)
                if size >= FILE_BYTES or len(rows) >= FILES:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return run


def text_files(spark: SparkSession, root: str, pattern: str = "*.{md,txt}", recursive: bool = True) -> DataFrame:
    """path (relative to ``root``, sorting by its parts) and value of each file; dotfiles, caches and empty files are left out.

    A folder on a shared disk is listed and read by executors. Spark's reader, which takes all else, keeps a record of each file
    in the driver's memory."""
    shown = ~F.col("path").rlike(r"(^|/)(\.|__pycache__/)")
    suffixes = re.fullmatch(r"\{?([\w,]+)\}?", pattern.rpartition(".")[2])
    if recursive and suffixes and set(suffixes[1].split(",")) <= PLAIN and (base := _local(spark, root)):
        named = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        tasks = 4 * spark.sparkContext.defaultParallelism
        top = spark.range(0, 1, 1, 1).select(F.lit("").alias("path")).mapInArrow(_walk(base, named, False), "path string, folder boolean")
        below = top.where("folder").select("path").repartition(tasks).mapInArrow(_walk(base, named, True), "path string, folder boolean")
        files = top.where("not folder").union(below).select("path").where(shown)
        return files.repartition(tasks).mapInArrow(_contents(base), "path string, value binary").select("path", F.col("value").cast("string").alias("value"))
    rows = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), rf"^(?:[a-z]+:)?/*?{base}/", "")
    return rows.select(path.alias("path"), "value").where(shown)


def one_file(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict]:
    """The file ``name`` (path, value) of a folder, and the run's report: without the file no rows, and an error counted."""
    rows = text_files(spark, root, name.rsplit("/", 1)[-1]).where(F.col("path") == name)
    found = not rows.isEmpty()
    return rows, {"ok": found, "stats": {"ok": 0, "dup": 0, "err": 0 if found else 1}}


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, empty where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def link_files(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    rows = link_rows(text_files(spark, root, "*.json", recursive=False))
    return rows if source is None else rows.where(F.col("source_id") == source)


def binary_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(blob: bytes) -> str:
    """Paragraphs, then the rows of tables with their cells between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(blob)).read("word/document.xml"))[0]
    said = lambda x: "".join(n.text or "" for n in x.iter(f"{WORD}t")).strip()
    lines = [said(p) for p in body.findall(f"{WORD}p")]
    lines += [" | ".join(said(c) for c in r.findall(f"{WORD}tc")) for r in body.iter(f"{WORD}tr")]
    return "\n".join(x for x in lines if x)


def xlsx_text(blob: bytes) -> str:
    """Every sheet under its name, a line for each row that has something in it."""
    book = zipfile.ZipFile(io.BytesIO(blob))
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet")]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(n.text or "" for n in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
    out = []
    for i, name in enumerate(names, 1):
        out.append(f"## {name}")
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{SHEET}row"):
            cells = []
            for c in row.findall(f"{SHEET}c"):
                v = c.find(f"{SHEET}v")
                raw = v.text if v is not None else "".join(n.text or "" for n in c.iter(f"{SHEET}t"))
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw or "")
            if any(x.strip() for x in cells):
                out.append(" | ".join(cells))
    return "\n".join(out)


def pdf_text(blob: bytes) -> str | None:
    """Pages with blank lines between them; null where no PDF reader is installed."""
    try:
        import fitz
    except ImportError:
        return None
    return "\n\n".join(p.get_text() for p in fitz.open(stream=blob, filetype="pdf"))


EXTRACTORS = {"docx": docx_text, "doc": docx_text, "xlsx": xlsx_text, "xls": xlsx_text, "pdf": pdf_text}


@F.pandas_udf(StringType())
def extracted(content: pd.Series, kind: pd.Series) -> pd.Series:
    """Text of attachments by type; null for types without a reader and for files that can't be read."""

    def one(blob, k):
        try:
            return EXTRACTORS[k](bytes(blob)) if k in EXTRACTORS else None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    return pd.Series([one(b, k) for b, k in zip(content, kind, strict=True)], dtype=object)


def attachments(files: DataFrame, recognize: Callable[[Column], Column] | None = None) -> DataFrame:
    """url, type, text of fetched files (url, content): the text by a reader where the type has one, of pictures by the
    caller's ``recognize`` (of a content, as ``crawl.picture_texts`` takes it), null where that finds too little."""
    kind = content_type("url")
    out = files.select("url", kind.alias("type"), extracted("content", kind).alias("text"))
    if recognize is None:
        return out
    pictures = files.where(kind == "image").select("url", F.col("content").alias("picture"))
    read = picture_texts(pictures, recognize).select("url", F.col("text").alias("_read")).dropDuplicates(["url"])
    return out.join(read, "url", "left").select("url", "type", F.coalesce("text", "_read").alias("text"))
