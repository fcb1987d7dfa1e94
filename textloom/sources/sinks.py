"""Written tables and files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.shared import stored


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may read from: staged in the shared folder first."""
    stored(df, "staged").write.mode("overwrite").parquet(path)


def write_texts(df: DataFrame, root: str) -> int:
    """(path, value) rows as files of their own at ``root``/path; the number of files.

    Executors write through Arrow's file systems, so ``root`` is a URI that those know, or a plain path on a shared disk. A
    file that is written again, as by a task that is run anew, gets the same contents. Paths must not lead out of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leads out of the folder")
                files.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{base}/{path}") as out:
                    out.write((value or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select("path", "value").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_state(df: DataFrame, path: str) -> None:
    """A state table (hashes, crawled URLs) in place of the one at ``path``, which ``df`` may have been read from."""
    replace(df, path)
