"""Walking Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PIECE_CHARS = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_CHARS) -> Iterator[dict[str, list]]:
    """Columns of the batches as lists, cut so that the texts of a piece have ``limit`` characters at most (or it is one row).

    Null texts come as ''."""
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != text}
        column, lo, size, texts = batch.column(batch.schema.names.index(text)), 0, 0, []
        for i, v in enumerate(column):
            t = v.as_py() or ""
            if texts and size + len(t) > limit:
                yield {n: c[lo:i] for n, c in cols.items()} | {text: texts}
                lo, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        if texts:
            yield {n: c[lo:] for n, c in cols.items()} | {text: texts}
