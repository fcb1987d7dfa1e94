"""Markdown tables as sentences, and rows of recognized text. Python, as cells depend on all that stands before them."""

from __future__ import annotations

import re

from pyspark.sql.types import ArrayType, StringType, StructType

from textloom.functions.rows import by_row

NO_DATA = "không có dữ liệu"
FIELD = "field"
BLOCK = re.compile(r"^[ \t]*\|[^\n]*(?:\n[ \t]*\|[^\n]*)+", re.MULTILINE)
LEAD = re.compile(r"\d{1,3}\.?\d*")
DASHES = {"-", "–", "—", "x", "X", ""}
SCORES = 9
RECORDS = ArrayType(StructType().add("code", StringType()).add("scores", ArrayType(StringType())))


def is_rule(row: str) -> bool:
    """A row of dashes between a table's header and its body."""
    bare = row.strip().strip("|").strip()
    return bool(bare) and all(re.fullmatch(r":?-{3,}:?", c.strip()) for c in bare.split("|"))


def _trimmed(cells: list[str]) -> list[str]:
    lo, hi = 0, len(cells)
    while lo < hi and not cells[lo]:
        lo += 1
    while hi > lo and not cells[hi - 1]:
        hi -= 1
    return cells[lo:hi]


def _value(cell: str) -> str:
    return NO_DATA if cell.upper() == "X" else cell


def table_sentences(table: str) -> str:
    """``name: value, ...`` for each row; the table itself where it has no header or no row."""
    rows = [_trimmed([c.strip() for c in x.strip().strip("|").split("|")]) for x in table.splitlines() if "|" in x and not is_rule(x)]
    while rows and not rows[0]:
        rows.pop(0)
    if not rows:
        return table
    head, out = rows[0], []
    for row in rows[1:]:
        n = len(head)
        if len(row) > n:
            row = [*row[: n - 1], "; ".join(c for c in row[n - 1 :] if c)]
        pairs = [f"{h or FIELD}: {_value(v)}" for h, v in zip(head, row + [""] * (n - len(row)), strict=True) if h or v]
        if pairs:
            out.append(", ".join(pairs))
    return "\n".join(out) or table


def tables_in(text: str) -> str:
    """Each block of two or more table lines in a text replaced by its sentences and a line end; the block's own stays too."""
    return BLOCK.sub(lambda m: table_sentences(m[0]) + "\n", text)


@by_row(StringType())
def table_to_text(text: str | None) -> str | None:
    return None if text is None else table_sentences(text)


@by_row(StringType())
def tables_to_text(text: str | None) -> str | None:
    return None if text is None else tables_in(text)


def score_of(part: str) -> str:
    """The number that a part starts with, '-' for a dash or a cross, else the part itself; commas count as points."""
    part = part.replace(",", ".")
    return "-" if part in DASHES else (LEAD.match(part) or [part])[0]


def parse_row(cells: list[str]) -> list[dict]:
    """A record for each seven-digit code in the first cell that has one, with the scores of the cells after it by place."""
    for i, cell in enumerate(cells):
        if codes := re.findall(r"\b\d{7}\b", cell):
            columns = [c for c in ([score_of(p) for p in cell.split()] for cell in cells[i + 1 :]) if c]
            return [{"code": code, "scores": [*(c[k] if k < len(c) else "-" for c in columns), *["-"] * SCORES][:SCORES]} for k, code in enumerate(codes)]
    return []


@by_row(RECORDS)
def table_records(rows: list[list[str]] | None) -> list[dict]:
    """The records of all rows of a table."""
    return [r for cells in rows or [] for r in parse_row(cells)]


@by_row(RECORDS)
def row_records(cells: list[str] | None) -> list[dict]:
    return parse_row(cells or [])
