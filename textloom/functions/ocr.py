"""Pictures made ready for recognition, and tokens of recognized text as rows of a table: folds over arrays of
(cy, cx, h, text)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from textloom.functions.text import bound, col

ROW_GAP, JOIN_GAP = 0.020, 1.2
TOKEN = "struct<cx:double,h:double,text:string>"


PICTURE = StructType([*(StructField(n, IntegerType()) for n in ("height", "width", "nChannels", "mode")), StructField("data", BinaryType())])
LOBES = 3


def _doubled(rows: np.ndarray) -> np.ndarray:
    """Rows of samples at twice the rate, by a windowed sinc of ``LOBES`` lobes; weights are scaled to one at the edges."""
    n = rows.shape[1]
    center = (np.arange(2 * n) + 0.5) / 2
    taps = np.floor(center).astype(int)[:, None] + np.arange(-LOBES, LOBES + 1)
    x = center[:, None] - (taps + 0.5)
    weights = np.where((np.abs(x) < LOBES) & (taps >= 0) & (taps < n), np.sinc(x) * np.sinc(x / LOBES), 0)
    weights = (weights / weights.sum(1, keepdims=True)).astype(np.float32)
    out = np.zeros((len(rows), 2 * n), np.float32)
    for k in range(taps.shape[1]):
        out += rows[:, np.clip(taps[:, k], 0, n - 1)] * weights[:, k]
    return out


def ready(pixels: np.ndarray) -> np.ndarray:
    """(height, width, channels) of blue, green, red, or of gray, as gray with twice the contrast and twice the size."""
    p = pixels.astype(np.float32)
    gray = np.round(p[..., 2] * 0.299 + p[..., 1] * 0.587 + p[..., 0] * 0.114) if p.shape[2] >= 3 else p[..., 0]
    mean = np.floor(gray.mean() + 0.5)
    gray = np.clip(2 * gray - mean, 0, 255)
    return np.clip(np.round(_doubled(_doubled(gray).T).T), 0, 255).astype(np.uint8)


@F.pandas_udf(PICTURE)
def prepared(picture: pd.DataFrame) -> pd.DataFrame:
    """Pictures as Spark's image source gives them, made ready for recognition; null where a picture couldn't be read."""
    out = []
    for h, w, n, data in zip(picture["height"], picture["width"], picture["nChannels"], picture["data"], strict=True):
        if data is None or not h > 0 or not w > 0:
            out.append((None, None, None, None, None))
        else:
            made = ready(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n)))
            out.append((made.shape[0], made.shape[1], 1, 0, made.tobytes()))
    made = pd.DataFrame(out, columns=["height", "width", "nChannels", "mode", "data"])
    return made.astype({c: "Int32" for c in ("height", "width", "nChannels", "mode")})


def token_rows(tokens: Column | str, height: Column | str, gap: float = ROW_GAP) -> Column:
    """Tokens from top to bottom, in rows: a token within ``gap`` of the picture's height of the row's running centre joins it
    and moves that centre half way. Within a row from left to right."""
    start = F.struct(F.array().cast(f"array<array<{TOKEN}>>").alias("done"), F.array().cast(f"array<{TOKEN}>").alias("row"), F.lit(None).cast("double").alias("y"))
    usable = F.array_sort(F.transform(F.filter(col(tokens), lambda t: F.trim(t["text"]) != ""), lambda t: F.struct(t["cy"].alias("cy"), t["cx"].alias("cx"), t["h"].alias("h"), F.trim(t["text"]).alias("text"))))

    def step(a: Column, t: Column) -> Column:
        one = F.array(F.struct(t["cx"].alias("cx"), t["h"].alias("h"), t["text"].alias("text")).cast(TOKEN))
        joins = a["y"].isNull() | (F.abs(t["cy"] - a["y"]) <= F.lit(gap) * col(height))
        more = F.struct(a["done"].alias("done"), F.concat(a["row"], one).alias("row"), F.coalesce((a["y"] + t["cy"]) / 2, t["cy"]).alias("y"))
        return F.when(joins, more).otherwise(F.struct(F.concat(a["done"], F.array(F.array_sort(a["row"]))).alias("done"), one.alias("row"), t["cy"].alias("y")))

    return F.aggregate(usable, start, step, lambda a: F.when(F.size(a["row"]) > 0, F.concat(a["done"], F.array(F.array_sort(a["row"])))).otherwise(a["done"]))


def merged_cells(row: Column | str, gap: float = JOIN_GAP) -> Column:
    """Texts of a row, neighbours joined where the room between them is small for the height of the cell's first token."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("end"), F.lit(0.0).alias("h"))

    def step(a: Column, t: Column) -> Column:
        end = t["cx"] + t["h"] * gap
        fresh = F.struct(F.when(a["text"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["text"]))).alias("done"), t["text"].alias("text"), end.alias("end"), t["h"].alias("h"))
        joined = F.struct(a["done"].alias("done"), F.concat(a["text"], F.lit(" "), t["text"]).alias("text"), end.alias("end"), a["h"].alias("h"))
        return F.when(a["text"].isNotNull() & (t["cx"] - a["end"] < a["h"] * gap), joined).otherwise(fresh)

    return F.aggregate(col(row), start, step, lambda a: F.when(a["text"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["text"]))))


# The columns of a score table.
COLUMNS = ["Ngành", "Mã ngành", "THPT", "ĐGNL/TSA", "SAT", "ACT", "HSA", "SPT", "APT", "Kết hợp", "TTNV"]
LEAST_TABLE, LEAST_TEXT = 30, 20


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_rows(records: Column | str, section: str = "") -> Column:
    """A markdown table of (code, scores) records, with a header; the name's column is empty. '' without records."""
    head = F.lit((f"\n## {section}\n\n" if section else "") + "| " + " | ".join(COLUMNS) + " |\n|" + "---|" * len(COLUMNS) + "\n")
    lines = F.transform(col(records), lambda r: _line(F.concat(F.array(F.lit(""), r["code"]), r["scores"])))
    return F.when(F.size(col(records)) > 0, F.concat(head, F.array_join(lines, "\n"))).otherwise("")


def generic_table(rows: Column | str) -> Column:
    """Rows of cells as a markdown table if the first has two or more and the next ones (ten in all) as many, else as lines."""
    kept = F.filter(F.transform(col(rows), lambda r: F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: c != "")), lambda r: F.size(r) > 0)

    def made(ls: Column) -> Column:
        n = F.size(F.get(ls, F.lit(0)))
        even = (F.size(ls) >= 2) & (n >= 2) & F.forall(F.slice(ls, 1, 10), lambda r: F.size(r) == n)
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), n))
        table = F.concat_ws("\n", _line(ls[0]), rule, F.array_join(F.transform(F.slice(ls, F.lit(2), F.size(ls)), _line), "\n"))
        return F.when(even, table).otherwise(F.array_join(F.transform(ls, lambda r: F.array_join(r, " | ")), "\n"))

    return bound(kept, made)


def picture_text(tables: Column | str, generic: Column | str) -> Column:
    """What stands for a picture in its page: its score table, else what else was read; null if that is too little to keep."""
    t, g = col(tables), col(generic)
    text = F.when(F.length(F.trim(F.coalesce(t, F.lit("")))) >= LEAST_TABLE, t).otherwise(g)
    return F.when(F.length(F.trim(text)) > LEAST_TEXT, text)


def table_page(url: Column | str, title: Column | str, tables: Column | str) -> Column:
    """The tables of a page's pictures as one text with its header, and the number of rows as they are counted there."""
    t, u = col(tables), col(url)
    name = F.when(F.coalesce(col(title), F.lit("")) == "", u).otherwise(col(title))
    text = F.concat(F.lit("["), name, F.lit("]\n[URL: "), u, F.lit("]\n\n# "), name, F.lit("\n"), F.array_join(t, "\n\n"), F.lit("\n"))
    rows = F.aggregate(F.transform(t, lambda x: F.regexp_count(x, F.lit(r"\n\| "))), F.lit(0), lambda a, x: a + x)
    return F.struct(F.when(F.size(t) > 0, text).otherwise("").alias("text"), rows.alias("rows"))
