"""Labelled rows for training, and logistic fits on tables of measures, whose rows never come to the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.shared import stored

BROADCAST_ROWS = 1_000_000
BINS, MOST = 4096, 100_000


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's digits, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, few: int = BROADCAST_ROWS) -> DataFrame:
    """``label`` and text of all labelled documents outside the held-out fold.

    Rows with a null id or label are left out; of labels that repeat an id, the larger counts. More than ``few`` labels are not
    broadcast: the texts are shuffled, and what is joined is stored."""
    known = labels.where(F.col(label).isNotNull() & (fold("doc_id", parts) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = stored(known, "labels")
    small = known.count() <= few
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold("doc_id", parts) != held)
    rows = texts.join(F.broadcast(known) if small else known, "doc_id").select("label", "text")
    return rows if small else stored(rows, "training")


def summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``sums`` of the labels and measures of ``rows`` (label, x), which adds up over batches; none without rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                made = sums(batch.column("label").to_numpy().astype(float), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([list(total.shape)])], ["total", "shape"])

    total = None
    for r in rows.mapInArrow(run, "total binary, shape array<long>").collect():
        made = np.frombuffer(r.total).reshape(r.shape)
        total = made if total is None else total + made
    return total


def quantile(rows: DataFrame, column: str, q: float, most: int = MOST) -> float:
    """As numpy's. Ever narrower ranges are counted, until ``most`` values at most are left to be sorted."""
    c = F.col(column)
    n, *ends = rows.agg(F.count(c), F.min(c), F.max(c)).first()

    def ranked(rank: int) -> float:
        held, (lo, hi) = n, ends
        while held > most and lo < hi:
            bin_ = F.least(F.floor((c - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
            for b in rows.where(c.between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy("b").collect():
                if rank < b.n:
                    break
                rank -= b.n
            held, lo, hi = b.n, b.lo, b.hi
        return lo if lo == hi else sorted(v for (v,) in rows.where(c.between(lo, hi)).select(c).collect())[rank]

    at = q * (n - 1)
    low = ranked(int(at))
    return low + (ranked(int(at) + 1) - low) * (at - int(at)) if at > int(at) else low


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def newton(k: int, slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], ridge: float, steps: int = 30, least: float = 1e-9) -> np.ndarray:
    """The ``k`` weights that minimise a loss plus ``ridge`` * |w|^2 / 2, by Newton's method; ``slopes`` gives the loss's falling
    gradient and its second derivatives at w. Weights are rounded, as last digits depend on how rows are dealt to tasks."""
    w = np.zeros(k)
    for _ in range(steps):
        falls, bends = slopes(w)
        step = np.linalg.solve(bends + ridge * np.eye(k), falls - ridge * w)
        w += step
        if np.abs(step).max() < least:
            break
    return np.round(w, 9)


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Of the logistic loss of rows that weigh ``weight`` each: its falling gradient above its second derivatives."""
    p = sigmoid(x @ w)
    return np.vstack([(weight * (y - p)) @ x, (x * (weight * p * (1 - p))[:, None]).T @ x])


def logistic(rows: DataFrame, k: int, ridge: float) -> np.ndarray:
    """Weights of the logistic loss over ``rows`` (label, x), ``k`` measures each and a last one of 1."""

    def at(w):
        total = summed(rows, lambda y, x: slopes(np.c_[x, np.ones(len(x))], y, w))
        return total[0], total[1:]

    return newton(k + 1, at, ridge)
