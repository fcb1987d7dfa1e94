"""Document quality by Bradley-Terry ranking.

Each text becomes a few measures of its characters, words and lines. From preference pairs (every good with every bad
labelled document) the logistic loss on the difference of their measures gives the weights; a document's strength is its
weighted sum, put on a scale from 0 to 1 by one more logistic fit.

The pairs are never listed: what a pair adds depends on the two strengths, so documents are summed by class and narrow
ranges of strength, and ranges are set against ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.arrow import pieces
from textloom.llm.labelled import fold, newton, quantile, sigmoid, slopes, summed, training_rows
from textloom.shared import discard, stored

PAIRS = 60_000  # what all pairs weigh together, against the ridge
PARTS, HELD = 3, 1
MEASURES = 12
REACH, STRENGTHS, FINE = 16, 256, 16_384


def _classes() -> np.ndarray:
    """Which bytes each counted class has."""
    sets = [b"*&#$%|!~^<>{}[]\\/=+@_", bytes(range(65, 91)), b"0123456789", b" \t\r\n\v\f", b"\n", b".,;:?'\"-()", bytes(range(128, 192))]
    made = np.zeros((256, len(sets)))
    for i, s in enumerate(sets):
        made[list(s), i] = 1
    return made


def measures(texts: list[str]) -> np.ndarray:
    out, classes = np.zeros((len(texts), MEASURES)), _classes()
    for i, t in enumerate(texts):
        if not t:
            continue
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        shares = np.bincount(raw, minlength=256) @ classes / len(raw)
        words, lines = t.split(), [x for x in t.split("\n") if x]
        n = len(words)
        out[i, :7] = np.sqrt(shares)
        out[i, 7] = sum(map(eq, words, words[1:])) / max(1, n - 1)
        out[i, 8] = np.log1p(len(set(words))) / np.log1p(n) if n else 0
        out[i, 9] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[i, 10] = min(len(t) / max(1, n), 40) / 10
        out[i, 11] = np.log1p(n) / 10
    return out


def strengths(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row is summed on its own, so that it gets the same strength in any batch."""
    return ((x - mean) / scale * weights).sum(1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    cut: float
    """The score quantile at the share of bad rows among those learned from."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * strengths(x, self.mean, self.scale, self.weights) + self.shift)


def _ranges(y: np.ndarray, s: np.ndarray, cols: np.ndarray, ranges: int) -> np.ndarray:
    """Sums of ``cols`` by class (bad, good) and range of strength; the first and the last range are open."""
    at = np.clip((s + REACH) * (ranges / 2 / REACH), 0, ranges - 1).astype(np.int64) + ranges * (y == 1)
    order, out = np.argsort(at, kind="stable"), np.zeros((2 * ranges, cols.shape[1]))
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    out[at[order][first]] = np.add.reduceat(cols[order], first)
    return out.reshape(2, ranges, -1)


def _pair_slopes(sums: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling gradient and second derivatives of the loss over all pairs, from the sums by class and range of 1, strength,
    measures and their products. Within a range the loss's slope is taken as a line."""
    k = len(w)
    bad, good = (c[c[:, 0] > 0] for c in sums)
    (n0, s0, z0, zz0), (n1, s1, z1, zz1) = ((c[:, 0], c[:, 1] / c[:, 0], c[:, 2 : k + 2], c[:, k + 2 :].reshape(-1, k, k)) for c in (bad, good))
    p = sigmoid(s1[:, None] - s0)
    bend = p * (1 - p)
    lost1, lost0, bend1, bend0 = (1 - p) @ n0, n1 @ (1 - p), bend @ n0, n1 @ bend
    falls = lost1 @ z1 - lost0 @ z0 - bend1 @ (zz1 @ w - s1[:, None] * z1) - bend0 @ (zz0 @ w - s0[:, None] * z0)
    cross = z1.T @ bend @ z0
    bends = np.tensordot(bend1, zz1, 1) + np.tensordot(bend0, zz0, 1) - cross - cross.T
    weigh = PAIRS / (n0.sum() * n1.sum())
    return falls * weigh, bends * weigh


def fit(rows: DataFrame) -> Ranking:
    """From all ``rows`` (label, x) labelled 1 (good) or 0. With rows of one class only there is nothing to rank: every score is
    that class's share, smoothed."""
    k, rows = MEASURES, rows.where("label in (0, 1)")
    total = summed(rows, lambda y, x: np.r_[len(y) - y.sum(), y.sum(), x.sum(0)])
    bad, good, *sums = total if total is not None else np.zeros(k + 2)
    n, share = good + bad, (good + 1) / (good + bad + 2)
    mean, scale = np.zeros(k), np.ones(k)
    if n:
        mean = np.array(sums) / n
        scale = np.sqrt(summed(rows, lambda y, x: ((x - mean) ** 2).sum(0)) / n) + 1e-6
    if not good or not bad:
        return Ranking(mean, scale, np.zeros(k), 0.0, float(np.log(share / (1 - share))), 0.0)

    def ranged(y, x, w):
        z, s = (x - mean) / scale, strengths(x, mean, scale, w)
        return _ranges(y, s, np.c_[np.ones(len(s)), s, z, (z[:, :, None] * z[:, None]).reshape(len(s), -1)], STRENGTHS)

    weights = newton(k, lambda w: _pair_slopes(summed(rows, lambda y, x: ranged(y, x, w)), w), ridge=1.0, least=1e-6)

    def placed(y, x):
        s = strengths(x, mean, scale, weights)
        return _ranges(y, s, np.c_[np.ones(len(s)), s], FINE)

    held = summed(rows, placed)
    known = held[..., 0] > 0
    weight, label = held[known][:, 0], np.nonzero(known)[0]
    x = np.c_[held[known][:, 1] / weight, np.ones(len(weight))]

    def at(w):
        made = slopes(x, label, w, weight)
        return made[0], made[1:]

    slope, shift = newton(2, at, ridge=1e-3)
    ranking = Ranking(mean, scale, weights, float(slope), float(shift), 0.0)

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)), pa.float64())], ["score"])

    made = stored(rows.mapInArrow(scores, "score double"), "scores")
    ranking.cut = quantile(made, "score", 1 - share)
    discard(made)
    return ranking


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array(piece["label"], pa.int32()), pa.array(list(measures(piece["text"])), pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Learn from all labelled documents outside the held-out fold; sums over their measures reach the driver, no texts and no rows."""
    rows = stored(training_rows(docs, labels, "quality", PARTS, HELD).mapInArrow(_measured, "label int, x array<double>"), "measured")
    ranking = fit(rows)
    discard(rows)
    return ranking


def scored(docs: DataFrame, ranking: Ranking, score: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``score``, whose name must be free. Null and empty texts get the score of no text at all; very
    long texts are read whole, a bounded number of characters at a time. Rows that repeat are scored alike; an empty table
    stays empty."""

    def run(batches):
        for batch in batches:
            at = 0
            for piece in pieces(iter([batch.select(["text"])])):
                part = batch.slice(at, len(piece["text"]))
                at += len(piece["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ranking(measures(piece["text"])), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted (1 from 0.5 on) of every document.

    Null and empty texts get the score of no text; very long texts are read whole. Rows that repeat are scored alike; other
    columns are left out, whatever their names; an empty table gives no rows."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    score = F.col("quality_score")
    return rows.select("doc_id", F.coalesce(fold("doc_id", PARTS) == HELD, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns, without those that score under the ranking's quantile and under 0.5: where few
    documents are bad, the quantile alone would also reject good ones. Nulls, empty and very long texts, repeated rows and
    empty tables are as for ``scored``; a column of any name comes through as it is."""
    score = next(n for n in (f"score_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return scored(docs, ranking, score).where(F.col(score) >= min(ranking.cut, 0.5)).select(docs.columns)
