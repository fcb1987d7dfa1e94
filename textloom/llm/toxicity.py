"""Toxicity by a weighted finite-state grammar over clauses.

Words map to classes: insult (with a learned weight), threat, target, negation, report. Four small transducers read a
clause's classes: who is addressed, what is denied, what is only reported, what is threatened. Their composition is one
transducer over joint states; the weights it puts out for insults and threats add up to the clause's score. A document's
clause scores are put on a scale from 0 to 1 by a logistic fit."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import pieces
from textloom.llm.labelled import fold, logistic, sigmoid, training_rows
from textloom.shared import discard, stored

PARTS, HELD = 4, 2
CUT = 0.3
MOST_INSULTS = 5_000
LEAST_DOCS, LEAST_CONTEXTS, LEAST_ODDS = 4, 4, 2.5
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Closed classes of the four languages, as whole words.
THREATS = "kill hurt destroy burn beat strangle matar golpear destruir tuer frapper brûler töten schlagen zerstören".split()
TARGETS = "you he she they him her them your their tú usted él ella ellos vosotros tu vous ils elles lui leur du ihr sie er ihn".split()
NEGATIONS = "not never neither nor nunca jamás ne jamais nicht kein keine nie niemals".split()
REPORTS = "said says wrote quoted claimed reported dijo dice escribió citó dit écrit affirme sagte sagt schrieb behauptet".split()
CLOSED = {w: k for words, k in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}


class State(NamedTuple):
    """Words for which each component still remembers what it saw."""

    addressed: int = 0
    denied: int = 0
    reported: int = 0
    threatened: int = 0


SPAN = State(addressed=3, denied=2, reported=6, threatened=3)


def _address(s: int, kind: int) -> tuple[int, float]:
    return (SPAN.addressed, 1.0) if kind == TARGET else (max(0, s - 1), 1.5 if s and kind == INSULT else 1.0)


def _deny(s: int, kind: int) -> tuple[int, float]:
    return (SPAN.denied, 1.0) if kind == NEGATION else (max(0, s - 1), 0.4 if s and kind in (INSULT, THREAT) else 1.0)


def _report(s: int, kind: int) -> tuple[int, float]:
    return (SPAN.reported, 1.0) if kind == REPORT else (max(0, s - 1), 0.6 if s and kind in (INSULT, THREAT, TARGET) else 1.0)


def _threaten(s: int, kind: int) -> tuple[int, float]:
    """A threat counts once its target follows."""
    if kind == THREAT:
        return SPAN.threatened, 0.0
    return (0, 1.0) if s and kind == TARGET else (max(0, s - 1), 0.0)


def composed() -> dict[tuple[State, int], tuple[State, float, float]]:
    """The reachable joint states: (state, class) to (state, factor of an insult's weight, factor of a threat's)."""
    made, todo = {}, [State()]
    while todo:
        s = todo.pop()
        if (s, OTHER) in made:
            continue
        for kind in range(6):
            a, by_target = _address(s.addressed, kind)
            d, by_denial = _deny(s.denied, kind)
            r, by_report = _report(s.reported, kind)
            t, fires = _threaten(s.threatened, kind)
            made[s, kind] = State(a, d, r, t), (kind == INSULT) * by_target * by_denial * by_report, fires * by_report * (0.4 if s.denied else 1.0)
            todo.append(made[s, kind][0])
    return made


THREAT_WEIGHT = 3.0


def clause_score(words: list[str], insults: dict[str, float], machine: dict) -> float:
    state, total = State(), 0.0
    for w in words:
        weight = insults.get(w)
        state, of_insult, of_threat = machine[state, INSULT if weight is not None else CLOSED.get(w, OTHER)]
        total += of_insult * (weight or 0.0) + of_threat * THREAT_WEIGHT
    return total


TRAITS = 4


def traits(texts: list[str], insults: dict[str, float]) -> np.ndarray:
    """Of each text: log of its clause scores' sum, largest clause score, log of the clauses that score, their share of clauses.

    The machine has a few hundred states and is composed anew for each piece of texts: as an object it would be sent to
    executors by name, and they need not have this package."""
    out, machine = np.zeros((len(texts), TRAITS)), composed()
    marks = {*insults, *THREATS}
    for i, t in enumerate(texts):
        low = t.lower()
        if marks.isdisjoint(WORD.findall(low)):
            continue
        clauses = [WORD.findall(c) for c in CLAUSE.split(low)]
        scores = [s for c in clauses if not marks.isdisjoint(c) and (s := clause_score(c, insults, machine))]
        if scores:
            out[i] = np.log1p(sum(scores)), max(scores) / 10, np.log1p(len(scores)), len(scores) / sum(map(bool, clauses))
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a document once, with the word before it where the document is toxic; counted within the piece."""
    for piece in pieces(batches):
        seen: Counter = Counter()
        for label, text in zip(piece["label"], piece["text"], strict=True):
            words = WORD.findall(text.lower())
            first = {}
            for before, w in zip(["", *words], words, strict=False):
                first.setdefault(w, before if label else "")
            seen.update((w, label, b) for w, b in first.items())
        word, label, before = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(label, pa.int32()), pa.array(before, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "label", "before", "n"])


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Words whose log odds of standing in a toxic document are high, in enough documents and after enough different words
    (a passage copied many times gives its words one context). At most ``MOST_INSULTS``, the heaviest."""
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return {}
    counted = rows.mapInArrow(_words, "word string, label int, before string, n long").groupBy("word", "label", "before").agg(F.sum("n").alias("n"))
    toxic = F.col("label") == 1
    words = counted.groupBy("word").agg(F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("good"), F.count(F.when(toxic, 1)).alias("contexts"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    kept = words.where((F.col("bad") >= LEAST_DOCS) & (F.col("contexts") >= LEAST_CONTEXTS)).select("word", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return {r.word: float(r.odds) for r in kept.orderBy(F.desc("odds"), "word").limit(MOST_INSULTS).collect()}


class Model(NamedTuple):
    insults: dict[str, float]
    weights: np.ndarray

    def __call__(self, texts: list[str]) -> np.ndarray:
        return sigmoid(np.c_[traits(texts, self.insults), np.ones(len(texts))] @ self.weights)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From all labelled documents outside the held-out fold; sums over them reach the driver, no texts and no rows.

    Without a toxic row (or without a clean one) every score is the classes' share, smoothed."""
    rows = training_rows(docs, labels, "toxic", PARTS, HELD)
    insults = learn_insults(rows)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(piece["label"], pa.int32()), pa.array(list(traits(piece["text"], insults)), pa.list_(pa.float64()))], ["label", "x"])

    read = stored(rows.mapInArrow(run, "label int, x array<double>"), "traits")
    n, bad = read.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < bad < n:
        share = (bad + 1) / (n + 2)
        return Model(insults, np.r_[np.zeros(TRAITS), np.log(share / (1 - share))])
    model = Model(insults, logistic(read, TRAITS, ridge=1e-2))
    discard(read)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted (1 from 0.3 on) of every document.

    Null and empty texts match no clause; very long texts are read whole. Rows that repeat are scored alike; other columns
    are left out, whatever their names; an empty table gives no rows. Insults are at most ``MOST_INSULTS`` words."""
    model = model or train(docs, labels)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), pa.array(model(piece["text"]), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold("doc_id", PARTS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
