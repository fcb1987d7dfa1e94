"""Sampling documents so that their tokens meet target shares, by DataFrame functions alone.

Tokens are counted for each cell of source, language and topic. Iterative proportional fitting rakes the cells' weights to
the target shares of each dimension in turn until all hold; a document's probability is its cell's weight for each token,
scaled so that the largest is one."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.shared import stored

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.9
ROUNDS, CLOSE = 200, 1e-6
ONE_TASK_CELLS = 100_000
SEED = 17
# Topics by words that speak for them; a text has the first of those with the most of its words, or 'other'.
TOPICS = {
    "legal": ["license", "licence", "copyright", "rights", "reserved", "terms", "released", "warranty", "permission"],
    "contact": ["email", "mail", "phone", "contact", "call", "com", "org", "example", "www", "http", "https"],
    "technical": ["password", "secret", "token", "key", "api", "apikey", "server", "config", "akia"],
}


def n_tokens(text: str) -> Column:
    """Runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: str, topics: dict[str, list[str]]) -> Column:
    """The topic with the most different words in a text; the first listed wins ties; 'other' without any."""
    if not topics:
        return F.lit("other")
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    counts = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))) for ws in topics.values()]
    ranked = F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, c) in enumerate(zip(topics, counts, strict=True))])
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["name"]).otherwise("other")


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """Target shares that flatten the observed ones: share ** power, scaled to sum to one."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    raised = sums.select(F.col(dimension).alias("value"), F.pow("t", F.lit(power)).alias("r"))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("r").alias("all")))).select("value", (F.col("r") / F.col("all")).alias("share"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE, one_task: int = ONE_TASK_CELLS) -> DataFrame:
    """``cells`` (the dimensions, tokens) with ``w``, raked so that each dimension's weights have its target shares.

    A value that has no target, or whose cells hold no tokens, keeps weight 0; targets of values without tokens are left out
    and the rest scaled up. Stops once every share is within ``close`` of its target. Where no weights of these cells can
    meet the targets, or ``rounds`` were not enough, a warning gives the widest gap that is left. Cells are as many as there
    are combinations of values: up to ``one_task`` of them are raked in one task, more are summed and joined over the
    cluster."""
    small = cells.count() <= one_task
    for d, t in targets.items():
        share = t.select(F.col("value").alias("v"), F.col("share").alias("s"))
        here = cells.where("tokens > 0").select(F.col(d).alias("here")).distinct()
        share = share.join(here, share["v"].eqNullSafe(here["here"]), "left_semi")
        share = share.crossJoin(F.broadcast(share.agg(F.sum("s").alias("all")))).select("v", (F.col("s") / F.col("all")).alias(f"to_{d}"))  # one row
        cells = cells.join(share, cells[d].eqNullSafe(share["v"]), "left").drop("v").withColumn(f"to_{d}", F.coalesce(f"to_{d}", F.lit(0.0)))
    cells = stored(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    gap = moved = 0.0
    for _ in range(0, rounds, 2):
        now = (cells.coalesce(1) if small else cells).withColumn("was", F.col("w"))
        for _ in range(2):
            for d in targets:
                now, of = _summed(now, d, small)
                now = now.withColumn("w", F.when(of > 0, F.col("w") * F.col(f"to_{d}") / of).otherwise(0.0)).drop("of")
        gaps = []
        for d in targets:
            now, of = _summed(now, d, small)
            now = now.withColumn(f"gap_{d}", F.when(F.col("tokens") > 0, F.abs(of - F.col(f"to_{d}"))).otherwise(0.0)).drop("of")
            gaps.append(F.max(f"gap_{d}"))
        cells = stored(now.withColumn("moved", F.abs(F.col("w") - F.col("was"))), "cells")
        moved, *gaps = cells.agg(F.max("moved"), *gaps).first()
        gap = max([x or 0.0 for x in gaps], default=0.0)
        cells = cells.drop("was", "moved", *[f"gap_{d}" for d in targets])
        if gap <= close or (moved or 0.0) <= 1e-12:
            break
    if gap > close:
        warnings.warn(f"raking stopped with a share {gap:.2g} off its target", stacklevel=2)
    return cells.drop(*[f"to_{d}" for d in targets])


def _summed(cells: DataFrame, dimension: str, one_task: bool) -> tuple[DataFrame, Column]:
    """``cells`` and the sum of the weights that share a cell's value: a window in one task, else two steps and a join, so
    that a value with most of the cells is no burden to one task."""
    if one_task:
        return cells, F.sum("w").over(Window.partitionBy(dimension))
    cells = stored(cells, "cells")
    sums = stored(cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("w").alias("of")), "sums")
    return cells.join(sums, cells[dimension].eqNullSafe(sums["value"])).drop("value"), F.col("of")


def _rates(cells: DataFrame, targets: dict[str, DataFrame] | None, power: float) -> DataFrame:
    """The probability of each cell (source, lang, topic, tokens): its raked weight for each token, the largest scaled to one."""
    cells = stored(cells, "tokens")
    raked = rake(cells, {d: (targets or {}).get(d) or tempered(cells, d, power) for d in DIMENSIONS})
    rates = raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).alias("r"))
    top = rates.agg(F.max("r").alias("top"))  # one row
    return stored(rates.crossJoin(F.broadcast(top)).select(*DIMENSIONS, F.coalesce(F.col("r") / F.col("top"), F.lit(1.0)).alias("probability")), "rates")


def _judged(rows: DataFrame, topic: str, tokens: str, rates: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``rows`` with their cells' rates, and of each row the probability and whether it is sampled."""
    same = rows["source"].eqNullSafe(rates["source"]) & rows["lang"].eqNullSafe(rates["lang"]) & rows[topic].eqNullSafe(rates["topic"])
    side = F.broadcast(rates) if rates.count() <= ONE_TASK_CELLS else rates
    chance = F.pmod(F.xxhash64(F.lit(SEED), rows["doc_id"].cast("long")), F.lit(1 << 53)) / float(1 << 53)
    probability = F.when(rows[tokens] == 0, 1.0).otherwise(rates["probability"])
    return rows.join(side, same), probability, chance < probability


def _summed_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"))


def mixing_weights(docs: DataFrame, topics: dict[str, list[str]] | None = None, power: float = TEMPER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, tokens, probability, sampled.

    ``targets`` (value, share of tokens) may be given for some dimensions; the others' shares are tempered. A document is
    sampled if the hash of its id, as a fraction, is below its probability, so that rows of one id and cell go together. A
    null source or lang is a value of its own; a null id has one hash. A document without tokens has probability 1 in any
    cell with weight and takes nothing from the shares; very long texts are counted whole. Other columns are left out,
    whatever their names; an empty table gives no rows."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", topic("text", TOPICS if topics is None else topics).alias("topic"), n_tokens("text").alias("tokens"))
    rows = stored(measured, "mixing")
    joined, probability, sampled = _judged(rows, "topic", "tokens", _rates(_summed_tokens(rows), targets, power))
    return joined.select(*[rows[c] for c in ("doc_id", *DIMENSIONS, "tokens")], probability.alias("probability"), sampled.alias("sampled"))


def mixed(docs: DataFrame, topics: dict[str, list[str]] | None = None, power: float = TEMPER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that ``mixing_weights`` samples.

    A row is judged by its own id and cell, so repeated rows go together. Nulls, empty and very long texts and empty tables
    are as there."""
    topics = TOPICS if topics is None else topics
    measured = docs.select("source", "lang", topic("text", topics).alias("topic"), n_tokens("text").alias("tokens"))
    rates = _rates(_summed_tokens(measured), targets, power)
    taken = {c.lower() for c in docs.columns}
    free = [n for n in (f"mixing_{i}" for i in range(len(taken) + 2)) if n not in taken][:2]
    rows = docs.withColumns({free[0]: topic("text", topics), free[1]: n_tokens("text")})
    joined, _, sampled = _judged(rows, *free, rates)
    return joined.where(sampled).select([rows[c] for c in docs.columns])
