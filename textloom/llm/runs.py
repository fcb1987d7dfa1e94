"""Stretches of a text that repeat a few words over and over, and texts without the repeats.

A suffix automaton of the words has a state for every set of places at which a stretch of words can end. Sets of states that
share a suffix link are merged, smaller ones into the largest, in order of place. Where two places of different sets become
neighbours, the words before them agree over the state's length exactly; if their distance is no longer than that length,
they are two periods of a run (a square), whose first word is thereby known. The last such pair of a run ends it.

Words of a long text mostly repeat far apart. Only ranges where a few words in a row stand again within the distance that a
run of that extent allows can hold runs, and only of those is an automaton built."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import pieces

PERIODS, SHORTEST = 4, 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FAR = 1 << 62


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state its longest length, its suffix link, and the place of the word that made it (-1 for copies)."""
    size, link, own, to = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(size)
        size.append(i + 1)
        link.append(0)
        own.append(i)
        to.append({})
        p = last
        while p >= 0 and w not in to[p]:
            to[p][w] = new
            p = link[p]
        if p >= 0:
            q = to[p][w]
            if size[q] != size[p] + 1:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                own.append(-1)
                to.append(to[q].copy())
                link[q] = copy
                while p >= 0 and to[p].get(w) == q:
                    to[p][w] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    return size, link, own


def squares(words: list[int], periods: int = PERIODS) -> dict[tuple[int, int], int]:
    """(start, period) of the runs that hold ``periods`` periods, with the place of their last word.

    Places are kept as negative numbers, so that the sets of a long run, which grow towards the front, grow at their end."""
    size, link, own = automaton(words)
    sets: dict[int, list[list[int]]] = {}
    out: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(size), kind="stable").tolist():
        length = size[v]
        if length < periods - 1:
            break  # the shortest distance is 1
        groups = sets.pop(v, [])
        if own[v] >= 0:
            groups.append([-own[v]])
        merged = groups[0]
        if len(groups) > 1:
            merged = max(groups, key=len)
            tag = {x: i for i, g in enumerate(groups) if g is not merged for x in g}
            if len(tag) * 16 > len(merged):
                merged = sorted([*merged, *tag])
            else:
                for x in tag:
                    insort(merged, x)
            for x, group in tag.items():
                at = bisect_left(merged, x)
                for a, b in ((at - 1, at), (at, at + 1)):
                    if a >= 0 and b < len(merged):
                        y = merged[a] if b == at else merged[b]
                        distance = merged[b] - merged[a]
                        if (periods - 1) * distance <= length and tag.get(y) != group:
                            key = (1 - merged[b] - length, distance)
                            if out.get(key, -1) < -merged[a]:
                                out[key] = -merged[a]
        sets.setdefault(link[v], []).append(merged)
    return out


def ranges(codes: np.ndarray, periods: int = PERIODS) -> list[tuple[int, int]]:
    """Ranges outside of which no run has a word, and none is cut by a range's end.

    In a run of period q every few words in a row that start after the first q stand again q places before or nearer, over
    (periods - 1) * q words less those few; so a stretch of n such places holds periods up to (n + few - 1) / (periods - 1)."""
    few = min(3, periods - 1)
    n = len(codes) - few + 1
    if n < 2:
        return []
    key = codes[:n].astype(np.uint64)
    for k in range(1, few):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    gap = np.full(n, FAR)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    again = gap < FAR
    while True:
        edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        lo, hi = edge[::2], edge[1::2]
        longest = (hi - lo + few - 1) // (periods - 1)
        limit = np.repeat(longest, hi - lo)
        at = np.flatnonzero(again)
        drop = at[gap[at] > limit]
        if not len(drop):
            break
        again[drop] = False
    out: list[tuple[int, int]] = []
    for a, b, q in zip(lo.tolist(), hi.tolist(), longest.tolist(), strict=True):
        a, b = max(0, a - q - 1), min(len(codes), b + few)
        while out and out[-1][1] >= a:
            before = out.pop()
            a, b = min(a, before[0]), max(b, before[1])
        out.append((a, b))
    return out


def runs_of(words: list[str], periods: int = PERIODS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """start, length, period of every run of at least ``periods`` smallest periods and ``shortest`` words, in that order."""
    if len(words) < shortest:
        return []
    out = []
    for lo, hi in ranges(np.fromiter(map(hash, words), np.int64, len(words)), periods):
        ids: dict[str, int] = {}
        found = squares([ids.setdefault(w, len(ids)) for w in words[lo:hi]], periods)
        out += [(lo + start, end - start + 1, period) for (start, period), end in found.items() if end - start + 1 >= max(shortest, periods * period)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(docs: DataFrame, periods: int = PERIODS, shortest: int = SHORTEST, rewrite: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period, numbered by words from 0), text (the words that are kept, joined by blanks).

    ``rewrite`` changes a document's words before they are read. A null or empty text has no runs and an empty text; very long
    texts are read whole, with an automaton of each range that may hold runs in memory (some 600 bytes a word of it); runs of
    one start come by period; rows that repeat have a row each; other columns are left out, whatever their names; an empty
    table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found, texts = [], []
            for doc_id, text in zip(piece["doc_id"], piece["text"], strict=True):
                words = WORD.findall(text)
                if rewrite:
                    words = rewrite(doc_id, words)
                runs = runs_of(words, periods, shortest)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(" ".join(without_repeats(words, runs)))
            yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), pa.array(found, RUNS), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def repeat_some(doc_id: int | None, words: list[str]) -> list[str]:
    """A tenth of the documents, by the crc32 of their ids, made to repeat a part of themselves to the end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * ((n - a) // p + 1))[:n]


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the run with the most periods (the first of equals; null
    without runs); and digests of the runs and of the words kept. Odd rows are as for ``collapse``; a null id is not rewritten."""
    rows = collapse(docs, rewrite=repeat_some)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("m"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.floor(F.expr("1000 * m.length div m.period")).cast("long")
    return out.select("doc_id", "n_runs", "m.start", "m.length", "m.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
