import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import runs

DOCS = "doc_id long, text string, runs string, period int"


def plain(words, periods=4, shortest=6):
    """Every period and every place."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, periods * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = rewritten(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 5), st.integers(1, 9))
def test_random_words(words, periods, shortest):
    assert runs.runs_of(words, periods, shortest) == plain(words, periods, shortest)


def test_made_runs():
    r = random.Random(5)
    for _ in range(300):
        words = []
        for _ in range(r.randrange(1, 8)):
            part = [r.choice("abcdefghij") for _ in range(r.randrange(1, 12))]
            words += (part * r.randrange(1, 9))[: r.randrange(1, 70)] + [r.choice("abxyz") for _ in range(r.randrange(0, 5))]
        assert runs.runs_of(words) == plain(words)


def test_ranges_leave_plain_text_alone():
    r = random.Random(1)
    words = [f"w{int(r.paretovariate(0.4)) % 5000}" for _ in range(20_000)]
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    assert sum(b - a for a, b in runs.ranges(codes)) < 0.05 * len(words) and plain(words[:800]) == runs.runs_of(words[:800])


def test_long_runs_in_little_time():
    words = ["x"] * 30_000 + list("ab") * 20_000 + [f"w{i % 5000}" for i in range(30_000)]
    assert runs.runs_of(words) == [(0, 30_000, 1), (30_000, 40_000, 2), (70_000, 30_000, 5000)]


def test_query_against_every_place(spark):
    r = random.Random(2)
    rows = [(i, r.choice([" ", "\n", "\t"]).join(r.choice(["a", "b", "c d", "e f", "Ü"]) for _ in range(r.randrange(0, 90))), "", 0) for i in range(120)]
    rows += [(None, "a " * 30, "", 0), (10, None, None, None), (11, "", "", 0), (12, "a b " * 4, "", 0), (12, "a b " * 4, "", 0), (13, " \x0b\x0c ", "", 0), (14, "y " * 5, "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(x) for x in runs.run_digest(df).collect()), key=str)
    want = sorted((digest(i, t) for i, t, *_ in rows), key=str)
    assert got == want and sum(x[1] > 0 for x in got) > 10
    assert runs.run_digest(df.limit(0)).collect() == []


def test_texts_without_their_repeats(spark):
    df = spark.createDataFrame([(1, "so " * 9 + "and now " * 4 + "end", "", 0)], DOCS)
    row = runs.collapse(df).first()
    assert row.text == "so and now end" and [tuple(x) for x in row.runs] == [(0, 9, 1), (9, 8, 2)]
