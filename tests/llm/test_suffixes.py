import hashlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import suffixes
from textloom.shared import table

DOCS = "doc_id long, text string, row long, spans long"


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = np.random.default_rng(seed)
    fresh = lambda n: "".join(rng.choice(list("abcdefghijklmnop é"), n))
    passage, out = fresh(700), ["", None, "a" * 1500, "ab" * 700, "line of text\n" * 90]
    for i in range(60):
        p = list(passage)
        for _ in range(int(rng.integers(0, 4))):
            p[int(rng.integers(0, 700))] = "Z"
        a = int(rng.integers(0, 350))
        b = int(rng.integers(a + 30, 700))
        out.append(fresh(int(rng.integers(0, 300))) + "".join(p[a:b]) + (passage[:399] if i % 9 == 0 else "") + fresh(int(rng.integers(0, 600))))
    return [*out, out[8], out[9] + "x", passage[100:500], passage[300:], passage]


@pytest.mark.parametrize("length,span,seed", [(400, 192, 1), (60, 25, 2), (60, 25, 3)])
def test_against_all_strings(spark, length, span, seed):
    docs = texts(seed)
    got = suffixes.remove_repeats(spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(docs)], DOCS), length, span).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain(docs, length)


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_real_documents(spark, monkeypatch, broadcast):
    monkeypatch.setattr(suffixes, "BROADCAST_VALUES", broadcast)
    rows = table(spark, "/root/testdata/sf0.001", "documents")
    docs = [r.text for r in rows.orderBy("doc_id").collect()]
    got = suffixes.remove_repeats(rows).orderBy("doc_id").collect()
    want = plain(docs, 400)
    assert [tuple(r)[1:] for r in got] == want and sum(w[1] for w in want) > 0


def test_strips_find_the_anchors_of_the_whole():
    data = np.random.default_rng(5).integers(97, 100, 3 * suffixes.PIECE // 2, np.uint8).tobytes()
    data = data[:5000] + b"x" * 3000 + data[8000:]
    whole = suffixes.Anchors(np.frombuffer(data, np.uint8), np.zeros(1, int), np.array([len(data)]), 400, 192)
    rows = []
    for base, part, start, end, low, high in suffixes._strips([data], 400):
        found = suffixes.Anchors(np.frombuffer(part, np.uint8), start, end, 400, 192)
        rows += [(a + base, f + base, z + base) for a, f, z in zip(found.at, found.first, found.last, strict=True) if low <= f < high]
    assert rows == list(zip(whole.at, whole.first, whole.last, strict=True))


def test_edges(spark):
    long = "q" * 10 + "".join(map(str, range(300)))
    rows = [(None, long, 1, 1), (1, long, 1, 1), (1, long, 1, 1), (1, "short", 1, 1), (2, None, 1, 1)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    n = len(long)
    assert got == [(False, 1, 5, 0, 0), (False, 1, n, n, 1), (False, 1, n, n, 1), (False, 2, 0, 0, 0), (True, 0, n, n, 1)]
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    kept = suffixes.remove_repeats(spark.createDataFrame(rows, DOCS), with_bytes=True).where("n_bytes = 5").first()
    assert bytes(kept.kept) == b"short"
