import re

import numpy as np
import xxhash

from textloom.llm import components
from textloom.llm.components import connected_components, joined_components
from textloom.llm.simhash import GrayIndex, fingerprint, near_links, simhash_groups

DOCS = "doc_id long, text string, fp string, root long"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(values):
    root = {v: v for v in values}
    find = lambda v: v if root[v] == v else find(root[v])
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprint():
    for t in ["", " \t\n", "One", "a b c", "a b c d", "The THE the the É é\x0bx\x1cy z", "word " * 300, "  b c d e f"]:
        assert fingerprint(t) == plain(t)


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        v = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 9))):
            out.add(v)
            v ^= sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(1, 7)))))
    return np.array(sorted(out), np.uint64)


def test_index_finds_all_pairs():
    fps = clusters(700, 1)
    index = GrayIndex(fps)
    a, b = (np.concatenate(x) for x in zip(*index.pairs(4), strict=True))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(index.fps[i] ^ index.fps[j]).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(want) > 50


def test_small_buckets_are_split_and_lose_no_link(spark):
    fps = clusters(900, 2)
    base = int(fps[0])
    fps = np.unique(np.r_[fps, np.array([base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)], np.uint64)])
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in connected_components(near_links(table, bucket=40)).collect()}
    want = plain_groups([int(x) for x in fps])
    same = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert same({int(x): got.get(int(x), int(x)) for x in fps}) == same(want)


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base + " end", "  " + base, "", None, "other words here now", base.replace("w150 ", "v "), " ", "x" * 50_000]
    rows = [(i + 3, t, "a", 1) for i, t in enumerate(texts)] + [(3, base, "a", 1), (None, "other words here now", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash_groups(docs).collect()
    values = {i: plain(t) for i, t in enumerate(r[1] for r in rows)}
    groups = plain_groups(sorted(set(values.values())))
    want = []
    for i, r in enumerate(rows):
        members = [rows[j][0] for j in values if groups[values[j]] == groups[values[i]] and rows[j][0] is not None]
        want.append((r[0], f"{values[i]:016x}", min(members)))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash_groups(docs.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_components_are_joined_by_further_links(spark):
    rng = np.random.default_rng(3)
    made = [tuple(map(int, x)) for x in rng.integers(0, 300, (150, 2))]
    first, more = (spark.createDataFrame(x, "a long, b long") for x in (made[:70], made[70:]))
    got = {r.node: r.root for r in joined_components(connected_components(first), more).collect()}
    assert got == {r.node: r.root for r in connected_components(first.union(more)).collect() if r.node in got} and len(set(got.values())) < len(got)
    assert {x for a, b in made if a != b for x in (a, b)} <= set(got)


def test_links_shrink_from_round_to_round(spark, monkeypatch):
    """Stars, a long path and single nodes: what is joined in all rounds together stays near the number of links."""
    rng, n = np.random.default_rng(4), 3000
    nodes = rng.permutation(10**6)[: 2 * n].tolist()
    pairs = [(nodes[0], x) for x in nodes[1:n]] + [(nodes[i], nodes[i + 1]) for i in range(n, 2 * n - 1)] + [(-5, -5)]
    kept, stored = [], components.stored

    def counted(df, name):
        out = stored(df, name)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(components, "stored", counted)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(nodes[:n], min(nodes[:n])), **dict.fromkeys(nodes[n:], min(nodes[n:])), -5: -5}
    edges = [c for name, c in kept if name == "edges"]
    joined = sum(edges) if len(edges) > 1 else edges[0] * (len(kept) - 2)  # where links are kept as they are, every round joins all
    assert joined < 2.5 * 2 * len(pairs) and len(kept) < 60
