import re
import zlib

import numpy as np

import corpus_pipeline
from textloom.llm import quality
from textloom.llm.decontaminate import LEAST, WINDOW
from textloom.llm.mixing import mixing_weights
from textloom.llm.token_output import tokenizer_path
from textloom.shared import table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    from tests.llm.test_near_dedup import brute_groups

    docs = table(spark, SF, "documents")
    names = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        after.append(docs.collect())
        if len(after) < 5:
            assert docs.columns == names
    first, second, third, fourth, last = after

    ranking = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = {r.doc_id: float(ranking(quality.measures([r.text]))[0]) for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id for r in first} == {d for d, s in scores.items() if s >= min(ranking.cut, 0.5)}

    groups, _ = brute_groups({r.doc_id: r.text for r in first})
    assert {r.doc_id for r in second} == set(groups.values())

    split = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    items = [split(r.text) for r in table(spark, SF, "benchmark").collect()]

    def leaks(text):
        y = split(text)
        for x in items:
            for shift in range(-len(x), len(y)):
                hit = [i for i in range(len(x)) if 0 <= i + shift < len(y) and x[i] == y[i + shift]]
                if len(hit) >= LEAST and any(sum(s <= i < s + WINDOW for i in hit) >= LEAST for s in hit):
                    return True
        return False

    clean = {r.doc_id for r in second if not any(set(x) & set(split(r.text)) and len(set(x) & set(split(r.text))) >= LEAST / 2 for x in items) or not leaks(r.text)}
    assert {r.doc_id for r in third} == clean

    chosen = {r.doc_id for r in mixing_weights(spark.createDataFrame(third)).collect() if r.sampled}
    assert {r.doc_id for r in fourth} == chosen and 0 < len(chosen) <= len(third)

    plain_tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    want = []
    for r in sorted(fourth, key=lambda r: r.doc_id):
        ids = np.array([*plain_tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, last)) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_on_odd_rows(spark, tmp_path):
    prose = "a quiet river runs past the old mill where nobody has lived for many years now"
    leak = "every single word of this passage stands in the benchmark as well and must go away"
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, leak), (None, None), (4, "long text " * 40_000), (5, "short"), (6, leak)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, row_0 string, score_0 double, key int, quality_score string, probability int, topic string, group int"
    docs = spark.createDataFrame([(*r, None, None if i % 2 else "s", None, "x", 1.0, 1, "q", 2, "t", 3) for i, r in enumerate(rows)], fields)
    spark.createDataFrame([(1, leak), (None, prose)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (_, quality_), (_, near), (_, clean), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    got = lambda stage, df: sorted(((r.doc_id, (r.text or "")[:9]) for r in stage(spark, df, str(tmp_path)).collect()), key=str)
    want = lambda *ids: sorted(((r[0], (r[1] or "")[:9]) for i, r in enumerate(rows) if i in ids), key=str)
    assert got(quality_, docs) == want(*range(9))
    assert got(near, docs) == want(0, 2, 4, 5, 6, 7, 8)
    assert got(clean, docs) == want(0, 1, 2, 3, 5, 6, 7)
    kept = got(mix, docs)
    assert set(kept) <= set(want(*range(9))) and set(want(2, 3, 5)) <= set(kept)
    assert sorted((r.n_tokens for r in tokens(spark, docs, str(tmp_path)).collect()))[:3] == [1, 1, 1]
    for stage in (quality_, near, clean, mix):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert tokens(spark, docs.limit(0), str(tmp_path)).collect() == []
