import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import simple8b
from textloom.llm.token_output import WordEncoder, encode_documents, encoder_of, tokenizer_path

DOCS = "doc_id long, text string, lang string, at string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=700), st.sampled_from([1, 7, 128]))
def test_round_trip(ids, block):
    assert simple8b.decode(simple8b.encode(np.array(ids, np.uint64), block)).tolist() == ids


def test_long_runs_and_wrong_bytes():
    ids = np.r_[np.zeros(5000, np.uint64), np.arange(9000, dtype=np.uint64), np.full(3, 2**63, np.uint64)]
    made = simple8b.encode(ids)
    assert (simple8b.decode(made) == ids).all() and len(simple8b.encode(np.zeros(5000, np.uint64))) < 1500
    for bad in (b"", made[:-8], b"x" + made[1:]):
        with pytest.raises(ValueError):
            simple8b.decode(bad)


TEXTS = ["Hello, world's  end", "", None, "tab\x1cseparated <|endoftext|> x", "é́ İstanbul ΑΣ ΑΣ. don't stop now", "x" * 50_000, "a b " * 4000, "Hello, world's  end"]


def test_words_as_the_tokenizer_alone():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    for t, got in zip(TEXTS, WordEncoder(tokenizer_path())([t or "" for t in TEXTS]), strict=True):
        assert got.tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_documents(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rows = [(7 * (i % 5) if i else None, t, None, "x") for i, t in enumerate(TEXTS)]
    got = [tuple(r) for r in encode_documents(spark.createDataFrame(rows, DOCS)).orderBy("start").collect()]
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want
    assert encode_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_odd_letters_as_the_tokenizer_alone():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    letters = [*"aeiou xyz  ABC.,!?;:'-0123", "\u03a3", "\u03c3", "\u03c2", "\u0130", "\u0131", "\u00df", "\u1e9e", "\u0301", "\u0307", "\u01c5", "\u00e9", "\u0149", "\u4e2d", "\U0001f600", "\u00a0", "\u200b", "\n"]
    texts = ["\u03a3 \u0130!", *("".join(rng.choice(letters, int(rng.integers(1, 24)))) for _ in range(100_000))]
    plain = Tokenizer.from_file(tokenizer_path()).encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, p, got in zip(texts, plain, WordEncoder(tokenizer_path())(texts), strict=True) if p.ids != got.tolist()] == []


def test_every_letter_and_a_small_cache():
    from tokenizers import Tokenizer

    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    texts = [f"{c} x{c}{c.upper()}y, {c.lower()}{c}! {c}'s" for c in letters] + ["".join(letters), "word " * 50, "a, b. c; word", "J\u030c X\u030c T\u0308, W\u030a H\u0331"]
    plain = [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch_fast(texts, add_special_tokens=False)]
    encoder = WordEncoder(tokenizer_path(), cache=4000)
    for t, want in zip(texts, plain, strict=True):
        assert encoder([t])[0].tolist() == want
        assert encoder.held < 4000 + 400 * (len(t) + 1)  # what one text adds goes before the next
    assert [x.tolist() for x in WordEncoder(tokenizer_path())(texts)] == plain and WordEncoder(tokenizer_path()).words == {}
    assert WordEncoder(tokenizer_path())([]) == [] and [len(x) for x in WordEncoder(tokenizer_path())(["", " "])] == [0, 0]


def test_a_run_starts_with_no_words():
    first = encoder_of("a", tokenizer_path(), 9000)
    first(["some words"])
    assert encoder_of("a", tokenizer_path(), 9000) is first and first.words
    assert encoder_of("b", tokenizer_path(), 9000).words == {} and encoder_of("a", tokenizer_path(), 9000).words == {}
