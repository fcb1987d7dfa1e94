"""Token ids of whole documents, written as Simple-8b segments and read back.

Texts are dealt out by ranges of doc_id, tokenised and packed where they land; a row of the written table is one segment
with the documents it holds. Offsets come from the segments' counts, summed within a part and then over the parts."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from struct import pack
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import simple8b
from textloom.llm.arrow import pieces
from textloom.shared import shared_path

END_ID = 2
SEGMENT_IDS = 1 << 16
CACHE_BYTES = 192 << 20  # of words that a Python worker keeps while it works on one table
ENTRY_BYTES = 150  # of the two objects and their place in a dictionary, beside their own lengths
MARKS = ".,!?;:"
LETTERS = "\u0250"  # beyond the letters that all Unicode versions agree on
SEGMENTS = "part int, seq int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
TOKENS = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts for a tokenizer that lower-cases and whose pieces never reach over white space: each word is
    encoded once and kept, and a word of letters with marks after it is put together from the two.

    Texts are cut at ASCII white space; whatever else stands between two such places is a word, which the tokenizer sees as
    it is unless it is of letters and marks. Texts that may hold its special tokens go through it whole. What is kept is
    bounded by ``cache`` bytes, counted before each piece; the words of one piece come on top of it until the next."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = [c for c in map(chr, range(ord(LETTERS))) if c.isalpha() and c == c.lower()]
        self.units = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.cache = cache
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _alone(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _keep(self, made: dict[str, bytes]) -> None:
        self.words.update(made)
        self.held += ENTRY_BYTES * len(made) + sum(map(len, made)) + sum(map(len, made.values()))

    def _learn_stems(self, stems: list[str]) -> None:
        """Words of letters alone: in lower case, letter by letter as its pre-tokenizer writes them, they are what the
        tokenizer's model sees of them."""
        split, made = self.tokenizer.model.tokenize, {}
        for w in stems:
            ids = [t.id for t in split(w.lower().translate(self.units))]
            made[w] = pack(f"<{len(ids)}I", *ids)
        self._keep(made)

    def _learn(self, words: list[str]) -> None:
        if self.held > self.cache:
            self.words.clear()
            self.held = 0
        known, plain, rest = self.words, {}, []
        for w in words:
            if w not in known:
                low = (s := w.rstrip(MARKS)).lower()
                if low.isalpha() and (low.isascii() or max(low) < LETTERS):  # as the tokenizer sees it
                    plain[w] = s
                else:
                    rest.append(w)
        self._learn_stems([s for s in {*plain.values()} if s not in known])
        marked = {w: s for w, s in plain.items() if len(s) < len(w)}
        rest += {w[len(s) :] for w, s in marked.items()}.difference(known, rest)
        for i in range(0, len(rest), 10_000):
            self._keep(dict(zip(rest[i : i + 10_000], self._alone(rest[i : i + 10_000]), strict=True)))
        self._keep({w: known[s] + known[w[len(s) :]] for w, s in marked.items()})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        special = pc.match_substring(column, "<|")
        split = pc.ascii_split_whitespace(pc.if_else(special, "", column))
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(words)
        kept = [self.words[w] for w in words]
        size = np.fromiter(map(len, kept), np.int64, len(kept)) // 4
        n, first = size[at], (np.cumsum(size) - size)[at]
        before = np.r_[0, np.cumsum(n)]  # ids before each word of the texts
        ids = np.frombuffer(b"".join(kept), "<u4")[np.repeat(first - before[:-1], n) + np.arange(before[-1])]
        bounds = before[np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out


def encoder_of(run: str, path: str, cache: int) -> WordEncoder:
    """The encoder that the tasks of one ``run`` share in this Python worker: executors get this package anew with each task,
    so it is kept by name. A new run starts with one that knows no words, and those of the run before are given back."""
    kept = sys.modules.setdefault("textloom_run", types.ModuleType("textloom_run")).__dict__
    if kept.get("run") != (run, path, cache):
        kept.update(run=(run, path, cache), encoder=None)
        kept["encoder"] = WordEncoder(path, cache)
    return kept["encoder"]


def _pack(run_id: str, path: str, end_id: int, limit: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, seq = encoder_of(run_id, path, cache), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        total = 0

        def segment() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "n_ids": total, "doc_ids": docs, "lengths": [len(x) for x in held], "payload": simple8b.encode(np.concatenate(held))}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in kinds.items()], list(kinds))

        for piece in pieces(batches):
            for doc_id, ids in zip(piece["doc_id"], encoder(piece["text"]), strict=True):
                docs.append(doc_id)
                held.append(np.append(ids, np.array([end_id], "<u4")))
                total += len(held[-1])
                if total >= limit:
                    yield segment()
                    docs, held, total, seq = [], [], 0, seq + 1
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, cache: int = CACHE_BYTES) -> None:
    """Write the ids of all ``docs`` (doc_id, text; other columns are ignored) to ``path`` in ascending doc_id order.

    A null text counts as empty, and an empty one gives the end id alone. A null doc_id comes first. Rows that share a
    doc_id each have their own entry, in order of text. Very long texts are encoded whole, in a segment of their own if they
    fill one. An empty table writes a table of no segments. Rows of one id are dealt out by how their texts start."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_pack(uuid4().hex, tokenizer or tokenizer_path(), end_id, segment_ids, cache), SEGMENTS).write.parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
    for batch in batches:
        for i in range(batch.num_rows):
            part, seq, docs, lengths, payload = (batch.column(n)[i].as_py() for n in ("part", "seq", "doc_ids", "lengths", "payload"))
            ids = simple8b.decode(payload).astype("<u4")
            end = np.cumsum(lengths)
            crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(end, lengths, strict=True)]
            cols = [[part] * len(docs), [seq] * len(docs), docs, end - np.array(lengths), lengths, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of the files in ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    counts = segments.select("part", "seq", "n_ids")
    within = counts.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("seg_base"))
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each written part: as many as there were tasks
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    bases = within.join(parts, "part").select("part", "seq", (F.col("seg_base") + F.col("part_base")).alias("base"))
    docs = segments.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(_unpack, TOKENS)
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, cache: int = CACHE_BYTES) -> DataFrame:
    """``write_tokens`` to ``path`` (by default in the shared folder), then ``read_tokens``. ``cache`` bounds the bytes of
    words that a Python worker keeps for the tasks of this call; fewer take less memory and more time."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, cache=cache)
    return read_tokens(docs.sparkSession, path)
