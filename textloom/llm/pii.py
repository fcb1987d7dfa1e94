"""Personal data in texts: sure finds by their formats, and what looks like them.

Four kinds have formats that can be checked: mail addresses, IP addresses, card numbers and phone numbers. Generators with
high recall propose further spans, which may overlap. Boosted trees score each proposal by its format and its surroundings.
They learn from the sure finds, but never see what makes those sure (check digits, ranges of parts, the plus sign, the sign
between name and host), so a proposal like them in all else scores like them. A threshold for each kind, calibrated on
proposals held out, selects those that are kept beside the sure ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import boosting
from textloom.llm.arrow import pieces

KINDS = ("email", "ip", "card", "phone")
# What counts as sure.
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Documents and proposals that trees are fitted on at most, proposals of one document among them, positives and others that a
# kind needs at least, the share held out, and the share of sure ones that a calibrated threshold asks for.
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_EACH, LEAST_ROWS, HELD, SURE = 200_000, 30_000, 64, 40, 5, 0.9
NEAR = 40
GENERATORS = (
    (("email",), re.compile(r"[^\s@<>()\[\]\"']{1,64}\s?@\s?[^\s@<>()\[\]\"']{1,255}")),
    (("email",), re.compile(r"(?i)\b[\w.+-]{1,64}\s?[\[({<]\s?at\s?[\])}>]\s?[\w-]{1,63}(?:\s?(?:\.|[\[({<]\s?dot\s?[\])}>])\s?[\w-]{1,63}){1,8}")),
    (("ip",), re.compile(r"(?<![0-9.])[0-9]{1,9}(?:[.,][0-9]{1,9}){3,7}(?![0-9])")),
    (("ip",), re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (("card", "phone"), re.compile(r"(?<![0-9A-Za-z])[0-9]{7,25}(?![0-9A-Za-z])")),
    (("card", "phone"), re.compile(r"(?<![0-9A-Za-z])[0-9]{1,6}(?:[\x20./-][0-9]{2,6}){1,6}(?![0-9A-Za-z])")),
    (("phone",), re.compile(r"(?<![0-9A-Za-z])[0-9]{0,4}[\x20.-]?\([0-9]{1,5}\)[\x20.-]?[0-9]{2,5}(?:[\x20.-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])")),
)
HINTS = re.compile(r"(?i)\b(?:(mail|e-?mail|contact|write)|(ip|host|server|address|addr)|(card|visa|pay|credit|account)|(phone|tel|call|mobile|fax))\b")


class Span(NamedTuple):
    start: int
    rank: int
    end: int


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def sure(text: str) -> list[Span]:
    """The sure finds, by start and kind; leftmost and without overlap within a kind."""
    out = []
    if "@" in text:
        free = 0
        for m in HOST.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(Span(start, 0, m.end()))
                free = m.end()
    out += [Span(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        out += [Span(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposed(text: str) -> list[tuple[Span, int]]:
    """Spans that may be personal data, with the number of their generator; each kind and place once."""
    seen: dict[Span, int] = {}
    for g, (kinds, pattern) in enumerate(GENERATORS):
        if (g == 0 and "@" not in text) or (g == 3 and ":" not in text):
            continue
        for m in pattern.finditer(text):
            for kind in kinds:
                seen.setdefault(Span(m.start(), KINDS.index(kind), m.end()), g)
    return sorted(seen.items())


FEATURES = 23 + len(GENERATORS)


def features(text: str, span: Span, generator: int) -> list[float]:
    """Format and surroundings of a proposal. A plus sign before it reads as a blank, and no check digit or range is looked at."""
    inside, before, after = text[span.start : span.end], text[max(0, span.start - NEAR) : span.start].replace("+", " "), text[span.end : span.end + NEAR]
    groups = re.findall(r"[0-9]+", inside)
    lengths = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    last, next_ = before[-1:] or " ", after[:1] or " "
    hints = [0.0] * 4
    for m in HINTS.finditer(before):
        hints[m.lastindex - 1] = 1.0
    around = before + after
    out = [len(inside), len(digits), sum(map(str.isalpha, inside)), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1], len(set(digits))]
    out += [inside.count(c) for c in " .-(:"]
    out += [last.isspace(), last.isalnum(), next_.isspace(), next_.isalnum()]
    out += [sum(c.isdigit() for c in around) / (len(around) + 1), *hints]
    return [*map(float, out), *(float(g == generator) for g in range(len(GENERATORS)))]


def alike(a: Span, b: Span) -> bool:
    """Whether spans of one kind are the same but for a fifth at the ends."""
    both = min(a.end, b.end) - max(a.start, b.start)
    return a.rank == b.rank and both > 0 and both >= 0.8 * (max(a.end, b.end) - min(a.start, b.start))


def labelled(text: str) -> Iterator[tuple[Span, int, bool]]:
    """The proposals of a text, and whether each is a sure find."""
    known = {(s.rank, c): s for s in sure(text) for c in range(s.start, s.end)} if text else {}
    for span, generator in proposed(text):
        hit = known.get((span.rank, (span.start + span.end) // 2))
        yield span, generator, hit is not None and alike(span, hit)


class Model(NamedTuple):
    """For each kind its trees and the least log odds of what is kept; kinds with too few examples have none."""

    kinds: dict[int, tuple[boosting.Trees, float]]

    def __call__(self, text: str) -> list[tuple[Span, float]]:
        """Proposals that are kept: the best of those that overlap, and none that overlaps a sure find."""
        found = [(s, g) for s, g in proposed(text) if s.rank in self.kinds] if self.kinds else []
        if not found:
            return []
        score, least = np.empty(len(found)), np.array([self.kinds[s.rank][1] for s, _ in found])
        rank = np.array([s.rank for s, _ in found])
        x = np.array([features(text, s, g) for s, g in found])
        for k, (trees, _) in self.kinds.items():
            score[rank == k] = trees(x[rank == k])
        taken, out = np.zeros(len(text) + 1, bool), []
        for s in sure(text):
            taken[s.start : s.end] = True
        for i in sorted(np.flatnonzero(score >= least).tolist(), key=lambda i: (-score[i], found[i][0])):
            s = found[i][0]
            if not taken[s.start : s.end].any():
                taken[s.start : s.end] = True
                out.append((s, float(score[i])))
        return sorted(out)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        rows = []
        for text in piece["text"]:
            own = []
            for span, generator, y in labelled(text):
                key = xxhash.xxh64_intdigest(f"{span.rank} {text[max(0, span.start - NEAR) : span.end + NEAR]}") >> 1
                own.append((key, span.rank, int(y), span, generator))
            rows += [(k, r, y, features(text, s, g)) for k, r, y, s, g in sorted(own)[:SAMPLE_EACH]]
        key, rank, y, x = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rank, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["key", "rank", "y", "x"])


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, seen: int = SAMPLE_DOCS) -> Model:
    """Trees from at most ``rows`` proposals of about ``seen`` documents, both chosen by hash; their features come to the
    driver, no texts. A kind without ``LEAST_ROWS`` sure and as many other proposals has no trees: nothing is added to it."""
    parts = 1 << 30
    share = min(parts, parts * seen // max(docs.count(), 1))
    picked = docs.select("text").where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(parts)) < share)
    got = picked.mapInArrow(_examples, "key long, rank int, y int, x array<double>").orderBy("key", "rank", "y", "x").limit(rows).toArrow()
    key, rank, y = (got.column(c).to_numpy() for c in ("key", "rank", "y"))
    x = np.array(got.column("x").to_pylist()).reshape(len(key), FEATURES)
    kinds = {}
    for k in range(len(KINDS)):
        own, held = rank == k, key % HELD == 0
        fit, test = own & ~held, own & held
        if min(y[fit].sum(), (1 - y[fit]).sum(), y[test].sum()) >= LEAST_ROWS // HELD and min(y[own].sum(), (1 - y[own]).sum()) >= LEAST_ROWS:
            trees = boosting.fit(x[fit], y[fit].astype(float))
            if np.isfinite(least := boosting.threshold(trees(x[test]), y[test].astype(float), SURE)):
                kinds[k] = trees, least
    return Model(kinds)


SPANS = "array<struct<start:int,rank:int,end:int,sure:boolean,score:double>>"


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, spans (start, rank of the kind, end, whether it is sure, log odds of those that aren't), by start and kind.

    A null or empty text has none; very long texts are read whole; rows that repeat have a row each; other columns are left
    out, whatever their names; an empty table gives no rows. Without a model one is trained on the table itself."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "rank", "end", "sure", "score")
        kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()), strict=True))))
        for piece in pieces(batches):
            rows = []
            for text in piece["text"]:
                found = [(*s, True, None) for s in sure(text)] + [(*s, False, p) for s, p in model(text)]
                rows.append([dict(zip(names, r, strict=True)) for r in sorted(found, key=lambda r: r[:4])])
            yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with the finds of each text replaced by their kind in brackets; of finds that overlap the first names all."""
    model = model or train(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, [*sure(t), *(s for s, _ in model(t))]) for t in (v.as_py() for v in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def redact(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for s in sorted(spans):
        if s.start >= done:
            out += [text[done : s.start], f"[{KINDS[s.rank].upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the sure finds by kind, sha256 of their list, and the list of all spans. Odd rows: ``find_pii``."""
    base = F.filter("spans", lambda s: s["sure"])
    count = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find_pii(docs, model).select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _is(kind: int):
    return lambda s: s["sure"] & (s["rank"] == kind)
