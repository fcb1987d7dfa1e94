"""Documents that hold benchmark passages, by spaced seeds, with DataFrame functions alone.

A mask picks some of the words in a short window and ignores the rest, so that a seed also matches where ignored words
were replaced. Seeds of the benchmark meet those of all documents in a join; every hit gives a document, an item and the
shift between them, and along that shift the words are compared one by one.

Every mask picks some words in a row; seeds of texts are made only where these words stand in a row in the benchmark too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.shared import stored

# Of all ways to replace 4 of 20 words none leaves these without a seed (tests go through them all).
MASKS = ("1111011", "110010111", "11011101")
# For items of these numbers of words, what the masks above would lose there (the same tests).
SHORT = {10: ("10101111", "111100011"), 11: ("110100111",), 12: ("111111001",), 15: ("111000010111",), 16: ("111000010111",)}
WINDOW, LEAST = 20, 16
WHOLE = 10
ANCHOR = 3  # words in a row, of those that a mask picks
BLOCK_SEEDS = 1_000_000
BLOCKS = 4
BLOCK_ROWS = 1_000_000


def words(text: str) -> Column:
    """Runs of letters and digits of a column, in lower case; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masks_of(n: int, masks: tuple[str, ...]) -> tuple[str, ...]:
    """Further masks for items of ``n`` words: all their words where no mask fits, and those of ``SHORT``."""
    return ("1" * n,) if n < min(map(len, masks)) else SHORT.get(n, ())


def _numbered(masks: tuple[str, ...], short: list[int]) -> list[tuple[int, str, list[int] | None]]:
    """Number and mask; for the further masks of items of ``short`` numbers of words also which of these numbers have it."""
    further = {m: [k for k in short if m in masks_of(k, masks)] for k in short for m in masks_of(k, masks)}
    return [(i, m, None) for i, m in enumerate(masks)] + [(-int(m, 2), m, only) for m, only in further.items()]


def _seeds(hashes: Column, masks: tuple[str, ...], short: list[int], items: bool) -> Column:
    """Hash of the picked words at each position, for one mask after another; then for the further masks of items of ``short``
    numbers of words, which of the items only those have."""
    made, n = [], F.size(hashes)
    for number, mask, only in _numbered(masks, short):
        fits = n.isin(only) if items and only else n >= len(mask)
        at = F.when(fits, F.sequence(F.lit(0), n - len(mask))).otherwise(F.array().cast("array<int>"))
        made.append(F.transform(at, _seed_at(hashes, number, [j for j, c in enumerate(mask) if c == "1"])))
    return F.concat(*made)


def _seed_at(hashes: Column, mask: int, picked: list[int]):
    return lambda k: F.struct(k.alias("at"), F.xxhash64(F.lit(mask), *[hashes[k + j] for j in picked]).alias("seed"))


def seeds(table: DataFrame, key: str, text: str, masks: tuple[str, ...] = MASKS, short: list[int] = [], items: bool = False) -> DataFrame:  # noqa: B006
    hashed = table.select(key, F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.select(key, F.explode(_seeds(F.col("h"), masks, short, items)).alias("s")).select(key, "s.seed", "s.at")


def _around(table: DataFrame, key: str, text: str, before: int, size: int) -> DataFrame:
    """key, at and w0, w1 ... of each word: hashes of ``size`` words, ``before`` of them before it; null beyond the text's ends."""
    hashes = F.concat(F.array_repeat(F.lit(None).cast("long"), before), F.transform(words(text), lambda w: F.xxhash64(w)))
    each = [F.slice("h", i + 1, F.size("h") + 1).alias(f"w{i}") for i in range(size)]
    at = F.sequence(F.lit(0), F.size("h") - before).alias("at")
    return table.select(key, hashes.alias("h")).select(key, F.inline(F.arrays_zip(at, *each))).where(F.col(f"w{before}").isNotNull())


def anchored_seeds(texts: DataFrame, items: DataFrame, masks: tuple[str, ...], short: list[int], block: int) -> DataFrame | None:
    """Those of the seeds of ``texts`` that the items may have too: where some words in a row, which the mask picks, are in a
    row in an item. None if there are more than ``block`` of such places in the items."""
    numbered = _numbered(masks, short)
    width = min(ANCHOR, *(max(map(len, m.split("0"))) for _, m, _ in numbered))
    place = {m: m.rindex("1" * width) for _, m, _ in numbered}
    before, after = max(place.values()), max(len(m) - p for m, p in place.items())
    row = lambda at: [F.col(f"w{at + j}") for j in range(width)]
    anchors = _around(items, "item_id", "text", 0, width).where(row(0)[-1].isNotNull()).select(F.xxhash64(*row(0)).alias("anchor"))
    anchors = stored(anchors.distinct(), "anchors")
    if anchors.count() > block:
        return None
    there = _around(texts, "key", "text", before, before + after).where(row(before)[-1].isNotNull()).withColumn("anchor", F.xxhash64(*row(before)))
    made = []
    for number, mask, _ in numbered:
        start = before - place[mask]
        picked = [F.col(f"w{start + j}") for j, c in enumerate(mask) if c == "1"]
        seed = F.struct((F.col("at") - place[mask]).alias("at"), F.xxhash64(F.lit(number), *picked).alias("seed"))
        made.append(F.when((F.col("at") >= place[mask]) & F.col(f"w{start + len(mask) - 1}").isNotNull(), seed))
    met = there.join(F.broadcast(anchors), "anchor", "left_semi")
    return met.select("key", F.explode(F.array_compact(F.array(*made))).alias("s")).select("key", "s.seed", "s.at")


def _hits(texts: DataFrame, items: DataFrame, masks: tuple[str, ...], block: int) -> DataFrame:
    """key, item_id, shift of every seed that a text shares with an item.

    The benchmark's seeds are broadcast in blocks of about ``block``, each against all texts; beyond ``BLOCKS`` of those both
    sides are shuffled instead, as making the texts' seeds time and again costs more than to move them once."""
    held = items.select(F.size(words("text")).alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()  # few numbers
    short = sorted(r.n for r in held if masks_of(r.n, masks))
    known = stored(seeds(items, "item_id", "text", masks, short, items=True).withColumnRenamed("at", "item_at"), "seeds")
    n, of_texts = known.count(), anchored_seeds(texts, items, masks, short, block)
    of_texts = seeds(texts, "key", "text", masks, short) if of_texts is None else of_texts
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if n > block * BLOCKS:
        return of_texts.join(known, "seed").select("key", "item_id", shift).distinct()
    blocks, found = 1 if n <= block else 2 * -(-n // block), None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id", "item_at", F.lit(7)), F.lit(blocks)) == b)
        hits = of_texts.join(F.broadcast(part), "seed").select("key", "item_id", shift)
        found = hits if found is None else found.union(hits)
    return found.distinct()


def _windows(flags: Column, n: Column, window: int) -> Column:
    """The most matches in any ``window`` places in a row; all of them if there are fewer places."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(flags, s, window), F.lit(0), lambda a, x: a + x)))


def _shared(texts: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], window: int, least: int, block: int) -> DataFrame:
    """key, item_id, shift, matched, item_words of the passages that ``texts`` (key, text) share with the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    of_items = stored(items.select("item_id", words("text").alias("item")), "items")
    hits = stored(_hits(texts, items, masks, block), "hits")
    lengths = of_items.groupBy("item_id").agg(F.max(F.size("item")).alias("n"))
    per_text = hits.join(lengths, "item_id").groupBy("key").agg(F.collect_list(F.struct("item_id", "shift", "n")).alias("hits"))
    per_text = F.broadcast(per_text) if hits.count() <= BLOCK_ROWS else per_text
    held = texts.join(per_text, "key").select("key", "hits", words("text").alias("w"))
    piece = lambda h: F.slice(F.col("w"), F.greatest(h["shift"], F.lit(0)) + 1, h["n"])
    cut = held.select("key", F.explode(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["shift"].alias("shift"), piece(h).alias("w")))).alias("c")).select("key", "c.*")
    aligned = cut.join(of_items, "item_id").withColumn("part", F.expr("slice(item, greatest(-shift, 0) + 1, size(w))"))
    n = F.least(F.size("w"), F.size("part"))
    flags = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.col("w")[i] == F.col("part")[i]).cast("int"))
    judged = aligned.where(n > 0).select("key", "item_id", "shift", flags.alias("flags"), n.alias("n"), F.size("item").alias("item_words"))
    judged = judged.select("*", _windows(F.col("flags"), F.col("n"), window).alias("best"), F.expr("aggregate(flags, 0, (a, x) -> a + x)").alias("matched"))
    enough = F.when(F.col("item_words") < WHOLE, F.col("matched") == F.col("item_words")).otherwise(F.col("matched") * window >= F.col("item_words") * least)
    short = (F.col("item_words") < window) & (F.col("n") == F.col("item_words")) & enough
    kept = judged.where(((F.col("n") >= window) & (F.col("best") >= least)) | short)
    order = F.struct(F.col("matched"), -F.col("shift"))
    return kept.groupBy("key", "item_id").agg(F.max_by("shift", order).alias("shift"), F.max("matched").cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = LEAST, block: int = BLOCK_SEEDS) -> DataFrame:
    """doc_id, item_id, shift, matched, item_words of each document and item that share a passage: at one shift, ``least``
    of ``window`` words in a row agree; an item of fewer words has to be there whole, with the same share of its words, and
    one of fewer than ``WHOLE`` words word for word.

    One row for each pair, the shift with the most matches (then the smallest). No substitution pattern in 20 words is lost,
    and none in shorter items. Null and empty texts share nothing, and rows
    with a null id have no name to be reported under. Very long texts are read whole. Rows that repeat add no result. Other
    columns are left out, whatever their names; where a table is empty there are no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), "text").where("key is not null")
    return _shared(texts, benchmark, masks, window, least, block).withColumnRenamed("key", "doc_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = LEAST, block: int = BLOCK_SEEDS) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that share no passage with the benchmark.

    A row is judged by its own text, known by two 64-bit hashes, so rows with a null id or one that others have are as any.
    Null and empty texts stay; very long texts, repeated rows and empty tables are as for ``contaminated``."""
    name = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))
    text = F.coalesce(docs["text"], F.lit(""))
    bad = stored(_shared(docs.select(name(text).alias("key"), text.alias("text")), benchmark, masks, window, least, block).select("key").distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= BLOCK_ROWS else bad
    return docs.join(bad, name(text) == bad["key"], "left_anti")
