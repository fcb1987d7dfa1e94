"""Credentials in texts, by DataFrame functions alone.

Three kinds of spans are sure finds: assignments to a secret's name, access identifiers, long hex runs. Weak candidates
(mixed tokens, endpoints) say little alone; an interval join looks for their complements within the same scope of a text,
and only those that have them are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.shared import stored

SCOPE = 256
# Kinds in the order of the contract, then those of the method, with their patterns as fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"https?://[^\s\"'<>]{4,}"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN, "endpoint": ENDPOINT}
ORDER = {k: i for i, k in enumerate(PATTERNS)}
BASE = ("assign", "access", "hex")


def _found(kind: str) -> Column:
    """The matches of a kind: lengths of what stands between them, of themselves, and whether each counts.

    A pattern with a least length matches the same spans as the open run filtered afterwards, except for assignments,
    where a short value still uses up its text; those are filtered by the length of the value."""
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    if kind == "assign":
        good = F.transform(F.regexp_extract_all("text", pattern, F.lit(2)), lambda v: F.length(v) >= 12)
    elif kind == "token":
        good = F.transform(whole, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    else:
        good = F.transform(whole, lambda _: F.lit(True))
    gaps = F.transform(F.split("text", PATTERNS[kind], -1), F.length)
    made = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("len"), good.alias("good"))
    return F.when(F.size(whole) > 0, F.filter(made, lambda m: m["len"].isNotNull()))


def _parts(found: DataFrame) -> DataFrame:
    """row, kind, start, end of every match that counts; code points, end exclusive."""
    each = None
    for kind in PATTERNS:
        one = found.where(F.col(kind).isNotNull()).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"))
        each = one if each is None else each.union(one)
    run = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(run)
    return each.select("row", "kind", (end - F.col("m.len")).alias("start"), end.alias("end"), "m.good").where("good").drop("good")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts with their complements in scope: a token beside an access identifier, or beside both an endpoint and
    an assignment; an endpoint beside an access identifier or an assignment. Tokens that touch a sure find are part of it."""
    cell = lambda c: F.floor(c / scope)
    weak = parts.where(F.col("kind").isin("token", "endpoint"))
    weak = weak.select("*", cell(F.col("start")).alias("cell_1"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    near = parts.where("kind != 'token'").select("row", F.col("kind").alias("by"), F.col("start").alias("a"), F.col("end").alias("b"))
    near = near.select("*", cell(F.col("a") - scope).alias("cell_2"), F.explode(F.sequence(cell(F.col("a") - scope), cell(F.col("b") + scope))).alias("cell"))
    within = (F.col("a") <= F.col("end") + scope) & (F.col("b") >= F.col("start") - scope)
    met = weak.join(near, ["row", "cell"]).where(within & (F.col("cell") == F.greatest("cell_1", "cell_2")))  # once, in the first cell of both
    has = lambda k: F.max((F.col("by") == k).cast("int")) == 1
    touches = F.max(((F.col("a") < F.col("end")) & (F.col("b") > F.col("start")) & F.col("by").isin(*BASE)).cast("int")) == 1
    token = has("access") | (has("endpoint") & has("assign"))
    endpoint = has("access") | has("assign")
    judged = met.groupBy("row", "kind", "start", "end").agg((F.when(F.col("kind") == "token", token & ~touches).otherwise(endpoint)).alias("keep"))
    return judged.where("keep").drop("keep")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty; without finds the counts are 0, spans is '' and the hash that of ''. Rows that repeat, and
    rows with a null doc_id, each have their own result. Very long texts are read whole. Other columns are left out, whatever
    their names; an empty table gives no rows."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(texts.select("row", "doc_id", *[_found(k).alias(k) for k in PATTERNS]), "found")
    parts = stored(_parts(found), "parts")
    spans = parts.where(F.col("kind").isin(*BASE)).union(_linked(parts, scope))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("kind"))
    rows = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("all"))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    out = found.select("row", "doc_id").join(rows, "row", "left").select("doc_id", every.alias("all"))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
