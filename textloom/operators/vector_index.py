"""Nearest vectors of many queries at once: exactly, or by an index.

The index is an inverted file. K-means cells are fitted on a bounded sample, and every vector goes to its nearest cell; its
difference from the cell's centre is kept as a code of a byte for each of a few subspaces. The table is partitioned by cell,
so a search opens only the cells near its queries, scores all their codes by looked-up products, and works out exact scores
of the best candidates alone. A cell that holds many vectors is dealt out in parts, one that many queries ask in blocks of
queries, so no task gets more than a bounded number of either. Scores are (1 + cosine) / 2."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.shared import stored

# Vectors that cells and codes are fitted on, cells at most, bytes of a code, rounds of k-means.
SAMPLE, MOST_CELLS, CODE_BYTES, ROUNDS = 65_536, 16_384, 16, 12
# Vectors and queries that meet in one task, candidates scored exactly; how many of the sample's ten nearest must lie in the
# cells that are opened, and queries that measure it.
PART_ROWS, BLOCK, CANDIDATES, RECALL, MEASURED = 50_000, 500, 200, 0.98, 256
# Cells nearest to a query that are scanned first: others only give what is better than the worst candidate of these.
FIRST = 8


class Model(NamedTuple):
    dim: int
    centres: np.ndarray
    codebooks: np.ndarray  # subspace, code, part of a vector


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of ``dim`` numbers with a direction, and those vectors at length 1."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.nan_to_num(flat, nan=0.0, posinf=0.0, neginf=0.0).reshape(-1, dim)
    size = np.sqrt((x * x).sum(1))
    good = size > 0
    return rows[good], (x[good] / size[good, None]).astype(np.float32)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = (centres * centres).sum(1)
    return np.concatenate([(own - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct rows; a centre that nothing is nearest to moves to a row far from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        if (empty := np.flatnonzero(n == 0)).size:
            far = ((x - centres[near]) ** 2).sum(1).argsort()[::-1][: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors in ``parts`` pieces of equal length, zeros at the end."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def fit(x: np.ndarray, cells: int) -> Model:
    centres = kmeans(x, cells)
    rest = _split(x - centres[nearest_centre(x, centres)], min(CODE_BYTES, x.shape[1]))
    books = [kmeans(rest[:, j], 256) for j in range(rest.shape[1])]
    return Model(x.shape[1], centres, np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books]))


def cells_needed(x: np.ndarray, model: Model, share: float = RECALL) -> int:
    """How many of its nearest cells a query must open so that ``share`` of its ten nearest rows of the sample lie there. In
    the whole table the ten nearest are nearer, and lie in fewer cells."""
    asked = x[:MEASURED]
    own = nearest_centre(x, model.centres)
    far = (model.centres * model.centres).sum(1) - 2 * asked @ model.centres.T
    place = far.argsort(1).argsort(1)
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1:11]
    if not near.size:
        return 1
    return int(np.quantile(np.take_along_axis(place, own[near], 1), share, method="higher")) + 1


def encode(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Cells and codes of vectors."""
    cell = nearest_centre(x, model.centres)
    rest = _split(x - model.centres[cell], len(model.codebooks))
    return cell, np.stack([nearest_centre(rest[:, j], b) for j, b in enumerate(model.codebooks)], 1).astype(np.uint8)


class VectorIndex(NamedTuple):
    """A written index: its table (cell, part, key, code, vector), the model, and the parts of each cell (of few enough rows), and the cells to
    open for a query."""

    path: str
    model: Model
    parts: dict[int, int]
    probe: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def build(docs: DataFrame, key: str, path: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Writes the index of all rows of ``docs`` with a direction and the commonest number of dimensions; keys are unique.

    The sample of at most ``sample`` vectors is chosen by hash of the key, and is all that comes to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where(F.col(key).isNotNull() & (F.size(vector) > 0))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        raise ValueError("no vector to index")
    dim, n = sizes.dim, sizes.n
    share = min(1 << 30, (1 << 30) * sample // n)
    picked = rows.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share)).orderBy(F.xxhash64("key"), "key").limit(sample)
    _, x = unit(picked.select("vector").toArrow().column("vector").combine_chunks(), dim)
    if not len(x):
        raise ValueError("no vector with a direction in the sample")
    model = fit(x, cells or int(min(MOST_CELLS, max(1, n**0.5), max(1, len(x) // 8))))
    probe = cells_needed(x, model)

    def assign(batches):
        for batch in batches:
            at, v = unit(batch.column("vector"), dim)
            cell, code = encode(v, model)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(v), pa.list_(pa.float32()))], ["key", "cell", "code", "vector"])

    kind = rows.schema["key"].dataType.simpleString()
    placed = stored(rows.mapInArrow(assign, f"key {kind}, cell int, code binary, vector array<float>"), "placed")
    parts = {r.cell: -(-r.n // PART_ROWS) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    part = F.pmod(F.xxhash64("key"), _of(parts)).cast("int")
    dealt = placed.withColumn("part", part).repartition("cell", "part").sortWithinPartitions("cell", "part", "key")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    saved = [(dim, model.centres.tobytes(), model.codebooks.tobytes(), *model.codebooks.shape, parts, probe)]
    spark.createDataFrame(saved, "dim int, centres binary, codebooks binary, spaces int, codes int, width int, parts map<int,int>, probe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return VectorIndex(path, model, parts, probe)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    r = spark.read.parquet(f"{path}/model").first()
    centres = np.frombuffer(r.centres, np.float32).reshape(-1, r.dim)
    return VectorIndex(path, Model(r.dim, centres, np.frombuffer(r.codebooks, np.float32).reshape(r.spaces, r.codes, r.width)), dict(r.parts), r.probe)


def _of(counts: dict[int, int]) -> Column:
    """The number of a cell, 1 for most: only others are listed."""
    many = {c: n for c, n in counts.items() if n > 1}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("cell")), F.lit(1)) if many else F.lit(1)


def cosine_score(a: str, b: str) -> Column:
    """(1 + cosine) / 2 of two vector columns, in double precision; null without a direction or with other lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), (1 + dot(a, b) / size) / 2)


def _best(scored: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The ``limit`` best rows of each query, ties by key, with their rank from 1. Rows are few for each query."""
    best = Window.partitionBy("query").orderBy(F.desc(score), "key")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _top(score: np.ndarray, order: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``limit`` best of each row, equals in the order of ``order``; scores count to nine places."""
    score = np.round(score.astype(np.float64), 9)
    if score.shape[1] > limit:
        least = np.partition(score, -limit, axis=1)[:, -limit]
        maybe = score >= least[:, None]
    else:
        maybe = np.ones(score.shape, bool)
    row, col = np.nonzero(maybe)
    sort = np.lexsort((order[col], -score[row, col], row))
    row, col = row[sort], col[sort]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < limit], col[place < limit]


def _ordered(keys: pa.ChunkedArray) -> np.ndarray:
    """The rank of each key."""
    out = np.empty(len(keys), np.int64)
    out[pc.array_sort_indices(keys.combine_chunks()).to_numpy()] = np.arange(len(keys))
    return out


def _queries(queries: DataFrame, query: str, vector: str) -> DataFrame:
    return queries.select(F.col(query).alias("query"), F.col(vector).cast("array<float>").alias("asked")).where("query is not null and size(asked) > 0")


def search(index: VectorIndex, queries: DataFrame, query: str, limit: int = 10, vector: str = "embedding", probe: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """query, key, score, rank of the ``limit`` best of each query among ``candidates`` rows of its ``probe`` nearest cells
    (as many as the sample asks for, unless given). The ``FIRST`` cells give the candidates of a query as they are; from the
    others a row can only be one if it is at least as near as the last of those, so fewer rows are shuffled and none is lost.

    Queries without a direction, or of another length than the index, have no rows. What is broadcast has a row a cell."""
    spark, model = queries.sparkSession, index.model
    asked = _queries(queries, query, vector)
    kind, known = asked.schema["query"].dataType.simpleString(), min(probe or index.probe, len(model.centres))

    def cells_of(batches):
        for batch in batches:
            at, v = unit(batch.column("asked"), model.dim)
            far = (model.centres * model.centres).sum(1) - 2 * v @ model.centres.T
            near = np.argpartition(far, known - 1, axis=1)[:, :known] if len(v) else np.zeros((0, known), int)
            near = np.take_along_axis(near, np.take_along_axis(far, near, 1).argsort(1), 1)
            each = np.repeat(np.arange(len(v)), known)
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(at[each])), pa.array(list(v[each]), pa.list_(pa.float32())), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(known), len(v)), pa.int32())], ["query", "asked", "cell", "place"])

    probes = stored(asked.mapInArrow(cells_of, f"query {kind}, asked array<float>, cell int, place int"), "probes")
    counts = {r.cell: r.n for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    opened = {c: n for c, n in counts.items() if c in index.parts}
    blocks = {c: -(-n // BLOCK) for c, n in opened.items()}
    rows = index.table(spark).where(F.col("cell").isin(sorted(opened)) if opened else F.lit(False))
    left = probes.withColumns({"part": F.explode(F.sequence(F.lit(0), _of(index.parts) - 1)), "block": F.pmod(F.xxhash64("query"), _of(blocks)).cast("int")})
    right = rows.select("cell", "part", "key", "code").withColumn("block", F.explode(F.sequence(F.lit(0), _of(blocks) - 1)))
    named = rows.schema["key"].dataType.simpleString()

    def scan(key, ask: pa.Table, held: pa.Table) -> pa.Table:
        cell, part = key[0].as_py(), key[1].as_py()
        names = ["query", "key", "cell", "part", "near"]
        if not ask.num_rows or not held.num_rows:
            return pa.table([ask["query"].slice(0, 0), held["key"].slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.float64())], names)
        q = ask["asked"].combine_chunks().flatten().to_numpy().reshape(-1, model.dim)
        code = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        least = ask["least"].to_numpy()
        order, found = _ordered(held["key"]), []
        for lo in range(0, len(q), 32):  # bounds the scores in memory
            part_of = _split(q[lo : lo + 32], len(model.codebooks))
            score = np.repeat((q[lo : lo + 32] @ model.centres[cell])[:, None], len(code), 1)
            for j, book in enumerate(model.codebooks):
                score += (part_of[:, j] @ book.T)[:, code[:, j]]
            row, col = _top(score, order, candidates)
            may = score[row, col] >= least[row + lo]
            row, col = row[may], col[may]
            found.append((row + lo, col, score[row, col]))
        row, col, near = (np.concatenate(x) for x in zip(*found, strict=True))
        n = len(row)
        return pa.table([ask["query"].take(pa.array(row)), held["key"].take(pa.array(col)), pa.array(np.full(n, cell, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(near.astype(np.float64))], names)

    by = ["cell", "part", "block"]

    def scanned(left: DataFrame) -> DataFrame:
        met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scan, f"query {kind}, key {named}, cell int, part int, near double")
        return _best(met, candidates, "near").select("query", "key", "cell", "part", "near")

    lowest = F.lit(float("-inf"))
    few = stored(scanned(left.where(F.col("place") < FIRST).withColumn("least", lowest)), "candidates")
    if known > FIRST:
        full = few.groupBy("query").agg(F.when(F.count(F.lit(1)) >= candidates, F.min("near")).alias("least"))
        rest = left.where(F.col("place") >= FIRST).join(full, "query", "left").withColumn("least", F.coalesce("least", lowest))
        few = stored(_best(few.union(scanned(rest)), candidates, "near"), "candidates")
    exact = few.select("query", "key", "cell", "part").join(rows.select("cell", "part", "key", "vector"), ["cell", "part", "key"]).join(asked, "query")
    scored = exact.select("query", "key", cosine_score("asked", "vector").alias("score")).where("score is not null")
    return _best(scored, limit).select("query", "key", "score", "rank")


def search_all(docs: DataFrame, queries: DataFrame, key: str, query: str, limit: int = 10, vector: str = "embedding", asked: str = "embedding") -> DataFrame:
    """query, key, score, rank of the ``limit`` best of each query among all rows: every query meets every row, in blocks.

    Rows are dealt to parts and queries to blocks, each pair of which is one product of matrices."""
    ask = _queries(queries, query, asked)
    rows = docs.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where("key is not null and size(vector) > 0")
    parts, blocks = docs.count() // PART_ROWS + 1, ask.count() // BLOCK + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = ask.withColumns({"dim": F.size("asked"), "block": own("query", blocks)}).withColumn("part", every(parts))
    right = rows.withColumns({"dim": F.size("vector"), "part": own("key", parts)}).withColumn("block", every(blocks))
    kind, named = ask.schema["query"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()

    def meet(key, ask: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query", "key"]
        if not ask.num_rows or not held.num_rows:
            return pa.table([ask["query"].slice(0, 0), held["key"].slice(0, 0)], names)
        (a, q), (b, x) = unit(ask["asked"].combine_chunks(), key[0].as_py()), unit(held["vector"].combine_chunks(), key[0].as_py())
        order, found = _ordered(held["key"])[b], []
        for lo in range(0, len(q), 64):
            row, col = _top(q[lo : lo + 64].astype(np.float64) @ x.T.astype(np.float64), order, 4 * limit)
            found.append((a[row + lo], b[col]))
        row, col = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (a[:0], b[:0])
        return pa.table([ask["query"].take(pa.array(row)), held["key"].take(pa.array(col))], names)

    by = ["dim", "part", "block"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"query {kind}, key {named}")
    exact = met.join(rows, "key").join(ask, "query").select("query", "key", cosine_score("asked", "vector").alias("score"))
    return _best(exact.where("score is not null"), limit).select("query", "key", "score", "rank")
