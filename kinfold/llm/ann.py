"""Nearest neighbours by cross-polytope hashing.

Vectors are turned by fast Hadamard pseudo-rotations (random signs and a Walsh-Hadamard transform, three times); the nearest
signed axis is a hash. A bucket of a table is named by ``hashes`` such axes, so many that there are about as many buckets as
rows: the buckets grow in number with the table. A query probes in each of ``TABLES`` tables the buckets for which its own
coordinates are largest in sum. How many follows from a recall target: the exact neighbours of ``SAMPLE`` queries are found in
one pass over all rows, and probes double, from those that hold thrice k rows or ``PROBE`` times the square root of
all, until the buckets hold ``RECALL`` of these neighbours. Distinct candidates are reranked exactly. Every row is indexed; no bucket is capped.

The rows are dealt to shards of about ``SHARD`` vectors; a task holds the tables of one shard, and the queries stream past
it. A shard is no part of the hashing: the buckets that a query probes are the same in all.

Inner products of vectors of different length become angles with one more coordinate that fills each vector up to the
longest; vectors of one length need none.

Defined cases: null, empty and zero vectors, those with null, infinite or NaN components, and those of another dimension
than most take no part; null ids take no part; rows with one id are rows of their own as candidates, the nearest is listed
once; ties go to the smaller id; fewer candidates than k are all returned; further columns, of any name, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import text_batches
from kinfold.session import materialize

K = 20
TABLES, SEED = 36, 20
PROBE = 0.45
SHARD = 1 << 14
#: Queries whose exact neighbours tell how many buckets to probe, and the share of these neighbours to be found.
SAMPLE, RECALL = 96, 0.95
#: Axes of each hash from which buckets are put together, by the number of hashes of a bucket.
AXES = (0, 1 << 20, 32, 12, 8)
#: Coordinates up to which a rotation is a matrix that is kept; beyond it butterflies take less.
MATRIX = 256
#: Queries that probe at once.
QUERY_ROWS = 64


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, by butterflies."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _signs(tables: int, hashes: int, size: int):
    """The random signs of each table: three times ``size`` for each hash."""
    rng = np.random.default_rng(SEED)
    for _ in range(tables):
        yield [[rng.choice([-1.0, 1.0], size) for _ in range(3)] for _ in range(hashes)]


def _turn(x: np.ndarray, signs: list[np.ndarray]) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


@cache
def _rotations(tables: int, hashes: int, size: int) -> list[list[np.ndarray]]:
    """The rotations of each table as matrices, made once in each process."""
    return [[_turn(np.eye(size), signs) for signs in table] for table in _signs(tables, hashes, size)]


class Polytope:
    """The tables: rotations, how many hashes name a bucket, how many buckets of a table a query probes."""

    def __init__(self, rows: int, dimension: int, longest: float, shortest: float, tables: int = TABLES, probe: float = PROBE):
        self.longest, self.tables = longest, tables
        self.fill = shortest < 0.999 * longest
        self.size = 1 << int(np.ceil(np.log2(max(2, dimension + self.fill))))
        self.hashes = int(np.clip(np.log(max(rows, 1)) / np.log(2 * self.size), 1, len(AXES) - 1))
        self.buckets = (2 * self.size) ** self.hashes
        self.axes = min(2 * self.size, AXES[self.hashes])
        budget = max(3 * K, probe * np.sqrt(rows))
        self.probes = int(min(self.axes**self.hashes, np.ceil(budget * self.buckets / max(rows, 1))))

    def turned(self, vectors: np.ndarray, query: bool):
        """The coordinates of the vectors, a table and a hash after the other."""
        norm = np.sqrt((vectors**2).sum(1))
        wide = np.zeros((len(vectors), self.size))
        wide[:, : vectors.shape[1]] = vectors / (norm[:, None] if query else self.longest)
        if self.fill and not query:
            wide[:, vectors.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        for turns in _rotations(self.tables, self.hashes, self.size) if self.size <= MATRIX else _signs(self.tables, self.hashes, self.size):
            yield [wide @ turn if self.size <= MATRIX else _turn(wide, turn) for turn in turns]

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table, numbered through all tables."""
        out = []
        for t, coordinates in enumerate(self.turned(vectors, False)):
            cell = np.full(len(vectors), t, np.int64)
            for x in coordinates:
                axis = np.abs(x).argmax(1)
                cell = cell * 2 * self.size + axis * 2 + (x[np.arange(len(x)), axis] < 0)
            out.append(cell)
        return np.stack(out, 1)

    def _sums(self) -> list[np.ndarray]:
        """Ranks of the axes of each hash whose sums can be among the best: of ranks i, j ... there are (i + 1)(j + 1) ... sums no smaller."""
        ranks: list[np.ndarray] = []
        ahead = np.ones(1, np.int64)
        for _ in range(self.hashes):
            product = ahead[:, None] * (1 + np.arange(self.axes))
            old, new = np.nonzero(product <= max(self.probes, 1))
            ranks, ahead = [r[old] for r in ranks] + [new], product[old, new]
        return ranks

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """The buckets that each query probes."""
        out, ranks = [], self._sums()
        for t, coordinates in enumerate(self.turned(queries, True)):
            cell, score = np.full((len(queries), len(ranks[0])), t, np.int64), np.zeros((len(queries), len(ranks[0])))
            for x, rank in zip(coordinates, ranks, strict=True):
                size = np.abs(x)
                order = np.argsort(-size, 1, kind="stable")
                # Signed axes, the largest first: all with the sign of their coordinate, then the others from behind.
                top = 2 * order + (np.take_along_axis(x, order, 1) < 0)
                large = np.take_along_axis(size, order, 1)
                top, large = np.concatenate([top, top[:, ::-1] ^ 1], 1), np.concatenate([large, -large[:, ::-1]], 1)
                cell = cell * 2 * self.size + top[:, rank]
                score += large[:, rank]
            if self.probes < score.shape[1]:
                cell = np.take_along_axis(cell, np.argpartition(-score, self.probes - 1, 1)[:, : self.probes], 1)
            out.append(cell)
        return np.concatenate(out, 1)


class Shard:
    """The tables over some of the rows."""

    def __init__(self, polytope: Polytope, ids: np.ndarray, vectors: np.ndarray):
        self.polytope, self.ids, self.vectors, self.read = polytope, ids, vectors, 0
        cells = polytope.places(vectors)
        order = np.argsort(cells, axis=None, kind="stable")
        self.row = (order // cells.shape[1]).astype(np.int32)
        # The cells that hold rows, and where each begins, and how many.
        cell = cells.ravel()[order]
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.cell, self.begin = cell[begin], begin
        self.count = np.diff(np.r_[begin, len(cell)])
        self.longest = np.sqrt((vectors**2).sum(1)).max(initial=0)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query ids, ids and scores of the k nearest candidates of each query."""
        out = []
        mark = np.zeros(len(self.ids), bool)
        for i in range(0, len(queries), QUERY_ROWS):
            probed = np.sort(self.polytope.probed(queries[i : i + QUERY_ROWS]), 1)
            at = np.minimum(np.searchsorted(self.cell, probed), len(self.cell) - 1)
            held = self.cell[at] == probed
            for q, x, c, h in zip(query_ids[i:], queries[i:], at, held, strict=False):
                a, n = self.begin[c[h]], self.count[c[h]]
                new = np.cumsum(n) - n
                mark[self.row[np.repeat(a - new, n) + np.arange(n.sum())]] = True
                rows = np.flatnonzero(mark)
                mark[rows] = False
                rows = rows[self.ids[rows] != q]
                self.read += len(rows)
                near = self.vectors[rows]
                if len(rows) > k:
                    # What cannot be among the k by more than rounding needs no exact sum.
                    rough = near @ x
                    least = np.partition(rough, len(rows) - k)[len(rows) - k]
                    keep = rough >= least - 1e-9 * self.longest * np.sqrt(x @ x)
                    rows, near = rows[keep], near[keep]
                # Sums in one order, whatever the other candidates are.
                score = (near * x).sum(1)
                top = np.lexsort((self.ids[rows], -score))[:k]
                out.append((np.full(len(top), q), self.ids[rows][top], score[top]))
        return out


def tune(polytope: Polytope, queries: np.ndarray, near: list[np.ndarray], recall: float = RECALL) -> float:
    """Double the probes of ``polytope`` until the buckets of ``queries`` hold a share of ``recall`` of their neighbours ``near``; the share."""
    total = sum(map(len, near))
    if not total:
        return 1.0
    every = polytope.places(np.concatenate([x for x in near if len(x)]))
    places = np.split(every, np.cumsum([len(x) for x in near])[:-1])
    while True:
        probed = np.concatenate([polytope.probed(queries[i : i + QUERY_ROWS]) for i in range(0, len(queries), QUERY_ROWS)])
        found = sum(int(np.isin(p, q).any(1).sum()) for p, q in zip(places, probed, strict=True)) / total
        if found >= recall or polytope.probes >= polytope.axes**polytope.hashes:
            return found
        polytope.probes = min(2 * polytope.probes, polytope.axes**polytope.hashes)


def exact(data: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> list[np.ndarray]:
    """The vectors of the ``k`` nearest rows of ``data`` for each of some queries, by comparison with all rows.

    A task keeps k rows for each query, whatever it reads.
    """
    shared = data.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries], np.int64), np.stack([x for _, x in queries])))

    def best(batches):
        ids, asked = shared.value
        held = [(np.zeros(0), np.zeros((0, asked.shape[1]))) for _ in ids]
        for batch in (b for b in batches if b.num_rows):
            vec, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))
            score = asked @ x.T
            for q, (own, vectors) in enumerate(held):
                mine = np.where(vec == ids[q], -np.inf, score[q])
                top = np.argsort(-mine, kind="stable")[:k]
                top = top[mine[top] > -np.inf]
                own, vectors = np.r_[own, mine[top]], np.concatenate([vectors, x[top]])
                order = np.argsort(-own, kind="stable")[:k]
                held[q] = own[order], vectors[order]
        number = np.repeat(np.arange(len(ids)), [len(own) for own, _ in held]).astype(np.int32)
        flat = np.concatenate([v for _, v in held])
        yield pa.record_batch([pa.array(number), pa.array(np.concatenate([own for own, _ in held])), pa.array(list(flat), pa.list_(pa.float64()))], ["query", "score", "embedding"])

    found = data.mapInArrow(best, "query int, score double, embedding array<double>")
    order = W.partitionBy("query").orderBy(F.desc("score"))
    near = [[] for _ in queries]
    for r in found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).toLocalIterator():
        near[r.query].append(r.embedding)
    return [np.array(x, float).reshape(len(x), -1) if x else np.zeros((0, 1)) for x in near]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, probe: float = PROBE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of ``vectors`` found for each row of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    text_batches(spark)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    data, asked = clean(vectors), clean(queries)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = data.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.min(square).alias("shortest")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    polytope = Polytope(most.n, most.d, float(np.sqrt(most.longest)) * (1 + 1e-12), float(np.sqrt(most.shortest)), tables, probe)
    same = data.filter(F.size("embedding") == most.d)
    order = F.xxhash64("vec_id", "embedding")
    sample = [(r.vec_id, np.array(r.embedding, float)) for r in asked.filter(F.size("embedding") == most.d).orderBy(order, "vec_id").limit(SAMPLE).collect()]
    if sample:
        tune(polytope, np.stack([x for _, x in sample]), exact(same, sample, k), recall)
    shards = -(-most.n // SHARD)
    rows = data.filter(F.size("embedding") == most.d).select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "vec_id", "embedding")
    looks = asked.filter(F.size("embedding") == most.d).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "vec_id", "embedding")
    stream = rows.unionByName(looks).repartition("shard").sortWithinPartitions("shard", "role", "vec_id")

    def rerank(batches):
        at, gathered, index = None, [], None
        for batch in (b for b in batches if b.num_rows):
            shard, role, vec = (batch.column(c).to_numpy() for c in ("shard", "role", "vec_id"))
            x = _matrix(batch.column("embedding"))
            edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (role[1:] != role[:-1]), True])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if shard[a] != at:
                    at, gathered, index = shard[a], [], None
                if role[a] == 0:
                    gathered.append((vec[a:b], x[a:b]))
                    continue
                if index is None and gathered:
                    index = Shard(polytope, *(np.concatenate([g[i] for g in gathered]) for i in range(2)))
                if index is not None:
                    found += index.nearest(vec[a:b], x[a:b], k)
            columns = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64 if j < 2 else float) for j in range(3)]
            yield pa.record_batch([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    near = materialize(stream.mapInArrow(rerank, "query_id long, vec_id long, score double"), "near")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "embedding")
    return neighbours(rows, rows.filter(F.pmod(F.col("vec_id"), F.lit(20)) == 0))
