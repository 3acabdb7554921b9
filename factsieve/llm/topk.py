"""Exact top-k search by inner product with a pivot-distance index.

All vectors lie in a ball of radius M; one more component, sqrt(M^2 - |y|^2), puts them on a sphere, where a larger inner product with a
query is a smaller distance: 2 q.y = |q|^2 + M^2 - d(q, y)^2. Each vector is keyed by its nearest pivot and the distance to it, and
the distances of a pivot are cut into rings. By the triangle inequality a vector at distance r of pivot p is no nearer to q than
|d(q, p) - r|, which bounds the inner products of a whole ring. A query starts with the k-th best of a sample, visits its
best rings first (wave one), takes the k-th best found as its new bar and then visits only the rings whose bound reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import table, written

#: Pivots, rings of a pivot and rows of the sample that pivots and first bars come from: the directory has PIVOTS * RINGS rows at most.
PIVOTS, RINGS, SAMPLE = 64, 16, 4096
#: Rings that a query visits in the first wave; queries and index rows that meet at once.
FIRST, PACK, CELL_ROWS = 4, 512, 4096
SCALE = 64


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x) of doubles. Null and empty vectors and those with null or non-finite components take no part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(odd, F.lit(True)) & F.col(id_col).isNotNull()
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


class Geometry:
    """The sphere: M^2, pivots on it and distances to them."""

    def __init__(self, sample: np.ndarray, largest: float, pivots: int):
        self.m2 = float(largest)
        lifted = self.lift(sample)
        chosen, gap = [0], np.linalg.norm(lifted - lifted[0], axis=1)
        while len(chosen) < min(pivots, len(lifted)) and gap.max() > 0:  # farthest first
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(lifted - lifted[chosen[-1]], axis=1))
        self.pivots = lifted[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(1)))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        d2 = (points * points).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0.0, d2))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([q, np.zeros((len(q), 1))]))

    def bound(self, q2: np.ndarray, dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest inner product that rows at distances low..high of a pivot can have with a query at distance dq; a little is added for rounding."""
        least = np.maximum(0.0, np.maximum(dq - high, low - dq))
        return (q2 + self.m2 - least**2) / 2 + 1e-6 * (1 + q2 + self.m2)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
    """The k largest scores without ``own``, ties to the smaller id."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > 4 * k:
        bar = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= bar]
    order = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return list(zip(ids[order].tolist(), scores[order].tolist(), strict=True))


def top_k(vectors: DataFrame, is_query, k: int = 20, pivots: int = PIVOTS, rings: int = RINGS) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each query with the rows of other ids.

    ``vectors`` is (vec_id, v); ``is_query`` is a condition on vec_id. Rows of equal vectors are one index row that carries the k + 1 smallest ids, all
    that can be asked of it; a row that repeats id and vector counts once. Vectors need one dimension. Queries are sent to cells in packs; no
    pair of a query and a row becomes a row of its own unless it is among the cell's k best for that query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    base = written(vectors.distinct(), "vectors")
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not some:
        return spark.createDataFrame([], schema)
    largest = base.select(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x * x))).first()[0]
    sample_ids, sample = np.array([r[0] for r in some]), np.array([r[1] for r in some], np.float64)
    order = np.random.default_rng(0).permutation(len(sample))
    geometry = Geometry(sample[order], largest, pivots)

    few = Window.partitionBy("v").orderBy("vec_id")
    index = base.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1).drop("place")

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                d = geometry.distances(geometry.lift(_matrix(b.column(1))))
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["vec_id", "v", "pivot", "r"])

    index = written(index.mapInArrow(keyed, "vec_id long, v array<long>, pivot int, r double"), "index")
    spans = index.groupBy("pivot").agg(F.min("r").alias("r0"), F.max("r").alias("r1"))  # at most one row a pivot
    width = F.greatest((F.col("r1") - F.col("r0")) / rings, F.lit(1e-9))
    index = index.join(F.broadcast(spans), "pivot").withColumn("ring", F.least(F.floor((F.col("r") - F.col("r0")) / width), F.lit(rings - 1)).cast("int")).drop("r0", "r1")
    listed = index.groupBy("pivot", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    listed = sorted((r["pivot"], r["ring"], r["low"], r["high"], r["n"]) for r in listed)
    cells = {(p, g): i for i, (p, g, *_) in enumerate(listed)}
    at = np.array([c[0] for c in listed])
    low, high, sizes = (np.array([c[j] for c in listed], float) for j in (2, 3, 4))
    parts = np.maximum(1, np.ceil(sizes / CELL_ROWS)).astype(int)
    grid = np.zeros((pivots, rings), int)
    for (p, g), i in cells.items():
        grid[p, g] = i
    cell_of = F.element_at(F.array(*[F.lit(int(x)) for x in grid.ravel()]), (F.col("pivot") * rings + F.col("ring") + 1).cast("int"))
    many = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), (F.col("cell") + 1).cast("int"))
    index = index.withColumn("cell", cell_of).withColumn("part", F.pmod(F.xxhash64("vec_id"), many).cast("int")).select("cell", "part", "vec_id", "v", "r")

    def sent(wave: int):
        """Packs of queries for the cells that their bars leave: cell, part, and of each query id, bar, vector."""

        def run(batches):
            for b in batches:
                for s in range(0, b.num_rows, PACK):
                    c = b.slice(s, PACK)
                    ids, q = c.column(0).to_numpy(), _matrix(c.column(1))
                    q2, dq = (q * q).sum(1), geometry.query_distances(q)[:, at]
                    bound = geometry.bound(q2[:, None], dq, low, high)
                    if wave == 1:
                        scores = np.where(sample_ids[None] == ids[:, None], -np.inf, q @ sample.T)
                        bar = np.partition(scores, max(0, len(sample) - k), axis=1)[:, max(0, len(sample) - k)] if len(sample) > k else np.full(len(ids), -np.inf)
                    else:
                        bar = c.column(2).to_numpy()
                    n = min(FIRST, bound.shape[1])
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, np.argpartition(-bound, n - 1, axis=1)[:, :n], True, axis=1)
                    go = (bound >= bar[:, None]) & (first if wave == 1 else ~first)
                    rows = [(int(i), j, np.flatnonzero(go[:, i])) for i in np.flatnonzero(go.any(0)) for j in range(parts[i])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                            pa.array([ids[r[2]].tolist() for r in rows], pa.list_(pa.int64())), pa.array([bar[r[2]].tolist() for r in rows], pa.list_(pa.float64())),
                            pa.array([q[r[2]].astype(np.int64).ravel().tolist() for r in rows], pa.list_(pa.int64()))], names=["cell", "part", "ids", "bars", "q"])

        return run

    def visit(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            ids, y = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks())
            for i in range(right.num_rows):
                asked, bars = right.column("ids")[i].values.to_numpy(), right.column("bars")[i].values.to_numpy()
                q = right.column("q")[i].values.to_numpy().reshape(len(asked), -1).astype(np.float64)
                scores = q @ y.T
                for own, bar, row in zip(asked.tolist(), bars.tolist(), scores, strict=True):
                    keep = np.flatnonzero(row >= bar)
                    out += [(own, v, int(s)) for v, s in best_of(ids[keep], row[keep], k, own)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    def found(queries: DataFrame, wave: int) -> DataFrame:
        packs = queries.mapInArrow(sent(wave), "cell int, part int, ids array<long>, bars array<double>, q array<long>")
        return index.groupBy("cell", "part").cogroup(packs.groupBy("cell", "part")).applyInArrow(visit, "query_id long, vec_id long, score long")

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = base.where(is_query)
    one = written(found(queries, 1).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "wave")
    bars = one.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
    rest = queries.join(bars, "vec_id", "left").select("vec_id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    two = found(rest, 2).select("query_id", "vec_id", "score")
    both = one.select("query_id", "vec_id", "score").unionByName(two)
    return both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark, sf_dir):
    vectors = clean_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
