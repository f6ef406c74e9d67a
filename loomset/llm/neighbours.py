"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length 1 and projected on single random lines; an index shard keeps each line's
values sorted. A query's window on each line is centred on the query; windows grow by virtual rehashing
(wider windows over the same sorted arrays, of which only the new ends are read). A vector that falls
into the windows of at least ALPHA of the lines is verified by its exact cosine. A query ends when a
vector as near as its k-th best would have been seen with high probability, or all windows are full.

Every vector is indexed. Shards hold about SHARD vectors and meet the queries in blocks; a query's
nearest of all shards are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part;
vectors are compared with those of their own dimension only; rows of the query's own id are no
candidates; repeated ids are candidates of their own; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, cut

LINES, ALPHA, SURE, SHARD, BLOCK, SEED = 128, 0.45, 1.64, 16384, 8192, 7
#: Half widths of the windows, in units of a projection's spread for vectors one apart.
WIDTHS = (0.2, 0.8, 0.9, 1.0, 1.15, 1.4, 2.0, 4.0, math.inf)


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        d = vectors.shape[1]
        self.lines = np.random.default_rng(SEED).standard_normal((d, LINES)) / math.sqrt(d)
        self.lines /= np.sqrt((self.lines**2).sum(axis=0))
        at = ((vectors / self.norms[:, None]) @ self.lines).T
        self.order = np.argsort(at, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query number, id, cosine) of the k nearest found."""
        n, d = self.vectors.shape
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = ((queries / norms[:, None]) @ self.lines).T
        need = math.ceil(ALPHA * LINES)
        out, done = [], np.zeros(len(queries), bool)
        spans = []
        for w in WIDTHS:
            h = w / math.sqrt(d)
            lo = np.stack([np.searchsorted(s, p - h, "left") for s, p in zip(self.sorted, at)])
            hi = np.stack([np.searchsorted(s, p + h, "right") for s, p in zip(self.sorted, at)])
            spans.append((lo, hi))
        for q in range(len(queries)):
            count = np.zeros(n, np.uint8)
            checked = np.zeros(n, bool)
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            for level, w in enumerate(WIDTHS):
                lo, hi = spans[level]
                if not level:
                    for i in range(LINES):
                        count[self.order[i, lo[i, q] : hi[i, q]]] += 1
                else:
                    lo0, hi0 = spans[level - 1]
                    for i in range(LINES):
                        o = self.order[i]
                        count[o[lo[i, q] : lo0[i, q]]] += 1
                        count[o[hi0[i, q] : hi[i, q]]] += 1
                new = np.flatnonzero((count >= need) & ~checked)
                if len(new):
                    checked[new] = True
                    new = new[self.ids[new] != own[q]]
                    s = (self.vectors[new] * queries[q]).sum(axis=1) / (self.norms[new] * norms[q])
                    rows, scores = np.concatenate([rows, new]), np.concatenate([scores, s])
                    best = np.lexsort((self.ids[rows], -scores))[:k]
                    rows, scores = rows[best], scores[best]
                if len(rows) == k and w < math.inf:
                    away = math.sqrt(max(2 - 2 * scores[-1], 1e-12))
                    if math.erf(w / away / math.sqrt(2)) >= ALPHA + SURE * math.sqrt(0.25 / LINES):
                        break
            out += [(q, int(self.ids[r]), float(s)) for r, s in zip(rows, scores)]
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))


def nearest(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query(id column) holds, its k nearest found."""
    spark = vectors.sparkSession
    bound_arrow(spark)
    v = cut(usable(vectors, id_col, vector_col), "vectors")
    n, n_queries = v.count(), v.where(is_query(F.col("id"))).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_queries // BLOCK))
    numbered = lambda x, c: F.explode(F.sequence(F.lit(0), F.lit(x - 1))).alias(c)
    base = v.select("id", "v", "d", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), numbered(blocks, "block"))
    asked = v.where(is_query(F.col("id"))).dropDuplicates(["id"]).select("id", "v", "d", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"), numbered(shards, "shard"))

    def find(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if len(left) and len(right):
            matrix = lambda t: t.column("v").combine_chunks().values.to_numpy().reshape(len(t), -1)
            own = right.column("id").to_numpy()
            got = [(int(own[q]), i, s) for q, i, s in Shard(left.column("id").to_numpy(), matrix(left)).nearest(own, matrix(right), k)]
        cols = list(zip(*got)) or [()] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    by = ["d", "shard", "block"]
    found = base.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
