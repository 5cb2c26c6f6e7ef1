"""Exact top-k search by MaxScore over shards of posting lists.

A vector's components are its terms: a term is a dimension and a sign, and its posting list in a shard holds the vectors
whose component has that sign. A query's bound for a term is its weight times the largest component of the list. Terms
are split by their bounds: those of the least bounds, whose sum stays below the k-th score so far, are non-essential.
Essential lists are traversed; the others are probed only for vectors that can still compete. Shards are merged.

Vectors are dealt into shards of bounded size and shuffled once; only queries are copied, to every shard, which reads
them in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, n_partitions, small_or_not
from lodestar.llm.shingles import bounds

#: Components of a shard's vectors: what one task holds at a time.
SHARD = 1 << 19
SCALE = 1024
#: Dimensions that are probed between two prunings.
STRIDE = 8


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component x, as whole doubles; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))


class _Shard:
    """Posting lists of a block of vectors."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[order], np.ascontiguousarray(m[order])
        self.columns = np.ascontiguousarray(self.m.T)
        d = m.shape[1]
        self.lists = {s: [np.flatnonzero(self.columns[j] * s > 0) for j in range(d)] for s in (1, -1)}
        self.top = {1: np.maximum(self.m.max(axis=0), 0), -1: np.maximum(-self.m.min(axis=0), 0)}

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        sign = np.where(q >= 0, 1, -1)
        bound = np.where(sign > 0, self.top[1], self.top[-1]) * np.abs(q)
        order = np.argsort(-bound, kind="stable")
        alive = self.ids != own
        # true scores of some promising vectors give the first threshold
        first = order[0]
        seeds = np.argpartition(-self.columns[first] * sign[first], min(4 * k, len(self.ids)) - 1)[: 4 * k]
        seeds = seeds[alive[seeds]]
        floor = -np.inf
        if len(seeds) >= k:
            floor = np.partition(self.m[seeds] @ q, len(seeds) - k)[len(seeds) - k]
        rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0.0]))
        essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(order)
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        for j in order[:essential]:
            at = self.lists[int(sign[j])][j]
            score[at] += q[j] * self.columns[j][at]
            seen[at] = True
        if rest[essential] >= floor:
            seen[:] = True
        # score holds the positive parts of essential terms; what lowers it and the other terms are probed
        at = np.flatnonzero(seen & alive & (score + rest[essential] >= floor))
        score = score[at]
        todo = [*[(int(j), True) for j in order[:essential]], *[(int(j), False) for j in order[essential:]]]
        for i in range(0, len(todo), STRIDE):
            for j, half in todo[i : i + STRIDE]:
                part = q[j] * self.columns[j][at]
                score = score + (np.minimum(part, 0) if half else part)
            left = rest[min(max(i + STRIDE, essential), len(order))]
            stay = score + left >= floor
            if not stay.all():
                at, score = at[stay], score[stay]
        if len(at) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= least], score[score >= least]
            best = np.lexsort((self.ids[at], -score))[:k]
            at, score = at[best], score[best]
        return self.ids[at], score


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _exactly(ids: np.ndarray, m: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Beyond exact doubles: whole numbers of any size."""
    scores = np.array([sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in m], object)
    best = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[best], scores[best]


def _search(k: int):
    """Sorted rows: of each shard first its vectors, then queries, which are answered one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        here, shard, ids, m, most = None, None, None, None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            d, s, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "s", "asks"))
            at = bounds(np.stack((d, s, asks), axis=1).astype(np.int64).view("i8,i8,i8").ravel())
            out: tuple[list, list, list, list] = ([], [], [], [])
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = batch.slice(a, b - a)
                own, vs = part.column("id").to_numpy(), _rows(part.column("v"), int(d[a]))
                if here != (d[a], s[a]):
                    here, held, shard = (d[a], s[a]), [], None
                if not asks[a]:
                    held.append((own, vs))
                    continue
                if not held:
                    continue
                if shard is None:
                    ids, m = (np.concatenate(x) for x in zip(*held, strict=True))
                    shard, most = _Shard(ids, m) if m.shape[1] else None, float(np.abs(m).max(initial=0))
                for query, q, key in zip(own, vs, part.column("key").to_numpy(), strict=True):
                    exact = shard and m.shape[1] * most * np.abs(q).max(initial=0) < 2**53
                    found, scores = shard.search(q, query, k) if exact else _exactly(ids, m, query, q, k)
                    for x, y in zip(out, ([query] * len(found), [key] * len(found), found, scores), strict=True):
                        x.extend(map(int, y))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "query_key", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k highest integer inner products among the other vectors.

    Components become floor(scale * x). Ties go to the smaller vec_id. Vectors that are null, or hold null or components
    that are not finite, and rows without an id, take no part on either side; only vectors of as many components as the
    query are compared; a query is not compared with rows of its own id. Repeated queries answer once, repeated
    vectors count each. With fewer than k vectors all are returned; empty tables give no rows.
    """

    def valid(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"))
        return rows.filter("id is not null and v is not null").withColumn("d", F.size("v"))

    # row numbers, fixed by the checkpoint, deal even equal rows evenly
    rows = checkpoint(valid(vectors).withColumn("n", F.monotonically_increasing_id()))
    asked = valid(queries).dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("id", "v"))
    sizes = checkpoint(rows.groupBy("d").agg(F.count(F.lit(1)).alias("rows")).select("d", F.ceil(F.col("rows") * F.greatest("d", F.lit(1)) / SHARD).alias("shards")))
    sizes = small_or_not(sizes, F.lit(16))
    here = rows.join(sizes, "d").select("d", F.pmod(F.xxhash64("n"), F.col("shards")).alias("s"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("key"), "id", "v")
    there = asked.join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("s"), F.lit(True).alias("asks"), "key", "id", "v")
    parts = n_partitions(vectors.sparkSession)
    dealt = here.unionByName(there).repartition(parts, "d", "s").sortWithinPartitions("d", "s", "asks")
    found = dealt.mapInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
