"""Blocks of queries against shards of vectors, in numpy, without a cross join of rows.

Vectors are dealt into shards of bounded size and shuffled once. Only queries are copied, to every shard of vectors of
their length, which reads them block by block. A task holds one shard and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of a shard's vectors, and distances of a block of queries to them, that a task holds at a time.
SHARD, BLOCK = 1 << 19, 1 << 21
#: (query ids, queries, ids, vectors) to (query places, vector places, distances).
Pick = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def stretches(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of rows that are equal in the named columns of whole numbers, with what they are equal in."""
    keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    n = batch.num_rows
    cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if n > 1 else np.zeros(0, np.int64)
    for a, b in zip([0, *cuts] if n else [], [*cuts, n], strict=False):
        yield tuple(k[a].item() for k in keys), batch.slice(a, b - a)


class _Groups:
    """What the pairs of one shard bring together: union by the shard's rows and those queries that are near any."""

    def __init__(self, ids: np.ndarray):
        self.names = ids.tolist()
        self.at = {x: i for i, x in enumerate(self.names)}
        self.parent = np.arange(len(ids))

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, qids: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        size = len(self.parent)
        met = np.unique(a * size + self.parent[b])  # a query meets each group once
        new = [x for x in qids[np.unique(a)].tolist() if x not in self.at]
        self.at.update(zip(new, range(size, size + len(new)), strict=True))
        self.names += new
        self.parent = np.concatenate((self.parent, np.arange(size, size + len(new))))
        for own, root in zip(qids[met // size].tolist(), (met % size).tolist(), strict=True):
            x, y = self._find(self.at[own]), self._find(root)
            self.parent[max(x, y)] = min(x, y)
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Every row of a group but the least, and the least."""
        names = np.array(self.names, np.int64)
        least = names.copy()
        np.minimum.at(least, self.parent, names)
        least = least[self.parent]
        return names[least < names], least[least < names]


def _linker(pick: Pick) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, groups, vectors = None, [], None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if groups is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in groups.links()], ["a", "b"])

        for batch in batches:
            for (d, s, asks), part in stretches(batch, ("d", "s", "asks")):
                if here != (d, s):
                    yield from ended()
                    here, held, groups = (d, s), [], None
                if not asks:
                    held.append((part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), matrix(part.column("vector"))))
                    continue
                if not held:
                    continue
                if groups is None:
                    ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                    groups = _Groups(ids)
                block = max(1, BLOCK // len(ids))
                for i in range(0, part.num_rows, block):
                    some = part.slice(i, block)
                    qids = some.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    a, b, _ = pick(qids, matrix(some.column("vector")), ids, vectors)
                    if len(a):
                        groups.add(qids, a, b)
        yield from ended()

    return run


def _runner(pick: Pick) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ids, vectors = None, [], None, None
        for batch in batches:
            for (d, s, asks), part in stretches(batch, ("d", "s", "asks")):
                if here != (d, s):
                    here, held, ids = (d, s), [], None
                if not asks:
                    held.append((part.column("id").to_numpy(zero_copy_only=False), matrix(part.column("vector"))))
                    continue
                if not held:
                    continue
                if ids is None:
                    ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                block = max(1, BLOCK // len(ids))
                for i in range(0, part.num_rows, block):
                    some = part.slice(i, block)
                    qids = some.column("query_id").to_numpy(zero_copy_only=False)
                    a, b, found = pick(qids, matrix(some.column("vector")), ids, vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[a]).cast(some.column("query_id").type), pa.array(ids[b]).cast(some.column("id").type), pa.array(found, pa.float64())], ["query_id", "id", "distance"])

    return run


def dealt(vectors: DataFrame, queries: DataFrame, size: int, length: int | None = None, key: str | None = None) -> DataFrame:
    """``d, s, asks, id, query_id, vector``: vectors in shards of about ``size`` components, and queries in every shard.

    Rows are partitioned and sorted by (d, s), with the vectors of a shard before its queries. d is the length of both
    sides, or else queries, all of one length, meet the vectors of ``length``, or d is the column ``key`` of both sides.
    """
    of = F.size("vector") if key is None else F.col(key).cast("int")
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), of.alias("d"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), (of if length is None else F.lit(length)).alias("d"))
    sizes = rows.groupBy("d").agg(F.ceil(F.sum(F.greatest(F.size("vector"), F.lit(1))) / size).alias("shards"))
    here = rows.join(sizes, "d").select("d", F.pmod(F.xxhash64("id", "vector"), F.col("shards")).alias("s"), F.lit(0).alias("asks"), "id", F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "vector")
    there = asked.join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("s"), F.lit(1).alias("asks"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "query_id", "vector")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64("d") + F.col("s"), F.lit(parts)).cast("int")  # shards in turn, so that tasks have as many
    return here.unionByName(there).repartitionById(parts, place).sortWithinPartitions("d", "s", "asks")


def pairs(vectors: DataFrame, queries: DataFrame, pick: Pick, length: int | None = None, key: str | None = None) -> DataFrame:
    """``query_id, id, distance`` of what ``pick`` takes from each block and shard.

    Only vectors of a query's length meet it, or those of ``length`` if queries are of another kind; with ``key``, a column
    of whole numbers on both sides, those of its key, which are all of one length.

    Both sides have columns id (long or string) and vector; rows with a null in them must be gone already.
    """
    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"
    return dealt(vectors, queries, SHARD, length, key).mapInArrow(_runner(pick), kinds)


def linked(rows: DataFrame, pick: Pick) -> DataFrame:
    """``a, b``: links that bring together whatever the picked pairs do; from each shard at most one for each row.

    Rows are as in ``pairs``, on both sides, with whole numbers as ids.
    """
    return dealt(rows, rows, SHARD).mapInArrow(_linker(pick), "a long, b long")
