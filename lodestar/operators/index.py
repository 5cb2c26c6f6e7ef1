"""Indexes as frames: inverted files, product quantisation, both, and navigable graphs.

An index is a trained model of bounded size on the driver (centroids, codebooks) and a frame of assigned or encoded rows.
Models are fitted by Spark's k-means, on a sample whose size is a parameter; every row is indexed. Each search returns
``query_id, rank, id, distance``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import DuplicateIdError, NotFoundError, ValidationError
from lodestar.functions.metrics import get_metric
from lodestar.functions.vectors import doubles, subtract
from lodestar.operators.blocks import Pick, pairs
from lodestar.operators.filters import where
from lodestar.operators.graph import built, walked
from lodestar.operators.search import _sides, knn_batch, measured

#: Rows that a model is fitted on at most.
SAMPLE = 100_000


def _sample(df: DataFrame, column: str, most: int, seed: int) -> DataFrame:
    rows = df.select(column).filter(F.col(column).isNotNull())
    n = rows.count()
    return rows if n <= most else rows.sample(most / n, seed=seed)


def fit_kmeans(df: DataFrame, k: int, column: str = "vector", iterations: int = 20, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Centroids (k x d; fewer if there are fewer distinct vectors)."""
    rows = _sample(df, column, sample, seed).select(array_to_vector(doubles(F.col(column))).alias("features"))
    n = rows.count()
    if not n:
        raise ValidationError("nothing to train on")
    if n <= k:
        return np.array([r[0].toArray() for r in rows.distinct().collect()])
    return np.array(KMeans(k=k, maxIter=iterations, seed=seed, tol=1e-6).fit(rows).clusterCenters())


def _lloyd(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """k centroids of the rows of a bounded sample (fewer if there are fewer distinct rows), from spread-out starts."""
    kernel, rng = get_metric("euclidean_squared").kernel, np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = x[rng.integers(len(x))][None, :]
    far = kernel(x, c)[:, 0]
    while len(c) < k:
        total = far.sum()
        c = np.concatenate((c, x[rng.choice(len(x), p=far / total if total > 0 else None)][None, :]))
        far = np.minimum(far, np.maximum(kernel(x, c[-1:])[:, 0], 0))
    for _ in range(iterations):
        of = kernel(x, c).argmin(axis=1)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


def nearest(v: Column, centroids: np.ndarray, metric: str = "euclidean", n: int = 1) -> Column:
    """The n nearest centroids of a vector, nearest first: array<int>."""
    kernel = get_metric(metric).kernel

    @F.pandas_udf("array<int>")
    def udf(s: pd.Series) -> pd.Series:
        d = kernel(np.stack(s.to_numpy()).astype(float), centroids) if len(s) else np.zeros((0, 1))
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return udf(v)


def centroid_of(cluster: Column, centroids: np.ndarray) -> Column:
    """The centroid of a cluster; null for null. The model travels with the function, so plans stay small."""

    @F.pandas_udf("array<double>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda c: None if pd.isna(c) else centroids[int(c)])

    return udf(cluster)


class _Rows:
    """What all indexes do by id. ``rows`` holds what is indexed; ids are unique."""

    id: str
    rows: DataFrame | None

    def _take(self, df: DataFrame) -> DataFrame:
        """df added to ``rows``; raises DuplicateIdError if an id is there already or twice in df."""
        ids = df.select(self.id)
        twice = ids.groupBy(self.id).count().filter("count > 1").select(self.id)
        if self.rows is not None:
            twice = twice.unionByName(ids.join(self.rows.select(self.id), self.id, "left_semi"))
        if (found := twice.first()) is not None:
            raise DuplicateIdError(found[0])
        self.rows = df if self.rows is None else self.rows.unionByName(df)
        return df

    def get(self, ids: Sequence[Any]) -> DataFrame:
        """The rows of the ids, in the order of ``rows``; unknown ids are left out."""
        return self.rows.filter(F.col(self.id).isin(list(ids)))

    def remove(self, ids: Sequence[Any]) -> Any:
        self.rows = self.rows.filter(~F.col(self.id).isin(list(ids)))
        return self

    def update(self, df: DataFrame) -> Any:
        """Rows in place of those of the same ids; an unknown id raises NotFoundError."""
        missing = df.select(self.id).join(self.rows.select(self.id), self.id, "left_anti").first()
        if missing is not None:
            raise NotFoundError(missing[0])
        self.rows = self.rows.join(df.select(self.id), self.id, "left_anti")
        return self.add(df)

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def stats(self) -> dict[str, Any]:
        """The kind of index, its rows and its plain options; bytes of codes against floats where it has codes."""
        plain = {k: v for k, v in vars(self).items() if isinstance(v, (int, float, str))}
        books = self if hasattr(self, "compression") else getattr(self, "fine", None)
        more = {"compression": books.compression()} if books is not None and books.books is not None else {}
        return {"kind": type(self).__name__, "count": self.count(), **plain, **more}

    def __iter__(self) -> Iterator[Any]:
        """Rows one partition at a time, for callers that have to see them on the driver."""
        return iter(()) if self.rows is None else self.rows.toLocalIterator()


@dataclass
class IVFIndex(_Rows):
    """An inverted file: rows with the cluster of their nearest centroid; a query looks into its n_probe nearest clusters."""

    n_clusters: int = 100
    n_probe: int = 10
    metric: str = "euclidean"
    iterations: int = 20
    seed: int = 42
    id: str = "id"
    vector: str = "vector"
    centroids: np.ndarray | None = None
    rows: DataFrame | None = None

    def train(self, df: DataFrame) -> IVFIndex:
        self.centroids = fit_kmeans(df, self.n_clusters, self.vector, self.iterations, self.seed)
        return self

    def assign(self, df: DataFrame) -> DataFrame:
        """df with ``cluster_id``; rows without a vector are left out."""
        if self.centroids is None:
            raise ValidationError("train the index first")
        return df.filter(F.col(self.vector).isNotNull()).withColumn("cluster_id", F.get(nearest(F.col(self.vector), self.centroids, self.metric), F.lit(0)))

    def add(self, df: DataFrame) -> IVFIndex:
        self._take(self.assign(df))
        return self

    def set_n_probe(self, n: int) -> None:
        self.n_probe = max(1, min(n, self.n_clusters))

    def rebuild(self) -> IVFIndex:
        old, self.rows = self.rows.drop("cluster_id"), None
        return self.train(old).add(old)

    def reset(self) -> None:
        self.centroids = self.rows = None

    def get_centroid(self, cluster: int) -> list[float]:
        if not 0 <= cluster < len(self.centroids):
            raise NotFoundError(cluster)
        return self.centroids[cluster].tolist()

    def in_cluster(self, cluster: int) -> DataFrame:
        return self.rows.filter(F.col("cluster_id") == cluster)

    def search(self, queries: DataFrame, k: int = 10, n_probe: int | None = None, filter: Any = None) -> DataFrame:
        """An equi-join of the probed clusters with the rows, then the k nearest of each query.

        Rows written by save() are partitioned by cluster, so only probed folders are read.
        """
        n = max(1, min(n_probe or self.n_probe, len(self.centroids)))
        m = get_metric(self.metric)
        asked = queries.select(F.col(self.id).alias("query_id"), F.col(self.vector).alias("__q")).filter("__q is not null")
        probes = asked.withColumn("cluster_id", F.explode(nearest(F.col("__q"), self.centroids, self.metric, n)))
        rows = where(self.rows, filter).select(F.col(self.id).alias("id"), F.col(self.vector).alias("__v"), "cluster_id")
        found = probes.join(rows, "cluster_id").withColumn("distance", m.column(F.col("__q"), F.col("__v")))
        order = F.col("distance").desc() if m.is_similarity else F.col("distance").asc()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.col("id").asc()))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cluster_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    def load(self, spark: Any, path: str) -> IVFIndex:
        self.rows = spark.read.parquet(f"{path}/rows")
        self.centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()])
        return self


def _by_codes(books: np.ndarray, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of queries from rows as their codes stand for them: tables of each slice, looked up and summed."""
    kernel, slices = get_metric("euclidean_squared").kernel, q.reshape(len(q), len(books), -1)
    d = np.zeros((len(q), len(codes)))
    for i, book in enumerate(books):
        d += kernel(slices[:, i], book).take(codes[:, i], axis=1)
    return d


def _reranker(books: np.ndarray, k: int, most: int) -> Pick:
    """Rows are codes and then the vector; queries are what the codes are compared with, and the vector last.

    Of each shard the ``most`` nearest by codes are measured exactly, and the k nearest of these stay, with ties.
    """
    m, _, width = books.shape
    each = get_metric("euclidean").each

    def pick(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, n = _by_codes(books, q[:, : m * width], v[:, :m].astype(np.int64)), min(most, len(ids))
        a, b = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n])
        exact = measured(each, q[:, -m * width :], v[:, m:], a, b)
        order = np.lexsort((exact, a))
        a, b, exact = a[order], b[order], exact[order]
        last = np.minimum(np.searchsorted(a, a) + k, np.searchsorted(a, a, "right")) - 1
        keep = exact <= exact[last]
        return a[keep], b[keep], exact[keep]

    return pick


def _with_codes(rows: DataFrame, vectors: DataFrame, id: str, vector: str, dimension: int) -> DataFrame:
    """Indexed rows with their codes and vector as one; rows without a vector of the dimension are left out."""
    stored = _sides(vectors, id, vector).filter(F.size("vector") == dimension)
    return rows.join(stored, "id").withColumn("vector", F.concat(doubles(F.col("codes")), "vector")).drop("codes")


@dataclass
class PQIndex(_Rows):
    """Product quantisation: each of n_subvectors slices is a code of its codebook; distances are squared-L2 sums from tables."""

    n_subvectors: int = 8
    n_bits: int = 8
    iterations: int = 20
    seed: int = 42
    id: str = "id"
    vector: str = "vector"
    books: np.ndarray | None = None
    rows: DataFrame | None = None

    def train(self, df: DataFrame, sample: int = 10_000) -> PQIndex:
        """One k-means for each slice, in numpy on about ``sample`` rows at most, which bounds what the driver holds."""
        rows = _sample(df, self.vector, sample, self.seed).select(doubles(F.col(self.vector)).alias("v"))
        x = np.array([r.v for r in rows.collect()])
        if x.ndim != 2 or not len(x) or x.shape[1] % self.n_subvectors:
            raise ValidationError("the dimension must be a multiple of n_subvectors, and there must be rows")
        width, k = x.shape[1] // self.n_subvectors, 2**self.n_bits
        books = np.zeros((self.n_subvectors, k, width))
        for i in range(self.n_subvectors):
            c = _lloyd(x[:, i * width : (i + 1) * width], k, self.iterations, self.seed)
            books[i] = c[np.arange(k) % len(c)]  # spare codes repeat a centroid
        self.books = books
        return self

    def encode(self, v: Column) -> Column:
        """array<int> of codes."""
        books, m = self.books, self.n_subvectors
        kernel = get_metric("euclidean_squared").kernel

        @F.pandas_udf("array<int>")
        def udf(s: pd.Series) -> pd.Series:
            x = np.stack(s.to_numpy()).astype(float).reshape(len(s), m, -1) if len(s) else np.zeros((0, m, 1))
            codes = np.stack([np.argmin(kernel(x[:, i], books[i]), axis=1) for i in range(m)], axis=1) if len(s) else np.zeros((0, m))
            return pd.Series(list(codes.astype(np.int32)))

        return udf(v)

    def decode(self, codes: Column) -> Column:
        """The vector that codes stand for, by table lookups; null for null."""
        books, place = self.books, np.arange(self.n_subvectors)

        @F.pandas_udf("array<double>")
        def udf(s: pd.Series) -> pd.Series:
            return s.map(lambda c: None if c is None else books[place, np.asarray(c, np.int64)].ravel())

        return udf(codes)

    def add(self, df: DataFrame) -> PQIndex:
        if self.books is None:
            raise ValidationError("train the index first")
        self._take(df.filter(F.col(self.vector).isNotNull()).withColumn("codes", self.encode(F.col(self.vector))).drop(self.vector))
        return self

    def search(self, queries: DataFrame, k: int = 10, filter: Any = None, vectors: DataFrame | None = None, rerank: int = 20) -> DataFrame:
        """Asymmetric distances: a table of slice distances for each query, summed by the codes of each row.

        With ``vectors``, a frame of the same ids, the rerank * k nearest by codes of each shard are ranked by their exact
        distances. Shards are of bounded size, so the candidates grow with the rows and recall doesn't fall.
        """
        books, m = self.books, self.n_subvectors
        dimension = m * books.shape[2]

        def pick(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = _by_codes(books, q, codes.astype(np.int64))
            n = min(k, len(ids))
            a, b = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n])
            return a, b, np.sqrt(d[a, b])

        rows = where(self.rows, filter).select(F.col(self.id).alias("id"), F.col("codes").alias("vector"))
        asked = _sides(queries, self.id, self.vector).filter(F.size("vector") == dimension)
        if vectors is None:
            found = pairs(rows, asked, pick, m)
        else:
            rows = _with_codes(rows.withColumnRenamed("vector", "codes"), vectors, self.id, self.vector, dimension)
            found = pairs(rows, asked, _reranker(books, k, k * rerank), m + dimension)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

    def compression(self) -> float:
        """Bytes of the float vectors over bytes of the codes."""
        m, _, w = self.books.shape
        return m * w * 4 / (m * self.n_bits / 8)


@dataclass
class IVFPQIndex(_Rows):
    """An inverted file whose rows are codes of what their centroid leaves over."""

    n_clusters: int = 100
    n_probe: int = 10
    n_subvectors: int = 8
    n_bits: int = 8
    seed: int = 42
    id: str = "id"
    vector: str = "vector"
    coarse: IVFIndex = field(init=False)
    fine: PQIndex = field(init=False)
    rows: DataFrame | None = None

    def __post_init__(self) -> None:
        self.coarse = IVFIndex(self.n_clusters, self.n_probe, seed=self.seed, id=self.id, vector=self.vector)
        self.fine = PQIndex(self.n_subvectors, self.n_bits, seed=self.seed, id=self.id, vector="residual")

    def _residuals(self, df: DataFrame) -> DataFrame:
        return self.coarse.assign(df).withColumn("residual", subtract(F.col(self.vector), centroid_of(F.col("cluster_id"), self.coarse.centroids)))

    def train(self, df: DataFrame) -> IVFPQIndex:
        self.coarse.train(df)
        self.fine.train(self._residuals(df))
        return self

    def add(self, df: DataFrame) -> IVFPQIndex:
        self._take(self._residuals(df).withColumn("codes", self.fine.encode(F.col("residual"))).drop("residual", self.vector))
        return self

    def reconstruct(self) -> DataFrame:
        """``id, vector``: centroid plus decoded remainder."""
        back = F.zip_with(centroid_of(F.col("cluster_id"), self.coarse.centroids), self.fine.decode(F.col("codes")), lambda a, b: a + b)
        return self.rows.select(F.col(self.id).alias("id"), back.alias("vector"), "cluster_id")

    def search(self, queries: DataFrame, k: int = 10, n_probe: int | None = None, filter: Any = None, vectors: DataFrame | None = None, rerank: int = 20) -> DataFrame:
        """Probed clusters joined by cluster; distances to the rows as their codes stand for them, reranked as in PQIndex."""
        n = max(1, min(n_probe or self.n_probe, len(self.coarse.centroids)))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        if vectors is not None:
            centroids = self.coarse.centroids
            rows = where(self.rows, filter).select(F.col(self.id).alias("id"), "cluster_id", "codes")
            asked = _sides(queries, self.id, self.vector).filter(F.size("vector") == centroids.shape[1])
            asked = asked.withColumn("cluster_id", F.explode(nearest(F.col("vector"), centroids, n=n)))
            asked = asked.withColumn("vector", F.concat(subtract(F.col("vector"), centroid_of(F.col("cluster_id"), centroids)), "vector"))
            rows = _with_codes(rows, vectors, self.id, self.vector, centroids.shape[1])
            found = pairs(rows, asked, _reranker(self.fine.books, k, k * rerank), key="cluster_id")
            return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
        asked = queries.select(F.col(self.id).alias("query_id"), F.col(self.vector).alias("__q")).filter("__q is not null")
        probes = asked.withColumn("cluster_id", F.explode(nearest(F.col("__q"), self.coarse.centroids, n=n)))
        kept = where(self.rows, filter).select(F.col(self.id).alias("id"), "cluster_id", "codes")
        kept = kept.withColumn("__v", F.zip_with(centroid_of(F.col("cluster_id"), self.coarse.centroids), self.fine.decode(F.col("codes")), lambda a, b: a + b))
        found = probes.join(kept, "cluster_id").withColumn("distance", get_metric("euclidean").column(F.col("__q"), F.col("__v")))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


@dataclass
class FlatIndex(_Rows):
    """No index: exact search."""

    metric: str = "euclidean"
    id: str = "id"
    vector: str = "vector"
    rows: DataFrame | None = None

    def train(self, df: DataFrame) -> FlatIndex:
        return self

    def add(self, df: DataFrame) -> FlatIndex:
        self._take(df)
        return self

    def search(self, queries: DataFrame, k: int = 10, filter: Any = None) -> DataFrame:
        return knn_batch(self.rows, queries, k, self.metric, filter, self.id, self.vector)


def _place(parts: int) -> Column:
    """Shards in turn, so that tasks have as many."""
    return F.pmod(F.xxhash64("d") + F.col("s"), F.lit(parts)).cast("int")


@dataclass
class GraphIndex(_Rows):
    """A navigable small world: a layered graph for each shard of vectors, built once and walked from the top.

    add() builds the graphs of the new rows, as shards of their own; rebuild() makes one set of shards of all.
    ``graph`` has a row for each node: ``d, s, place, entry, live, id, vector, links``, links being places by level; it is
    persisted, as building it is the costly part. Removed rows stay as waypoints that no search returns, until rebuild().
    With a filter a search is exact over the rows it lets through, since a walk could end among others.
    """

    m: int = 16
    ef_construction: int = 100
    ef_search: int = 50
    metric: str = "euclidean"
    seed: int = 42
    id: str = "id"
    vector: str = "vector"
    #: Components of a shard's vectors.
    shard: int = 1 << 20
    rows: DataFrame | None = None
    graph: DataFrame | None = None

    def train(self, df: DataFrame) -> GraphIndex:
        return self

    def _built(self, df: DataFrame) -> DataFrame:
        rows = _sides(df, self.id, self.vector).withColumn("d", F.size("vector"))
        sizes = rows.groupBy("d").agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.first("d"), F.lit(1)) / self.shard).alias("shards"))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.join(sizes, "d").select("d", F.pmod(F.xxhash64("id", "vector"), F.col("shards")).alias("s"), "id", "vector")
        m = get_metric(self.metric)
        kind = df.schema[self.id].dataType.simpleString()
        schema = f"d int, s long, place int, entry boolean, live boolean, id {kind}, vector array<double>, links array<array<int>>"
        return rows.repartitionById(parts, _place(parts)).sortWithinPartitions("d", "s", "id").mapInArrow(built(m.kernel, self.m, self.ef_construction, self.seed, -1.0 if m.is_similarity else 1.0), schema)

    def add(self, df: DataFrame) -> GraphIndex:
        self._take(df)
        new = self._built(df)
        if self.graph is not None:
            new = self.graph.unionByName(new.withColumn("s", F.col("s") + (self.graph.agg(F.max("s")).first()[0] or 0) + 1))
        self.graph = new.persist()
        return self

    def remove(self, ids: Sequence[Any]) -> GraphIndex:
        self.graph = self.graph.withColumn("live", F.col("live") & ~F.col("id").isin(list(ids)))
        return super().remove(ids)

    def update(self, df: DataFrame) -> GraphIndex:
        old = df.select(F.col(self.id).alias("id"), F.lit(False).alias("__stays")).distinct()
        graph = self.graph
        self.graph = graph.join(old, "id", "left").withColumn("live", F.col("live") & F.coalesce("__stays", F.lit(True))).select(*graph.columns)
        return super().update(df)

    def rebuild(self) -> GraphIndex:
        self.graph.unpersist()
        self.graph = self._built(self.rows).persist()
        return self

    def set_ef_search(self, ef: int) -> None:
        self.ef_search = max(1, ef)

    def search(self, queries: DataFrame, k: int = 10, filter: Any = None, ef: int | None = None) -> DataFrame:
        """The k nearest found by walks that keep ``ef`` nodes or, in shards where these miss some, more; without removed rows."""
        if filter is not None:
            return knn_batch(self.rows, queries, k, self.metric, filter, self.id, self.vector)
        m = get_metric(self.metric)
        kept = max(ef or self.ef_search, k)
        asked = _sides(queries, self.id, self.vector).withColumn("d", F.size("vector"))
        nodes = self.graph.select("d", "s", F.lit(0).alias("asks"), "place", "entry", "live", "id", F.lit(None).cast(asked.schema["id"].dataType).alias("query_id"), "vector", "links")
        there = asked.withColumnRenamed("id", "query_id").join(self.graph.select("d", "s").distinct(), "d").withColumn("asks", F.lit(1))
        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = nodes.unionByName(there, allowMissingColumns=True).repartitionById(parts, _place(parts)).sortWithinPartitions("d", "s", "asks", "place", "query_id")
        kinds = f"query_id {asked.schema['id'].dataType.simpleString()}, id {self.graph.schema['id'].dataType.simpleString()}, distance double"
        found = rows.mapInArrow(walked(m.kernel, self.m, k, kept, -1.0 if m.is_similarity else 1.0), kinds)
        order = F.col("distance").desc() if m.is_similarity else F.col("distance").asc()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.col("id").asc()))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

    def edges(self) -> DataFrame:
        """``level, src, dst, distance``: the links of every node."""
        links = self.graph.select("d", "s", F.col("id").alias("src"), F.col("vector").alias("__a"), F.posexplode("links").alias("level", "to")).withColumn("place", F.explode("to"))
        ends = self.graph.select("d", "s", "place", F.col("id").alias("dst"), F.col("vector").alias("__b"))
        distance = get_metric(self.metric).column(F.col("__a"), F.col("__b"))
        return links.join(ends, ["d", "s", "place"]).select("level", "src", "dst", distance.alias("distance"))

    def neighbors(self, value: Any, level: int = 0) -> DataFrame:
        return self.edges().filter((F.col("src") == F.lit(value)) & (F.col("level") == level))

    def levels(self) -> DataFrame:
        """``id, level``: the highest level of each node."""
        return self.graph.filter("live").select("id", (F.size("links") - 1).alias("level"))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.graph.write.mode("overwrite").parquet(f"{path}/graph")

    def load(self, spark: Any, path: str) -> GraphIndex:
        self.rows, self.graph = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/graph")
        return self


INDEXES = {"flat": FlatIndex, "ivf": IVFIndex, "hnsw": GraphIndex, "pq": PQIndex, "ivf_pq": IVFPQIndex, "hybrid": IVFPQIndex}


def create_index(kind: str, **options: Any) -> Any:
    if kind not in INDEXES:
        raise ValidationError(f"no index {kind!r}; there are {', '.join(INDEXES)}")
    return INDEXES[kind](**options)


def recommend_index(n_vectors: int, dimension: int, priority: str = "balanced") -> tuple[str, dict]:
    """A kind and its options for a size and a priority: speed, recall (or accuracy), memory or balanced."""
    if priority not in ("speed", "recall", "accuracy", "memory", "balanced"):
        raise ValidationError(f"no priority {priority!r}")
    if n_vectors < 10_000:
        return "flat", {}
    clusters = max(1, int(4 * math.sqrt(n_vectors)))
    if priority == "memory":
        return "ivf_pq", {"n_clusters": clusters, "n_subvectors": next(m for m in (16, 8, 4, 2, 1) if dimension % m == 0)}
    if n_vectors < 100_000:
        return "hnsw", {"m": 16}
    share = {"speed": 100, "balanced": 20}.get(priority, 5)
    return "ivf", {"n_clusters": clusters, "n_probe": max(1, clusters // share)}
