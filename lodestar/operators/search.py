"""Exact search: nearest neighbours of one or many queries, ranges, duplicates, matrices, centres.

Frames have an id, a vector and metadata columns. Ties in distance go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import NotFoundError
from lodestar.functions.metrics import Each, Metric, get_metric, quick_squares
from lodestar.functions.validation import check_k
from lodestar.functions.vectors import doubles
from lodestar.operators.blocks import Pick, linked, pairs
from lodestar.operators.components import components, cut
from lodestar.operators.filters import where

#: Pairs that are measured exactly at a time.
STEP = 1 << 16


def measured(each: Each, q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of q[a] from v[b], a bounded number at a time."""
    return np.concatenate([np.zeros(0), *(each(q[a[i : i + STEP]] - v[b[i : i + STEP]]) for i in range(0, len(a), STEP))])


def literal(v: Sequence[float]) -> Column:
    return F.lit([float(x) for x in v])


def with_distance(df: DataFrame, query: Sequence[float], metric: str | Metric = "euclidean", vector: str = "vector", name: str = "distance") -> DataFrame:
    """df with the distance of each vector from the query; null for null vectors."""
    return df.withColumn(name, get_metric(metric).column(F.col(vector), literal(query)))


def relative_score(distance: str = "distance", window: Any = None) -> Column:
    """1 - d / (d_k + 1e-8), with d_k the largest distance of the result; 1 if that isn't above 0."""
    last = F.max(distance).over(window or Window.partitionBy())
    return F.when(last > 0, 1 - F.col(distance) / (last + 1e-8)).otherwise(F.lit(1.0))


def inverse_score(distance: str = "distance") -> Column:
    """1 / (1 + d); null at d = -1."""
    return F.try_divide(F.lit(1.0), 1 + F.col(distance))


def knn(df: DataFrame, query: Sequence[float], k: int = 10, metric: str | Metric = "euclidean", filter: Any = None, id: str = "id", vector: str = "vector", min_score: float | None = None) -> DataFrame:
    """The k nearest rows, nearest first, with ``distance``. The filter comes before the distances.

    One scan; each partition keeps k rows, and only these meet on the driver's side of the plan. With ``min_score`` only
    rows stay whose inverse_score is that high, or whose similarity, where the metric is one.
    """
    m = get_metric(metric)
    found = with_distance(where(df, filter), query, m, vector).filter(F.col("distance").isNotNull())
    order = F.col("distance").desc() if m.is_similarity else F.col("distance").asc()
    if min_score is not None:
        found = found.filter((F.col("distance") if m.is_similarity else inverse_score()) >= float(min_score))
    return found.orderBy(order, F.col(id).asc()).limit(check_k(k))


def _sides(df: DataFrame, id: str, vector: str) -> DataFrame:
    rows = df.select(F.col(id).alias("id"), doubles(F.col(vector)).alias("vector"))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))


def _order(w: Any, m: Metric) -> Any:
    return w.orderBy(F.col("distance").desc() if m.is_similarity else F.col("distance").asc(), F.col("id").asc())


def knn_batch(df: DataFrame, queries: DataFrame, k: int = 10, metric: str | Metric = "euclidean", filter: Any = None, id: str = "id", vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest for each query (columns ``id`` and ``vector`` as in df).

    Blocks of queries meet shards of vectors, each keeps k per query, and ranks are taken over these. Under euclidean
    metrics inner products leave out what is farther than the k nearest by more than they may be off; the others are
    measured exactly.
    """
    m, k = get_metric(metric), check_k(k)
    kernel, each, sign = m.kernel, m.each, -1.0 if m.is_similarity else 1.0

    def pick(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = min(k, len(ids))
        if each and (quick := quick_squares(q, v)):
            near, off = quick
            if exclude_self:
                near[qids[:, None] == ids[None, :]] = np.inf
            edge = np.partition(near, n - 1, axis=1)[:, n - 1 : n]
            a, b = np.divmod(np.flatnonzero(near < np.minimum(edge + 2 * off[:, None], np.finfo(float).max)), len(ids))
            return a, b, measured(each, q, v, a, b)
        d = kernel(q, v)
        key = d * sign
        if exclude_self:
            key = np.where(qids[:, None] == ids[None, :], np.inf, key)
        edge = np.partition(key, n - 1, axis=1)[:, n - 1 : n]
        a, b = np.nonzero((key <= edge) & (key < np.inf))  # ties at the edge stay for the ids to settle
        return a, b, d[a, b]

    found = pairs(_sides(where(df, filter), id, vector), _sides(queries, id, vector), pick)
    rank = F.row_number().over(_order(Window.partitionBy("query_id"), m))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn_graph(df: DataFrame, k: int, metric: str | Metric = "euclidean", include_self: bool = False, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest neighbours of every row."""
    return knn_batch(df, df, k, metric, id=id, vector=vector, exclude_self=not include_self)


def knn_by_id(df: DataFrame, value: Any, k: int = 10, metric: str | Metric = "euclidean", exclude_self: bool = True, filter: Any = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """Neighbours of a stored row; an unknown id raises NotFoundError."""
    seed = df.filter(F.col(id) == F.lit(value)).select(vector).first()
    if seed is None:
        raise NotFoundError(value)
    rest = df.filter(F.col(id) != F.lit(value)) if exclude_self else df
    return knn(rest, seed[0], k, metric, filter, id, vector)


def range_search(df: DataFrame, query: Sequence[float], radius: float, metric: str | Metric = "euclidean", filter: Any = None, max_results: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """All rows within the radius, inclusive, nearest first; max_results keeps the nearest."""
    found = with_distance(where(df, filter), query, metric, vector).filter(F.col("distance") <= float(radius)).orderBy("distance", id)
    return found if max_results is None else found.limit(max_results)


def duplicates(df: DataFrame, threshold: float = 1e-6, id: str = "id", vector: str = "vector", pivots: int = 2) -> DataFrame:
    """``id1, id2, distance`` of pairs id1 < id2 within the (euclidean) threshold.

    By the triangle inequality such vectors have distances from a pivot that differ by no more than the threshold. So
    cells of that width in the distances from a few pivots are joined with their neighbours, an equi-join; one of the
    two sides is repeated for the neighbouring cells. Where the distances from a pivot spread over so few cells that
    this would join most rows anyway, blocks of vectors are compared in numpy instead.
    """
    rows = _sides(df, id, vector)
    near = _celled(rows, float(threshold), pivots)
    return _close(rows, float(threshold)) if near is None else near


def _celled(rows: DataFrame, threshold: float, pivots: int = 2) -> DataFrame | None:
    """The pairs within the threshold by cells, or None where cells don't select."""
    first = rows.select("vector").limit(1)
    d = (first.select(F.size("vector")).first() or [0])[0]
    width = max(threshold, 1e-9) * (1 + 1e-9)
    rng = np.random.default_rng(0)
    places = [literal(rng.normal(size=d)) for _ in range(pivots)]
    euclid = get_metric("euclidean").column
    spread = rows.select(F.stddev_pop(euclid(F.col("vector"), places[0]))).first()[0] or 0.0
    if spread < 2 * width:
        return None
    cells = [F.floor(euclid(F.col("vector"), p) / width) for p in places]
    left = rows.select(F.col("id").alias("id1"), F.col("vector").alias("__a"), *[c.alias(f"__c{i}") for i, c in enumerate(cells)])
    right = rows.select(F.col("id").alias("id2"), F.col("vector").alias("__b"), *[c.alias(f"__d{i}") for i, c in enumerate(cells)])
    for i in range(pivots):
        right = right.withColumn(f"__c{i}", F.explode(F.array(*[F.col(f"__d{i}") + s for s in (-1, 0, 1)]))).drop(f"__d{i}")
    near = left.join(right, [f"__c{i}" for i in range(pivots)]).filter("id1 < id2")
    return near.withColumn("distance", euclid(F.col("__a"), F.col("__b"))).filter(F.col("distance") <= threshold).select("id1", "id2", "distance")


def duplicate_groups(df: DataFrame, threshold: float = 1e-6, id: str = "id", vector: str = "vector") -> DataFrame:
    """``id, group_id`` of rows that links within the threshold bring together; group_id is the least id of the group.

    Equal vectors are one vertex, so many copies of a vector make no pairs; where blocks are compared, a task hands on one
    link for each row of its groups, however many pairs they have. Ids must be whole numbers.
    """
    rows = _sides(df, id, vector)
    reps = rows.groupBy("vector").agg(F.min("id").alias("rep"))
    ends = reps.select(F.col("rep").alias("id"), "vector")
    near = _celled(ends, float(threshold))
    links = linked(ends, _within(float(threshold))) if near is None else near.select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    of = rows.join(reps, "vector").select("id", "rep")
    of = of.join(components(links).select(F.col("v").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    several = of.groupBy("group_id").count().filter("count > 1").select("group_id")
    return of.join(several, "group_id", "left_semi").select("id", "group_id")


def _within(threshold: float) -> Pick:
    """Picks pairs of smaller and larger ids within the threshold; inner products leave few pairs to be measured exactly."""
    each = get_metric("euclidean").each

    def pick(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * (q @ v.T)
        a, b = np.nonzero((near <= threshold * threshold + 1e-6 * (1 + near)) & (qids[:, None] < ids[None, :]))
        d = measured(each, q, v, a, b)
        keep = d <= threshold
        return a[keep], b[keep], d[keep]

    return pick


def _close(rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs within the threshold, by blocks."""
    return pairs(rows, rows, _within(threshold)).select(F.col("query_id").alias("id1"), F.col("id").alias("id2"), "distance")


def distance_matrix(left: DataFrame, right: DataFrame | None = None, metric: str | Metric = "euclidean", id: str = "id", vector: str = "vector") -> DataFrame:
    """``query_id, id, distance`` for all pairs: the output is that large, the plan works by blocks."""
    kernel = get_metric(metric).kernel

    def pick(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = kernel(q, v)
        a, b = np.indices(d.shape)
        return a.ravel(), b.ravel(), d.ravel()

    return pairs(_sides(left if right is None else right, id, vector), _sides(left, id, vector), pick)


def centroid(df: DataFrame, by: Sequence[str] = (), vector: str = "vector") -> DataFrame:
    """The mean vector, per group of ``by``: sums by component, combined before the shuffle."""
    parts = df.select(*by, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def medoid(df: DataFrame, metric: str | Metric = "euclidean", id: str = "id", vector: str = "vector") -> DataFrame:
    """The row of the least total distance from all rows, with ``total``; the smaller id on ties.

    For the euclidean metric inner products tell how small each total may be, and only rows that may be at or below the
    total of the most promising one are measured exactly.
    """
    m = get_metric(metric)
    kernel = m.kernel

    def pick(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.arange(len(qids))
        return n, np.zeros(len(qids), np.int64), kernel(q, v).sum(axis=1)

    def least(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, low = np.arange(len(qids)), np.full(len(qids), -np.inf)
        if quick := quick_squares(q, v):
            near, off = quick
            total = np.sqrt(np.maximum(near, 0, out=near), out=near).sum(axis=1)
            low = total * (1 - 1e-12) - len(ids) * np.sqrt(off)  # roots differ by no more than the root of the difference
        return n, np.zeros(len(qids), np.int64), low

    def totals(asked: DataFrame, pick: Pick) -> DataFrame:
        return pairs(rows, asked, pick).groupBy("query_id").agg(F.sum("distance").alias("total"))

    rows = _sides(df, id, vector)
    asked = rows
    if m.each and m.each is get_metric("euclidean").each:
        low = cut(totals(rows, least))
        best = low.orderBy("total", "query_id").first()
        if best is not None:
            most = totals(rows.filter(F.col("id") == F.lit(best[0])), pick).first()[1]
            asked = rows.join(low.filter(F.col("total") <= F.lit(most)).select(F.col("query_id").alias("id")), "id", "left_semi")
    return totals(asked, pick).orderBy("total", "query_id").limit(1).select(F.col("query_id").alias("id"), "total")
