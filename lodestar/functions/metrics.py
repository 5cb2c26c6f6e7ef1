"""Distance metrics as columns and as numpy kernels, with a registry of names.

Every built-in metric has both forms: columns for single queries and SQL, kernels for blocks of vectors in Arrow
batches. Smaller is nearer for all of them; a registered similarity is ordered the other way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.errors import ValidationError
from lodestar.functions.vectors import EPS, dot, doubles, norm, total

ColumnFn = Callable[[Column, Column], Column]
#: (queries n x d, vectors m x d) to distances n x m.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Differences (... x d) to distances (...).
Each = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Metric:
    """A metric: its column form, its kernel, and whether larger means nearer."""

    name: str
    column: ColumnFn
    kernel: Kernel
    is_similarity: bool = False
    requires_normalization: bool = False
    description: str = ""
    #: For metrics that grow with the euclidean distance: their distances of single differences, equal to the kernel's.
    each: Each | None = None


def quick_squares(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared euclidean distances by inner products, and for each query how far they may be off; None where they overflow."""
    a, b = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", v, v)
    if not a.max(initial=0) + b.max(initial=0) < 1e150:
        return None
    near = q @ v.T
    near *= -2
    near += a[:, None]
    near += b
    return near, 8 * (q.shape[1] + 8) * np.finfo(float).eps * (a + b.max(initial=0))


def _pairs(f: Callable[[Column, Column], Column]) -> ColumnFn:
    return lambda a, b: F.zip_with(doubles(a), doubles(b), f)


def euclidean_squared(a: Column, b: Column) -> Column:
    return total(_pairs(lambda x, y: (x - y) * (x - y))(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def cosine_similarity(a: Column, b: Column, eps: float = EPS) -> Column:
    """0 where the product of the norms is below eps."""
    den = norm(a) * norm(b)
    return F.when(den < eps, F.lit(0.0)).otherwise(dot(a, b) / den)


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return total(_pairs(lambda x, y: F.abs(x - y))(a, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_pairs(lambda x, y: F.abs(x - y))(a, b))


def hamming(a: Column, b: Column) -> Column:
    """The number of components that differ."""
    return F.size(F.filter(_pairs(lambda x, y: x - y)(a, b), lambda d: d != 0)).cast("double")


def angular(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(a, b))))


def euclidean_normalized(a: Column, b: Column) -> Column:
    """Euclidean distance of unit vectors from their inner product."""
    return F.sqrt(F.lit(2.0) - 2.0 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def minkowski(p: float) -> Metric:
    """The metric of order p >= 1; not in the registry, as it has a parameter."""
    if p < 1:
        raise ValidationError("p must be at least 1")

    def column(a: Column, b: Column) -> Column:
        return F.pow(total(_pairs(lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))(a, b)), F.lit(1.0 / p))

    return Metric(f"minkowski{p:g}", column, _each(lambda d: (np.abs(d) ** p).sum(-1) ** (1 / p)))


def _each(f: Callable[[np.ndarray], np.ndarray], budget: int = 1 << 22) -> Kernel:
    """A kernel from a function of the differences, a slice of the queries at a time so memory stays bounded."""

    def kernel(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), len(v)))
        step = max(1, budget // max(1, v.size))
        for i in range(0, len(q), step):
            out[i : i + step] = f(q[i : i + step, None, :] - v[None, :, :])
        return out

    return kernel


def _cos(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    den = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
    return np.where(den < EPS, 0.0, q @ v.T / np.where(den < EPS, 1.0, den))


_METRICS: dict[str, Metric] = {}
_ALIASES: dict[str, str] = {}


def register(metric: Metric, aliases: tuple[str, ...] = ()) -> Metric:
    """Adds a metric under its name and aliases, replacing earlier ones."""
    _METRICS[metric.name] = metric
    _ALIASES.update(dict.fromkeys(aliases, metric.name))
    return metric


def register_metric(name: str, function: Callable[[np.ndarray, np.ndarray], float], is_similarity: bool = False, description: str = "", batch_function: Kernel | None = None, aliases: tuple[str, ...] = ()) -> Metric:
    """A metric from a Python function of two vectors; its column form is an Arrow-batched UDF."""

    def kernel(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return batch_function(q, v) if batch_function else np.array([[float(function(x, y)) for y in v] for x in q]).reshape(len(q), len(v))

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(function(np.asarray(x, float), np.asarray(y, float))) for x, y in zip(a, b, strict=True)])

    return register(Metric(name, lambda a, b: udf(a, b), kernel, is_similarity, False, description), aliases)


def _l2(d: np.ndarray) -> np.ndarray:
    return np.sqrt((d * d).sum(-1))


def _l2_squared(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(-1)


register(Metric("euclidean", euclidean, _each(_l2), description="L2 distance", each=_l2), ("l2", "euclidean_distance"))
register(Metric("euclidean_squared", euclidean_squared, _each(_l2_squared), description="squared L2 distance", each=_l2_squared), ("l2_squared", "sqeuclidean"))
register(Metric("cosine", cosine, lambda q, v: 1 - _cos(q, v), description="1 - cosine similarity"), ("cosine_distance",))
register(Metric("dot", negative_dot, lambda q, v: -(q @ v.T), requires_normalization=True, description="negative inner product"), ("inner_product", "ip"))
register(Metric("manhattan", manhattan, _each(lambda d: np.abs(d).sum(-1)), description="L1 distance"), ("l1", "cityblock", "taxicab"))
register(Metric("chebyshev", chebyshev, _each(lambda d: np.abs(d).max(-1, initial=0)), description="largest difference"), ("linf", "chessboard"))
register(Metric("hamming", hamming, _each(lambda d: (d != 0).sum(-1).astype(float)), description="differing components"))
register(Metric("angular", angular, lambda q, v: np.arccos(np.clip(_cos(q, v), -1, 1)), description="angle"))


def get_metric(name: str | Metric) -> Metric:
    """By name or alias; a Metric is returned as it is."""
    if isinstance(name, Metric):
        return name
    found = _METRICS.get(_ALIASES.get(name, name))
    if not found:
        raise ValidationError(f"no metric {name!r}; there are {', '.join(list_metrics())}")
    return found


def list_metrics() -> list[str]:
    return list(_METRICS)


def metric_exists(name: str) -> bool:
    return _ALIASES.get(name, name) in _METRICS


def is_similarity(name: str) -> bool:
    return get_metric(name).is_similarity
