"""Hand-computed distances, and columns against kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.errors import DimensionMismatchError, ValidationError
from lodestar.functions import validation as V
from lodestar.functions.metrics import cosine_similarity, euclidean_normalized, get_metric, is_similarity, list_metrics, metric_exists, minkowski, register_metric
from lodestar.functions.vectors import is_normalized, is_valid, norm, normalize


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>")


def value(spark, metric, a, b):
    return pair(spark, a, b).select(metric.column(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [
        ("euclidean", [0, 0], [3, 4], 5), ("euclidean_squared", [0, 0], [3, 4], 25), ("manhattan", [0, 0], [3, 4], 7), ("chebyshev", [0, 0], [3, 4], 4),
        ("dot", [1, 2, 3], [4, 5, 6], -32), ("hamming", [1, 0, 1, 1], [1, 1, 0, 1], 2), ("cosine", [1, 0], [0, 1], 1), ("cosine", [1, 1], [2, 2], 0), ("cosine", [0, 0], [1, 2], 1),
        ("angular", [1, 0], [0, 1], math.pi / 2), ("l2", [0, 0], [3, 4], 5), ("cityblock", [0, 0], [3, 4], 7), ("ip", [1, 1], [2, 3], -5), ("linf", [0, 0], [3, 4], 4),
    ],
)
def test_known_values(spark, name, a, b, want):
    m = get_metric(name)
    assert value(spark, m, [float(x) for x in a], [float(x) for x in b]) == pytest.approx(want, abs=1e-9)
    assert m.kernel(np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want, abs=1e-9)


def test_columns_equal_kernels(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 8)), rng.normal(size=(5, 8))
    df = spark.createDataFrame([(x[i].tolist(), y[i].tolist()) for i in range(5)], "a array<double>, b array<double>")
    for m in [*map(get_metric, list_metrics()), minkowski(3)]:
        got = [r[0] for r in df.select(m.column(F.col("a"), F.col("b"))).collect()]
        assert np.allclose(got, np.diag(m.kernel(x, y))), m.name


def test_minkowski_and_registry(spark):
    assert value(spark, minkowski(3), [0.0, 0.0], [3.0, 4.0]) == pytest.approx(91 ** (1 / 3))
    with pytest.raises(ValidationError):
        minkowski(0.5)
    with pytest.raises(ValidationError):
        get_metric("nope")
    m = register_metric("overlap", lambda a, b: float(np.minimum(a, b).sum()), is_similarity=True, aliases=("common",))
    assert metric_exists("common") and is_similarity("overlap") and not is_similarity("dot")
    assert value(spark, m, [1.0, 5.0], [2.0, 3.0]) == 4


def test_norms(spark):
    df = pair(spark, [3.0, 4.0], [0.0, 0.0])
    row = df.select(norm(F.col("a")), normalize(F.col("a")), normalize(F.col("b")), is_normalized(normalize(F.col("a"))), cosine_similarity(F.col("a"), F.col("b"))).first()
    assert row[0] == 5 and row[1] == pytest.approx([0.6, 0.8]) and row[2] == [0, 0] and row[3] and row[4] == 0
    unit = pair(spark, [1.0, 0.0], [0.0, 1.0]).select(euclidean_normalized(F.col("a"), F.col("b"))).first()[0]
    assert unit == pytest.approx(math.sqrt(2))


def test_validity(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), ([],), (None,), ([1.0],)], "v array<double>")
    assert [r[0] for r in df.select(is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False, False, False]


def test_driver_checks():
    assert V.check_vector([1, 2], 2) == [1.0, 2.0]
    for bad in ([], [float("nan")], [[1.0]], "x", None):
        with pytest.raises(ValidationError):
            V.check_vector(bad)
    with pytest.raises(DimensionMismatchError):
        V.check_vector([1.0], 2)
    for bad in ("", "a b", "x" * 257, 5):
        with pytest.raises(ValidationError):
            V.check_id(bad)
    for bad in (0, -1, True, 10001, 1.5):
        with pytest.raises(ValidationError):
            V.check_k(bad)
    for bad in ({"_id": 1}, {"": 1}, {"x" * 65: 1}, {"a": object()}, {str(i): 1 for i in range(101)}, {"a": "x" * 65537}, [1]):
        with pytest.raises(ValidationError):
            V.check_metadata(bad)
    assert V.check_metadata({"a": [1, {"b": None}]}) == {"a": [1, {"b": None}]}
    with pytest.raises(ValidationError):
        V.check_dimension(0)
