"""Searches and indexes against brute force."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.errors import DuplicateIdError, NotFoundError, ValidationError
from lodestar.functions.metrics import get_metric
from lodestar.operators import blocks, search
from lodestar.operators.index import FlatIndex, GraphIndex, IVFIndex, IVFPQIndex, PQIndex, create_index, recommend_index
from lodestar.plans.query import Executor

N, D = 400, 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    x = rng.normal(size=(N, D))
    x[N // 2 :] += rng.normal(size=D) * 3
    return x


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(data)], "id long, vector array<double>, label int").cache()


def best(data, q, k, keep=None, order=2):
    d = np.linalg.norm(data - q, axis=1, ord=None) if order == 2 else np.abs(data - q).sum(axis=1)
    ids = [i for i in np.lexsort((np.arange(len(data)), d)) if keep is None or keep(i)]
    return ids[:k]


def test_knn(df, data):
    q = data[3] + 0.1
    assert [r.id for r in search.knn(df, q, 7).collect()] == best(data, q, 7)
    assert [r.id for r in search.knn(df, q, 7, "manhattan", {"label": 2}).collect()] == best(data, q, 7, lambda i: i % 5 == 2, 1)
    assert len(search.knn(df.limit(3), q, 10).collect()) == 3
    assert search.knn(df.filter("false"), q, 10).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 2, 9, 1)], "id long, vector array<double>")
    assert [r.id for r in search.knn(same, [0.0, 0.0], 3).collect()] == [1, 2, 5]
    assert sorted((r["rank"], r.id) for r in search.knn_batch(same, same.filter("id = 5"), 3).collect()) == [(1, 1), (2, 2), (3, 5)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot", "chebyshev"])
def test_batch_equals_single(df, data, metric):
    got = search.knn_batch(df, df.filter("id % 100 = 0"), 5, metric, exclude_self=True).collect()
    for i in range(0, N, 100):
        want = [r.id for r in search.knn(df.filter(F.col("id") != i), data[i], 5, metric).collect()]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == want


def test_by_id_range_and_scores(df, data):
    assert [r.id for r in search.knn_by_id(df, 9, 4).collect()] == best(data, data[9], 4, lambda i: i != 9)
    with pytest.raises(NotFoundError):
        search.knn_by_id(df, -1)
    grid = df.sparkSession.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1), (5, 5), (6, 5), (5, 6), (6, 6)])], "id long, vector array<double>")
    assert [r.id for r in search.range_search(grid, [0, 0], 1.5).collect()] == [0, 1, 2, 3]
    assert [r.id for r in search.range_search(grid, [0, 0], 1.5, max_results=2).collect()] == [0, 1]
    rows = search.knn(grid, [0, 0], 3).select("*", search.relative_score().alias("r"), search.inverse_score().alias("i")).collect()
    assert rows[0].r == 1 and rows[0].i == 1 and rows[2].r == pytest.approx(0, abs=1e-6) and rows[2].i == 0.5


def test_duplicates(spark, data):
    rng = np.random.default_rng(0)
    x = np.concatenate((data[:100], data[:20], data[:20] + rng.normal(size=(20, D)) * 0.02))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for t in (1e-6, 0.1, 1.0):
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= t}
        assert {(r.id1, r.id2) for r in search.duplicates(rows, t).collect()} == want
    assert search.duplicates(rows.filter("false")).collect() == []


def test_matrix_centres_graph(df, data):
    part = df.filter("id < 30")
    got = {(r.query_id, r.id): r.distance for r in search.distance_matrix(part).collect()}
    assert len(got) == 900 and got[3, 7] == pytest.approx(np.linalg.norm(data[3] - data[7]))
    c = {r.label: r.centroid for r in search.centroid(df, ["label"]).collect()}
    assert c[1] == pytest.approx(data[1::5].mean(axis=0))
    m = search.medoid(df).first()
    sums = np.linalg.norm(data[:, None] - data[None], axis=2).sum(axis=1)
    assert m.id == int(np.argmin(sums)) and m.total == pytest.approx(sums.min())
    assert search.knn_graph(part, 2).groupBy("query_id").count().filter("count <> 2").count() == 0


def recall(found, exact):
    f = {(r.query_id, r.id) for r in found.collect()}
    e = {(r.query_id, r.id) for r in exact.collect()}
    return len(f & e) / len(e)


def test_ivf(df, tmp_path):
    queries = df.filter("id % 20 = 0")
    exact = search.knn_batch(df, queries, 10)
    index = IVFIndex(n_clusters=8, n_probe=3).train(df).add(df)
    assert recall(index.search(queries, 10), exact) >= 0.7
    assert recall(index.search(queries, 10, n_probe=8), exact) == 1
    assert recall(index.search(queries, 10, filter={"label": 1}), search.knn_batch(df, queries, 10, filter={"label": 1})) >= 0.7
    index.save(str(tmp_path / "ivf"))
    back = IVFIndex(n_clusters=8).load(df.sparkSession, str(tmp_path / "ivf"))
    assert recall(back.search(queries, 10, n_probe=8), exact) == 1
    index.remove([0])
    assert index.rows.count() == N - 1 and index.in_cluster(0).count() >= 0
    with pytest.raises(NotFoundError):
        index.get_centroid(99)
    with pytest.raises(ValidationError):
        IVFIndex().add(df)


def test_quantisation(df, data):
    queries = df.filter("id % 40 = 0")
    exact = search.knn_batch(df, queries, 10)
    pq = PQIndex(n_subvectors=4, n_bits=4).train(df).add(df)
    assert recall(pq.search(queries, 10), exact) >= 0.3 and pq.compression() == 16
    back = {r.id: r.v for r in pq.rows.select("id", pq.decode(F.col("codes")).alias("v")).collect()}
    err = np.mean([np.linalg.norm(np.array(back[i]) - data[i]) for i in range(N)])
    assert err < 0.6 * np.mean(np.linalg.norm(data - data.mean(axis=0), axis=1))
    both = IVFPQIndex(n_clusters=4, n_probe=4, n_subvectors=4, n_bits=4).train(df).add(df)
    assert recall(both.search(queries, 10), exact) >= 0.3
    assert both.reconstruct().count() == N


def test_graph(df, data, tmp_path):
    queries = df.filter("id % 20 = 0")
    exact = search.knn_batch(df, queries, 10)
    graph = GraphIndex(m=8).add(df)
    assert recall(graph.search(queries, 10), exact) >= 0.95
    assert recall(graph.search(queries, 10, ef=10), exact) <= recall(graph.search(queries, 10, ef=200), exact)
    some = GraphIndex(m=8, shard=100 * data.shape[1]).add(df)
    assert some.graph.select("s").distinct().count() > 1 and recall(some.search(queries, 10), exact) >= 0.95
    degrees = graph.edges().groupBy("src", "level").count().groupBy("level").agg(F.max("count").alias("n"), F.count(F.lit(1)).alias("nodes")).orderBy("level").collect()
    assert degrees[0].n <= 16 and degrees[0].nodes == N and len(degrees) > 1 and all(r.n <= 8 for r in degrees[1:])
    assert graph.levels().filter("level > 0").count() < N / 4
    near = graph.neighbors(0).collect()
    assert near and all(abs(r.distance - np.linalg.norm(data[0] - data[r.dst])) < 1e-9 for r in near)
    assert recall(graph.search(queries, 5, filter={"label": 1}), search.knn_batch(df, queries, 5, filter={"label": 1})) == 1
    graph.save(str(tmp_path / "g"))
    assert recall(GraphIndex(m=8).load(df.sparkSession, str(tmp_path / "g")).search(queries, 10), exact) >= 0.95
    graph.remove([0, 20])
    left = df.filter("id not in (0, 20)")
    assert recall(graph.search(queries, 10), search.knn_batch(left, queries, 10)) >= 0.95 and not graph.search(queries, 10).filter("id in (0, 20)").count()
    moved = df.filter("id in (40, 41)").withColumn("vector", F.transform("vector", lambda x: x + 100.0))
    graph.update(moved)
    first = graph.search(moved, 2).filter("rank = 1").collect()
    assert {r.query_id for r in first} == {40, 41} and all(r.distance < 1e-9 for r in first) and graph.count() == N - 2
    assert graph.rebuild().graph.count() == N - 2
    assert GraphIndex(metric="cosine").add(df).search(queries, 1).filter("query_id <> id").count() == 0


@pytest.mark.parametrize("make", [FlatIndex, GraphIndex, lambda: IVFIndex(n_clusters=4), lambda: PQIndex(n_subvectors=4, n_bits=3), lambda: IVFPQIndex(n_clusters=2, n_subvectors=4, n_bits=3)])
def test_rows_of_indexes(df, make):
    some = df.filter("id < 60").select("id", "vector")
    index = make().train(some).add(some)
    assert index.count() == 60 and sorted(r.id for r in index.get([3, 5, 999]).collect()) == [3, 5]
    for again in (some.limit(1), df.filter("id = 70").select("id", "vector").unionByName(df.filter("id = 70").select("id", "vector"))):
        with pytest.raises(DuplicateIdError):
            index.add(again)
    with pytest.raises(NotFoundError):
        index.update(df.filter("id = 70").select("id", "vector"))
    index.update(some.filter("id = 7"))
    assert index.count() == 60 and index.remove([7]).count() == 59
    held = index.stats()
    assert held["count"] == 59 and held["kind"] == type(index).__name__ and ("compression" in held) == ("PQ" in held["kind"])
    assert len({r.id for r in index}) == 59


def test_flat_and_factory(df):
    queries = df.filter("id % 40 = 0")
    assert recall(FlatIndex().add(df).search(queries, 5), search.knn_batch(df, queries, 5)) == 1
    assert isinstance(create_index("hnsw"), GraphIndex)
    with pytest.raises(ValidationError):
        create_index("tree")
    assert recommend_index(100, 8)[0] == "flat" and recommend_index(50_000, 8)[0] == "hnsw" and recommend_index(10**6, 8)[0] == "ivf" and recommend_index(10**6, 8, "memory")[0] == "ivf_pq"
    assert recommend_index(10**6, 8, "speed") == ("ivf", {"n_clusters": 4000, "n_probe": 40}) and recommend_index(10**6, 8, "recall")[1]["n_probe"] == 800


def test_vectors_of_unlike_length(spark):
    """Only vectors of a query's length meet it; repeated ids and wide vectors are no matter."""
    rng = np.random.default_rng(2)
    wide = [(i, rng.normal(size=65_536).tolist()) for i in range(12)]
    rows = [(100, [0.0, 0.0, 0.0]), (101, [1.0]), (102, [1.0, 1.0, 1.0]), (103, [3.0]), (104, [0.0] * 5), (105, None), (106, [1.0, None, 2.0]), (102, [1.0, 1.0, 1.0]), *wide]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r.id): r.distance for r in search.knn_batch(df, df.filter("id in (0, 100, 101, 104)"), 3, exclude_self=True).collect()}
    assert {k for k in got if k[0] >= 100} == {(100, 102), (101, 103)} and got[101, 103] == 2
    x = np.array([v for _, v in wide])
    assert {j for i, j in got if i == 0} == set((np.argsort(((x[1:] - x[0]) ** 2).sum(axis=1))[:3] + 1).tolist())


def test_executor(df, data):
    run = Executor(df)
    assert [r.id for r in run.execute({"vector": data[1].tolist(), "k": 3}).collect()] == best(data, data[1], 3)
    assert run.execute({"count": True, "filter": {"label": 3}}).collect()[0][0] == N // 5
    assert [r.id for r in run.execute({"ids": [5, 999, 2]}).collect()] == [5, 2]
    rows = run.execute({"filter": {"label": 1}, "sort_by": "id", "order": "desc", "limit": 2, "offset": 1, "include_metadata": False}).frame
    assert rows.columns == ["id"] and [r.id for r in rows.collect()] == [391, 386]
    assert "TakeOrderedAndProject" in run.explain({"vector": data[1].tolist()})


def test_groups_take_a_link_for_a_row(spark, monkeypatch):
    """A cluster of 120 has 7140 pairs; each shard hands on at most a link for each row, and groups are those of all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64)) + 10
    x[:120] = x[0] + rng.normal(size=(120, 64)) * 1e-3
    x[150:170] = x[150] + np.cumsum(np.full((20, 64), 0.05), axis=0)  # a chain
    rows = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    root = {1000 - i: 1000 - i for i in range(200)}
    root |= dict.fromkeys(range(881, 1001), 881) | dict.fromkeys(range(831, 851), 831)
    want = {(k, v) for k, v in root.items() if v in (881, 831)}
    for shard, shards in ((1 << 19, 1), (64 * 50, 4)):
        monkeypatch.setattr(blocks, "SHARD", shard)
        assert blocks.linked(rows, search._within(0.5)).count() <= 200 * shards
        assert {tuple(r) for r in search.duplicate_groups(rows, 0.5).collect()} == want


def _refuses(q, v):
    raise AssertionError("all pairs were measured one by one")


def test_graph_measures_the_near_only(spark):
    """Far from the origin, where inner products are coarse, and with copies, whose ties go to the smaller id."""
    rng = np.random.default_rng(4)
    for at in (0.0, 1e4):
        x = rng.normal(size=(300, 16)) + at
        x[200:220] = x[100]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        want = {(i, r + 1, j) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), d[i]))[:4].tolist())}
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
        got = search.knn_graph(rows, 4, replace(get_metric("euclidean"), kernel=_refuses)).collect()
        assert {(r.query_id, r["rank"], r.id) for r in got} == want


def _few(q, v):
    assert len(q) < 60, "all totals were measured one by one"
    return get_metric("euclidean").kernel(q, v)


def test_medoid_measures_the_promising_only(spark):
    rng = np.random.default_rng(5)
    for at in (0.0, 1e4):
        x = rng.normal(size=(300, 16)) + at
        x[[40, 250]] = x.mean(axis=0)  # a tie
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
        got = search.medoid(rows, replace(get_metric("euclidean"), kernel=_few)).collect()
        assert [r.id for r in got] == [40]
        assert got[0].total == pytest.approx(np.sqrt(((x - x[40]) ** 2).sum(-1)).sum(), rel=1e-12)
    assert search.medoid(rows.filter("false")).collect() == []


def _rerank_by_shard(index, df, monkeypatch):
    """Codes of one bit say little; as each shard's candidates are measured, recall holds over any number of shards."""
    want = {(r.query_id, r.id) for r in search.knn_batch(df, df.filter("id % 20 = 0"), 10).collect()}
    monkeypatch.setattr(blocks, "SHARD", 12 * 8)
    found = index.train(df).add(df).search(df.filter("id % 20 = 0"), 10, vectors=df, rerank=2).collect()
    assert len(found) == len(want)
    assert len(want & {(r.query_id, r.id) for r in found}) >= 0.95 * len(want)


def test_pq_candidates_grow_with_shards(df, monkeypatch):
    _rerank_by_shard(PQIndex(n_subvectors=4, n_bits=1), df, monkeypatch)


def test_ivfpq_candidates_grow_with_shards(df, monkeypatch):
    _rerank_by_shard(IVFPQIndex(n_clusters=4, n_probe=4, n_subvectors=4, n_bits=1), df, monkeypatch)


def test_walks_widen_until_they_agree(spark):
    """A sparse graph in many dimensions, where walks that keep ten nodes miss about half of the neighbours."""
    x = np.random.default_rng(6).normal(size=(800, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    asked = rows.filter("id % 10 = 0")
    want = {(r.query_id, r.id) for r in search.knn_batch(rows, asked, 10).collect()}
    found = GraphIndex(m=4, ef_construction=8, ef_search=10).train(rows).add(rows).search(asked, 10).collect()
    assert len(want & {(r.query_id, r.id) for r in found}) >= 0.95 * len(want)
