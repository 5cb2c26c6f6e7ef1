"""Collections, databases, storage, changes, streams, chunks."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.collection import Collection, Config, Database, records_from_numpy
from lodestar.errors import CapacityError, CollectionExistsError, DimensionMismatchError, DuplicateIdError, NotFoundError, StorageError, ValidationError
from lodestar.functions.batching import batch_process
from lodestar.operators import chunking, dml, stats
from lodestar.sources import store
from lodestar.streaming import ingest


@pytest.fixture
def items(spark):
    c = Database(spark).create_collection("items", 2, max_vectors=10)
    c.add_batch([("a", [0, 0], {"kind": "x", "n": 1}), ("b", [1, 0], {"kind": "y", "n": 2, "tags": ["t"]}), ("c", [0, 3], {"n": 3})])
    return c


def test_crud(items):
    assert items.count() == 3 and "a" in items and "z" not in items
    assert items.get("b")["metadata"] == {"kind": "y", "n": 2, "tags": ["t"]} and items.get("z") is None
    with pytest.raises(DuplicateIdError):
        items.add("a", [1, 1])
    with pytest.raises(DimensionMismatchError):
        items.add("d", [1])
    items.add("a", [9, 9], {"n": 9}, overwrite=True)
    assert items.get("a")["vector"] == [9, 9]
    items.update("b", metadata={"n": 5}, mode="merge")
    assert items.get("b")["metadata"] == {"kind": "y", "n": 5, "tags": ["t"]}
    items.update("b", vector=[7, 7], metadata={"q": None})
    assert items.get("b")["metadata"] == {"q": None} and items.get("b")["vector"] == [7, 7]
    with pytest.raises(NotFoundError):
        items.update("z", [1, 1])
    with pytest.raises(ValidationError):
        items.update("b", mode="zz")
    assert [r and r["id"] for r in items.get_many(["c", "z", "a"])] == ["c", None, "a"]
    assert items.delete("a") and not items.delete("a")
    assert items.delete_many(["b", "q"]) == {"deleted": 1, "not_found": 1}
    with pytest.raises(CapacityError):
        items.add_batch([(f"n{i}", [0, 0], None) for i in range(11)])
    assert items.clear() == 1 and items.count() == 0 and items.search([0, 0]).collect() == []


def test_reads(items):
    assert [r.id for r in items.search([0, 0], 2).collect()] == ["a", "b"]
    assert [r.id for r in items.search([0, 0], 5, {"n": {"$gte": 2, "$lt": 3}}).collect()] == ["b"]
    assert [r.id for r in items.query_by_metadata({"kind": {"$exists": False}}).collect()] == ["c"]
    assert [r.id for r in items.list_ids(1, 1).collect()] == ["b"]
    assert items.fields() == ["kind", "n", "tags"]
    s = items.stats()
    assert s["count"] == 3 and s["dimension"] == 2 and s["memory_bytes"] > 24
    q = items.frame.filter("id = 'b'").select("id", "vector")
    assert [r.id for r in items.search_batch(q, 2).collect()] == ["b", "a"]


def test_more_reads(spark, items):
    assert "TakeOrderedAndProject" in items.explain([0, 0], 2, {"n": 1})
    assert [r.id for r in items.range_search([0, 0], 1.0).collect()] == ["a", "b"] and [r.id for r in items.range_search([0, 0], 5.0, max_results=1).collect()] == ["a"]
    assert {r.id for r in items.sample(2, 1).collect()} == {r.id for r in items.sample(2, 1).collect()} and items.sample(9).count() == 3
    back = Collection.from_dict(spark, json.loads(json.dumps(items.to_dict())))
    assert back.to_dict() == items.to_dict()
    items.add_batch(records_from_numpy(np.eye(2), ["p", "q"]))
    assert items.get("q")["vector"] == [0, 1] and len(records_from_numpy(np.eye(2))[0][0]) == 36
    with pytest.raises(ValidationError):
        records_from_numpy(np.eye(2), ["p"])


def test_frames_into_collections(spark, items):
    new = spark.createDataFrame([("e", [1.0, 1.0], '{"n": 1}'), ("a", [1.0, 1.0], "{}"), ("bad id", [1.0, 1.0], "{}"), ("f", [1.0], "{}"), ("g", [float("nan"), 0.0], None)], "id string, vector array<double>, metadata string")
    left = items.add_frame(new)
    assert sorted(r.id for r in left.collect()) == ["a", "bad id", "f", "g"]
    assert items.count() == 4 and items.get("e")["metadata"] == {"n": 1}


def test_database(spark, tmp_path):
    path = str(tmp_path / "db")
    with Database(spark, path) as db:
        c = db.create_collection("one", 2, "l2", normalize=True)
        c.add("x", [3, 4], {"k": {"deep": [1, None, "s"]}})
        db.create_collection("two", 3)
        with pytest.raises(CollectionExistsError):
            db.create_collection("one", 2)
        assert db.create_collection("one", 2, exist_ok=True) is c and db.get_or_create_collection("two", 3).config.dimension == 3
        assert db.list_collections() == ["one", "two"] and len(db) == 2 and "one" in db and db.info()["vectors"] == 1
    back = Database.load(spark, path)
    assert back.get_collection("one").get("x")["vector"] == pytest.approx([0.6, 0.8])
    assert back.get_collection("one").get("x")["metadata"] == {"k": {"deep": [1, None, "s"]}} and back.get_collection("two").count() == 0
    assert back.delete_collection("two") and not back.delete_collection("two")
    with pytest.raises(NotFoundError):
        back.get_collection("two")
    with pytest.raises(StorageError):
        Database.load(spark, str(tmp_path / "none"))
    before = store.checksum(back.get_collection("one").frame)
    store.compact(spark, path)
    assert store.checksum(Database.load(spark, path).get_collection("one").frame) == before
    with pytest.raises(ValidationError):
        Database(spark).save()


def test_changes(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2), (1, "d", 2)], "id long, v string, seq int")
    assert {(r.id, r.v) for r in dml.latest(log).collect()} == {(1, "b"), (2, "c")}
    state = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, v string, w int")
    assert {tuple(r) for r in dml.upsert(state, spark.createDataFrame([(2, "z", 5), (3, "n", 1)], state.schema)).collect()} == {(1, "a", 1), (2, "z", 5), (3, "n", 1)}
    assert {tuple(r) for r in dml.patch(state, spark.createDataFrame([(1, None), (2, "q"), (9, "x")], "id long, v string")).collect()} == {(1, "a", 1), (2, "q", None)}
    new, taken = dml.insert(state, spark.createDataFrame([(1, "x", 0), (5, "y", 0)], state.schema))
    assert new.count() == 3 and [r.id for r in taken.collect()] == [1]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "1"}), ({"a": "1"}, None)], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in m.select(dml.merge_maps(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3"}, {"c": "1"}, {"a": "1"}]
    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 1)], "level int, src long, dst long")
    assert stats.degree_stats(edges).first().asDict() == {"level": 0, "nodes": 2, "edges": 3, "min_degree": 1, "max_degree": 2, "mean_degree": 1.5}


def test_streams(spark, tmp_path):
    schema = "id string, vector array<double>, seq long"
    rows = [("a", [1.0], 1), ("a", [2.0], 2), ("b", [3.0], 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("id", "vector", "seq"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {(r.id, r.vector[0]) for r in dml.latest(log, "id", ("batch", "seq")).collect()} == {("a", 2.0), ("b", 3.0)}
    hits = spark.createDataFrame([("2024-01-01 00:00:05", "x"), ("2024-01-01 00:00:50", "x"), ("2024-01-01 00:01:10", "x")], "ts string, client string").withColumn("ts", F.to_timestamp("ts"))
    rates = ingest.request_rates(hits)
    assert sorted(r.n for r in rates.collect()) == [1, 2] and ingest.over_limit(rates, 1).count() == 1


def test_batches(spark):
    df = spark.range(25).repartition(2)
    out = batch_process(df, lambda b: pd.DataFrame({"n": [len(b)], "s": [int(b.id.sum())]}), "n int, s long", 10)
    rows = out.collect()
    assert sum(r.s for r in rows) == 300 and max(r.n for r in rows) <= 10


def test_plans_are_cut(spark, monkeypatch):
    monkeypatch.setattr("lodestar.collection.CHANGES", 3)
    c = Collection(spark, Config("c", 2))
    for i in range(7):
        c.add(f"v{i}", [i, i])
    assert [r["id"] for r in c] == [f"v{i}" for i in range(7)] and c.count() == 7 and c.frame._jdf.queryExecution().optimizedPlan().toString().count("Union") <= 3


def test_batches_with_errors(spark):
    c = Collection(spark, Config("c", 2, max_vectors=4))
    c.add("a", [1, 2])
    got = c.add_batch([{"id": "b", "vector": [1, 1]}, {"id": "a", "vector": [0, 0]}, {"id": "x", "vector": [1]}, {"id": "b", "vector": [2, 2]}, ("d", [3, 3]), ("e", [4, 4]), ("f", [5, 5])], on_error="skip")
    assert (got["success_count"], got["error_count"]) == (3, 4) and sorted(e["id"] for e in got["errors"]) == ["a", "b", "f", "x"]
    assert c.count() == 4 and list(c.get("b")["vector"]) == [1, 1]
    assert c.add_batch([("a", [7, 7]), ("g", [0, 0])], overwrite=True, on_error="continue")["success_count"] == 1 and list(c.get("a")["vector"]) == [7, 7]
    with pytest.raises(ValidationError):
        c.add_batch([], on_error="stop")


def test_long_texts_in_chunks(spark):
    text = "One more sentence of a text. " * 30_000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = chunking.chunk_sentences(df, size=100, overlap=30).select("chunk_no", "chunk").collect()
    assert len(rows) == 14_999 + 1 and all(len(r.chunk) <= 102 for r in rows)
    assert chunking.chunk_recursive(df, size=100).filter("length(chunk) > 100").count() == 0 and chunking.chunk_fixed(df).select("chunk").count() == 1934


def recursively(text, size, separators=("\n\n", "\n", ". ", " ")):
    parts = [text or ""]
    for x in separators:
        parts = [q for p in parts for q in ([p] if len(p) <= size else p.split(x))]
    parts = [q.strip(" ") for p in parts for q in ([p] if len(p) <= size else [p[i : i + size] for i in range(0, len(p), size)])]
    out, held = [], []
    for p in filter(None, parts):
        if held and len(" ".join([*held, p])) > size:
            out.append(" ".join(held))
            held = []
        held.append(p)
    return out + [" ".join(held)] * bool(held)


def test_recursive_chunks(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(["ab", "c", " ", ". ", "\n", "\n\n", "é" * 30], p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.03, 0.02], size=300)) for _ in range(40)] + ["", None, "x" * 500, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got: dict = {}
    for r in chunking.chunk_recursive(df, size=50).collect():
        got.setdefault(r.id, {})[r.chunk_no] = r.chunk
    assert {i: [c[k] for k in sorted(c)] for i, c in got.items()} == {i: w for i, t in enumerate(texts) if (w := recursively(t, 50))}


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "One two. Three four! Five?\n\nSix seven eight nine ten")], "id long, text string")
    fixed = chunking.chunk_fixed(df, size=4, overlap=1).filter("id = 1").orderBy("chunk_no").collect()
    assert [(r.start, r.end, r.chunk) for r in fixed] == [(0, 4, "abcd"), (3, 7, "defg"), (6, 10, "ghij"), (9, 10, "j")]
    assert chunking.chunk_fixed(df).filter("id in (2, 3)").count() == 0
    with pytest.raises(ValidationError):
        chunking.chunk_fixed(df, size=5, overlap=5)
    s = chunking.chunk_sentences(df, size=22, overlap=11).filter("id = 4").orderBy("chunk_no").collect()
    assert [r.chunk for r in s] == ["One two. Three four!", "Three four! Five?", "Five? Six seven eight nine ten"]
    r = chunking.chunk_recursive(df, size=12).filter("id = 4").collect()
    assert all(len(x.chunk) <= 12 for x in r) and len(r) > 3
    c = chunking.context(spark.createDataFrame([(1, 2, "bbbbbb"), (1, 1, "aa")], "k int, o int, t string"), "k", "o", "t", 4).first()
    assert c.context == "[1] aa\n[2] bbbb..."
