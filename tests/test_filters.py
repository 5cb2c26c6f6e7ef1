"""Filters on typed columns and on VARIANTs against plain Python."""

import pytest
from pyspark.sql import functions as F

from lodestar.errors import QuerySyntaxError, QueryTimeout
from lodestar.operators.filters import And, Field, FilterBuilder, Not, Or, from_dict, indexed_fields, parse_filter, where
from lodestar.plans.query import Result, parse_query, parse_string, parse_value

ROWS = [
    (1, "Anna", 5, 1.5, True, ["a", "b"], {"deep": {"n": 1}}, '{"n": 1, "s": "5", "l": [1, 2], "o": {"x": 3}, "t": true}'),
    (2, "bob", None, -2.0, False, [], {"deep": {"n": 9}}, '{"n": 2.5, "s": null}'),
    (3, None, 7, None, None, None, None, '{"n": "1"}'),
    (4, "Anton", 0, 0.0, True, ["c"], {"deep": None}, None),
]


@pytest.fixture(scope="module")
def df(spark):
    rows = spark.createDataFrame(ROWS, "id long, name string, n int, x double, ok boolean, tags array<string>, s struct<deep:struct<n:int>>, js string")
    return rows.withColumn("v", F.try_parse_json("js")).withColumn("m", F.create_map(F.lit("k"), F.col("n")))


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (None, [1, 2, 3, 4]), ({}, [1, 2, 3, 4]), ({"name": "bob"}, [2]), ({"n": None}, [2]), ({"n": {"$ne": 5}}, [2, 3, 4]), ({"n": {"$gte": 0, "$lt": 7}}, [1, 4]),
        ({"n": {"$between": [0, 5]}}, [1, 4]), ({"n": {"$between": 3}}, []), ({"name": {"$gt": 5}}, []), ({"$not": {"name": {"$gt": 5}}}, [1, 2, 3, 4]), ({"name": {"$contains": "nn"}}, [1]),
        ({"name": {"$icontains": "AN"}}, [1, 4]), ({"name": {"$startswith": "An"}}, [1, 4]), ({"name": {"$endswith": "b"}}, [2]), ({"name": {"$regex": "^A.*n$"}}, [4]),
        ({"n": {"$in": [0, None]}}, [2, 4]), ({"n": {"$nin": [0, 5]}}, [2, 3]), ({"tags": {"$contains_any": ["b", "c"]}}, [1, 4]), ({"tags": {"$contains_all": ["a", "b"]}}, [1]), ({"tags": {"$contains_all": []}}, [1, 2, 4]),
        ({"tags": {"$array_length": 0}}, [2]), ({"tags": {"$array_length": {"op": "gte", "value": 1}}}, [1, 4]), ({"tags": {"$exists": False}}, [3]), ({"nope": {"$exists": False}}, [1, 2, 3, 4]), ({"nope": 1}, []),
        ({"nope": {"$ne": 1}}, [1, 2, 3, 4]), ({"s.deep.n": {"$gt": 5}}, [2]), ({"s.deep.nope": None}, [1, 2, 3, 4]), ({"m.k": 7}, [3]), ({"tags.0": "a"}, [1]), ({"tags.-1": "b"}, [1]), ({"ok": True}, [1, 4]), ({"ok": 1}, [1, 4]),
        ({"n": {"$type": "int"}}, [1, 3, 4]), ({"x": {"$type": "float"}}, [1, 2, 4]), ({"ok": {"$type": "int"}}, [1, 2, 4]), ({"n": {"$type": "null"}}, [2]), ({"tags": {"$type": "list"}}, [1, 2, 4]), ({"s": {"$type": "dict"}}, [1, 2, 4]),
        ({"$or": [{"n": 5}, {"x": 0.0}], "id": {"$lt": 4}}, [1]), ({"$and": [{"n": 5}, {"ok": True}]}, [1]), ({"n": {"$not": {"$gt": 3}}}, [2, 4]), ([{"n": 5}, {"ok": True}], [1]), ({"tags": ["a", "b"]}, [1]),
        ({"v.n": 1}, [1]), ({"v.n": {"$gt": 0}}, [1, 2]), ({"v.n": "1"}, [3]), ({"v.s": "5"}, [1]), ({"v.s": 5}, []), ({"v.s": None}, [2, 3, 4]), ({"v.o.x": {"$gte": 3}}, [1]), ({"v.l[0]": 1}, [1]), ({"v.l.0": 1}, [1]),
        ({"v.n": {"$type": "string"}}, [3]), ({"v.n": {"$type": "int"}}, [1]), ({"v.n": {"$type": "float"}}, [2]), ({"v.t": True}, [1]), ({"v.t": 1}, [1]), ({"v.l": {"$type": "list"}}, [1]), ({"v.o": {"$type": "dict"}}, [1]), ({"v.zz": {"$ne": 1}}, [1, 2, 3, 4]),
    ],
)
def test_conditions(df, spec, want):
    assert sorted(r.id for r in where(df, spec).collect()) == want
    f = parse_filter(spec)
    if f is not None:
        assert sorted(r.id for r in where(df, from_dict(f.to_dict())).collect()) == want
        inverse = sorted(r.id for r in where(df, ~f).collect())
        assert inverse == sorted({1, 2, 3, 4} - set(want))


def test_unknown_operators_raise():
    for bad in ({"a": {"$near": 1}}, {"$nor": []}, {"type": "field", "field": "a", "operator": "zz"}, 5):
        with pytest.raises(QuerySyntaxError):
            parse_filter(bad)
    with pytest.raises(QuerySyntaxError):
        from_dict({"type": "xor"})
    assert parse_filter({"type": "shirt"}) == Field("type", "eq", "shirt")


def test_builder(df):
    f = FilterBuilder().field("n").gte(0).lt(6).field("ok").eq(True).or_().field("name").icontains("BO").build()
    assert sorted(r.id for r in where(df, f).collect()) == [1, 2, 4]
    assert FilterBuilder().build() is None
    assert sorted(r.id for r in where(df, FilterBuilder().field("n").is_null().build()).collect()) == [2]


def test_pushdown(spark, tmp_path):
    spark.range(100).withColumn("x", F.col("id") % 7).withColumn("y", F.lit("a")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    plan = where(read, {"x": {"$gt": 3}}).select("id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(x,3)" in plan and "y:string" not in plan


def test_language(df):
    assert sorted(r.id for r in where(df, parse_string('n:>=0 name:^"An"')).collect()) == [1, 4]
    assert sorted(r.id for r in where(df, parse_string("n:5,7")).collect()) == [1, 3]
    assert [parse_value(x) for x in ("true", "null", "5", "-2.5", "'5'", "a,1", "abc")] == [True, None, 5, -2.5, "5", ["a", 1], "abc"]
    with pytest.raises(QuerySyntaxError):
        parse_string("n:5 and more")
    q = parse_query('{"vector": [1, 2], "top_k": 3, "where": {"a": 1}, "nprobe": 4}')
    assert (q.kind, q.k, q.filter, q.hints) == ("search", 3, Field("a", "eq", 1), {"nprobe": 4})
    assert parse_query({"ids": "x"}).ids == ["x"] and parse_query({"count": True}).kind == "count" and parse_query("a:1").kind == "filter"
    for bad in ('{"a"', {"type": "zz"}, 5, {"order": "up"}):
        with pytest.raises(QuerySyntaxError):
            parse_query(bad)


def test_indexed_fields(df):
    assert "s.deep.n" in indexed_fields(df.schema)


@pytest.mark.parametrize(("spec", "pushed"), [({"x": 3}, "EqualTo(x,3)"), ({"x": {"$in": [1, 5]}}, "In(x, [1,5])"), ({"x": {"$between": [2, 4]}}, "LessThanOrEqual(x,4)"), ({"y": {"$startswith": "a"}}, "StringStartsWith(y,a)"), ({"$or": [{"x": 1}, {"y": "a"}]}, "Or(EqualTo(x,1),EqualTo(y,a))"), ({"x": {"$is_not_null": True}, "y": "a"}, "IsNotNull(x)")])
def test_pushed(spark, tmp_path, spec, pushed):
    spark.range(100).withColumn("x", F.col("id") % 7).withColumn("y", F.lit("a")).write.parquet(str(tmp_path / "t"))
    plan = where(spark.read.parquet(str(tmp_path / "t")), spec)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan[plan.index("PushedFilters") :]


def test_timeout(spark):
    slow = spark.range(4).repartition(2).mapInPandas(lambda batches: (__import__("time").sleep(20) or b for b in batches), "id long")
    with pytest.raises(QueryTimeout):
        Result(slow, None).collect(timeout=1)
    fast = Result(spark.range(5), None)
    assert len(fast.collect(timeout=60)) == fast.rows == 5 and fast.estimate()["bytes"] > 0
