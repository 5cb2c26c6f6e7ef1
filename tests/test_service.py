"""The service by plain values and over HTTP; settings; blobs."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.collection import Database
from lodestar.config import ServiceSettings, Settings, load_settings
from lodestar.errors import StorageError, ValidationError
from lodestar.functions import codec
from lodestar.service import AutoSaver, RateLimiter, Service, filter_of, serve

KEY = {"X-API-Key": "k"}


def test_routes(spark, tmp_path):
    s = Service(Database(spark, str(tmp_path / "db")), ServiceSettings(api_key="k"))
    ask = lambda m, p, b=None, h=KEY: s.handle(m, p, b, h)
    assert ask("GET", "/health", h={})[0] == 200
    assert ask("POST", "/collections", {"name": "c", "dimension": 2}, {})[0] == 401
    assert ask("POST", "/collections", {"name": "c", "dimension": 2}, {"x-api-key": "z"})[0] == 403
    assert ask("POST", "/collections", {"name": "c", "dimension": 2})[0] == 201
    assert ask("POST", "/collections", {"name": "c", "dimension": 2})[0] == 409
    assert ask("POST", "/collections", {"name": "d"})[0] == 400
    assert ask("GET", "/collections?limit=1")[1] == {"collections": ["c"], "total": 1}
    add = {"vectors": [{"id": "a", "vector": [0, 0], "metadata": {"n": 1}}, {"id": "b", "vector": [1, 0], "metadata": {"n": 2}}]}
    assert ask("POST", "/collections/c/vectors", add)[1] == {"ids": ["a", "b"]}
    assert ask("POST", "/collections/c/vectors", add)[0] == 409
    assert ask("POST", "/collections/c/vectors/single", {"id": "e", "vector": [1]})[0] == 400
    assert ask("GET", "/collections/c/vectors/a")[1]["vector"] == [0, 0] and ask("GET", "/collections/c/vectors/z")[0] == 404
    assert ask("PUT", "/collections/c/vectors/a", {"metadata": {"m": 5}, "mode": "merge"})[0] == 200
    got = ask("POST", "/collections/c/search", {"vector": [0, 0], "k": 2, "filter": {"match": {"n": 1}, "conditions": [{"field": "m", "operator": "gte", "value": 5}]}})[1]
    assert got["results"] == [{"id": "a", "distance": 0, "score": 1, "metadata": {"n": 1, "m": 5}}]
    assert [[x["id"] for x in r] for r in ask("POST", "/collections/c/search/batch", {"queries": [[0, 0], [1, 0]], "k": 1})[1]["results"]] == [["a"], ["b"]]
    assert ask("POST", "/collections/c/search/batch", {"queries": []})[0] == 400
    assert [r["id"] for r in ask("POST", "/collections/c/query", {"filter": {"n": 2}})[1]["results"]] == ["b"]
    assert [r["id"] for r in ask("GET", "/collections/c/vectors?limit=1&offset=1")[1]["vectors"]] == ["b"] and ask("GET", "/collections/c/vectors?limit=0")[0] == 400
    assert ask("POST", "/save")[1] == {"saved": ["c"]}
    assert ask("GET", "/info")[1]["vectors"] == 2 and ask("GET", "/metrics")[1]["collections"] == {"c": 2} and ask("GET", "/collections/c")[1]["count"] == 2
    assert ask("POST", "/collections/c/vectors/delete", {"ids": ["a", "q"]})[1] == {"deleted": 1, "not_found": 1}
    assert ask("DELETE", "/collections/c/vectors/b")[0] == 200 and ask("DELETE", "/collections/c/vectors/b")[0] == 404
    assert ask("DELETE", "/collections/c")[0] == 200 and ask("DELETE", "/collections/c")[0] == 404 and ask("GET", "/zzz")[0] == 404
    with pytest.raises(ValidationError):
        filter_of({"conditions": [{"field": "a", "operator": "near"}]})


def test_http_and_autosave(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    server = serve(Service(db, ServiceSettings(port=0)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    made = urllib.request.Request(f"{url}/collections", json.dumps({"name": "h", "dimension": 2}).encode(), {"Content-Type": "application/json"})
    assert urllib.request.urlopen(made).status == 201
    assert json.load(urllib.request.urlopen(f"{url}/collections"))["total"] == 1
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(urllib.request.Request(url, b"{"))
    server.shutdown()
    AutoSaver(db, 3600).close()
    assert Database.load(spark, str(tmp_path / "db")).list_collections() == ["h"]


def test_rate_limit():
    now = [0.0]
    r = RateLimiter(2, lambda: now[0])
    assert [r.allowed("x"), r.allowed("x"), r.allowed("x"), r.allowed("y")] == [True, True, False, True]
    now[0] = 61
    assert r.allowed("x")


def test_settings(tmp_path):
    assert load_settings(None, {}) == Settings()
    (tmp_path / "s.json").write_text('{"dimension": 4, "service": {"port": 9}}')
    s = load_settings(None, {"LODESTAR_CONFIG": str(tmp_path / "s.json")})
    assert s.dimension == 4 and s.service.port == 9
    with pytest.raises(ValidationError):
        Settings.from_dict({"zz": 1})


def test_blobs(spark):
    v = np.array([1.5, -2.0, 3.25])
    for kind in ("f4", "f8", "f2"):
        for c in (False, True):
            assert codec.decode(codec.encode(v, kind, c)).tolist() == v.tolist()
    for bad in (b"", b"xxxxxx", codec.encode(v)[:-1], codec.encode(v, compress=True)[:-3]):
        with pytest.raises(StorageError):
            codec.decode(bad)
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(codec.from_blob(codec.to_blob(F.col("v"), "f8", True))).collect()] == [[1.0, 2.0], None]
    assert df.select(F.count(codec.checksum(codec.to_blob(F.col("v"))))).first()[0] == 2
