"""Collections of (id, vector, metadata) and databases of them, over immutable frames."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.errors import CapacityError, CollectionExistsError, DuplicateIdError, EngineError, NotFoundError, ValidationError
from lodestar.functions.metrics import get_metric
from lodestar.functions.validation import check_dimension, check_id, check_k, check_metadata, check_vector
from lodestar.functions.vectors import normalize
from lodestar.operators import dml, search, stats
from lodestar.operators.filters import And, Field, Filter, Not, Or, parse_filter
from lodestar.sources import store

SCHEMA = "id string, vector array<float>, metadata variant, ts double, seq bigint"
_ROW = "id string, vector array<float>, json string, ts double, seq bigint"


#: Changes after which a collection's plan is cut.
CHANGES = 24


@dataclass(frozen=True)
class Config:
    """What a collection is made of."""

    name: str
    dimension: int
    metric: str = "euclidean"
    normalize: bool = False
    max_vectors: int | None = None


def in_metadata(f: Filter | None) -> Filter | None:
    """The filter with its fields looked for in the metadata, save ``id``."""
    if f is None:
        return None
    if isinstance(f, Field):
        return f if f.field == "id" else Field(f"metadata.{f.field}", f.op, f.value)
    if isinstance(f, Not):
        return Not(in_metadata(f.filter))
    return (And if isinstance(f, And) else Or)([in_metadata(x) for x in f.filters])


class Collection:
    """Rows in order of insertion (``seq``). Changes replace ``frame``, a lazy plan.

    After CHANGES of them the plan is cut by a checkpoint where the session has a folder for these; else call
    checkpoint() or save now and then.
    """

    def __init__(self, spark: SparkSession, config: Config, frame: DataFrame | None = None):
        check_dimension(config.dimension)
        self.spark, self.config, self.metric = spark, config, get_metric(config.metric)
        self._changes = 0
        self.frame = spark.createDataFrame([], SCHEMA) if frame is None else frame

    @property
    def frame(self) -> DataFrame:
        return self._frame_now

    @frame.setter
    def frame(self, df: DataFrame) -> None:
        self._changes += 1
        if self._changes > CHANGES and (self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir", None)):
            df, self._changes = self._cut(df), 0
        self._frame_now = df

    def _cut(self, df: DataFrame) -> DataFrame:
        sc = self.spark.sparkContext
        if not sc.getCheckpointDir() and (folder := self.spark.conf.get("spark.checkpoint.dir", None)):
            sc.setCheckpointDir(folder)
        return df.checkpoint()

    # changes

    def _next(self) -> int:
        return (self.frame.agg(F.max("seq")).first()[0] or 0) + 1

    def _row(self, record: dict | tuple, seq: int) -> tuple:
        i, v, m = (record.get("id"), record["vector"], record.get("metadata")) if isinstance(record, dict) else (*record, None)[:3]
        return check_id(i or str(uuid.uuid4())), check_vector(v, self.config.dimension), json.dumps(check_metadata(m)), time.time(), seq

    def _rows(self, records: Iterable[dict | tuple]) -> list[tuple]:
        first = self._next()
        return [self._row(r, first + n) for n, r in enumerate(records)]

    def _frame(self, rows: list[tuple]) -> DataFrame:
        df = self.spark.createDataFrame(rows, _ROW)
        v = normalize(F.col("vector")).cast("array<float>") if self.config.normalize else F.col("vector")
        return df.select("id", v.alias("vector"), F.parse_json("json").alias("metadata"), "ts", "seq")

    def add(self, id: str, vector: Sequence[float], metadata: dict | None = None, overwrite: bool = False) -> str:
        """Adds one record; a taken id raises DuplicateIdError unless it may be overwritten. An empty id gets a new one."""
        return self.add_batch([(id, vector, metadata)], overwrite)[0]

    def _add_some(self, records: Iterable[dict | tuple], overwrite: bool) -> dict[str, Any]:
        """The records that can be added are; bad ones, and those beyond the collection's capacity, are reported."""
        first, rows, errors, done = self._next(), [], [], 0
        for n, r in enumerate(records):
            try:
                rows.append(self._row(r, first + n))
            except (EngineError, KeyError, TypeError) as e:
                errors.append({"id": r.get("id") if isinstance(r, dict) else r[0], "error": str(e)})
        if rows:
            wanted = self.spark.createDataFrame([(r[0],) for r in rows], "id string").distinct()
            held = {r.id for r in self.frame.join(wanted, "id", "left_semi").select("id").collect()}
            most = self.config.max_vectors
            room = None if most is None else most - self.count()
            new: dict[str, tuple] = {}
            for r in rows:
                known = r[0] in held or r[0] in new
                if known and not overwrite:
                    errors.append({"id": r[0], "error": f"{r[0]!r} exists already"})
                elif not known and room == 0:
                    errors.append({"id": r[0], "error": f"{self.config.name} holds at most {most} vectors"})
                else:
                    room = room if known or room is None else room - 1
                    new[r[0]], done = r, done + 1
            if new:
                self.frame = dml.upsert(self.frame, self._frame(list(new.values())))
        return {"success_count": done, "error_count": len(errors), "errors": errors}

    def add_batch(self, records: Iterable[dict | tuple], overwrite: bool = False, on_error: str = "raise") -> Any:
        """All or none of the records are added, and their ids returned; or, if ``on_error`` is "skip" or "continue", all that
        can be, and ``success_count``, ``error_count`` and ``errors`` (id and error of each) returned."""
        if on_error not in ("raise", "skip", "continue"):
            raise ValidationError(f"no way {on_error!r} to treat errors")
        if on_error != "raise":
            return self._add_some(records, overwrite)
        rows = self._rows(records)
        ids = [r[0] for r in rows]
        if len(set(ids)) < len(ids) and not overwrite:
            raise DuplicateIdError("an id is repeated in the batch")
        rows = list({r[0]: r for r in rows}.values())
        new = self._frame(rows)
        taken = self.frame.join(new.select("id"), "id", "left_semi")
        if not overwrite and (first := taken.first()) is not None:
            raise DuplicateIdError(first.id)
        if self.config.max_vectors is not None and self.count() - taken.count() + len(rows) > self.config.max_vectors:
            raise CapacityError(f"{self.config.name} holds at most {self.config.max_vectors} vectors")
        self.frame = dml.upsert(self.frame, new)
        return ids

    def add_frame(self, df: DataFrame) -> DataFrame:
        """Adds a frame (id, vector, metadata as JSON or VARIANT) without collecting it; returns the rows left out.

        Left out are rows with bad ids or vectors, and with ids that the collection has already.
        """
        from lodestar.functions.validation import valid_id
        from lodestar.functions.vectors import is_valid

        kind = dict(df.dtypes).get("metadata")
        meta = F.col("metadata") if kind == "variant" else F.try_parse_json("metadata") if kind == "string" else F.parse_json(F.lit("{}"))
        v = F.col("vector").cast("array<float>")
        good = valid_id(F.col("id")) & is_valid(v, self.config.dimension)
        first = (self.frame.agg(F.max("seq")).first()[0] or 0) + 1
        rows = df.filter(good).select("id", (normalize(v).cast("array<float>") if self.config.normalize else v).alias("vector"), meta.alias("metadata"), F.unix_timestamp().cast("double").alias("ts"), (F.monotonically_increasing_id() + first).alias("seq"))
        self.frame, taken = dml.insert(self.frame, rows)
        return df.filter(~good).select("id").unionByName(taken.select("id"))

    def update(self, id: str, vector: Sequence[float] | None = None, metadata: dict | None = None, mode: str = "replace") -> None:
        """Replaces the vector, and replaces or shallowly merges the metadata; an unknown id raises NotFoundError."""
        if mode not in ("replace", "merge"):
            raise ValidationError(f"no mode {mode!r}")
        old = self.get(id)
        if old is None:
            raise NotFoundError(id)
        meta = old["metadata"] if metadata is None else {**old["metadata"], **metadata} if mode == "merge" else metadata
        row = self._rows([(id, old["vector"] if vector is None else vector, meta)])[0]
        self.frame = dml.upsert(self.frame, self._frame([(*row[:4], old["seq"])]))

    def delete(self, id: str) -> bool:
        return self.delete_many([id])["deleted"] == 1

    def delete_many(self, ids: Sequence[str]) -> dict[str, int]:
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        counts = dml.delete_counts(self.frame, wanted).first().asDict()
        self.frame = dml.delete(self.frame, wanted)
        return counts

    def clear(self) -> int:
        n = self.count()
        self.frame = self.spark.createDataFrame([], SCHEMA)
        return n

    def checkpoint(self) -> None:
        """Cuts the plan that changes have built up, in spark.checkpoint.dir."""
        self.frame = self._cut(self.frame)

    # reads

    def count(self, filter: Any = None) -> int:
        return self._where(filter).count()

    def __contains__(self, id: str) -> bool:
        return not self.frame.filter(F.col("id") == id).isEmpty()

    def _where(self, filter: Any) -> DataFrame:
        f = in_metadata(parse_filter(filter))
        return self.frame if f is None else self.frame.filter(f.predicate(self.frame.schema))

    @staticmethod
    def _record(row: Any) -> dict:
        return {"id": row.id, "vector": list(row.vector), "metadata": json.loads(row.json), "ts": row.ts, "seq": row.seq}

    def _json(self, df: DataFrame) -> DataFrame:
        return df.withColumn("json", F.coalesce(F.to_json("metadata"), F.lit("{}"))).drop("metadata")

    def get(self, id: str) -> dict | None:
        row = self._json(self.frame.filter(F.col("id") == id)).first()
        return row and self._record(row)

    def __iter__(self) -> Iterator[dict]:
        """The records in order of insertion, one partition at a time."""
        return map(self._record, self._json(self.frame.orderBy("seq")).toLocalIterator())

    def get_many(self, ids: Sequence[str]) -> list[dict | None]:
        rows = self._json(dml.get_many(self.frame, ids)).collect()
        return [self._record(r) if r.found else None for r in rows]

    def search(self, query: Sequence[float], k: int = 10, filter: Any = None, include_vector: bool = False) -> DataFrame:
        """``id, distance, score, metadata`` of the k nearest rows that the filter lets through; score is relative to the last."""
        q = check_vector(query, self.config.dimension)
        if self.config.normalize:
            n = sum(x * x for x in q) ** 0.5
            q = [x / n for x in q] if n >= 1e-8 else q
        found = search.knn(self._where(filter), q, check_k(k), self.metric)
        return found.select("id", "distance", search.relative_score().alias("score"), *["vector"] * include_vector, "metadata")

    def explain(self, query: Sequence[float], k: int = 10, filter: Any = None) -> str:
        """The plan of a search."""
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return self.search(query, k, filter)._jdf.queryExecution().explainString(mode)

    def range_search(self, query: Sequence[float], radius: float, filter: Any = None, max_results: int | None = None) -> DataFrame:
        found = search.range_search(self._where(filter), check_vector(query, self.config.dimension), radius, self.metric, None, max_results)
        return found.select("id", "distance", "metadata")

    def sample(self, n: int, seed: int | None = None) -> DataFrame:
        return dml.sample(self.frame, n, seed)

    def to_dict(self) -> dict:
        """Config and records as plain values: for small collections."""
        return {"config": asdict(self.config), "records": [self._record(r) for r in self._json(self.frame).orderBy("seq").collect()]}

    @classmethod
    def from_dict(cls, spark: SparkSession, data: dict) -> Collection:
        c = cls(spark, Config(**data["config"]))
        if data["records"]:
            rows = [(r["id"], r["vector"], json.dumps(r["metadata"]), r["ts"], r["seq"]) for r in data["records"]]
            c.frame = c._frame(rows)
        return c

    def search_batch(self, queries: DataFrame, k: int = 10, filter: Any = None) -> DataFrame:
        """Queries (id, vector) to ``query_id, rank, id, distance``."""
        return search.knn_batch(self._where(filter).select("id", "vector"), queries, check_k(k), self.metric)

    def query_by_metadata(self, filter: Any, limit: int | None = None) -> DataFrame:
        return dml.page(self._where(filter), ["seq"], limit)

    def list_ids(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        return dml.page(self.frame, ["seq"], limit, offset).select("id")

    def stats(self) -> dict:
        return asdict(self.config) | stats.collection_stats(self.frame, metadata=F.to_json("metadata")).first().asDict() | {"dimension": self.config.dimension}

    def fields(self) -> list[str]:
        """Metadata keys in use."""
        keys = F.map_keys(F.from_json(F.to_json("metadata"), "map<string,string>"))
        return sorted(r[0] for r in self.frame.select(F.explode(keys)).distinct().collect())


def records_from_numpy(vectors: Any, ids: Sequence[str] | None = None, metadata: Sequence[dict] | None = None) -> list[tuple]:
    """Records for add_batch from a matrix; without ids they get new ones. Lengths must agree."""
    n = len(vectors)
    if ids is not None and len(ids) != n or metadata is not None and len(metadata) != n:
        raise ValidationError("as many ids and metadata as vectors")
    return [(ids[i] if ids is not None else str(uuid.uuid4()), vectors[i].tolist(), metadata[i] if metadata is not None else None) for i in range(n)]


class Database:
    """Named collections, saved to and loaded from a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.created = spark, path, time.time()
        self._all: dict[str, Collection] = {}

    def create_collection(self, name: str, dimension: int, metric: str = "euclidean", normalize: bool = False, max_vectors: int | None = None, exist_ok: bool = False) -> Collection:
        if name in self._all:
            if exist_ok:
                return self._all[name]
            raise CollectionExistsError(name)
        self._all[check_id(name)] = Collection(self.spark, Config(name, dimension, metric, normalize, max_vectors))
        return self._all[name]

    def get_collection(self, name: str) -> Collection:
        if name not in self._all:
            raise NotFoundError(name)
        return self._all[name]

    def get_or_create_collection(self, name: str, dimension: int, metric: str = "euclidean", **options: Any) -> Collection:
        return self.create_collection(name, dimension, metric, exist_ok=True, **options)

    def delete_collection(self, name: str) -> bool:
        return self._all.pop(name, None) is not None

    def list_collections(self) -> list[str]:
        return list(self._all)

    def has_collection(self, name: str) -> bool:
        return name in self._all

    __contains__ = has_collection

    def __len__(self) -> int:
        return len(self._all)

    def search(self, name: str, query: Sequence[float], k: int = 10, filter: Any = None) -> DataFrame:
        return self.get_collection(name).search(query, k, filter)

    def info(self) -> dict:
        each = {n: c.stats() for n, c in self._all.items()}
        return {"collections": len(each), "vectors": sum(s["count"] for s in each.values()), "memory_bytes": sum(s["memory_bytes"] for s in each.values()), "created_at": self.created}

    def save(self, path: str | None = None) -> dict:
        path = path or self.path
        if not path:
            raise ValidationError("no path to save to")
        return store.save(self.spark, path, {n: (c.frame, asdict(c.config)) for n, c in self._all.items()}, self.created)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Database:
        db = cls(spark, path)
        for name, (df, config) in store.load(spark, path).items():
            db._all[name] = Collection(spark, Config(**config), df)
        return db

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        """Saves if the database has a path."""
        if self.path:
            self.save()
