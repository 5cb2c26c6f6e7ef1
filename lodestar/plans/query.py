"""Queries as dicts, JSON or a mini-language, and their execution on frames.

A query becomes a QuerySpec, the spec becomes a lazy frame; the physical plan is Spark's.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.errors import QuerySyntaxError, QueryTimeout
from lodestar.operators import dml, search
from lodestar.operators.filters import And, Field, Filter, parse_filter, where

KINDS = ("search", "filter", "hybrid", "get", "count", "aggregate")
#: The operators of the mini-language, longest first.
_SIGNS = {">=": "gte", "<=": "lte", "!=": "ne", "=": "eq", "!": "ne", ">": "gt", "<": "lt", "~": "contains", "^": "startswith", "$": "endswith", "*": "regex", "": "eq"}
_TERM = re.compile(r"""([\w.]+):(>=|<=|!=|[=!><~^$*]|)("[^"]*"|'[^']*'|\S+)""")


@dataclass(frozen=True)
class QuerySpec:
    """What a query asks for."""

    kind: str
    vector: list[float] | None = None
    ids: list[Any] | None = None
    filter: Filter | None = None
    k: int = 10
    limit: int | None = None
    offset: int = 0
    sort_by: str | None = None
    sort_order: str = "asc"
    include_vector: bool = False
    include_metadata: bool | list[str] = True
    hints: dict = field(default_factory=dict)


def parse_value(s: str) -> Any:
    """A literal: quoted text, true/false, null, whole and other numbers, a list with commas, or text."""
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    if s.lower() in ("null", "none", "nil"):
        return None
    if "," in s:
        return [parse_value(x.strip()) for x in s.split(",")]
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", s):
        return float(s)
    return s


def parse_string(text: str) -> Filter | None:
    """``price:>10 name:~"blue shirt" tag:a,b``: terms are ANDed; a value with commas is a choice."""
    terms, at = [], 0
    for m in _TERM.finditer(text):
        if text[at : m.start()].strip():
            raise QuerySyntaxError(f"can't read {text[at : m.start()].strip()!r}")
        name, sign, raw = m.groups()
        value, op = parse_value(raw), _SIGNS[sign]
        if isinstance(value, list) and op in ("eq", "ne"):
            op = "in" if op == "eq" else "nin"
        elif op in ("contains", "startswith", "endswith", "regex") and not isinstance(value, str):
            value = raw
        terms.append(Field(name, op, value))
        at = m.end()
    if text[at:].strip():
        raise QuerySyntaxError(f"can't read {text[at:].strip()!r}")
    return None if not terms else terms[0] if len(terms) == 1 else And(terms)


def parse_query(query: str | dict | QuerySpec, kind: str | None = None) -> QuerySpec:
    """A spec from a dict, JSON text or the mini-language. The kind follows from what is given, or is named."""
    if isinstance(query, QuerySpec):
        return query
    if isinstance(query, str):
        if not query.lstrip().startswith("{"):
            return QuerySpec(kind or "filter", filter=parse_string(query))
        try:
            query = json.loads(query)
        except ValueError as e:
            raise QuerySyntaxError(str(e)) from e
    if not isinstance(query, dict):
        raise QuerySyntaxError(f"not a query: {query!r}")

    def pick(*names: str, default: Any = None) -> Any:
        return next((query[n] for n in names if n in query), default)

    vector, ids = pick("vector", "query_vector"), pick("ids", "id")
    ids = [ids] if ids is not None and not isinstance(ids, list) else ids
    guess = "search" if vector is not None else "get" if ids is not None else "count" if query.get("count") else "filter"
    kind = kind or pick("type", "query_type", default=guess)
    if kind not in KINDS:
        raise QuerySyntaxError(f"no query type {kind!r}")
    order = pick("sort_order", "order", default="asc")
    if order not in ("asc", "desc"):
        raise QuerySyntaxError(f"no order {order!r}")
    hints = {n: query[n] for n in ("ef", "ef_search", "n_probe", "nprobe") if n in query}
    return QuerySpec(
        kind, vector, ids, parse_filter(pick("filter", "where")), int(pick("k", "top_k", "limit", default=10)), pick("limit"), int(pick("offset", "skip", default=0)),
        pick("sort_by", "order_by", "sort"), order, bool(pick("include_vector", "include_vectors", default=False)), pick("include_metadata", default=True), hints,
    )


@dataclass
class Result:
    """The rows of a query as a frame, and what is known of its run once it is collected."""

    frame: DataFrame
    spec: QuerySpec
    seconds: float | None = None
    rows: int | None = None

    def collect(self, timeout: float | None = None) -> list:
        """The rows. After ``timeout`` seconds the query's jobs are cancelled and QueryTimeout is raised."""
        began, late, done = time.time(), threading.Event(), threading.Event()
        context, tag = self.frame.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}"

        def watch() -> None:
            if not done.wait(timeout):
                late.set()
                while not done.wait(0.2):  # a stage that starts only now is cancelled as well
                    context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        if timeout is not None:
            threading.Thread(target=watch, daemon=True).start()
        try:
            out = self.frame.collect()
        except Exception as e:
            if late.is_set():
                raise QueryTimeout(f"the query took more than {timeout} s") from e
            raise
        finally:
            done.set()
            context.removeJobTag(tag)
        self.seconds, self.rows = time.time() - began, len(out)
        return out

    def estimate(self) -> dict[str, int | None]:
        """What Catalyst expects of the optimized plan: bytes and, where statistics are known, rows."""
        stats = self.frame._jdf.queryExecution().optimizedPlan().stats()
        rows = stats.rowCount()
        return {"bytes": int(str(stats.sizeInBytes())), "rows": int(str(rows.get())) if rows.isDefined() else None}

    def explain(self) -> str:
        return self.frame._jdf.queryExecution().explainString(self.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class Executor:
    """Runs queries on one collection's frame."""

    def __init__(self, df: DataFrame, metric: str = "euclidean", id: str = "id", vector: str = "vector", order: str | None = None):
        self.df, self.metric, self.id, self.vector = df, metric, id, vector
        self.order = order or id

    def _shown(self, df: DataFrame, spec: QuerySpec, extra: tuple[str, ...] = ()) -> DataFrame:
        rest = [c for c in self.df.columns if c not in (self.id, self.vector)]
        if spec.include_metadata is False:
            rest = []
        elif isinstance(spec.include_metadata, list):
            rest = [c for c in rest if c in spec.include_metadata]
        return df.select(self.id, *extra, *[self.vector] * spec.include_vector, *rest)

    def execute(self, query: str | dict | QuerySpec, kind: str | None = None) -> Result:
        spec = parse_query(query, kind)
        return Result(getattr(self, f"_{spec.kind}")(spec), spec)

    def _search(self, spec: QuerySpec) -> DataFrame:
        if spec.vector is None:
            raise QuerySyntaxError("a search needs a vector")
        found = search.knn(self.df, spec.vector, spec.k + spec.offset, self.metric, spec.filter, self.id, self.vector)
        if spec.offset:
            found = found.offset(spec.offset)
        return self._shown(found.withColumn("score", search.inverse_score()), spec, ("distance", "score"))

    _hybrid = _search

    def _filter(self, spec: QuerySpec) -> DataFrame:
        rows = where(self.df, spec.filter)
        if spec.sort_by:
            c = F.coalesce(F.col(spec.sort_by), F.lit(0)) if dict(self.df.dtypes).get(spec.sort_by) in ("int", "bigint", "double", "float") else F.col(spec.sort_by)
            rows = rows.orderBy(c.desc() if spec.sort_order == "desc" else c.asc(), F.col(self.order).asc())
        else:
            rows = rows.orderBy(self.order)
        if spec.offset:
            rows = rows.offset(spec.offset)
        return self._shown(rows.limit(spec.limit) if spec.limit else rows, spec)

    def _get(self, spec: QuerySpec) -> DataFrame:
        if spec.ids is None:
            raise QuerySyntaxError("a get needs ids")
        return self._shown(dml.get_many(self.df, spec.ids, self.id).filter("found").orderBy("pos"), spec)

    def _count(self, spec: QuerySpec) -> DataFrame:
        return where(self.df, spec.filter).agg(F.count(F.lit(1)).alias("count"))

    def _aggregate(self, spec: QuerySpec) -> DataFrame:
        raise QuerySyntaxError("aggregates are DataFrame operations: see lodestar.operators.stats")

    def explain(self, query: str | dict | QuerySpec) -> str:
        return self.execute(query).explain()
