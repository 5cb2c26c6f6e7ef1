"""Filters: a small tree of conditions, compiled to a Column against a schema.

Conditions are two-valued: a missing field, a null and a comparison of unlike types are just false, so NOT of them is
true. Fields are dotted paths through structs, maps, arrays (by place, negative from the end) and VARIANTs.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.errors import QuerySyntaxError

_ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_TEXT = {"contains": lambda v, c: v.contains(c), "icontains": lambda v, c: F.lower(v).contains(c.lower()), "startswith": lambda v, c: v.startswith(c), "endswith": lambda v, c: v.endswith(c), "regex": lambda v, c: v.rlike(c)}
_SHORT = {"equals": "eq", "not_equals": "ne", "greater_than": "gt", "less_than": "lt", "not_in": "nin", "=": "eq", "==": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "~": "contains", "like": "contains", "starts_with": "startswith", "ends_with": "endswith", "matches": "regex", "len": "array_length", "size": "array_length"}
OPERATORS = ("eq", "ne", *_ORDER, "between", *_TEXT, "in", "nin", "contains_any", "contains_all", "array_length", "exists", "is_null", "is_not_null", "type")


class Filter:
    """A condition on metadata; combines by &, | and ~."""

    def __and__(self, other: Filter) -> Filter:
        return And([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Or([self, other])

    def __invert__(self) -> Filter:
        return Not(self)

    def column(self, schema: T.StructType) -> Column:
        """The condition as a value that is never null."""
        raise NotImplementedError

    def predicate(self, schema: T.StructType) -> Column:
        """The condition for a WHERE, where null is as good as false: bare comparisons, which Spark pushes into scans."""
        return self.column(schema)

    def to_dict(self) -> dict:
        raise NotImplementedError


@dataclass(frozen=True)
class Field(Filter):
    """One field against a value."""

    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        op = _SHORT.get(self.op.removeprefix("$"), self.op.removeprefix("$"))
        if op not in OPERATORS:
            raise QuerySyntaxError(f"no operator {self.op!r}")
        object.__setattr__(self, "op", op)

    def to_dict(self) -> dict:
        return {"type": "field", "field": self.field, "operator": self.op, "value": self.value}

    def column(self, schema: T.StructType) -> Column:
        return F.coalesce(self.predicate(schema), F.lit(False))

    def predicate(self, schema: T.StructType) -> Column:
        return _compare(*resolve(schema, self.field), self.op, self.value)


@dataclass(frozen=True)
class And(Filter):
    """All of the filters; true for none."""

    filters: list[Filter]

    def to_dict(self) -> dict:
        return {"type": "and", "filters": [f.to_dict() for f in self.filters]}

    def column(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.and_, [f.column(schema) for f in self.filters], F.lit(True))

    def predicate(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.and_, [f.predicate(schema) for f in self.filters]) if self.filters else F.lit(True)


@dataclass(frozen=True)
class Or(Filter):
    """Any of the filters; false for none."""

    filters: list[Filter]

    def to_dict(self) -> dict:
        return {"type": "or", "filters": [f.to_dict() for f in self.filters]}

    def column(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.or_, [f.column(schema) for f in self.filters], F.lit(False))

    def predicate(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.or_, [f.predicate(schema) for f in self.filters]) if self.filters else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    filter: Filter

    def to_dict(self) -> dict:
        return {"type": "not", "filter": self.filter.to_dict()}

    def column(self, schema: T.StructType) -> Column:
        return ~self.filter.column(schema)


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """The column of a dotted path and its type; a typed null where the path leads nowhere."""
    nothing = F.lit(None).cast("string"), T.NullType()
    if path in schema.names:
        return F.col(f"`{path}`"), schema[path].dataType
    first, *rest = path.split(".")
    if first not in schema.names:
        return nothing
    v, kind = F.col(f"`{first}`"), schema[first].dataType
    for n, step in enumerate(rest):
        if isinstance(kind, T.StructType) and step in kind.names:
            v, kind = v.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            v, kind = F.try_element_at(v, F.lit(step)), kind.valueType
        elif isinstance(kind, T.ArrayType) and step.lstrip("-").isdigit():
            i = int(step)
            v, kind = F.try_element_at(v, F.lit(i + 1 if i >= 0 else i)), kind.elementType
        elif isinstance(kind, T.VariantType):
            inner = "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in rest[n:])
            return F.try_variant_get(v, inner, "variant"), kind
        else:
            return nothing
    return v, kind


def _class(kind: T.DataType | Any) -> str:
    if isinstance(kind, (bool, int, float, T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(kind, (str, T.StringType)):
        return "string"
    if isinstance(kind, (list, tuple, set, T.ArrayType)):
        return "list"
    if isinstance(kind, (dict, T.StructType, T.MapType)):
        return "dict"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "null" if kind is None or isinstance(kind, T.NullType) else type(kind).__name__


def _typed(v: Column, kind: T.DataType, c: Any) -> tuple[Column, Column] | None:
    """v and c made comparable, or None if they are of unlike types. Booleans are the numbers 0 and 1."""
    own = _class(c)
    if isinstance(kind, T.VariantType):
        stored = F.schema_of_variant(v)
        if own == "string":
            return F.when(stored == "STRING", F.try_variant_get(v, "$", "string")), F.lit(c)
        if own == "number":
            number = F.when(stored.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"), F.try_variant_get(v, "$", "double"))
            return number.when(stored == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")), F.lit(float(c))
        return None
    if isinstance(kind, T.BooleanType) and own == "number":
        return v.cast("int"), F.lit(int(c) if isinstance(c, bool) else c)
    if _class(kind) == "time":
        return (v, F.lit(c).try_cast("timestamp")) if own == "string" or hasattr(c, "year") else None
    if _class(kind) != own:
        return None
    return v, F.lit(int(c) if isinstance(c, bool) else c) if own == "number" else F.lit(list(c) if own == "list" else c)


def _same(v: Column, kind: T.DataType, c: Any) -> Column:
    """v = c; null where v is."""
    if c is None:
        return v.isNull() | F.is_variant_null(v) if isinstance(kind, T.VariantType) else v.isNull()
    pair = _typed(v, kind, c)
    return F.lit(False) if pair is None or _class(c) == "dict" else pair[0] == pair[1]


def _equals(v: Column, kind: T.DataType, c: Any) -> Column:
    return F.coalesce(_same(v, kind, c), F.lit(False))


def _among(v: Column, kind: T.DataType, values: list) -> Column:
    """v is one of the values; null where v is. Whole numbers and strings are looked up together, as a scan can."""
    plain: list[Any] = []
    if isinstance(kind, (T.IntegralType, T.StringType)):
        own = int if isinstance(kind, T.IntegralType) else str
        plain = [c for c in values if type(c) is own]
    other = [_same(v, kind, c) for c in values if not any(c is p for p in plain)]
    return functools.reduce(operator.or_, [v.isin(plain)] * bool(plain) + other) if values else F.lit(False)


def _compare(v: Column, kind: T.DataType, op: str, c: Any) -> Column:
    no = F.lit(False)
    if op == "eq":
        return _same(v, kind, c)
    if op == "ne":
        return ~_equals(v, kind, c)
    if op in _ORDER:
        pair = _typed(v, kind, c) if _class(c) in ("number", "string") or hasattr(c, "year") else None
        return _ORDER[op](*pair) if pair else no
    if op == "between":
        if not isinstance(c, (list, tuple)) or len(c) != 2:
            return no
        return _compare(v, kind, "gte", c[0]) & _compare(v, kind, "lte", c[1])
    if op in _TEXT:
        pair = _typed(v, kind, c) if isinstance(c, str) else None
        return _TEXT[op](pair[0], c) if pair and _class(kind) != "time" else no
    if op in ("in", "nin"):
        if not isinstance(c, (list, tuple, set)):
            raise QuerySyntaxError(f"{op} takes a list")
        found = _among(v, kind, list(c))
        return found if op == "in" else ~F.coalesce(found, no)
    if op in ("contains_any", "contains_all"):
        if not isinstance(kind, T.ArrayType) or not isinstance(c, (list, tuple, set)):
            return no
        parts = [_has(v, kind.elementType, y) for y in c]
        return functools.reduce(operator.or_, parts, no) if op == "contains_any" else functools.reduce(operator.and_, parts, v.isNotNull())
    if op == "array_length":
        if not isinstance(kind, T.ArrayType):
            return no
        how, n = (c.get("op", "eq"), c.get("value")) if isinstance(c, dict) else ("eq", c)
        how = _SHORT.get(how.removeprefix("$"), how.removeprefix("$"))
        if how not in ("eq", *_ORDER) or not isinstance(n, int):
            return no
        size = F.when(v.isNotNull(), F.size(v))
        return size == n if how == "eq" else _ORDER[how](size, F.lit(n))
    if op in ("exists", "is_null", "is_not_null"):
        missing = _equals(v, kind, None)
        return missing if op == "is_null" or op == "exists" and not c else ~missing
    return _has_type(v, kind, c)


def _has(v: Column, element: T.DataType, y: Any) -> Column:
    return F.coalesce(F.exists(v, lambda x: _equals(x, element, y)), F.lit(False))


def _has_type(v: Column, kind: T.DataType, name: str) -> Column:
    """string, int, float, bool, list, dict or null; a bool is an int as well."""
    if name == "null":
        return _equals(v, kind, None)
    if isinstance(kind, T.VariantType):
        tests = {"string": "^STRING$", "int": "^(BIGINT|INT|SMALLINT|TINYINT|BOOLEAN)$", "float": "^(DOUBLE|FLOAT|DECIMAL.*)$", "bool": "^BOOLEAN$", "list": "^ARRAY", "dict": "^OBJECT"}
        return F.schema_of_variant(v).rlike(tests[name]) if name in tests else F.lit(False)
    kinds = {"string": T.StringType, "int": (T.IntegralType, T.BooleanType), "float": T.FractionalType, "bool": T.BooleanType, "list": T.ArrayType, "dict": (T.StructType, T.MapType)}
    return v.isNotNull() if name in kinds and isinstance(kind, kinds[name]) else F.lit(False)


def from_dict(spec: dict) -> Filter:
    """A filter from to_dict's form."""
    kind = spec.get("type")
    if kind == "field":
        return Field(spec["field"], spec["operator"], spec.get("value"))
    if kind in ("and", "or"):
        return (And if kind == "and" else Or)([from_dict(f) for f in spec["filters"]])
    if kind == "not":
        return Not(from_dict(spec["filter"]))
    raise QuerySyntaxError(f"no filter type {kind!r}")


def parse_filter(spec: Any) -> Filter | None:
    """A filter from what users write: {"price": {"$gte": 5, "$lt": 9}, "$or": [...]}; conditions are ANDed.

    A Filter is returned as it is; None and {} mean no filter; a list is an AND. Unknown operators raise.
    """
    if spec is None or isinstance(spec, Filter):
        return spec
    if isinstance(spec, (list, tuple)):
        parts = [f for f in map(parse_filter, spec) if f is not None]
        return And(parts) if parts else None
    if not isinstance(spec, dict):
        raise QuerySyntaxError(f"not a filter: {spec!r}")
    if spec.get("type") in ("field", "and", "or", "not") and ({"field", "operator"} <= spec.keys() or spec.keys() == {"type", "filters"} or spec.keys() == {"type", "filter"}):
        return from_dict(spec)
    parts: list[Filter] = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [f for f in map(parse_filter, value) if f is not None]
            parts.append(And(inner) if key == "$and" else Or(inner))
        elif key == "$not":
            inner = parse_filter(value)
            parts.append(Not(inner if inner is not None else And([])))
        elif key.startswith("$"):
            raise QuerySyntaxError(f"no operator {key!r}")
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            parts.extend(Not(parse_filter({key: v})) if op == "$not" else Field(key, op, v) for op, v in value.items())
        else:
            parts.append(Field(key, "eq", value))
    return (parts[0] if len(parts) == 1 else And(parts)) if parts else None


def where(df: DataFrame, spec: Any) -> DataFrame:
    """The rows that a filter (in any form, or None) lets through; comparisons stand bare, so Spark pushes them down."""
    f = parse_filter(spec)
    return df if f is None else df.filter(f.predicate(df.schema))


class FilterBuilder:
    """Filters by method chains: FilterBuilder().field("price").gte(5).lt(9).or_().field("free").eq(True).build().

    Conditions on one field and between fields are ANDed; or_() begins another alternative.
    """

    def __init__(self) -> None:
        self._groups: list[list[Filter]] = [[]]

    def field(self, name: str) -> FieldBuilder:
        return FieldBuilder(self, name)

    def where(self, spec: Any) -> FilterBuilder:
        if (f := parse_filter(spec)) is not None:
            self._groups[-1].append(f)
        return self

    def not_(self, spec: Any) -> FilterBuilder:
        return self.where(Not(parse_filter(spec)))

    def or_(self) -> FilterBuilder:
        self._groups.append([])
        return self

    def build(self) -> Filter | None:
        groups = [g[0] if len(g) == 1 else And(g) for g in self._groups if g]
        return None if not groups else groups[0] if len(groups) == 1 else Or(groups)


class FieldBuilder:
    """Conditions on a field of a FilterBuilder; every operator is a method."""

    def __init__(self, parent: FilterBuilder, name: str):
        self._parent, self._name = parent, name

    def __getattr__(self, op: str) -> Any:
        name = {"in_": "in", "not_in": "nin", "not_equals": "ne"}.get(op, op)
        name = _SHORT.get(name, name)
        if name in OPERATORS:
            return lambda *value: self._add(name, list(value) if name == "between" and len(value) == 2 else value[0] if value else True)
        return getattr(self._parent, op)

    def _add(self, op: str, value: Any) -> FieldBuilder:
        self._parent.where(Field(self._name, op, value))
        return self


def indexed_fields(schema: T.StructType, skip: Iterable[str] = ()) -> list[str]:
    """The paths that filters can name."""
    out: list[str] = []

    def walk(kind: T.StructType, prefix: str) -> None:
        for f in kind.fields:
            if prefix or f.name not in skip:
                out.append(prefix + f.name)
                if isinstance(f.dataType, T.StructType):
                    walk(f.dataType, f"{prefix}{f.name}.")

    walk(schema, "")
    return out
