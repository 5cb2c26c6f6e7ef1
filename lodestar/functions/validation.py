"""Checks of arguments on the driver, and of ids in frames."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.errors import DimensionMismatchError, ValidationError

#: What ids look like, and the limits of metadata.
ID_PATTERN = r"^[a-zA-Z0-9_\-\.]+$"
MAX_ID, MAX_KEYS, MAX_KEY, MAX_STRING, MAX_DIMENSION, MAX_K = 256, 100, 64, 65536, 65536, 10000
RESERVED = ("_id", "_vector", "_score", "_distance", "_timestamp")


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID_PATTERN) & (F.length(c) <= MAX_ID), F.lit(False))


def check_id(value: Any) -> str:
    if not isinstance(value, str) or not 0 < len(value) <= MAX_ID or not re.match(ID_PATTERN, value):
        raise ValidationError(f"not an id: {value!r}")
    return value


def check_k(k: int, most: int = MAX_K) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= most:
        raise ValidationError(f"k must be a whole number from 1 to {most}")
    return k


def check_dimension(d: int) -> int:
    if isinstance(d, bool) or not isinstance(d, int) or not 1 <= d <= MAX_DIMENSION:
        raise ValidationError(f"a dimension is a whole number from 1 to {MAX_DIMENSION}")
    return d


def check_vector(v: Any, dimension: int | None = None) -> list[float]:
    """A flat, finite, non-empty list of floats of the dimension."""
    try:
        out = [float(x) for x in v]
    except (TypeError, ValueError) as e:
        raise ValidationError("a vector is a flat list of numbers") from e
    if not out or not all(map(math.isfinite, out)):
        raise ValidationError("a vector has finite components, at least one")
    if dimension and len(out) != dimension:
        raise DimensionMismatchError(f"expected {dimension} components, got {len(out)}")
    return out


def check_metadata(m: Any) -> dict:
    """A dict of str to str, int, float, bool, None, lists and dicts of these, within the limits."""
    if m is None:
        return {}
    if not isinstance(m, dict) or len(m) > MAX_KEYS:
        raise ValidationError(f"metadata is a dict of at most {MAX_KEYS} keys")

    def check(x: Any) -> None:
        if isinstance(x, str):
            if len(x) > MAX_STRING:
                raise ValidationError(f"a string has at most {MAX_STRING} characters")
        elif isinstance(x, dict):
            for k, y in x.items():
                if not isinstance(k, str):
                    raise ValidationError("keys are strings")
                check(y)
        elif isinstance(x, list):
            for y in x:
                check(y)
        elif x is not None and not isinstance(x, (bool, int, float)):
            raise ValidationError(f"{type(x).__name__} isn't a kind of metadata")

    for k, v in m.items():
        if not isinstance(k, str) or not k or len(k) > MAX_KEY or k in RESERVED:
            raise ValidationError(f"not a metadata key: {k!r}")
        check(v)
    return m
