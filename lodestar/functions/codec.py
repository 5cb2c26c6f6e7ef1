"""Vectors as self-describing blobs, and checksums, for exchange with programs that don't read parquet."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.errors import StorageError

_KINDS = {"f4": 0, "f8": 1, "f2": 2}
#: dimension, kind, flags (1: compressed).
_HEAD = struct.Struct("<IBB")


def encode(v: np.ndarray, kind: str = "f4", compress: bool = False) -> bytes:
    raw = np.asarray(v, dtype=f"<{kind}").tobytes()
    return _HEAD.pack(len(v), _KINDS[kind], int(compress)) + (zlib.compress(raw, 1) if compress else raw)


def decode(blob: bytes) -> np.ndarray:
    """The vector of a blob; StorageError if it is damaged."""
    try:
        n, kind, flags = _HEAD.unpack_from(blob)
        raw = blob[_HEAD.size :]
        v = np.frombuffer(zlib.decompress(raw) if flags & 1 else raw, f"<{[*_KINDS][kind]}")
    except (struct.error, zlib.error, IndexError, ValueError) as e:
        raise StorageError("not a vector blob") from e
    if len(v) != n:
        raise StorageError("a vector blob of the wrong length")
    return v


def to_blob(v: Column, kind: str = "f4", compress: bool = False) -> Column:
    @F.pandas_udf("binary")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else encode(x, kind, compress))

    return udf(v)


def from_blob(b: Column) -> Column:
    @F.pandas_udf("array<double>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(x).astype(float))

    return udf(b)


def checksum(b: Column) -> Column:
    """64 bits of a binary or string column."""
    return F.xxhash64(b)
