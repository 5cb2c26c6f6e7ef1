"""Databases on disk: a parquet folder for each version of a collection, and a manifest that names the current ones.

Everything goes through Spark's writers and readers, so a path may be in any store that Spark can reach. A save writes
new folders and then the manifest; readers of the old manifest aren't disturbed.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.errors import StorageError

VERSION = 1


def to_stored(df: DataFrame) -> DataFrame:
    """VARIANT columns as JSON, which every parquet reader knows."""
    return df.select(*[F.to_json(c).alias(c) if kind == "variant" else F.col(c) for c, kind in df.dtypes])


def from_stored(df: DataFrame, variants: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("{}"))).alias(c) if c in variants else F.col(c) for c in df.columns])


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(f"{path}/manifest").collect()
        return json.loads(rows[0][0])
    except (AnalysisException, IndexError, ValueError) as e:
        raise StorageError(f"no database at {path}") from e


def save(spark: SparkSession, path: str, collections: dict[str, tuple[DataFrame, dict]], created: float | None = None) -> dict:
    """Writes each collection's frame and config, then the manifest, which is returned."""
    entries = {}
    for name, (df, config) in collections.items():
        folder = f"{name}/{uuid.uuid4().hex}"
        to_stored(df).write.parquet(f"{path}/{folder}")
        entries[name] = {"folder": folder, "config": config, "variants": [c for c, kind in df.dtypes if kind == "variant"]}
    manifest = {"version": VERSION, "created_at": created or time.time(), "saved_at": time.time(), "collections": entries}
    write_manifest(spark, path, manifest)
    return manifest


def load(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, dict]]:
    """The collections that the manifest names; StorageError if there is none."""
    entries = read_manifest(spark, path)["collections"]
    return {name: (from_stored(spark.read.parquet(f"{path}/{e['folder']}"), e["variants"]), e["config"]) for name, e in entries.items()}


def compact(spark: SparkSession, path: str, files: int = 1) -> dict:
    """Rewrites every collection in few files."""
    return save(spark, path, {name: (df.coalesce(files), config) for name, (df, config) in load(spark, path).items()})


def checksum(df: DataFrame) -> Any:
    """A number that any changed, lost or added row changes; the order of rows doesn't matter."""
    return to_stored(df).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*to_stored(df).columns))).first()
