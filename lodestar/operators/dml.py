"""Changes to keyed frames. Frames don't change in place: each operator returns the new state."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, id: str = "id", version: Sequence[str] = ("seq",)) -> DataFrame:
    """The last version of each id in a log of versions."""
    if len(version) == 1 and len(log.columns) <= 3:
        rest = [c for c in log.columns if c != id]
        best = log.groupBy(id).agg(F.max_by(F.struct(*rest), F.col(version[0])).alias("__v"))
        return best.select(*[F.col(id) if c == id else F.col(f"__v.{c}") for c in log.columns])
    w = Window.partitionBy(id).orderBy(*[F.col(c).desc() for c in version])
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(state: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """Rows of changes replace rows of the same id; ids of changes are unique (see latest)."""
    return state.join(changes.select(id), id, "left_anti").select(*state.columns).unionByName(changes.select(*state.columns))


def insert(state: DataFrame, new: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(state with the new rows whose ids are free, the new rows whose ids are taken)."""
    free = new.join(state.select(id), id, "left_anti").select(*state.columns)
    return state.unionByName(free), new.join(state.select(id), id, "left_semi").select(*new.columns)


def delete(state: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """The rows whose id isn't among ids (a frame with that column)."""
    return state.join(ids.select(id).distinct(), id, "left_anti").select(*state.columns)


def delete_counts(state: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``deleted, not_found`` for a delete."""
    marked = ids.select(id).distinct().join(state.select(id, F.lit(1).alias("__there")), id, "left")
    return marked.agg(F.count("__there").alias("deleted"), F.count_if(F.col("__there").isNull()).alias("not_found"))


def get_many(state: DataFrame, ids: Sequence[Any], id: str = "id") -> DataFrame:
    """A row for each wanted id in order of ``pos``, with nulls for those that aren't there."""
    wanted = state.sparkSession.range(1).select(F.posexplode(F.lit(list(ids))).alias("pos", "__id"))
    found = wanted.join(state.withColumnRenamed(id, "__own"), F.col("__id") == F.col("__own"), "left")
    return found.select("pos", F.col("__id").alias(id), F.col("__own").isNotNull().alias("found"), *[c for c in state.columns if c != id]).orderBy("pos")


def patch(state: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """Columns of changes that aren't null replace those of rows of the same id; other ids are ignored."""
    columns = [c for c in changes.columns if c != id and c in state.columns]
    renamed = changes.select(id, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = state.join(renamed, id, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in state.columns])


def merge_maps(old: Column, new: Column) -> Column:
    """A shallow merge of maps in which new entries win; nulls count as empty."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def page(state: DataFrame, order: Sequence[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows from ``offset`` on, at most ``limit`` (None and 0: all), in order."""
    out = state.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def sample(state: DataFrame, n: int, seed: int | None = None, id: str = "id") -> DataFrame:
    """n rows without replacement; with a seed the same ones each time, as the order is by hashes of ids."""
    order = F.xxhash64(F.col(id), F.lit(seed)) if seed is not None else F.rand()
    return state.orderBy(order, F.col(id)).limit(n)
