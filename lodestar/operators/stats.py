"""Statistics of collections and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collection_stats(df: DataFrame, id: str = "id", vector: str = "vector", metadata: Column | None = None) -> DataFrame:
    """``count, dimension, memory_bytes``: four bytes a component, and the lengths of ids and of metadata as JSON."""
    meta = F.coalesce(F.length(metadata), F.lit(0)) if metadata is not None else F.lit(0)
    size = F.size(vector) * 4 + F.length(F.col(id).cast("string")) + meta
    return df.agg(F.count(F.lit(1)).alias("count"), F.max(F.size(vector)).alias("dimension"), F.coalesce(F.sum(size), F.lit(0)).alias("memory_bytes"))


def cluster_sizes(df: DataFrame, n_clusters: int, cluster: str = "cluster_id") -> DataFrame:
    """``cluster_id, n`` of every cluster, empty ones too."""
    all_ids = df.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias(cluster))
    counts = df.groupBy(F.col(cluster).cast("int").alias(cluster)).agg(F.count(F.lit(1)).alias("n"))
    return all_ids.join(counts, cluster, "left").select(cluster, F.coalesce("n", F.lit(0)).alias("n"))


def cluster_stats(df: DataFrame, n_clusters: int, cluster: str = "cluster_id") -> DataFrame:
    """Least, largest, mean, median and population deviation of the sizes, empty clusters, and the imbalance."""
    s = cluster_sizes(df, n_clusters, cluster)
    return s.agg(
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.median("n").alias("median_size"), F.stddev_pop("n").alias("std_size"),
        F.count_if(F.col("n") == 0).alias("empty"), (F.max("n") / (F.avg("n") + 1e-8)).alias("imbalance"),
    )


def degree_stats(edges: DataFrame, level: str = "level", source: str = "src") -> DataFrame:
    """Per level of a neighbour graph its nodes, edges, and least, largest and mean degree."""
    degrees = edges.groupBy(level, source).agg(F.count(F.lit(1)).alias("degree"))
    return degrees.groupBy(level).agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
