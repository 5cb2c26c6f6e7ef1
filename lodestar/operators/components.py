"""Connected components of a link table by rounds of label propagation and shortcuts; nothing is collected."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a folder of its own only where the session has none, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, in either direction, to ``v, root``: every linked vertex and the least one it reaches, itself included.

    Each round every vertex takes the least label of its neighbours, and then the label of that vertex, so the rounds are
    about the logarithm of the longest path. Joins are by shuffle, as a round's broadcasts would all be built in the
    driver. Loops and links with a null say nothing.
    """
    links = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "v").hint("merge"), "v").select("v", F.least("root", "near").alias("to"), F.col("root").alias("old"))
        new = new.join(labels.select(F.col("v").alias("to"), F.col("root").alias("further")).hint("merge"), "to").select("v", F.least("to", "further").alias("root"), "old")
        new = cut(new)
        if new.filter("root <> old").isEmpty():
            return new.select("v", "root")
        labels = new.select("v", "root")
