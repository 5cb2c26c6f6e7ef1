"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and the words between it, as the contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in spark.checkpoint.dir, which all executors share.

    The folder is set here only where the session has none, as in local tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def small_or_not(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its sum of ``size`` (bytes of a row) is within BROADCAST_BYTES.

    Beyond that bound Spark joins by a shuffle, whose hot partitions adaptive execution splits.
    df must be cheap to read twice: a checkpoint.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda x: x != "")


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe(col: Column) -> Column:
    """A string that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))
