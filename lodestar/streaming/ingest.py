"""Streams of vectors into collections, and rates of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hands each micro-batch to ``write``; without an interval it takes what there is and stops.

    write may see a batch again after a failure, with the same number: it should be idempotent, as writing to a folder
    named by the number is.
    """
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Appends versions of vectors to a log: a folder for each batch, overwritten if the batch comes again.

    Read it with operators.dml.latest over (batch, seq).
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return append_batches(stream, write, checkpoint, seconds)


def request_rates(stream: DataFrame, at: str = "ts", client: str = "client", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests of each client in tumbling windows; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), client).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), client, "n")


def over_limit(rates: DataFrame, limit: int) -> DataFrame:
    return rates.filter(F.col("n") > limit)
