"""Text chunks for retrieval."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.errors import ValidationError


def chunk_fixed(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """A row for each window of ``size`` characters, every size - overlap: ``chunk_no, start, end, chunk``, trimmed.

    Null and empty texts have no chunk; windows of blanks alone are left out.
    """
    if not 0 <= overlap < size:
        raise ValidationError("overlap must be from 0 to less than size")
    t = F.col(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap)))
    # chunks are cut within the array, so rows carry the whole text only if it is asked for afterwards
    chunks = F.transform(starts, lambda x: F.struct(x.alias("start"), F.least(x + size, F.length(t)).alias("end"), F.trim(F.substring(t, x + 1, F.lit(size))).alias("chunk")))
    rows = df.select("*", F.posexplode(chunks).alias("chunk_no", "__chunk"))
    return rows.select(*df.columns, "chunk_no", "__chunk.start", "__chunk.end", "__chunk.chunk").filter("chunk <> ''")


def _packed(parts: Column, size: int, overlap: int, glue: int) -> Column:
    """Greedy runs of parts: array of (first, last) places.

    A run ends before a part that would take it beyond ``size`` characters, with ``glue`` between parts; the next begins
    with the last parts of the run that have ``overlap`` characters at most. Each run depends on the one before, so this
    is a walk over lengths, in Arrow batches; texts stay in the JVM.
    """

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def walk(lengths: pd.Series) -> pd.Series:
        def runs(ns: list[int]) -> list[dict[str, int]]:
            out, begin, n = [], 0, 0
            for i, x in enumerate(ns):
                if i > begin and n + glue + x > size:
                    out.append({"first": begin, "last": i - 1})
                    back, held = i, 0
                    while back > begin and held + ns[back - 1] <= overlap:
                        back -= 1
                        held += ns[back]
                    begin, n = back, held + glue * max(0, i - back - 1)
                n += x + glue * (i > begin)
            return out + [{"first": begin, "last": len(ns) - 1}] * bool(ns)

        return lengths.map(lambda ns: runs([int(x) for x in ns]))

    # as it counts as nondeterministic, the optimizer neither repeats it nor moves it into a generator
    return walk.asNondeterministic()(F.transform(parts, lambda p: F.length(p)))


def _rows(df: DataFrame, parts: Column, size: int, overlap: int, glue: int) -> DataFrame:
    rows = df.withColumn("__parts", parts).withColumn("__runs", _packed(F.col("__parts"), size, overlap, glue))
    chunks = F.transform("__runs", lambda r: F.array_join(F.slice("__parts", r["first"] + 1, r["last"] - r["first"] + 1), " "))
    return rows.withColumn("__chunks", chunks).select(*df.columns, F.posexplode("__chunks").alias("chunk_no", "chunk"))


def chunk_sentences(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Whole sentences packed up to ``size`` characters, blanks between them not counted: ``chunk_no, chunk``.

    A chunk begins with the last sentences of the one before that have ``overlap`` characters at most. A sentence longer
    than ``size`` is a chunk by itself. Null and empty texts have no chunk.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return _rows(df, parts, size, overlap, 0)


def chunk_recursive(df: DataFrame, text: str = "text", size: int = 500, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """Parts that are still too long are split at the next separator of the list, then packed up to ``size``."""
    parts = F.array(F.coalesce(F.col(text), F.lit("")))
    for s in separators:
        parts = F.flatten(F.transform(parts, _splitter(r"\Q" + s + r"\E", size)))
    last = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.length(p), F.lit(size)), lambda i: F.substring(p, i, F.lit(size))))))
    return _rows(df, F.filter(F.transform(last, lambda p: F.trim(p)), lambda p: p != ""), size, 0, 1)


def _splitter(cut: str, size: int):
    return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.split(p, cut))


def context(df: DataFrame, by: str, order: str, text: str, length: int = 200) -> DataFrame:
    """Per group one text of its numbered excerpts in order, each cut to ``length`` with three dots."""
    cut = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(F.col(text))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), cut.alias("t"))))
    return df.groupBy(by).agg(F.array_join(F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["t"])), "\n").alias("context"))
