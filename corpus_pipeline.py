"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens. Part of the subpackage lodestar.llm.

Every stage takes a table with the columns of documents, and others, and works on all of its rows. Null, empty and very
long texts, nulls in any column, ties, repeated rows and empty tables are treated as each stage says; a column of any
name passes through, as stages hold the columns they don't read in a struct. The last stage returns token ids.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, line_dedup, minhash, mixing, quality

#: Similarity in percent from which the near-dedup stage takes documents for copies; op10's own contract is 85.
NEAR_PERCENT = 80


def _held(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs, beside a struct of all but the text, so that none can clash with a stage's own."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__doc"), *names)


def _released(df: DataFrame, columns: list[str], measured: bool = False) -> DataFrame:
    """The columns again, with the text as it is now and, if ``measured``, n_chars set to its length."""

    def one(c: str) -> Column:
        if measured and c == "n_chars":
            return F.length("text").cast("long").alias(c)
        return F.col("text") if c == "text" else F.col("__doc")[c].alias(c)

    return df.select(*[one(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or are outliers of their language and source go.

    Null and empty texts have no words and fail; null languages and sources are groups of their own; repeated rows each
    count and are judged alike.
    """
    return _released(quality.assess(_held(docs, "text", "lang", "source")).filter("kept"), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many of a source's other documents go; documents stay, whatever is left of them.

    Null texts stay null; null sources are one source; repeated rows are documents of their own.
    """
    return _released(line_dedup.remove_boilerplate(_held(docs, "text", "source"), "source"), docs.columns, measured=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays, once if rows are repeated.

    Rows without an id all stay, and documents without words are copies of none; a document that shares its id with a
    copy stays.
    """
    return _released(minhash.without_copies(_held(docs, "doc_id", "text"), percent=NEAR_PERCENT), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each pass over a source; where the mix takes a part, the part.

    Texts without words are not taken; null sources are one source; repeated rows are taken each.
    """
    return _released(mixing.mixed(_held(docs, "doc_id", "text", "source")), docs.columns, measured=True)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with hashes of the ids and of the bytes they decode to; none for null and empty texts."""
    keep = tuple(c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level bpe", byte_bpe),
]

#: SQL can't express the byte-pair merges of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written as Parquet in the shared folder and read again."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="pipeline-")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(before)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        before = path
    return docs
