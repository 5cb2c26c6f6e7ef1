"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order and form a stream of words, cut into blocks of equal length. Slots of
the mix are points of the golden-ratio sequence mapped through the cumulative targets, so any stretch of the mix holds
the sources in their shares; the r-th slot of a source takes its r-th block, from the start again after the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, WORD, checkpoint, n_words, null_safe

#: Production parameters: weights of the sources in the order of their names, and how often a source may be repeated.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block, and so of a slot.
BLOCK = 256
#: Rows of a running total's bucket, and cells that the unit interval is cut into to look points up.
BUCKET, CELLS = 4096, 4096
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, __source, size) per source to the same plus ``target``: shares of the total by weight, at most repeats * size.

    The excess of full sources is shared by weight among the rest until none is above. In order of size over weight the
    full sources come first, so one pass over the per-source table settles it. Only that table is in one partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    w = sizes.select("*", weight.alias("__w")).select("*", (F.lit(repeats) * F.col("size")).alias("__cap"))
    order = Window.orderBy((F.col("size") / F.col("__w")).asc(), F.col("__source").asc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("size").over(Window.partitionBy())
    w = w.select("*", (total - F.coalesce(F.sum("__cap").over(before), F.lit(0))).alias("__rest"), F.sum("__w").over(after).alias("__weights"))
    w = w.select("*", (F.col("__cap") * F.col("__weights") < F.col("__w") * F.col("__rest")).alias("__full"))
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("size") / F.col("__w"), "__source", "__rest", "__weights"))).over(Window.partitionBy())
    share = (F.col("__w") * level["__rest"]).cast("double") / level["__weights"].cast("double")
    return w.select("source", "__source", "size", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(share).alias("target"))


def _running(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """rows with ``__before``: the total of ``value`` over the rows of the same __source before each.

    Rows have a ``__bucket`` that follows the order and is of bounded size: totals of buckets are summed first, so no
    task holds a source.
    """
    sums = rows.groupBy("__source", "__bucket").agg(F.sum(value).alias("__sum"))
    # buckets of buckets bound the window over a source's buckets as well
    sums = checkpoint(sums).withColumn("__top", F.floor(F.col("__bucket") / BUCKET))
    tops = sums.groupBy("__source", "__top").agg(F.sum("__sum").alias("__t"))
    tops = tops.select("__source", "__top", (F.sum("__t").over(Window.partitionBy("__source").orderBy("__top")) - F.col("__t")).alias("__t"))
    ahead = F.sum("__sum").over(Window.partitionBy("__source", "__top").orderBy("__bucket")) - F.col("__sum")
    sums = sums.withColumn("__b", ahead).join(tops, ["__source", "__top"]).select("__source", "__bucket", (F.col("__b") + F.col("__t")).alias("__b"))
    w = Window.partitionBy("__source", "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(sums, ["__source", "__bucket"]).withColumn("__before", F.sum(value).over(w) - F.col(value) + F.col("__b")).drop("__b")


def sized(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """docs with __size (words), __source (never null) and __key, by whose order a source is shuffled; columns named so are replaced."""
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    return docs.select(*[c for c in docs.columns if c not in ("__size", "__source", "__key")], n_words(F.col(text)).alias("__size"), null_safe(F.col(source)).alias("__source"), mark.alias("__key"))


class Mix:
    """A mix of sized rows. ``light``: rows hold no texts, so they are kept in a checkpoint instead of computed again.

    Null texts have no words and are not taken; null sources form one source, the last; repeated rows count each, and
    which of several equal rows a block takes doesn't matter; an empty table gives an empty mix. Reruns agree: the
    order is by hashes of ids and texts.
    """

    def __init__(self, rows: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, light: bool = False, block: int = BLOCK):
        spark = rows.sparkSession
        narrow = checkpoint(rows if light else rows.select(F.col(source), "__source", "__size", "__key"))
        sums = narrow.groupBy("__source").agg(F.first(source).alias("source"), F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n"))
        sums = checkpoint(sums)
        n = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.block = block
        self.sources = checkpoint(targets(sums.drop("n"), weights, repeats))
        buckets = -(-n // BUCKET)
        bucket = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / 2**32 * buckets)
        placed = _running((narrow if light else rows).withColumn("__bucket", bucket), [F.col("__key")], "__size")
        #: Rows with __start, their first word's place in the source's stream.
        self.placed = placed.drop("__bucket").withColumnRenamed("__before", "__start")
        size, blocks, words = F.col("size"), F.ceil(F.col("size") / self.block), F.round("target").cast("long")
        passes = F.when(size > 0, F.floor(words / size)).otherwise(0)
        rest = words - passes * size
        plan = self.sources.select("*", blocks.alias("__blocks"), passes.alias("__passes"), rest.alias("__over"), (passes * blocks + F.ceil(rest / self.block)).alias("__slots"))
        self.plan = checkpoint(plan)
        self.spark = spark

    def slots(self) -> DataFrame:
        """The schedule: ``slot, __source, rank, pass, block``."""
        count = self.plan.agg(F.coalesce(F.sum("__slots"), F.lit(0))).first()[0]
        upto = F.sum("target").over(Window.orderBy("__source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        everything = F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-9))
        spans = self.plan.select("__source", ((upto - F.col("target")) / everything).alias("__lo"), (upto / everything).alias("__hi"))
        spans = checkpoint(spans).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * CELLS), F.least(F.floor(F.col("__hi") * CELLS), F.lit(CELLS - 1)))))
        points = self.spark.range(count).withColumn("__u", (F.col("id") + 0.5) * GOLDEN % 1.0).withColumn("__cell", F.floor(F.col("__u") * CELLS))
        drawn = points.join(spans, "__cell").filter("__lo <= __u and __u < __hi").select(F.col("id").alias("slot"), "__source", F.floor(F.col("id") / BUCKET).alias("__bucket"), F.lit(1).cast("long").alias("__one"))
        ranked = _running(drawn, [F.col("slot")], "__one").select("slot", "__source", F.col("__before").alias("rank"))
        ranked = ranked.join(self.plan.select("__source", "__slots", "__blocks"), "__source").filter("rank < __slots")
        # sources whose points were a few too few get their last slots at the end
        have = ranked.groupBy("__source").agg(F.count(F.lit(1)).alias("n"))
        late = self.plan.join(have, "__source", "left").select("__source", "__slots", "__blocks", F.coalesce("n", F.lit(0)).alias("n")).filter("n < __slots")
        late = late.select("__source", F.explode(F.sequence("n", F.col("__slots") - 1)).alias("rank"), "__slots", "__blocks").withColumn("slot", F.lit(count) + F.col("rank"))
        both = ranked.select("slot", "__source", "rank", "__blocks").unionByName(late.select("slot", "__source", "rank", "__blocks"))
        return both.select("slot", "__source", "rank", F.floor(F.col("rank") / F.col("__blocks")).alias("pass"), (F.col("rank") % F.col("__blocks")).alias("block"))

    def taken(self) -> DataFrame:
        """The mix: ``slot, rank, pass, block, __source, __start, from, words`` — words of the row at __start, from its word ``from`` (0: the first)."""
        rows = self.placed.filter("__size > 0").select("__source", "__start", "__size")
        last = F.floor((F.col("__start") + F.col("__size") - 1) / self.block)
        rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("__start") / self.block), last)))
        lo = F.greatest(F.col("__start"), F.col("block") * self.block)
        hi = F.least(F.col("__start") + F.col("__size"), (F.col("block") + 1) * self.block)
        rows = rows.select("__source", "block", "__start", lo.alias("__lo"), hi.alias("__hi"))
        rows = rows.join(self.slots(), ["__source", "block"]).join(self.plan.select("__source", "__passes", "__over"), "__source")
        hi = F.when(F.col("pass") == F.col("__passes"), F.least("__hi", "__over")).otherwise(F.col("__hi"))
        return rows.select("slot", "rank", "pass", "block", "__source", "__start", (F.col("__lo") - F.col("__start")).alias("from"), (hi - F.col("__lo")).alias("words")).filter("words > 0")


def mixed(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents of the mix, with docs' columns: each text once for each pass that takes all of it or a part.

    Of a part only the taken words stay, with the white space between them.
    """
    columns = docs.columns
    # all but the text in a struct, so that no column clashes with those that are added
    held = docs.select(F.struct(*[c for c in columns if c != text]).alias("__doc"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(key).alias("doc_id"))
    m = Mix(sized(held))
    parts = m.taken().groupBy("__source", "__start", "pass").agg(F.min("from").alias("__from"), F.sum("words").alias("__words"))
    rows = m.placed.filter("__size > 0").join(parts, ["__source", "__start"])
    pieces = F.regexp_extract_all("text", F.lit(f"({SPACE}*{WORD})"), 1)
    part = F.array_join(F.slice(pieces, F.col("__from").cast("int") + 1, F.col("__words").cast("int")), "")
    taken = F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(part)
    return rows.select(*[taken.alias(c) if c == text else F.col("__doc")[c].alias(c) for c in columns])
