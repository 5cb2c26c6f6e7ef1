"""Line dedup by site-relative frequency: lines that stand on too large a share of a site's pages go.

A page is set beside the other pages of its site: a line is boilerplate if more than RATIO of these have it too. So a
line that stands on one page alone is never boilerplate, in however small a site, and large sites see no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, checkpoint, null_safe, small_or_not

#: Production parameter: a line goes if more than this share of its site's other pages has it.
RATIO = 0.1
#: What stands in HTML and is no text, the tags at which a line ends, other tags, and white space.
HIDDEN = r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul"
TAG = r"<[!/?A-Za-z][^>]*>"
BLANKS = " \t\r\f\x0b"


def html_lines(html: Column) -> Column:
    """The text of a page, a line for each block of it without white space at its ends; null for null."""
    cut = f"(?is){HIDDEN}|</?(?:{BLOCKS.replace(' ', '|')})\\b[^>]*>"
    blocks = F.transform(F.split(html, cut), lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, TAG, "")).otherwise(x))
    lines = F.flatten(F.transform(blocks, lambda x: F.split(x, "\n")))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), "\n")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _mark(line: Column) -> Column:
    """128 bits of two independent hashes stand for a line in shuffles."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float = RATIO) -> DataFrame:
    """Per site the marks of its boilerplate lines: ``__site, __marks, n_pages``.

    A site has at most (mean distinct lines of a page) / ratio of them, whatever its size, so an array holds them.
    Lines are counted once a page, as hashes, and summed before they are shuffled, so a hot site or line is no
    burden to one task.
    """
    rows = pages.select(null_safe(site).alias("__site"), text.alias("__text"))
    totals = rows.groupBy("__site").agg(F.count(F.lit(1)).alias("__total"))
    lines = rows.select("__site", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("__text")), lambda x: x.rlike(f"(?!{SPACE})[\\s\\S]")), _mark))).alias("__mark"))
    counts = lines.groupBy("__site", "__mark").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    totals = checkpoint(totals)
    totals = small_or_not(totals, F.length("__site") + 24)
    return (
        counts.join(totals, "__site")
        .filter(F.col("__n") - 1 > F.lit(ratio) * (F.col("__total") - 1))
        .groupBy("__site")
        .agg(F.sort_array(F.collect_set("__mark")).alias("__marks"))
    )


def remove_boilerplate(pages: DataFrame, site: str, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """pages with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines are split at \\n and compared as they stand; a line of n of a site's N pages goes from all of them if
    n - 1 > ratio * (N - 1). Lines of white space alone are never dropped.
    Null sites form one site. Null or empty texts are one empty line and stay as they are; repeated rows each count
    as a page; an empty table stays empty. Other columns pass through; input columns named n_lines, n_dropped are
    replaced.
    """
    found = checkpoint(boilerplate(pages, F.col(site), F.col(text), ratio))
    found = small_or_not(found, F.length("__site") + 16 * F.size("__marks") + 32)
    keep = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    joined = pages.select(*keep, null_safe(F.col(site)).alias("__site")).join(found, "__site", "left")
    lines = _lines(F.col(text))
    kept = F.when(F.col("__marks").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__marks"), _mark(x))))
    joined = joined.withColumn("__kept", kept)
    return joined.select(
        *[c for c in keep if c != text],
        F.when(F.col("__marks").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")).alias(text),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("__kept")).cast("long").alias("n_dropped"),
    )
