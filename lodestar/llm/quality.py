"""Quality rules: word and line statistics of each text, and robust multivariate outliers per language and source.

A minimum covariance determinant is fitted to each group by concentration steps from two starts, medians with median
deviations and the plain mean with the covariance: the mean and covariance of the closest rows are taken again and again
until no determinant falls any more, the start of the least determinant is chosen, and rows far from its fit by
Mahalanobis distance are rejected. Everything is sums, counts and histograms per group, so no task holds a group. Groups
too small for an estimate are judged by the one of their language, or else of all rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_BYTES, SPACE, checkpoint, let, null_safe, small_or_not, words

WINDOW = 5
#: Production parameters: share of a group the estimate rests on, the squared distance from which a row is an outlier,
#: and the rows that a group needs for an estimate of its own. Statistics of text have heavier tails than a normal
#: distribution, hence the wide cut.
SUPPORT, CUT, MIN_GROUP = 0.75, 60.0, 30
#: A determinant falls if its logarithm falls by this much.
LESS = 1e-3
#: Statistics are whole multiples of 1/SCALE, so that their sums are exact and don't depend on the order of rows.
SCALE = 1024
#: Least standard deviation of each statistic, in its own units: log words, letters a word, log symbols a word, share of
#: repeated lines, share of repeated words.
FLOORS = (0.5, 0.6, 0.15, 0.06, 0.05)
P = len(FLOORS)
X = [f"__x{i}" for i in range(P)]
#: Squared distances are counted in bins of a twentieth of a power of 2.
BINS = 20


def _covered(w: Column) -> Column:
    """Words in WINDOW-word windows that the text has twice or more. Windows are compared by 64-bit hashes."""
    n = F.size(w)

    def windows(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(g, i + k) for k in range(WINDOW)]))

    def places(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.array_sort(F.transform(F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        def total(d: Column) -> Column:
            return F.aggregate(F.transform(d, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(d, i - 1)))), F.lit(0), operator.add)

        return let(let(ordered, twice), total)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), count))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines and base_failed.

    Null texts have no words: all counts are 0 and base_failed is true. Other columns pass through, save input columns
    with these names, which are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"(?!{SPACE})[\\s\\S]"))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "base_failed"]
    kept = [c for c in docs.columns if c not in new]
    out = docs.select(
        *kept,
        let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _covered(w).cast("long").alias("r"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("c"))).alias("__w"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("__l"),
    )
    n, r = F.col("__w.n"), F.col("__w.r")
    return out.select(
        *kept, n.alias("n_words"), F.col("__w.c").alias("word_chars"), "n_symbols", F.col("__l.d").alias("n_dup_lines"), r.alias("n_repeat_words"), F.col("__l.n").alias("n_word_lines"),
        ((n < 10) | (100 * r > 20 * n)).alias("base_failed"),
    )


def _key(by: list[str]) -> Column:
    return F.concat_ws("\x01", F.lit(str(len(by))), *[null_safe(F.col(c)) for c in by])


def _vectors(df: DataFrame, by: list[str]) -> DataFrame:
    """df with the group's key and the transformed statistics, in whole 1/SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / n,
        F.log1p(10.0 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_word_lines"), F.lit(1)).cast("double"),
        F.col("n_repeat_words") / n,
    ]
    return df.select("*", _key(by).alias("__g"), *[F.round(x * SCALE).cast("double").alias(c) for x, c in zip(raw, X, strict=True)])


def _quantile(rows: DataFrame, bin_of: Column, share: float, name: str) -> DataFrame:
    """Per group the first bin at which at least ``share`` of the rows are counted."""
    from pyspark.sql import Window

    counts = rows.select("__g", bin_of.alias("__b")).groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__g").orderBy("__b")
    total = F.sum("__n").over(Window.partitionBy("__g"))
    return counts.select("__g", "__b", F.sum("__n").over(w).alias("__c"), total.alias("__t")).filter(F.col("__c") >= share * F.col("__t")).groupBy("__g").agg(F.min("__b").alias(name))


def _medians(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """Per group the median of each value (whole numbers), by counts of distinct values: one row for each."""
    from pyspark.sql import Window

    long = rows.select("__g", F.posexplode(F.array(*values)).alias("__i", "__v")).groupBy("__g", "__i", "__v").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__g", "__i")
    med = long.select("__g", "__i", "__v", F.sum("__n").over(w.orderBy("__v")).alias("__c"), F.sum("__n").over(w).alias("__t")).filter(2 * F.col("__c") >= F.col("__t")).groupBy("__g", "__i").agg(F.min("__v").alias("__v"))
    return med.groupBy("__g").agg(*[F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(n) for i, n in enumerate(names)])


def _fit(rows: DataFrame) -> DataFrame:
    """Per group the mean (__m*), the inverse (__a*_*) of the Cholesky factor of the covariance plus the floors' squares, and
    the logarithm of the factor's determinant (__det)."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = rows.groupBy("__g").agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        *[F.sum(X[i]).alias(f"__s{i}") for i in range(P)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"__s{i}_{j}") for i, j in pairs],
    )
    n = F.col("__n")
    cov = {(i, j): F.col(f"__s{i}_{j}") / n - F.col(f"__s{i}") / n * F.col(f"__s{j}") / n + (F.lit((FLOORS[i] * SCALE) ** 2) if i == j else 0) for i, j in pairs}
    out = sums.select("__g", *[(F.col(f"__s{i}") / n).alias(f"__m{i}") for i in range(P)], *[c.alias(f"__c{i}_{j}") for (i, j), c in cov.items()])
    for i in range(P):  # Cholesky's factor, row by row
        for j in range(i + 1):
            rest = F.col(f"__c{i}_{j}") - sum((F.col(f"__l{i}_{k}") * F.col(f"__l{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"__l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"__l{j}_{j}"))
    for j in range(P):  # its inverse, column by column
        for i in range(j, P):
            rest = F.lit(float(i == j)) - sum((F.col(f"__l{i}_{k}") * F.col(f"__a{k}_{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"__a{i}_{j}", rest / F.col(f"__l{i}_{i}"))
    det = functools.reduce(operator.add, [F.log(f"__l{i}_{i}") for i in range(P)])
    return out.select("__g", *[f"__m{i}" for i in range(P)], *[f"__a{i}_{j}" for i, j in pairs], det.alias("__det"))


def _first_fit(rows: DataFrame) -> DataFrame:
    """Medians, and median deviations on the diagonal."""
    med = small_or_not(checkpoint(_medians(rows, [F.col(x) for x in X], [f"__m{i}" for i in range(P)])), F.lit(200))
    near = rows.join(med, "__g")
    mad = _medians(near, [F.abs(F.col(X[i]) - F.col(f"__m{i}")) for i in range(P)], [f"__d{i}" for i in range(P)])
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"__d{i}"), 2) + (FLOORS[i] * SCALE) ** 2) for i in range(P)]
    det = functools.reduce(operator.add, [F.log(x) for x in scale])
    return med.join(mad, "__g").select("__g", *[f"__m{i}" for i in range(P)], *[(1.0 / scale[i] if i == j else F.lit(0.0)).alias(f"__a{i}_{j}") for i in range(P) for j in range(i + 1)], det.alias("__det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance: the squared length of the factor's inverse times the deviation."""
    gap = [F.col(X[i]) - F.col(f"__m{i}") for i in range(P)]
    y = [functools.reduce(operator.add, [F.col(f"__a{i}_{j}") * gap[j] for j in range(i + 1)]) for i in range(P)]
    return rows.withColumn("__d2", functools.reduce(operator.add, [F.pow(x, 2) for x in y]))


def _concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The model after concentration steps, until no group's determinant falls. A group whose doesn't keeps its model."""
    columns = [c for c in model.columns if c != "__g"]
    # as many groups in every round, so their size is summed once
    few = model.count() * 400 <= BROADCAST_BYTES
    hint = F.broadcast if few else lambda df: df
    first = True
    while True:
        # each fit becomes a small checkpoint, so plans stay short
        near = _distance(rows.join(hint(model), "__g")).select("__g", *X, F.floor(BINS * F.log2(F.col("__d2") + 1.0)).cast("long").alias("__b"))
        cut = hint(checkpoint(_quantile(near, F.col("__b"), SUPPORT, "__cut")))
        new = _fit(near.join(cut, "__g").filter(F.col("__b") <= F.col("__cut"))).select("__g", F.struct(*columns).alias("__new"))
        old = model.select("__g", F.struct(*columns).alias("__old"))
        fell = F.lit(first) | (F.col("__new.__det") < F.col("__old.__det") - LESS)
        model = checkpoint(new.join(old, "__g").select("__g", fell.alias("__fell"), F.when(fell, F.col("__new")).otherwise(F.col("__old")).alias("__fit")).select("__g", "__fell", "__fit.*"))
        if model.filter("__fell").isEmpty():
            return model.drop("__fell")
        model, first = model.drop("__fell"), False


def fit(stats: DataFrame, by: list[str]) -> DataFrame:
    """The model: per group of ``by`` a mean and a factor of the covariance, its own from MIN_GROUP rows on.

    Smaller groups have that of the rows alike in all columns but the last, and so on, in the end that of all rows.
    stats: with_statistics' rows, of which those that passed the base rules count, read several times (a checkpoint).
    """
    fine = stats.filter(~F.col("base_failed"))
    levels = [by[:n] for n in range(len(by), -1, -1)]
    keyed = _vectors(fine, by).select(*[_key(x).alias(f"__k{i}") for i, x in enumerate(levels)], *X)
    rows = keyed.select(F.explode(F.array(*[f"__k{i}" for i in range(len(levels))])).alias("__g"), *X)
    # both starts of a group are groups of their own, told apart by the first character
    starts = [start(rows).withColumn("__g", F.concat(F.lit(str(n)), "__g")) for n, start in enumerate((_first_fit, _fit))]
    both = rows.withColumn("__g", F.explode(F.array(*[F.concat(F.lit(str(n)), "__g") for n in range(len(starts))])))
    models = _concentrated(both, checkpoint(functools.reduce(DataFrame.unionByName, starts))).withColumn("__g", F.substring("__g", 2, 1 << 20))
    columns = [c for c in models.columns if c not in ("__g", "__det")]
    least = models.groupBy("__g").agg(F.min(F.struct("__det", *columns)).alias("__fit")).select("__g", "__fit.*")
    # which model a group has: the first level at which it has rows enough
    sizes = checkpoint(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__size")))
    groups = stats.select(*[_key(x).alias(f"__k{i}") for i, x in enumerate(levels)]).distinct()
    last = len(levels) - 1
    for i in range(last):
        groups = groups.join(sizes.select(F.col("__g").alias(f"__k{i}"), F.col("__size").alias(f"__n{i}")), f"__k{i}", "left")
    chosen = F.coalesce(*[F.when(F.col(f"__n{i}") >= MIN_GROUP, F.col(f"__k{i}")) for i in range(last)], F.col(f"__k{last}"))
    groups = groups.select(F.col("__k0").alias("__own"), chosen.alias("__g"))
    return checkpoint(groups.join(least, "__g").drop("__g", "__det").withColumnRenamed("__own", "__g"))


def judge(stats: DataFrame, model: DataFrame, by: list[str], cut: float = CUT) -> DataFrame:
    """stats with ``distance2`` (null if no row at all passed the base rules) and ``kept``."""
    names = [c for c in stats.columns if c not in ("distance2", "kept")]
    rows = _distance(_vectors(stats.select(*names), by).join(small_or_not(model, F.lit(400)), "__g", "left"))
    return rows.select(*names, F.col("__d2").alias("distance2"), (~F.col("base_failed") & (F.coalesce(F.col("__d2"), F.lit(0.0)) <= cut)).alias("kept"))


def assess(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs with the statistics of with_statistics, ``distance2`` and ``kept``.

    kept is false where base_failed is, and where the statistics lie further than CUT from the robust centre of the
    row's language and source. Null languages and sources form groups of their own; groups of fewer than MIN_GROUP
    rows that pass the base rules are judged by their language's centre, or else by that of all rows. Repeated rows each
    count; empty tables stay empty.
    """
    stats = with_statistics(docs, text)
    narrow = checkpoint(stats.select(*by, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "base_failed"))
    return judge(stats, fit(narrow, list(by)), list(by))


def assess_ids(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """assess without the texts: the statistics are computed once and kept in a checkpoint."""
    stats = with_statistics(docs, text)
    narrow = checkpoint(stats.select(*ids, *[c for c in by if c not in ids], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "base_failed"))
    return judge(narrow, fit(narrow, list(by)), list(by))
