"""Personal data: fixed patterns as seeds, and contextual extraction bootstrapped from them.

Seeds are whole matches of the fixed patterns, and long hexadecimal tokens as secrets. The one or two words before a
seed are its lexical patterns; whatever token with digits or @ follows the same words is an instance of them. Patterns
and instances form a graph that is scored in turns: a pattern for a kind by the share of its instances that are known to
be of it, where those of other kinds and tokens unlike an identifier speak against it in full and others, which may yet
prove to be of the kind, in part; an instance by its patterns. Tokens that only confident patterns vouch for are new
identifiers of the pattern's kind.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, checkpoint, let

#: The kinds of the fixed patterns, and those that only the method finds.
KINDS, FURTHER = ("email", "ip", "card", "phone"), ("secret",)
#: The fixed patterns, with possessive repeats where nothing can be given back, and starts inside a run of characters
#: left out where the run's start has failed; what they match is the same, in time linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A word with a digit or @; the seeds among these that count as secrets.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SECRET = r"^(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: Production parameters: turns, distinct known instances that a pattern needs, the scores from which a pattern and an
#: instance count as known, what an unknown instance like an identifier counts for against a pattern, and the characters
#: and digits of a new identifier.
TURNS, SUPPORT, PATTERN_SCORE, INSTANCE_SCORE, UNKNOWN, LENGTH, DIGITS = 2, 5, 0.6, 0.6, 0.25, 6, 4
#: Sums are taken in blocks of so many, and tokens meet spans in cells of so many code points.
BLOCK, CELL = 128, 256


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(terms, F.lit(0), operator.add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _sums(sizes: Column) -> Column:
    """Running totals of an array of whole numbers: within blocks, and of the blocks before, so no array grows by steps."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), operator.add)

    def spread(blocks: Column) -> Column:
        sums = F.transform(blocks, total)
        ahead = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return let(ahead, lambda ahead: F.flatten(F.transform(blocks, lambda block, b: F.transform(block, lambda _, j: F.get(ahead, b) + total(F.slice(block, F.lit(1), j + 1))))))

    return let(blocks, spread)


def _places(text: Column, pattern: str, made: Callable[[Column, Column, Column, Column], Column], element: str) -> Column:
    """made(match, end, gap before, match before) of every match of a pattern; ends are in code points."""
    none = F.array().cast(f"array<{element}>")

    def walk(found: Column, gaps: Column) -> Column:
        ends = _sums(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
        return let(ends, lambda ends: F.transform(found, lambda m, i: made(m, F.get(ends, i), F.get(gaps, i), F.get(found, i - 1))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(text, pattern), lambda g: walk(f, g))))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a fixed pattern: array of (start, end, match), in code points, end exclusive."""
    element = "struct<s:int,e:int,m:string>"
    found = _places(text, PATTERNS[kind], lambda m, end, *_: F.struct((end - F.length(m)).alias("s"), end.alias("e"), m.alias("m")), element)
    spans = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), spans).otherwise(F.array().cast(f"array<{element}>")) if _NEEDS[kind] else spans


def _candidates(text: Column) -> Column:
    """Tokens with digits or @: array of (near, far, token, start, end), the token without edges of signs.

    near and far are the word and the two words before it, in lower case; a word with digits or @ there is written #.
    """
    element = "struct<near:string,far:string,token:string,s:int,e:int>"

    def cut(m: Column, end: Column, gap: Column, before: Column) -> Column:
        head = F.length(F.regexp_extract(m, r"^[^A-Za-z0-9+]*+", 0))
        core = F.regexp_replace(m, r"^[^A-Za-z0-9+]++|[^A-Za-z0-9]++$", "")
        start = end - F.length(m) + head
        words = F.filter(F.split(gap, SPACE + "+"), lambda x: x != "")
        words = F.concat(F.when(before.isNotNull(), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>")), F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)))
        return let(words, lambda w: F.struct(F.lower(F.try_element_at(w, F.lit(-1))).alias("near"), F.lower(F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), F.try_element_at(w, F.lit(-1)))).alias("far"), core.alias("token"), start.alias("s"), (start + F.length(core)).alias("e")))

    return F.when(text.rlike("[0-9@]"), _places(text, TOKEN, cut, element)).otherwise(F.array().cast(f"array<{element}>"))


def _bootstrap(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of (pattern, kind) and of (instance, kind) that count as known, from places (contexts, token, kind)."""
    edges = checkpoint(found.select(F.explode("contexts").alias("context"), "token", "kind").groupBy("context", "token").agg(F.max("kind").alias("seed")))
    seeds = edges.filter("seed is not null").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("weight")).distinct()
    known, patterns = seeds, None
    for _ in range(TURNS):
        # only patterns with enough known instances are weighed, so rare words fall out before the join
        scores = edges.join(known, "token").groupBy("context", "kind").agg(F.sum("weight").alias("known"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
        weighed = edges.join(scores.select("context").distinct(), "context", "left_semi").join(known.select("token", "weight"), "token", "left")
        totals = weighed.groupBy("context").agg(F.sum(F.coalesce("weight", F.when(_may_be_new(), UNKNOWN).otherwise(1.0))).alias("total"))
        scores = scores.join(totals, "context").select("context", "kind", F.round(F.col("known") / F.col("total"), 9).alias("score")).filter(F.col("score") >= PATTERN_SCORE)
        patterns = checkpoint(scores)
        new = edges.filter("seed is null").join(patterns, "context").filter(_may_be_new())
        # noisy or, rounded so that the order of rows doesn't matter
        new = new.groupBy("token", "kind").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))), 9).alias("weight")).filter(F.col("weight") >= INSTANCE_SCORE)
        known = checkpoint(seeds.unionByName(new))
    return patterns, known


def _may_be_new() -> Column:
    return (F.length("token") >= LENGTH) & ((F.length(_digits(F.col("token"))) >= DIGITS) | F.contains("token", F.lit("@")))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the ``keep`` columns, ``base`` and ``spans``: arrays of (kind, start, end), kind an index of KINDS + FURTHER.

    base is what the fixed patterns find, leftmost and without overlaps within a kind; spans are these and what the method
    adds, secrets and new ones of the bootstrapped patterns, which never touch a base span. Null and empty texts have no
    spans. Rows repeat as they are; an empty table gives no rows; other columns are left out. Python runs nowhere.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], *[base_spans(t, k).alias(f"__{k}") for k in KINDS], _candidates(t).alias("__found"), F.monotonically_increasing_id().alias("__row"))

    def of_kind(n: int) -> Column:
        return F.transform(f"__{KINDS[n]}", lambda x: F.struct(F.lit(n).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["m"].alias("match")))

    base = functools.reduce(F.concat, [of_kind(n) for n in range(len(KINDS))])
    # the row numbers are fixed by the checkpoint
    rows = checkpoint(rows.select(*[F.col(f"__keep_{c}") for c in keep], base.alias("__base"), "__found", "__row"))
    tokens = rows.select("__row", F.posexplode("__found").alias("i", "x")).select("__row", "i", F.array_distinct(F.array_compact(F.array("x.near", "x.far"))).alias("contexts"), "x.token", F.col("x.s").alias("start"), F.col("x.e").alias("end")).filter(F.length("token") >= 2)
    spans = rows.select("__row", F.explode("__base").alias("b")).select("__row", "b.kind", F.col("b.start").alias("s"), F.col("b.end").alias("e"), "b.match")

    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))

    # a token within a base span is no candidate; the words before a span's first token are the span's
    hits = tokens.withColumn("cell", cells("start", "end")).join(spans.withColumn("cell", cells("s", "e")), ["__row", "cell"]).filter("start < e and s < end")
    hits = checkpoint(hits.select("__row", "i", "contexts", "kind", "s", "match").distinct())
    seeds = hits.groupBy("__row", "kind", "s").agg(F.min(F.struct("i", "contexts")).alias("first"), F.first("match").alias("token")).select("first.contexts", "token", "kind")
    fresh = tokens.join(hits.select("__row", "i").distinct(), ["__row", "i"], "left_anti")
    fresh = checkpoint(fresh.withColumn("kind", F.when(F.col("token").rlike(SECRET), F.lit(len(KINDS)))))
    patterns, known = _bootstrap(seeds.unionByName(fresh.select("contexts", "token", "kind")))
    place = ["__row", "start", "end", "kind", "score"]
    secrets = fresh.filter("kind is not null").withColumn("score", F.lit(2.0)).select(*place)
    open_ = fresh.filter("kind is null").drop("kind").filter(_may_be_new())
    by_pattern = open_.withColumn("context", F.explode("contexts")).join(patterns, "context").select(*place)
    by_instance = open_.join(known.select("token", "kind", F.col("weight").alias("score")), "token").select(*place)
    best = secrets.unionByName(by_pattern).unionByName(by_instance).groupBy("__row", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    added = best.groupBy("__row").agg(F.collect_list(F.struct((-F.col("b.k")).alias("kind"), "start", "end")).alias("__new"))
    out = rows.join(added, "__row", "left")
    base = F.transform("__base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = F.array_sort(F.concat(base, F.coalesce("__new", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return out.select(*[F.col(f"__keep_{c}").alias(c) for c in keep], base.alias("base"), spans.alias("spans"))


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of base spans and of all, and both lists as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS + FURTHER])

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = [count(n) for n in range(len(KINDS))]
    return found.select(*keep, *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
