"""URL filters by a temporal list join: every capture is judged by the list as it stood when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, null_safe, small_or_not


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to two labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (domain, listed boolean, at) as validity intervals ``domain, from, to``; to is null while open.

    An entry holds until the domain's next one; of entries of the same time the one that lists comes last. Entries with
    a null in a field say nothing. Repeated entries change nothing.
    """
    e = entries.filter("domain is not null and listed is not null and at is not null").select(F.lower("domain").alias("domain"), "listed", "at").groupBy("domain", "at").agg(F.max("listed").alias("listed"))
    w = Window.partitionBy("domain").orderBy("at")
    return e.withColumn("to", F.lead("at").over(w)).filter("listed").select("domain", F.col("at").alias("from"), "to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with ``host``, ``blocked`` and ``blocked_by``, the longest listed domain that holds the host (null: none).

    A capture is blocked if its host or a parent domain is listed at its time: from an entry's time, inclusive, until
    the next, exclusive. Null URLs, hosts or times match nothing and aren't blocked. Rows repeat and other columns pass
    as they are; input columns named host, blocked, blocked_by are replaced. Empty lists block nothing.

    The list meets the distinct hosts first, so captures need one equi-join by host with an array of intervals; a hot
    host's rows stay apart, as that table is broadcast if small and else its partitions are split by adaptive execution.
    """
    kept = [c for c in captures.columns if c not in ("host", "blocked", "blocked_by")]
    hosts = captures.select(host_of(F.col(url)).alias("host")).filter("host is not null").distinct()
    active = hosts.withColumn("domain", F.explode(suffixes(F.col("host")))).join(intervals(entries), "domain")
    lists = active.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("domain").alias("n"), "domain", "from", "to")), asc=False).alias("__spans"))
    lists = small_or_not(checkpoint(lists.select(null_safe(F.col("host")).alias("__host"), "__spans")), F.length("__host") + F.size("__spans") * 64)
    rows = captures.select(*kept, host_of(F.col(url)).alias("host"))
    rows = rows.withColumn("__host", null_safe(F.col("host"))).join(lists, "__host", "left")
    t = F.col(at)
    hit = F.filter("__spans", lambda s: (s["from"] <= t) & (s["to"].isNull() | (t < s["to"])))
    by = F.get(hit, F.lit(0))["domain"]
    return rows.select(*kept, "host", by.alias("blocked_by")).select(*kept, "host", F.col("blocked_by").isNotNull().alias("blocked"), "blocked_by")
