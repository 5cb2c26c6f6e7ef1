"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestar.llm.line_dedup import html_lines, remove_boilerplate
    from lodestar.llm.url_filter import host_of

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return remove_boilerplate(pages, "host").select("page_id", "host", "n_lines", "n_dropped", "text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestar.llm.mixing import Mix, sized

    rows = sized(_documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "source", "__size", "__source", "__key")
    m = Mix(rows, light=True)
    taken = m.taken().groupBy("__source", "__start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    # rows without words share their start with the next row
    taken = taken.select(F.col("__source").alias("__s"), F.col("__start").alias("__at"), "taken", "first_slot")
    out = m.placed.join(taken, (F.col("__source") == F.col("__s")) & (F.col("__start") == F.col("__at")) & (F.col("__size") > 0), "left")
    out = out.select("doc_id", F.col("__size").alias("size"), F.col("__source").alias("__s"), F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))
    per = m.sources.select(F.col("__source").alias("__s"), F.col("size").alias("source_size"), "target")
    return out.join(per, "__s").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestar.llm.bpe import digests

    return digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _url_list(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the pages' hosts: hashes of a domain choose whether and when it is listed and freed."""
    from pyspark.sql import functions as F

    from lodestar.llm.url_filter import host_of, suffixes

    domains = pages.select(F.explode(F.slice(suffixes(host_of(F.col("url"))), 1, 2)).alias("domain")).filter(F.size(F.split("domain", r"\.")) >= 3).distinct()
    h = lambda a, b: F.conv(F.substring(F.md5("domain"), a, b), 16, 10).cast("long")
    start = F.lit(1704067200) + h(2, 4) * 240
    events = F.array(
        F.struct(F.lit(True).alias("listed"), F.timestamp_seconds(start).alias("at")),
        F.struct(F.lit(False).alias("listed"), F.timestamp_seconds(start + h(6, 3) * 3600).alias("at")),
        F.struct(F.lit(True).alias("listed"), F.timestamp_seconds(start + h(6, 3) * 3600 + h(9, 3) * 3600).alias("at")),
    )
    return domains.filter(h(1, 1) < 6).select("domain", F.explode(events).alias("e")).select("domain", "e.listed", "e.at")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestar.llm.url_filter import judge

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # captures have no time of their own: minutes of a year by their id
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(525600)) * 60))
    out = judge(captures, _url_list(pages))
    return out.select("page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "blocked", "blocked_by")


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.sentence_spans import remove_repeated

    return remove_repeated(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.pii import digest, find

    return digest(find(_documents(spark, sf_dir).select("doc_id", "text")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.quality import assess_ids

    out = assess_ids(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.topk import top_k

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") or name == "pipeline"}


SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = """
WITH a AS (SELECT page_id, nullif(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
             regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\\b[^>]*>', chr(1), 'g') AS t FROM pages),
     b AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '<[!/?A-Za-z][^>\\x01]*>', '', 'g'), '[\\x20\\t\\r\\f\\x0B]*[\\n\\x01][\\x20\\t\\r\\n\\f\\x0B\\x01]*', chr(10), 'g') AS t FROM a),
     c AS (SELECT page_id, host, regexp_replace(t, '^[\\x20\\t\\r\\n\\f\\x0B]+|[\\x20\\t\\r\\n\\f\\x0B]+$', '', 'g') AS text FROM b),
     l AS (SELECT page_id, host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM c),
     u AS (SELECT host, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS line FROM l),
     n AS (SELECT host, line, count(*) AS n FROM u GROUP BY ALL),
     s AS (SELECT host, count(*) AS total FROM l GROUP BY host),
     m AS (SELECT n.host, list(line) AS marks FROM n JOIN s ON n.host IS NOT DISTINCT FROM s.host WHERE n - 1 > 0.1::DOUBLE * (total - 1) GROUP BY n.host),
     k AS (SELECT l.*, list_filter(lines, lambda x: NOT list_contains(coalesce(marks, []), x)) AS kept FROM l LEFT JOIN m ON l.host IS NOT DISTINCT FROM m.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM k
"""

SQL["op3_mixing"] = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER (ORDER BY n / w, source) AS i FROM s),
l AS (SELECT rest, ws FROM o WHERE NOT 3 * n * ws < w * rest ORDER BY i LIMIT 1),
t AS (SELECT o.source, o.n, CASE WHEN 3 * o.n * o.ws < o.w * o.rest THEN (3 * o.n)::DOUBLE ELSE (o.w * l.rest)::DOUBLE / l.ws::DOUBLE END AS target FROM o LEFT JOIN l ON true),
p AS (SELECT d.*, t.n, t.target, round(t.target)::BIGINT AS words,
             sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS MATERIALIZED (SELECT coalesce('v' || source, 'n') AS s, target, (n + 255) // 256 AS blocks, CASE WHEN n > 0 THEN round(target)::BIGINT // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN round(target)::BIGINT % n ELSE 0 END AS over FROM t),
e AS MATERIALIZED (SELECT *, passes * blocks + (over + 255) // 256 AS slots, sum(target) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto, greatest(sum(target) OVER (), 1e-9) AS everything FROM c),
g AS (SELECT i AS slot, (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE % 1.0::DOUBLE AS u FROM range((SELECT sum(slots)::BIGINT FROM e)) r(i)),
h AS (SELECT slot, s, slots, blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank FROM g JOIN e ON (upto - target) / everything <= u AND u < upto / everything),
i AS (SELECT e.s, e.slots, e.blocks, count(h.s) AS have FROM e LEFT JOIN h ON h.s = e.s AND h.rank < h.slots GROUP BY ALL),
j AS (SELECT s, rank, slot FROM h WHERE rank < slots UNION ALL SELECT s, unnest(range(have, slots)) AS rank, (SELECT sum(slots)::BIGINT FROM e) + unnest(range(have, slots)) FROM i),
q AS (SELECT doc_id, coalesce('v' || source, 'n') AS s, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM p WHERE size > 0),
f AS (SELECT doc_id, min(slot)::BIGINT AS first_slot FROM q JOIN e USING (s) JOIN j ON j.s = q.s AND j.rank % e.blocks = q.block
      WHERE j.rank // e.blocks < passes OR least(start + size, (block + 1) * 256, over) > greatest(start, block * 256) GROUP BY doc_id)
SELECT p.doc_id, size, n AS source_size, target,
       (CASE WHEN n = 0 THEN 0 ELSE words // n * size + least(greatest(words % n - start, 0), size) END)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot
FROM p LEFT JOIN f USING (doc_id)
"""

SQL["op5_url_filters"] = """
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
                  1704067200 + (page_id * 7919 % 525600) * 60 AS t FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL),
x AS (SELECT host, unnest(CASE WHEN len(l) < 2 THEN [host] ELSE list_transform(range(1, greatest(len(l), 2)), lambda i: array_to_string(l[i:], '.')) END) AS domain,
             unnest(range(1, greatest(len(l), 2))) AS i FROM h),
d AS (SELECT DISTINCT domain, md5(domain) AS m FROM x WHERE i <= 2 AND len(string_split(domain, '.')) >= 3),
n AS (SELECT domain, 1704067200 + ('0x' || m[2:5])::BIGINT * 240 AS a, ('0x' || m[6:8])::BIGINT * 3600 AS b, ('0x' || m[9:11])::BIGINT * 3600 AS c
      FROM d WHERE ('0x' || m[1:1])::BIGINT < 6),
e AS (SELECT domain, t, bool_or(on_) AS on_ FROM (SELECT domain, a AS t, true AS on_ FROM n UNION ALL SELECT domain, a + b, false FROM n UNION ALL SELECT domain, a + b + c, true FROM n) GROUP BY ALL),
v AS (SELECT domain, on_, t AS f, lead(t) OVER (PARTITION BY domain ORDER BY t) AS u FROM e),
b AS (SELECT p.page_id, max_by(x.domain, len(x.domain)) AS blocked_by FROM p JOIN x ON p.host = x.host JOIN v ON v.domain = x.domain AND v.on_ AND p.t >= v.f AND (v.u IS NULL OR p.t < v.u) GROUP BY p.page_id)
SELECT p.page_id, host, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS fetched_at, blocked_by IS NOT NULL AS blocked, blocked_by
FROM p LEFT JOIN b USING (page_id)
"""

SQL["op6_sentence_spans"] = """
WITH t AS (SELECT doc_id, unnest(l) AS tok, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS l FROM documents)),
u AS (SELECT doc_id, tok, k, translate(regexp_replace(tok, '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
             (regexp_matches(tok, '[.!?,;:][\\x20\\x09-\\x0D]*$') OR regexp_matches(tok, '[\\r\\n]'))::INT AS over FROM t),
v AS (SELECT *, coalesce(sum(over) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS i FROM u),
s AS MATERIALIZED (SELECT doc_id, i, min(k) AS a, max(k) AS e, string_agg(tok, '' ORDER BY k) AS sentence FROM v GROUP BY doc_id, i),
d AS MATERIALIZED (SELECT doc_id, list(w ORDER BY k) AS w, max(i) + 1 AS n FROM v GROUP BY doc_id),
x AS (SELECT s.*, s2.i AS j20 FROM s ASOF LEFT JOIN s s2 ON s.doc_id = s2.doc_id AND s.a + 19 <= s2.e),
y AS (SELECT x.*, s3.i AS j50 FROM x ASOF LEFT JOIN s s3 ON x.doc_id = s3.doc_id AND x.a + 49 <= s3.e),
z AS (SELECT y.doc_id, y.i, a, least(greatest(y.i + 2, coalesce(j20, 1e9)), coalesce(j50, 1e9))::BIGINT AS j, n, w FROM y JOIN d USING (doc_id)),
r AS (SELECT doc_id, i, a, w, CASE WHEN n < 3 AND i = 0 AND len(w) >= 20 THEN least(j, n - 1) ELSE j END AS j, n FROM z),
h AS (SELECT r.doc_id, r.i, r.j, md5(array_to_string(w[r.a:s.e], ' ')) AS run FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.j),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS c FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE c > 1),
k AS (SELECT s.doc_id, count(*) AS n, count(g.i) AS gone, string_agg(sentence, '' ORDER BY s.i) FILTER (g.i IS NULL) AS text FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(gone, 0)::BIGINT AS n_removed,
       regexp_extract(coalesce(documents.text, ''), '^[\\x20\\x09-\\x0D]*') || coalesce(k.text, '') AS text
FROM documents LEFT JOIN k USING (doc_id)
"""

SQL["op9_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

SQL["op10_minhash_near_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT a.doc_id, b.doc_id AS other, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) a
  JOIN n x ON x.doc_id = a.doc_id JOIN n b ON b.doc_id = a.other WHERE 100 * common >= 85 * (x.n + b.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
