"""The pipeline stage by stage: what each may change, and that its decisions take effect."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestar.llm import minhash, quality
from tests.llm.test_operators import DOCS, WORD, corpus, encoding  # noqa: F401


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.createDataFrame(corpus(3), DOCS), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages(spark, steps, encoding):  # noqa: F811
    docs = spark.createDataFrame(corpus(3), DOCS)
    columns = docs.columns
    assert [n for n, _ in steps] == ["quality rules", "line dedup", "minhash near-dedup", "mixing sources", "byte-level bpe"]
    assert all(df.columns == columns for _, df in steps[:-1])
    good, lines, near, mix, ids = (df for _, df in steps)
    assert good.count() == quality.assess(docs).filter("kept").count() < docs.count()
    assert lines.count() == good.count() and lines.agg(F.sum(F.length("text"))).first()[0] < good.agg(F.sum(F.length("text"))).first()[0]
    kept = minhash.near_duplicates(lines, percent=corpus_pipeline.NEAR_PERCENT).filter("kept").select("doc_id").distinct()
    assert {r[0] for r in near.select("doc_id").collect()} == {r[0] for r in kept.collect()}
    known = near.filter("doc_id is not null")
    assert known.count() == known.select("doc_id").distinct().count() < lines.count()
    words = lambda df: sum(len(WORD.findall(r.text)) for r in df.select("text").collect())
    assert abs(words(mix) - words(near)) <= 6
    texts = sorted(encoding.encode_ordinary(r.text) for r in mix.collect())
    assert sorted(list(r.ids) for r in ids.collect()) == texts
    assert mix.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_run_and_nothing(spark, tmp_path, steps):
    spark.createDataFrame(corpus(3), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.ids_sha256 for r in out.collect()) == sorted(r.ids_sha256 for r in steps[-1][1].collect())
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_copies_by_row(spark):
    """A document that shares its id with a copy stays; of copies of one id one stays; clashing columns pass through."""
    a = " ".join(f"w{i}" for i in range(100))
    near, b, c = a.replace("w50", "other"), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(2, a), (5, near), (5, b), (7, c), (7, c.replace("u30", "x")), (7, c), (8, None), (8, None), (9, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, root string, t double")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((i, t or "") for i, t in got if i is not None and i != 7) == [(2, a), (5, b), (8, ""), (9, "")] and len([1 for i, _ in got if i == 7]) == 1
    assert got.count((None, a)) == 2
    assert corpus_pipeline.near_dedup(spark, docs.filter("false"), "").count() == 0


def test_stages_of_odd_tables(spark):
    """Every stage takes nulls in all columns, empty texts, repeated rows, and columns named like its own."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text + " x", None, None), (2, None, None, "a"), (3, "", "en", None), (4, " \n ", None, None), (5, "short", "de", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1) for r in rows], f"{DOCS}, __size string, n_words int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() <= 2 * len(rows)
        if name != "byte-level bpe":
            assert out.columns == docs.columns and not out.exceptAll(out.select(*docs.columns)).count()
