"""The registered queries at the smallest scale, and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from strandframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(queries.ORACLES[name])
    assert cols == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[c] for c in cols]) for r in rows)


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_toxicity", "op6_decontamination", "op7_html", "op8_licenses", "op9_pii"])
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = len(df.collect())
    table = "pages" if name == "op7_html" else "documents"
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if name != "op6_decontamination" else n > 0


def test_stages_take_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing names; then no rows at all."""
    rows = [
        (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "a b c d e f g", None, "s", 13), (3, "a b c d e f g", None, "s", 13),
        (4, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13), (5, "word " * 30_000, "en", "s", 1), (6, "x\n" * 3000, "en", "s", 1), (7, "you idiot " * 9, "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("numbers", "_n", "cls", "label", "toxic", "n", "place", "item_id", "prints"):
        docs = docs.withColumn(name, docs.lang)
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame([(1, 1, 0), (None, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "one two three four five six"), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, sf)
            n = out.count()
            if out.columns != docs.columns:
                assert out.columns[:2] == ["doc_id", "n_tokens"]
            at = out
        assert n == 0 if table is not docs else n >= 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_take_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").collect() == []
