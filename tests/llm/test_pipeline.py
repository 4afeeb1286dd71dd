"""The stages on a small table: columns stay, decisions take effect, awkward rows pass."""

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` int, kept_text string, n_removed string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None, 1, None, "x"), (90001, None, None, None, None, 1, "c", None), (90002, "", "en", "s", 0, 1, "c", None)], DOCS
    )
    docs = real.selectExpr("*", "1 AS `row`", "'clash' AS kept_text", "'clash' AS n_removed").unionByName(odd)
    out = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= rows
            rows = docs.count()
    assert docs.select("bin_id").distinct().count() > 1


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_copies_leave_one(spark, folder):
    line = " ".join(f"word{i}" for i in range(80))
    near = line.replace("word40", "other")
    rows = [(1, line, "en", "s", 1), (2, line, "en", "t", 1), (3, near, "en", "s", 1), (4, "something else altogether here", "en", "s", 1), (4, "something else altogether here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4]
