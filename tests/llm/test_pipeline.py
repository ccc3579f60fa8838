import os

import pytest

import corpus_pipeline
from holdfold.llm import toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    rejected = {r.doc_id for r in toxicity.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if k == 0:
            assert {r.doc_id for r in before.select("doc_id").subtract(after.select("doc_id")).collect()} == rejected
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count() > 0


BARE = "doc_id long, text string, lang string, source string, n_chars long"


def small_tables(spark, folder):
    """Labels of ids 0 to 199, odd ones toxic, and one benchmark item."""
    spark.createDataFrame([(k, 1, k % 2) for k in range(200)] + [(None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


ITEM = " ".join(f"benchmark{k}" for k in range(30))


def text(k, n=60):
    return " ".join(f"w{(k * 131 + j * j * 7 + j) % 997}" for j in range(n))


def test_rows_of_every_kind_go_through(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, and columns of further names."""
    small_tables(spark, tmp_path)
    rows = [(k, text(k) + (" you idiotic fool " if k % 2 else " ") + text(k + 5000, 20), "en", "s", None) for k in range(200)]
    rows += [(500, text(500), None, None, 1), (500, text(500), None, None, 1), (500, text(501), "en", "t", 2), (None, text(502), "en", "s", None), (None, None, None, None, None), (503, "", "en", "s", 0), (504, None, "en", "t", None)]
    rows += [(505, text(505, 30_000), "en", "s", 9), (506, "say " + ITEM + " again", "en", "s", 9), (507, text(507) + " mail me at jo@example.org", "en", "s", 9), (508, text(505, 30_000) + " end", "en", "s", 9)]
    docs = spark.createDataFrame(rows, BARE)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in out}
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "taken", "repeat"}
    assert not any("idiotic" in (r.text or "") for r in out) and 506 not in texts and "jo@example.org" not in str(texts)
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path)).cache()
        if k == 1:  # one of each group, texts of one id apart, and every text without words
            got = sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in kept.where("doc_id is null or doc_id >= 500").collect() if r.text and len(r.text) < 3000)
            assert sum(r[1] == 500 for r in got) == 2 and kept.where("doc_id in (505, 508)").count() == 1
            assert kept.where("text is null or text = ''").count() == 3
    assert kept.where("doc_id = 507").first().text.endswith("<EMAIL>") and kept.where("doc_id is null").count() == 2


def test_empty_tables_go_through(spark, tmp_path):
    spark.createDataFrame([], BARE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_further_columns_stay(spark, tmp_path):
    """Columns named like those that the operators add or use come out as they went in, but for the mixture's own."""
    small_tables(spark, tmp_path)
    rows = [(k, text(k) + (" you idiotic fool" if k % 2 else ""), "en", "s", None, "a", k) for k in range(200)]
    docs = spark.createDataFrame(rows, BARE + ", score string, id long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.where("score <> 'a' or id <> doc_id").count() == 0 and docs.count() > 0
