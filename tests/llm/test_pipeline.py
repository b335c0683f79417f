"""Stages of the corpus pipeline, each against a plain version of its decision."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "language_id":
            assert now == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
        if name == "near_dedup":
            assert docs.count() == docs.select("text").distinct().count() < before.count()
        if name == "substring_dedup":
            assert now == ids and all(r.n_chars == len(r.text) for r in docs.collect())
        if name != "packing":
            assert docs.columns == columns
        ids = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids


def test_letterless_and_null_texts(spark):
    rows = [(1, None, "en", "s", 0), (2, "12 !!", None, "s", 5), (3, "plain words here", "en", "s", 16), (4, "more plain words", None, "s", 16), (3, "plain words here", "en", "s", 16), (None, "plain other words", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in told) == [0, 3, 3, 4] and all(r.lang == "en" for r in told)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert corpus_pipeline.packing(spark, docs, "").count() == 6


def test_columns_that_clash_and_empty_tables(spark):
    """A user's own columns come through every stage as they are; an empty table stays empty."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "s", 3, "mine", 0.125, "keepme", "rid"), (2, "other " + words, None, None, None, "mine", 0.125, "keepme", "rid"), (3, "x", "fr", "s", 1, "mine", 0.125, "keepme", "rid"), (4, "plain text of another kind", "en", "s", 1, "mine", 0.125, "keepme", "rid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_words string, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "")
            assert out.columns == docs.columns, name
            assert all((r.lang_pred, r.score, r.n_words, r.row) == ("mine", 0.125, "keepme", "rid") for r in out.collect())
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} >= {1, 2}
    assert {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()} == {1: "", 2: "other", 3: "x", 4: "plain text of another kind"}
    assert corpus_pipeline.packing(spark, docs.limit(0), "").collect() == []
