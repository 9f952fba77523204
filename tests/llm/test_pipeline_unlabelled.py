from __future__ import annotations

import corpus_pipeline


def test_documents_without_labels_pass_undetermined(spark):
    rows = [(1, "some text", None), (2, "12 34 !!", None), (3, None, None), (4, "é", None), (5, "日本語", None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5}
