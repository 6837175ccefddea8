"""The language stage where there is nothing to learn from."""

from __future__ import annotations

import corpus_pipeline


def test_lettered_documents_stay_when_no_language_is_known(spark, tmp_path):
    given = [(1, "some words"), (2, "12 !!"), (3, None), (4, "\u65e5\u672c"), (None, "x"), (6, "")]
    docs = spark.createDataFrame([(d, t, None, "s", len(t or "")) for d, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert left.dtypes == docs.dtypes
    assert {(r.doc_id, r.text, r.lang) for r in left.collect()} == {(1, "some words", None), (4, "\u65e5\u672c", None), (None, "x", None)}
