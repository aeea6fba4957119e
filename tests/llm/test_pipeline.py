"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and out.count() > 0
        if name in ("quality", "near_duplicates"):
            assert out.count() < ids and out.join(docs, docs.columns, "left_anti").count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
