import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_keep_columns_and_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    from veilspark.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        if name != "bpe":
            assert docs.columns == columns
            assert docs.count() <= before
            before = docs.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == before > 0
