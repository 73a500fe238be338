import pytest
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup
from veilspark.llm.common import shared_dir


def test_reopened_under_other_settings(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("texto "), "id").alias("text"))
    path, before = shared_dir(spark), spark.conf.get("spark.sql.shuffle.partitions")
    first = exact_dedup.DigestIndex(spark, path, 8)
    assert exact_dedup.kept_documents(docs, first, "one").count() == 40
    first.close()
    try:
        for partitions in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            index = exact_dedup.DigestIndex(spark, path)
            assert index.buckets == 8
            assert exact_dedup.kept_documents(docs, index, f"again {partitions}").count() == 0
            assert exact_dedup.kept_documents(docs, index, "one").count() == 40
            assert index.rows().count() == 40
            index.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 4)


def test_folder_of_other_files(spark):
    path = shared_dir(spark)
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path)
