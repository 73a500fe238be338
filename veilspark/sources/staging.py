"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset there is no folder that executors surely share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/veilspark"  # one machine: tests, a laptop
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Writes a step's result as Parquet in the shared folder and reads it back.

    Later steps neither repeat it, nor plan it again, nor lose it with an executor.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task at most, and at least, where each row is much work.
MOST, LEAST = 50_000, 1_000


def spread(df: DataFrame) -> DataFrame:
    """Few small columns dealt evenly over tasks before much work is done on each row.

    A file is read by its size, so a column of keys that fills some MB would keep a single task busy with all its rows.
    """
    spark, rows = df.sparkSession, df.count()
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / MOST))
    return df.repartition(max(1, min(wanted, math.ceil(rows / LEAST))))
