"""Texts redacted as they arrive: the record job as one stateless query on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilspark.jobs.anonymize import Source, steps
from veilspark.operators.entities import source_none


def redact_stream(texts: DataFrame, source: Source = source_none) -> DataFrame:
    """The columns of ``jobs.anonymize`` for a stream of (seq, text, ...).

    ``source`` may be any that keeps rows apart: small dictionaries and models work inside the row, stored mentions are a
    static table that each batch is joined with. Sources that write their input first (large dictionaries, models with a
    limit of length) are for batches: use them in ``foreachBatch``.
    """
    return steps(texts, source)


def run_available(
    spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, source: Source = source_none, files: int = 1000
) -> StreamingQuery:
    """Redacts the Parquet files in ``folder`` that no earlier call has seen, ``files`` at a time, appends and stops.

    The file sink's log and the checkpoint make each batch take effect once: a run that was killed goes on with the batch
    it was in, and the files of a half-written batch are never read.
    """
    texts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    out = redact_stream(texts, source).writeStream.format("parquet").option("path", sink)
    return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
