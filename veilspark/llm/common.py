"""Shared helpers of the training-data operators: scratch tables in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor shares.

    Only where that setting is absent (tests, a laptop) a local folder is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.gettempdir() + "/veilspark"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive the executors that wrote them, so a lost executor costs no recomputation. ``codec``: the files'
    compression, else the session's.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


ROW = "__row"


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with a number in ``ROW`` that names each row, written so that every later use sees the same numbers.

    Stages choose rows by it: doc_id may be null, and rows may be repeated.
    """
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()))


#: Rows up to which a table of numbers is sent to every executor (16 MB).
FEW = 1 << 20


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df``, numbers that are written already; up to ``FEW`` rows are sent to every executor, so that texts joined to them stay in place."""
    return F.broadcast(df) if df.count() <= FEW else df


def rows_kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose number in ``ROW`` is in ``kept``.

    As most rows stay, the numbers of the others are looked up, and no text is shuffled or sorted unless those are many.
    """
    gone = materialize(rows.select(ROW).join(kept.select(ROW), ROW, "left_anti"))
    return rows.join(sent_if_few(gone), ROW, "left_anti")


#: Bytes of a batch that are worked on at a time in a Python worker.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions of about ``size`` bytes, so that what is made of them stays small."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold about 2 MB, unless it has a size of its own.

    With Spark's default of 64 MB, 10,000 whole texts at a time stand in the JVM's and in each Python worker's memory.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, 2 * PORTION)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc's: freed memory between other objects goes back to the system
except (AttributeError, OSError, TypeError):
    _trim = None
_KEPT: list[dict] = []
_STAGE = [""]


def worker_cache(found: dict) -> dict:
    """``found``, which a Python worker fills from batch to batch, and which is emptied when it turns to another stage."""
    _KEPT.append(found)
    return found


def turn_to(stage: str) -> None:
    """Workers live on from stage to stage: what one has kept for another stage goes before ``stage`` takes memory."""
    if _STAGE[0] != stage:
        for found in _KEPT:
            found.clear()
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)
        _STAGE[0] = stage


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list]]], schema: str, stage: str = "", portion: int = PORTION
) -> DataFrame:
    """``mapInArrow`` for functions that turn a portion of a batch into dicts of columns; strings arrive as bytes.

    ``fn`` yields one dict per output batch, so that a function may emit more or fewer rows than it reads. Workers keep
    their caches between calls of one ``stage``; without a name each call is its own. ``portion``: see ``portions``.
    """
    short_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, stage = to_arrow_schema(out), stage or uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(stage)
        for batch in batches:
            for part in portions(batch, portion):
                for cols in fn(part):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding it; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
