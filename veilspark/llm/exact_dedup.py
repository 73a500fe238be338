"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest in shared storage. A new batch is reduced to one row per
digest (map-side combined, so a group that holds a third of all rows costs one row per task), joined to the index by a
sort-merge anti-join that moves only the batch's side, and its unseen digests are appended under the batch's name. A batch
that is run again under its name, after a failure or by mistake, keeps the same rows and appends only what is missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import ROW, keyed, materialize, rows_kept, shared_dir

#: ASCII white space, deleted before texts are compared.
SPACE = r"[\x20\x09-\x0D]+"


def normalized(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, digest, chars) and other columns: SHA-256 of the normalised text and the original's code points."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalized().cast("binary"), 256)).alias("digest"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("chars"),
        *others,
    )


class DigestIndex:
    """A table (digest, keep_id, group_size, batch) at ``path``, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """``path``: an existing or new folder that all executors share.

        ``buckets`` is fixed when the index is made and kept with it; an index that is opened again has its own number,
        whatever the session's settings. Asking for another one is an error.
        """
        self.spark, self.path = spark, path or shared_dir(spark)
        self.buckets = self._bucket_count(buckets)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _bucket_count(self, wanted: int | None) -> int:
        """The number of buckets that stands beside the files, in a hidden folder that no scan of the table reads."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        note = hadoop.Path(f"{self.path}/_buckets")
        if note.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(note):
            kept = int(self.spark.read.text(note.toString()).first().value)
            if wanted and wanted != kept:
                raise ValueError(f"the index at {self.path} has {kept} buckets, not {wanted}")
            return kept
        here = hadoop.Path(self.path)
        files = here.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(here) and len(files.listStatus(here)):
            raise ValueError(f"{self.path} holds files but no number of buckets: not an index, or one from before the number was kept")
        made = wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.range(1).select(F.lit(str(made)).alias("value")).coalesce(1).write.mode("overwrite").text(note.toString())
        return made

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """Groups whose digest no other batch has brought: sort-merge anti-join on the buckets."""
        others = self.rows().where(F.col("batch") != batch).select("digest")
        return groups.hint("merge").join(others.hint("merge"), "digest", "left_anti")

    def seen(self, groups: DataFrame, batch: str) -> DataFrame:
        """What other batches have stored for digests of ``groups``; the index is read bucket by bucket, not moved."""
        others = self.rows().where(F.col("batch") != batch)
        return others.hint("merge").join(groups.select("digest").hint("merge"), "digest", "left_semi")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Stores the groups that ``batch`` hasn't stored yet."""
        own = self.rows().where(F.col("batch") == batch).select("digest")
        if not own.isEmpty():
            groups = materialize(groups.hint("merge").join(own.hint("merge"), "digest", "left_anti"))
        (
            groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the session's name for the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, row) of ``rows`` (doc_id, digest, chars, row): the row that stays of each digest."""
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("negative_id"), (-F.col(ROW)).alias("negative_row")))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    # Written before the anti-join, which the optimizer would otherwise push below the aggregation, onto every row.
    return materialize(groups.select("digest", (-F.col("best.negative_id")).alias("keep_id"), "group_size", (-F.col("best.negative_row")).alias(ROW)))


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Of equal texts of a batch, the row with the most code points, then the smallest doc_id stays, unless another batch
    stored that digest: then its keep_id holds and no row of this batch is kept. ``group_size`` counts the rows of the
    batch that brought the digest. ``batch`` names the batch, so that it can be run again; without a name it is a new one.
    Null text counts as empty. Rows without doc_id never win over rows with one. Of repeated rows exactly one can stay.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    index, batch = index or DigestIndex(docs.sparkSession), batch or uuid.uuid4().hex
    rows = materialize(digests(docs, F.monotonically_increasing_id().alias(ROW)))
    groups = _groups(rows)
    fresh = materialize(index.unseen(groups, batch))
    seen = materialize(index.seen(groups, batch).select("digest", "keep_id", "group_size", F.lit(None).cast("long").alias(ROW)))
    index.append(fresh, batch)
    # Both sides are plain scans, so that adaptive execution can split the partitions of hot digests.
    verdict = materialize(fresh.select("digest", "keep_id", "group_size", ROW).unionByName(seen)).withColumnRenamed(ROW, "__kept")
    return rows.join(verdict, "digest", "left").select(
        "doc_id", "keep_id", "group_size", F.col(ROW).eqNullSafe(F.col("__kept")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row of ``docs`` for each text that no other batch of the index holds, with all columns.

    The choice is that of ``dedup``; of repeated rows, and of rows without doc_id where no other has the text, one stays.
    """
    index, batch = index or DigestIndex(docs.sparkSession), batch or uuid.uuid4().hex
    rows = keyed(docs)
    fresh = materialize(index.unseen(_groups(digests(rows, ROW)), batch))
    index.append(fresh, batch)
    return rows_kept(rows, fresh).select(docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
