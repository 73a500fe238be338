"""Line deduplication over the whole corpus, as compressed keep bitmaps.

Every line long enough to count becomes (key hash, document, position). The rows are dealt by range of the whole triple
and sorted within each range, so a line that a third of all documents hold spreads over many ranges instead of filling
one. One streaming pass over a sorted range keeps a constant state (the current key and its first document) and emits
the positions to drop. Only the first key of a range can have begun in an earlier range: its lines of one document are
emitted as pending, and settled against one summary row for each range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, map_batches, materialize

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
DROP, PENDING, SUMMARY = 0, 1, 2
#: Sorts rows without doc_id behind all others.
NO_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _counts(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, t, pos): 128-bit key hash, document, hash of its text, line number."""

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {"h1": [], "h2": [], "doc_id": [], "t": [], "pos": []}
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            t = _signed(xxhash.xxh64_intdigest(text, 42))
            for pos, line in enumerate(text.split(b"\n")):
                key = line_key(line)
                if _counts(key, min_chars):
                    d = hashlib.md5(key, usedforsecurity=False).digest()
                    out["h1"].append(int.from_bytes(d[:8], "big", signed=True))
                    out["h2"].append(int.from_bytes(d[8:], "big", signed=True))
                    out["doc_id"].append(doc)
                    out["t"].append(t)
                    out["pos"].append(pos)
        yield out

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return map_batches(docs.select(ids, "text"), run, "h1 long, h2 long, doc_id long, t long, pos int")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """Streams each sorted range: (kind, h1, h2, doc_id, t, pos) with kind DROP, PENDING or SUMMARY."""
    keys = ["h1", "h2", "doc_id", "t", "pos"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h1, h2, first document) of the current key
        opening = True  # still in the first key of this range
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, t, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.empty(len(h1), bool)
            new[0] = last is None or (h1[0], h2[0]) != last[:2]
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            firsts = doc[starts] if new[0] else np.concatenate([[last[2]], doc[starts]])
            group = np.cumsum(new) - int(new[0])
            first = firsts[group]
            drop = doc != first
            wait = np.zeros(len(h1), bool)
            if opening:
                ends = starts[starts > 0] if last is None else starts
                end = ends[0] if len(ends) else len(h1)
                wait[:end] = ~drop[:end]
                opening = not len(ends)
            last = (h1[-1], h2[-1], first[-1])
            for kind, mask in ((DROP, drop), (PENDING, wait)):
                if mask.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(mask.sum(), kind, np.int32))] + [pa.array(x[mask]) for x in (h1, h2, doc, t, pos)], schema=schema
                    )
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(kind=SUMMARY, h1=int(last[0]), h2=int(last[1]), doc_id=int(last[2]), t=0, pos=0)], schema=schema)

    return ranged.mapInArrow(run, "kind int, h1 long, h2 long, doc_id long, t long, pos int")


def _bitmaps(dropped: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        packed = []
        for gone in batch.column(2).to_pylist():
            keep = np.ones(max(gone) // 8 * 8 + 8, bool)  # whole bytes
            keep[gone] = False
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield {"doc_id": batch.column(0), "t": batch.column(1), "keep": packed}

    lists = dropped.groupBy("doc_id", "t").agg(F.collect_list("pos").alias("gone"))
    return map_batches(lists, run, "doc_id long, t long, keep binary")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t, keep) for each document that loses lines; lines behind the bitmap's last bit stay.

    ``t`` is xxhash64 of the text, so that rows that share a doc_id but not a text keep their own bitmaps; the lines of
    all rows of one doc_id count as that document's. Rows without doc_id count as one document behind all others.
    """
    events = materialize(first_occurrences(line_rows(docs, min_chars)))
    begun = events.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    late = events.where(F.col("kind") == PENDING).join(begun, ["h1", "h2"]).where("first_id < doc_id")
    cols = ["doc_id", "t", "pos"]
    dropped = events.where(F.col("kind") == DROP).select(*cols).unionByName(late.select(*cols))
    return _bitmaps(dropped)


def unpack(keep: bytes | None, n: int) -> np.ndarray:
    """The bitmap as booleans, one for each of ``n`` lines."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n].astype(bool)
        out[: len(bits)] = bits
    return out


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents beside their bitmaps; the small bitmaps are hashed, so whole texts are moved once and never sorted."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id")
    texts = docs.select(ids, F.coalesce("text", F.lit("")).alias("__text")).withColumn("__t", F.xxhash64("__text"))
    keep = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__hash"), "keep").hint("shuffle_hash")
    return texts.join(keep, (F.col("__id") == F.col("__doc")) & (F.col("__t") == F.col("__hash")), "left").select("__id", "__text", "keep")


def _kept(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    stay = [x for x, k in zip(lines, unpack(keep, len(lines))) if k]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text): every text without the lines whose key an earlier (smaller doc_id) document holds.

    Null and empty texts are one empty line and come back as empty texts. An empty table gives no rows.
    """

    def run(batch: pa.RecordBatch):
        kept = [_kept(t, k)[2].decode("utf-8", "replace") for t, k in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
        yield {"doc_id": _ids(batch), "text": kept}

    return map_batches(_with_bitmaps(docs, keep_bitmaps(docs, min_chars)), run, "doc_id long, text string")


def _ids(batch: pa.RecordBatch) -> list:
    return [None if x == NO_ID else x for x in batch.column(0).to_pylist()]


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(batch: pa.RecordBatch):
        kept = [_kept(t, k) for t, k in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
        yield {
            "doc_id": _ids(batch), "n_lines": [x[0] for x in kept], "n_dropped": [x[1] for x in kept],
            "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in kept],
        }

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    return map_batches(_with_bitmaps(docs, keep_bitmaps(docs)), run, schema)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(first_id < doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
