"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments, each with a table of the fingerprints under the segment's value. Two
fingerprints that differ in at most two bits differ in at most one bit of the first segment, or in none of the second. So
a look-up enumerates the Hamming ball of radius one around the first segment (33 values) and the value of the second,
fetches what the tables hold there, and verifies the distance of the complete fingerprints.

A table entry with many distinct fingerprints (thousands of near copies can agree in a segment) would give pairs without
number. Fingerprints that look up such an entry are linked in another exact way: two of them within two bits have a common
neighbour one bit from each, so each is stored at itself and its 64 neighbours, where at most 65 can meet, and an entry's
state is one mask of flipped bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import ROW, as_bytes, keyed, map_batches, materialize
from veilspark.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints of one table entry from which on it is not fetched.
CROWD = 64
CHUNK = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Unsigned SimHash of the text's k-word shingles (A-Z lower-cased, ASCII white space); no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else iter([b" ".join(words)])
    n, counts, digest = max(1, len(words) - k + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        size = min(CHUNK, n - start)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(size), shingles)), np.dtype("<u8"), size)
        counts += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def of_set(found: np.ndarray) -> int:
    """Signed SimHash of a set of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(found), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. Null text counts as empty."""

    def run(batch: pa.RecordBatch):
        bits = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield {"doc_id": batch.column(0), "fp": bits}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def looked_up(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored and looked-up addresses (address, fp): a segment's number in front of its 32 bits."""
    # Few and small rows that become many: dealt anew before they are multiplied.
    fps = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    first, second = "fp & 4294967295L", "(1L << 32) | shiftrightunsigned(fp, 32)"
    stored = fps.select(F.expr(f"explode(array({first}, {second}))").alias("address"), "fp")
    ball = f"transform(sequence(0, 31), i -> ({first}) ^ shiftleft(1L, i))"
    return stored, fps.select(F.expr(f"explode(concat(array({first}, {second}), {ball}))").alias("address"), "fp")


def linked_fingerprints(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that link everything within ``MAX_BITS`` bits."""
    stored, probes = looked_up(distinct)
    crowded = materialize(stored.groupBy("address").count().where(F.col("count") > crowd).select("address"))
    none = crowded.isEmpty()
    fetched = probes.withColumnRenamed("fp", "a").join((stored if none else stored.join(crowded, "address", "left_anti")).withColumnRenamed("fp", "b"), "address")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    edges = fetched.where((F.col("a") < F.col("b")) & near).select("a", "b")
    if none:
        return edges
    return edges.unionByName(neighbours_met(materialize(probes.join(crowded, "address", "left_semi").select("fp").distinct())))


def neighbours_met(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that link everything within two bits, in linear size however many fingerprints agree in a segment."""
    fps = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit"))
    mask = F.expr("if(bit < 64, shiftleft(1L, bit), 0L)")
    stored = balls.select(F.col("fp").bitwiseXOR(mask).alias("address"), mask.alias("mask"), (F.col("bit") == 64).alias("own"))
    met = stored.groupBy("address").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
    met = met.where(F.bit_count("mask") + F.col("own").cast("int") >= 2)
    members = F.expr(
        "transform(filter(sequence(0, 64), i -> if(i < 64, shiftright(mask, i) & 1L = 1L, own)),"
        " i -> address ^ if(i < 64, shiftleft(1L, i), 0L))"
    )
    met = met.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return met.where(F.col("a") != F.col("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most two differing bits. Texts without words
    (null, empty, white space) have fingerprint zero and are linked like any other. Rows without doc_id take part in
    linking but are never a component's id, unless it has no other rows: then it is null. Repeated rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(linked_fingerprints(distinct))
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    final = materialize(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(final, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, with all columns: the one with the smallest doc_id, if any has one.

    Rows without doc_id stay where their group has no other, one of each group; of repeated rows one stays.
    """
    rows = keyed(docs)
    groups = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")).join(groups, ROW)
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("best"))
    kept = materialize(best.select(f"best.{ROW}"))
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
