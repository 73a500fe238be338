"""Near copies by word shingles: SimHash tables link first, MinHash bands find what is left, exact shingle sets decide.

SimHash fingerprints within two bits are found by operator 10's tables, and such a pair is a link if its sets are
similar. Those are the nearest copies, in linear size. Pairs of a Jaccard similarity of 0.8 differ by about ten of 64 bits,
a radius for which segments would be so short that table entries grow with the corpus. So bands of minima find the pairs
between the components that SimHash leaves, a few heads of a bucket at a time, as in operator 11. Equal sets are one from
the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ROW, as_bytes, keyed, map_batches, materialize, rows_kept, sent_if_few
from veilspark.llm.minhash_dedup import buckets, confirmed, found_sets, joined, linked, shingles
from veilspark.llm.simhash_dedup import linked_fingerprints, of_set

#: Words of a shingle; links have 100 * intersection >= SIMILAR * union.
SHINGLE, SIMILAR = 5, 80
#: A pair at the threshold shares no band once in 2,800 times, one at 0.85 once in 40,000.
BANDS, WIDTH = 20, 5
SEED = 42
CHUNK = 1 << 11
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, BANDS * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * WIDTH, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """``BANDS`` signed longs; one for each group of minima."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, (found[at : at + CHUNK, None] * FACTORS + TERMS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, WIDTH))], np.uint64).view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """(row, set_id, n, fp, bands): hash, size, fingerprint and bands of the text's shingle set. Null text counts as empty."""

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {"row": batch.column(0), "set_id": [], "n": [], "fp": [], "bands": []}
        for text in as_bytes(batch.column(1)):
            found = shingles(text, SHINGLE)
            out["set_id"].append(int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)))
            out["n"].append(len(found))
            out["fp"].append(of_set(found))
            out["bands"].append(bands(found).tolist() if len(found) else [])
        yield out

    return map_batches(rows.select(F.col(ROW), "text"), run, "row long, set_id long, n long, fp long, bands array<long>")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids that SimHash finds: fingerprints within two bits, by their tables; linear in number.

    Each set is paired with the smallest one of its fingerprint, and those with each other.
    """
    own = sets.where("n > 0").select("set_id", "fp")
    first = materialize(own.groupBy("fp").agg(F.min("set_id").alias("first")))
    pairs = own.join(first, "fp").where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    near = linked_fingerprints(first.select("fp"))
    at = [first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"]
    near = near.join(at[0], "a").join(at[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return materialize(pairs.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def groups(rows: DataFrame) -> DataFrame:
    """(row, root): rows of one root are linked by pairs of similar shingle sets."""
    signed = materialize(signatures(rows))
    sets = signed.groupBy("set_id").agg(F.min(F.struct("row", "n", "fp", "bands")).alias("first"))
    sets = materialize(sets.select("set_id", "first.*"))
    pairs = fingerprint_pairs(sets)
    members = materialize(buckets(sets.select(F.explode("bands").alias("key"), "set_id", "n")))
    wanted = members.select("set_id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    first = materialize(sets.join(wanted, "set_id").select("set_id", F.col("row").alias(ROW)))
    found = found_sets(rows.select(ROW, "text").join(sent_if_few(first), ROW), SHINGLE)
    known = joined(None, confirmed(pairs, found, SIMILAR))
    roots = linked(members, lambda _: found, SIMILAR, known)
    return signed.join(roots, F.col("set_id") == F.col("v"), "left").select("row", F.coalesce("root", "set_id").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all columns: the one with the smallest doc_id, if any has one."""
    rows = keyed(docs)
    ids = rows.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(groups(rows), "row")
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    kept = materialize(best.select(F.col("best.row").alias(ROW)))
    return rows_kept(rows, kept).select(docs.columns)
