"""k-means on integer vectors with block-norm screening.

Every vector is stored once, as integers and compressed to half as many numbers: the mean of each of 16 segments, and the
norm of what is left of the segment without its mean. Segments' parts of a distance split in the same way: the means' part
is exact, and the rest is at least the squared difference of the two norms (Cauchy-Schwarz). So compressed vectors and
centroids give a lower bound. A vector's exact distance to the centroid of the least bound comes first; of the others, only
those whose bound doesn't exceed it get exact integer distances. Rounds read the stored vectors without a shuffle; each
task sends one row of sums for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

SIZE, SEGMENTS = 64, 16
CENTROIDS, ROUNDS, SCALE, SEED = 16, 3, 64, 1
#: Integers beyond this could give squared distances that no long holds.
MOST = 1 << 27
#: Rows of a batch that are compared at a time.
CHUNK = 1 << 12


def norms(x: np.ndarray) -> np.ndarray:
    """Each row compressed: its segments' means, scaled to be norms, and the norms of the rest of each segment."""
    parts = x.reshape(len(x), SEGMENTS, SIZE // SEGMENTS).astype(np.float64)
    mean = parts.mean(2)
    rest = parts - mean[..., None]
    return np.hstack([mean * np.sqrt(SIZE // SEGMENTS), np.sqrt(np.einsum("ijk,ijk->ij", rest, rest))])


def bounds(x_norms: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of rows to centroids, with room for rounding."""
    least = np.zeros((len(x_norms), len(c_norms)))
    scale = (x_norms**2).sum(1)[:, None] + (c_norms**2).sum(1)
    for s in range(x_norms.shape[1]):
        least += (x_norms[:, s, None] - c_norms[:, s]) ** 2
    return least - 1e-12 * scale


def nearest(x: np.ndarray, x_norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many exact distances it took."""
    rows, least = np.arange(len(x)), bounds(x_norms, c_norms)
    exact = np.full(least.shape, np.iinfo(np.int64).max)
    start = least.argmin(1)
    exact[rows, start] = ((x - c[start]) ** 2).sum(1)
    open_ = least <= exact[rows, start][:, None]
    open_[rows, start] = False
    for j in range(len(c)):
        at = np.flatnonzero(open_[:, j])
        exact[at, j] = ((x[at] - c[j]) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[rows, cluster], open_.sum(1) + 1


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norms): the kept vectors, as 64 integers and compressed, in bytes."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == SIZE) & ~bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE) * SCALE)
            if len(v) and np.abs(v).max() > MOST:
                raise ArithmeticError(f"a component is beyond {MOST} after scaling: no long holds its squared distances")
            packed = [[row.tobytes() for row in m] for m in (v.astype("<i4"), norms(v))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, pa.binary()) for p in packed]], names=["vec_id", "v", "norms"])

    return materialize(kept.mapInArrow(run, "vec_id long, v binary, norms binary"))


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    v, n = (b"".join(batch.column(j).slice(i, CHUNK).to_pylist()) for j in (1, 2))
    return np.frombuffer(v, "<i4").reshape(-1, SIZE).astype(np.int64), np.frombuffer(n, np.float64).reshape(-1, 2 * SEGMENTS)


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, fewer if there are fewer; equal ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.where("vec_id is not null").select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(-1, SIZE)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of the vectors nearest to each centroid; a centroid without any stays."""
    own = norms(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), SIZE), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                x, n = unpacked(batch, i)
                cluster, _, _ = nearest(x, n, centroids, own)
                np.add.at(total, cluster, x)
                np.add.at(count, cluster, 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    sent = kept.mapInArrow(run, "cluster int, n long, total array<long>")
    sums = sent.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(SIZE)]).alias("total"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = np.array(r.total, np.int64) // r.n
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, exact): ``exact`` is the number of exact distances that the screening left."""
    own = norms(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                cluster, distance, n = nearest(*unpacked(batch, i), centroids, own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, CHUNK), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(n, pa.int32())],
                    names=["vec_id", "cluster", "distance", "exact"],
                )

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long, exact int")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``assigned`` for every kept vector (vec_id, embedding), written, and the final centroids.

    Kept are vectors of exactly 64 components, none null or non-finite. Vectors without vec_id are clustered but never
    start a centroid; if no vector has one, none is clustered. Equal vectors, and repeated rows, are vectors of their own.
    An empty table gives no rows; other columns are ignored. A scaled component beyond 2^27 is an error.
    """
    kept = compressed(vectors)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        kept = kept.limit(0)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    return materialize(assigned(kept, centroids)), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most 16 rows
    rows = [(i, sums.get(i, 0), sum(sums.values()), name) for i, name in names]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS cluster, v FROM (SELECT v, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        d = f"CAST(list_sum(list_transform(generate_series(1, {SIZE}), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS BIGINT)"
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT * FROM (SELECT r, vec_id, a.v, cluster, {d} AS distance FROM v a, c{i} b) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"
        )
        if i < ROUNDS:
            parts.append(
                f"m{i} AS (SELECT cluster, list(m ORDER BY k) AS v FROM (SELECT cluster, k, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT cluster, k, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM d{i}) GROUP BY ALL)) GROUP BY cluster)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM d{ROUNDS} JOIN c{ROUNDS} c USING (cluster)"
    )


SQL = _sql()
