"""Connected components by contraction, without ever holding a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); vertices of one component share one root.

    Each round sends every vertex to the neighbour (or itself) with the smallest hash, relabels the edges and drops
    loops and repeats. The hash order makes chains short, so rounds grow with the logarithm of the longest path. Every
    round's tables are written to the shared folder; minima and distinct rows are combined before the shuffle.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("n"))
        parents = materialize(best.select(F.col("a").alias("v"), F.least(F.col("n"), rank("a"))["v"].alias("p")))
        if labels is None:
            labels = parents.select("v", F.col("p").alias("root"))
        else:
            moved = labels.join(parents.withColumnRenamed("v", "q"), F.col("root") == F.col("q"), "left")
            labels = materialize(moved.select("v", F.coalesce("p", "root").alias("root")))
        to_a = parents.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        to_b = parents.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        edges = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
