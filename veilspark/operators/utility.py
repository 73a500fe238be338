"""Utility metrics, reconciliation with earlier results, and replays of a changed detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.detectors import Detector, may_hold, stage1
from veilspark.functions.textnorm import kept_length
from veilspark.operators.score import ratio, scores_by_type, summary, totals

TOLERANCE = 5e-4


def retention(outputs: DataFrame, before: str = "text", after: str = "redacted") -> DataFrame:
    """(config, retention, replaced_share): mean share of characters kept, over records that had any."""
    kept = F.least(F.lit(1.0), kept_length(F.col(after)) / F.length(before))
    some = outputs.where(F.length(before) > 0)
    return some.groupBy("config").agg(F.avg(kept).alias("retention"), F.avg(1 - kept).alias("replaced_share"))


def utility_table(sums: DataFrame, kept: DataFrame) -> DataFrame:
    s = summary(sums)
    over = ratio(F.col("fp"), F.col("tp") + F.col("fp"))
    return s.join(kept, "config").select("config", "macro_safety", "micro_f1", "micro_precision", "tp", "fp", over.alias("over_removal"), "replaced_share", "retention")


def reconcile_points(points: DataFrame, frozen: DataFrame, metric: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(config, value, frozen, state): ok within the tolerance, else or without a frozen value diverges."""
    f = frozen.select("config", F.col(metric).alias("frozen"))
    near = F.coalesce(F.abs(F.col(metric) - F.col("frozen")) < tolerance, F.lit(False))
    return points.join(f, "config", "left").select("config", F.col(metric).alias("value"), "frozen", F.when(near, "ok").otherwise("diverges").alias("state"))


def reconcile_counts(sums: DataFrame, frozen: DataFrame) -> DataFrame:
    """(config, state, differing): whether tp, fn and fp of every type equal the frozen ones, and how many types differ."""
    f = frozen.select("config", "tipo", *[F.col(c).alias(f"f_{c}") for c in ("tp", "fn", "fp")])
    same = F.lit(True)
    for c in ("tp", "fn", "fp"):
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    j = sums.join(f, ["config", "tipo"], "left").withColumn("same", same)
    g = j.groupBy("config").agg(F.count("f_tp").alias("known"), F.sum((~F.col("same")).cast("long")).alias("differing"))
    return g.select("config", F.when(F.col("known") == 0, "no file").when(F.col("differing") == 0, "ok").otherwise("diverges").alias("state"), "differing")


def tradeoff(utility: DataFrame, bounds: DataFrame, order: list[str]) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, order)), F.col("config")).cast("int")
    return utility.join(bounds, "config").select(place.alias("ord"), "config", "macro_safety", "safety_low", "safety_high", "retention").where("ord > 0")


def replayed(outputs: DataFrame, old: tuple[Detector, ...], new: tuple[Detector, ...]) -> DataFrame:
    """Stored ``outputs`` (seq, text, captures, ...) as if ``new`` detectors had made their captures instead of ``old``.

    Only texts in which a changed detector can match at all, by its gate, go through the chain again, each once for all
    configurations that hold it; all others keep what is stored, and so does everything else of the record. Records are
    told apart by id and text, so repeated and null ids are safe. Stored entities are not looked up again. If detectors
    that both lists have change their order, all of them count as changed.
    """
    both = set(old) & set(new)
    moved = [d for d in old if d in both] != [d for d in new if d in both]
    changed = tuple(set(old) | set(new)) if moved else tuple(set(old) ^ set(new))
    mark = lambda df: df.withColumn("__hash", F.xxhash64("text"))
    touched = mark(outputs.where(may_hold(F.col("text"), changed)).select("seq", "text")).dropDuplicates(["seq", "text"])
    again = stage1(touched, "text", "__redacted", "__captures", new).select(F.col("seq").alias("__seq"), F.col("__hash").alias("__same"), F.col("text").alias("__text"), "__captures")
    own = mark(outputs)
    same = own["seq"].eqNullSafe(again["__seq"]) & (own["__hash"] == again["__same"]) & (own["text"] == again["__text"])
    kept = [F.coalesce("__captures", "captures").alias("captures") if c == "captures" else own[c] for c in outputs.columns]
    return own.join(again, same, "left").select(*kept)


def replay_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per version of a replayed detector, from the two versions' record stats."""

    def row(stats: DataFrame, name: str) -> DataFrame:
        sums = totals(stats)
        place = sums.where("tipo = 'local'").select("config", F.col("leak").alias("leak_local"), (1 - ratio(F.col("leak"), F.col("gold"))).alias("removed_local"))
        s = summary(sums).select("config", "macro_safety", "micro_f1", "micro_precision", F.col("leak").alias("leak_total"))
        return s.join(place, "config").select(F.lit(name).alias("version"), "*")

    return row(before, "frozen").unionByName(row(after, "corrected"))


def replay_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Types whose leaks or misses changed."""
    a = totals(before).select("config", "tipo", F.col("leak").alias("leak_before"), F.col("fn").alias("fn_before"))
    b = totals(after).select("config", "tipo", F.col("leak").alias("leak_after"), F.col("fn").alias("fn_after"))
    return a.join(b, ["config", "tipo"]).where("leak_before <> leak_after or fn_before <> fn_after")


__all__ = ["retention", "utility_table", "reconcile_points", "reconcile_counts", "tradeoff", "replayed", "replay_table", "replay_changes", "scores_by_type"]
