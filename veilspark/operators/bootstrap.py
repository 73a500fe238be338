"""Paired bootstrap over records with Poisson weights, and spread over repeated runs.

The weight of a record in a replicate is a function of seed, record and replicate alone: every configuration sees the
same resample, on any number of partitions and in any engine that has MD5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.score import STATS, ratio

SEED = 42


def poisson_steps() -> list[float]:
    """The Poisson(1) distribution function, as far as a 32-bit uniform number can tell it from one."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
        if 1 - total < 2**-33:
            return out
        k += 1


def weight(seq: Column, b: Column, seed: int = SEED) -> Column:
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), seq, b.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return F.size(F.filter(F.array(*[F.lit(x) for x in poisson_steps()]), lambda c: u >= c))


#: Weights that are drawn at a time, and the longest text of which a digest takes one block.
CHUNK, BLOCK = 1 << 14, 55
#: Shifts of the digest's four rounds.
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(texts: np.ndarray, length: int) -> np.ndarray:
    """First four bytes of the MD5 digests, as big-endian numbers; ``texts``: (n, whole words of bytes), of which ``length`` count.

    Steps write into the five arrays at hand: new ones for each would fall out of the processor's cache.
    """
    texts[:, length] = 0x80
    words = dict(enumerate(np.ascontiguousarray(texts.view("<u4").T)))
    sines = list(map(np.uint32, SINES))
    a, b, c, d = (np.full(len(texts), x, np.uint32) for x in START)
    f = np.empty_like(a)
    for i in range(61):  # the last three steps don't change the first word
        turn, g = TURNS[i // 16][i % 4], (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        a += sines[i] + np.uint32(8 * length) if g == 14 and 14 not in words else sines[i]
        if g in words:
            a += words[g] + np.uint32(8 * length) if g == 14 else words[g]
        np.right_shift(a, np.uint32(32 - turn), out=f)
        a <<= np.uint32(turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(START[0])
    return b.byteswap()


def _poisson(u: np.ndarray) -> np.ndarray:
    """How many of the distribution's steps uniform 32-bit numbers reach."""
    out = np.zeros(u.shape, np.uint8)
    for x in poisson_steps():
        if (least := math.ceil(x * 2**32)) < 2**32:
            out += (u >= np.uint32(least)).view(np.uint8)
    return out


def weight_block(seqs: list[bytes], first: int, last: int, seed: int = SEED) -> np.ndarray:
    """Weights (records x replicates first..last-1) as ``weight`` draws them, many digests at a time."""
    heads = [b"%d-%s-" % (seed, s) for s in seqs]
    u = np.empty((len(seqs), last - first), np.uint32)
    by_length: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        by_length.setdefault(len(h), []).append(i)
    for digits in range(len(str(first)), len(str(last - 1)) + 1):
        lo, hi = max(first, 10 ** (digits - 1) if digits > 1 else 0), min(last, 10**digits)
        numbers = np.array([b"%d" % x for x in range(lo, hi)], f"S{digits}").view(np.uint8).reshape(-1, digits)
        for length, rows in by_length.items():
            if length + digits > BLOCK:
                for r in rows:
                    u[r, lo - first : hi - first] = [int(hashlib.md5(heads[r] + b"%d" % x, usedforsecurity=False).hexdigest()[:8], 16) for x in range(lo, hi)]
                continue
            own = np.frombuffer(b"".join(heads[r] for r in rows), np.uint8).reshape(len(rows), length)
            step = max(1, CHUNK // len(numbers))
            for at in range(0, len(rows), step):
                part = own[at : at + step]
                for k in range(0, len(numbers), CHUNK):
                    texts = np.zeros((len(part), len(numbers[k : k + CHUNK]), (length + digits) // 4 * 4 + 4), np.uint8)
                    texts[:, :, :length] = part[:, None]
                    texts[:, :, length : length + digits] = numbers[k : k + CHUNK]
                    n = texts.shape[1]
                    u[rows[at : at + step], lo - first + k : lo - first + k + n] = _first_words(texts.reshape(-1, texts.shape[2]), length + digits).reshape(-1, n)
    return _poisson(u)


#: Records whose weights are multiplied with their counts at a time, and replicates.
RECORDS, REPLICATES = 256, 2048


def replicate_sums(stats: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(config, b, tipo, weighted sums) of ``stats`` (config, seq, tipo, counts).

    Records are brought together once, whatever the number of replicates; those without any count change no sum and are
    left out first. A task draws blocks of weights (records x replicates), multiplies them with the matrix of the records'
    counts, and sends one row for each configuration, type and replicate in the end. Its memory grows with these, not with
    the records. The sums are those of ``replicate_sums_by_rows``; both leave a replicate out for which no record of the
    configuration and type was drawn. Rows without seq are never drawn; repeated rows count each.
    """
    some = stats.where(" or ".join(f"{c} <> 0" for c in STATS)).where("seq is not null")
    row = F.struct("config", "tipo", *[F.col(c).cast("double").alias(c) for c in STATS])
    record = some.groupBy(F.col("seq").cast("string").alias("seq")).agg(F.collect_list(row).alias("rows"))  # configs x types
    kinds = {c: t for c, t in stats.dtypes if c in ("config", "tipo")}
    schema = f"config {kinds['config']}, b int, tipo {kinds['tipo']}, " + ", ".join(f"{c} long" for c in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS):
                part = batch.slice(at, RECORDS)
                rows, n = part.column(1).flatten(), part.num_rows
                owner = np.repeat(np.arange(n), part.column(1).value_lengths().to_numpy())
                keys = list(zip(rows.field("config").to_pylist(), rows.field("tipo").to_pylist()))
                place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                # One more column counts what was drawn at all.
                counts = np.zeros((n, len(place), len(STATS) + 1))
                values = np.stack([*[rows.field(c).to_numpy() for c in STATS], np.ones(len(rows))], axis=1)
                np.add.at(counts, (owner, [place[k] for k in keys]), values)
                seqs = part.column(0).cast(pa.binary()).to_pylist()
                for b in range(0, replicates, REPLICATES):
                    drawn = weight_block(seqs, b, min(b + REPLICATES, replicates), seed)
                    sums = (drawn.T.astype(np.float64) @ counts.reshape(n, -1)).reshape(-1, *counts.shape[1:])
                    for k, i in place.items():
                        if k not in total:
                            total[k] = np.zeros((replicates, len(STATS) + 1))
                        total[k][b : b + REPLICATES] += sums[:, i]
        for (config, tipo), sums in total.items():
            at = np.flatnonzero(sums[:, -1])
            columns = [pa.array([config] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array([tipo] * len(at), pa.string())]
            columns += [pa.array(sums[at, i].astype(np.int64)) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(columns, names=["config", "b", "tipo", *STATS])

    return record.mapInArrow(run, schema).groupBy("config", "b", "tipo").agg(*[F.sum(c).alias(c) for c in STATS])


def replicate_sums_by_rows(stats: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """The same by a row for each record and replicate, with built-in functions only; for small numbers of replicates."""
    some = stats.where(" or ".join(f"{c} <> 0" for c in STATS)).where("seq is not null")
    record = some.groupBy("seq").agg(F.collect_list(F.struct("config", "tipo", *STATS)).alias("rows"))
    drawn = record.select("seq", "rows", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    drawn = drawn.withColumn("w", weight(F.col("seq"), F.col("b"), seed)).where("w > 0")
    return drawn.select("b", "w", F.explode("rows").alias("r")).groupBy("r.config", "b", "r.tipo").agg(
        *[F.sum(F.col("w") * F.col(f"r.{c}")).cast("long").alias(c) for c in STATS]
    )


def replicate_metrics(sums: DataFrame) -> DataFrame:
    """(config, b, safety, micro_f1); types without gold in a replicate are left out of the mean."""
    g = sums.groupBy("config", "b").agg(
        F.avg(F.when(F.col("gold") > 0, 1 - F.col("leak") / F.col("gold"))).alias("safety"), *[F.sum(c).alias(c) for c in ("tp", "fn", "fp")]
    )
    recall, precision = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return g.select("config", "b", "safety", ratio(2 * recall * precision, recall + precision).alias("micro_f1"))


def _bounds(c: str) -> list[Column]:
    return [F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for q, name in ((0.025, "low"), (0.975, "high"))]


def intervals(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("config").agg(*_bounds("safety"), *_bounds("micro_f1"))


def paired(metrics: DataFrame, order: list[str]) -> DataFrame:
    """(config_a, config_b, metric, mean, low, high, has_zero) for all pairs of the listed configurations."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("config"))
    m = metrics.withColumn("ord", place).where("ord > 0")
    a = m.select("b", *[F.col(c).alias(f"{c}_a") for c in ("config", "ord", "safety", "micro_f1")])
    b = m.select("b", *[F.col(c).alias(f"{c}_b") for c in ("config", "ord", "safety", "micro_f1")])
    both = a.join(b, "b").where("ord_a < ord_b")
    diffs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(f"{c}_a") - F.col(f"{c}_b")).alias("d")) for c in ("safety", "micro_f1")]))
    g = both.select("config_a", "config_b", diffs.alias("x")).groupBy("config_a", "config_b", "x.metric").agg(
        F.avg("x.d").alias("mean"), F.percentile("x.d", F.lit(0.025)).alias("low"), F.percentile("x.d", F.lit(0.975)).alias("high")
    )
    return g.withColumn("has_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def run_spread(runs: DataFrame, metric: str) -> DataFrame:
    """(config, mean, spread): sample deviation over repeated runs, zero for a single one."""
    return runs.groupBy("config").agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("spread"))
