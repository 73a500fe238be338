import hashlib
import time

import numpy as np

from veilspark.operators import bootstrap as bs
from veilspark.operators.score import STATS


def plain_weight(seq, b, seed=42):
    u = int(hashlib.md5(f"{seed}-{seq}-{b}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= x for x in bs.poisson_steps())


def test_weights_by_definition():
    seqs = ["1", "22", "çé", "", "x" * 49, "x" * 52, "y" * 200]
    for first, last in ((0, 12), (98, 103), (9_998, 10_002)):
        got = bs.weight_block([s.encode() for s in seqs], first, last)
        want = [[plain_weight(s, b) for b in range(first, last)] for s in seqs]
        assert np.array_equal(got, want)


def records(spark, n):
    rng = np.random.default_rng(3)
    rows = [(c, str(s), t, *map(int, rng.integers(0, 3, len(STATS)))) for s in range(n) for c in ("a", "b") for t in ("nome", "local")]
    rows += [("a", "0", "nome", *[1] * len(STATS)), ("a", None, "nome", *[5] * len(STATS)), ("c", "7", "placa", *[0] * len(STATS))]
    return spark.createDataFrame(rows, "config string, seq string, tipo string, " + ", ".join(f"{c} long" for c in STATS))


def test_blocks_equal_rows(spark):
    stats = records(spark, 150)
    both = [sorted(map(tuple, f(stats, 200).select("config", "b", "tipo", *STATS).collect())) for f in (bs.replicate_sums, bs.replicate_sums_by_rows)]
    assert len(both[0]) > 700
    # Rows without a record are drawn by neither.
    assert both[0] == both[1]


def test_empty(spark):
    assert bs.replicate_sums(records(spark, 0).limit(0), 50).isEmpty()


def test_ten_thousand_replicates(spark):
    stats = records(spark, 400)
    began = time.time()
    metrics = bs.replicate_metrics(bs.replicate_sums(stats, 10_000))
    rows = {r.config: r for r in bs.intervals(metrics).collect()}
    assert time.time() - began < 60
    assert set(rows) == {"a", "b"} and rows["a"].micro_f1_low < rows["a"].micro_f1_high
