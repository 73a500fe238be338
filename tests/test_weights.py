import tracemalloc

import numpy as np

from veilspark.operators import bootstrap as bs


def test_steps_by_whole_numbers_equal_the_distribution():
    u = np.random.default_rng(1).integers(0, 2**32, 200_000, dtype=np.uint32)
    u[:3] = 0, 2**32 - 1, 2**31
    assert np.array_equal(bs._poisson(u), np.searchsorted(bs.poisson_steps(), u / 2**32, side="right"))


def test_digests_work_in_place():
    """Texts take the words they need, and steps no arrays of their own."""
    seqs = [b"%d" % i for i in range(100_000, 100_064)]
    bs.weight_block(seqs, 100, 300)
    tracemalloc.start()
    bs.weight_block(seqs, 100, 300)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_200_000
