"""What used to change or fail with the input's size."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import packing
from hyperloom.operators import hyper


@pytest.mark.parametrize("step", [1, 7, 1_000_000])
def test_pairs_of_blocks_in_steps_against_counting(monkeypatch, step):
    monkeypatch.setattr(hyper, "STEP", step)
    rng = np.random.default_rng(3)
    rows = sorted({(int(m), int(p)) for m, p in zip(rng.integers(0, 8, 90), rng.integers(0, 20, 90), strict=True)})
    member, pack = (np.array(x) for x in zip(*rows, strict=True))
    times, half = rng.integers(1, 4, len(rows)), pack % 2 == 0
    whole = np.ones(len(rows), dtype=bool)
    for left, right in ((half, ~half), (whole, whole)):
        want = Counter()
        for i in np.flatnonzero(left):
            for j in np.flatnonzero(right):
                if member[i] == member[j] and (left is not right or pack[i] < pack[j]):
                    want[int(pack[i]), int(pack[j])] += int(times[i] * times[j])
        got = [(a, b, n) for x in hyper.block_pairs(member, pack, times, left, right) for a, b, n in zip(*(y.tolist() for y in x), strict=True)]
        assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_lengths_are_exact_at_any_number(spark):
    n = packing.BINS + 1000
    found = packing.length_histogram(spark.range(n).select((F.col("id") * 3).alias("length")))
    assert found == [(3 * k, 1) for k in range(n)]
