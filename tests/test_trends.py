import datetime as dt
import itertools
import random

import numpy as np

from plumbline.operators import trends
from plumbline.operators.trends import inversions, inverted_pairs, ranked_slope, robust_trends, trend


def all_slopes(t, v):
    return sorted((v[j] - v[i]) / (t[j] - t[i]) for i, j in itertools.combinations(range(len(t)), 2))


def test_inversions_are_the_pairs_out_of_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 65):
        for ties in (False, True):
            v = rng.integers(0, max(2, n // 2), n).astype(float)
            want = {(i, j) for i in range(n) for j in range(i + 1, n) if v[i] > v[j] or (ties and v[i] == v[j])}
            i, j = inverted_pairs(v, ties)
            assert inversions(v, ties) == len(want) == len(i) and set(zip(i.tolist(), j.tolist())) == want


def test_median_slope_equals_that_of_all_pairs(monkeypatch):
    monkeypatch.setattr(trends, "FEW", 1)  # so that ranges are narrowed
    rng = random.Random(1)
    for _ in range(120):
        n = rng.randrange(2, 60)
        t = np.array(sorted(rng.sample(range(1000), n)), float) / 7
        kind = rng.randrange(4)
        v = np.array([rng.gauss(0, 3) if kind == 0 else rng.randrange(3) if kind == 1 else 2.5 if kind == 2 else 0.3 * x + rng.choice([0, 0, 0, 9]) for x in t], float)
        every = all_slopes(t, v)
        for rank in {0, len(every) // 2, len(every) - 1, rng.randrange(len(every))}:
            assert abs(ranked_slope(t, v, rank) - every[rank]) < 1e-9
        s, _, slope = trend(t, v)
        assert abs(slope - np.median(every)) < 1e-9 and s == sum(np.sign(x) for x in every)


def test_long_curve_takes_sorts_not_pairs():
    import time

    rng = np.random.default_rng(3)
    t = np.cumsum(rng.random(200_000) + 0.01)
    v = 0.25 * t + rng.normal(size=len(t)) * 50
    v[::10] += 10_000  # a tenth is far off
    began = time.time()
    s, z, slope = trend(t, v)
    assert abs(slope - 0.25) < 0.01 and z > 100 and time.time() - began < 60  # of 2 * 10^10 pairs


def test_odd_curves(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(hours=m)
    rows = [(1, at(0), 5.0), (2, at(0), 1.0), (2, at(0), 3.0), (2, at(2), 6.0), (3, at(1), 4.0), (3, at(2), 4.0), (3, at(3), 4.0), (4, None, 1.0), (None, at(1), 1.0), (5, at(1), None), (6, at(5), 1.0), (6, at(1), 3.0), (6, at(3), 2.0)]
    df = spark.createDataFrame(rows, "curve_id long, ts timestamp_ntz, value double")
    got = {r.curve_id: (r.n, r.s, r.slope_per_hour) for r in robust_trends(df).collect()}
    assert got == {1: (1, 0, None), 2: (2, 1, 2.0), 3: (3, 0, 0.0), 6: (3, -3, -0.5)}
    assert robust_trends(df.limit(0)).count() == 0
