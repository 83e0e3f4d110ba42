import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import sketches
from plumbline.operators.segments import ChangePoints, change_points

T0 = dt.datetime(2024, 1, 1)


def unpruned(v, penalty):
    """The recursion over all starts."""
    n = len(v)
    t, s = np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0.0], np.cumsum(np.square(v))])
    cost = lambda a, z: max(0.0, s[z] - s[a] - (t[z] - t[a]) * (t[z] - t[a]) / (z - a))
    best, back = [0.0], [0]
    for z in range(1, n + 1):
        each = [best[a] + cost(a, z) for a in range(z)]
        best.append(min(each) + penalty)
        back.append(each.index(min(each)))
    cuts, z = [], n
    while z:
        cuts.append((back[z], z))
        z = back[z]
    return best[-1], cuts[::-1]


def curve(rng, n):
    v, level = [], 0.0
    for _ in range(n):
        if rng.random() < 0.08:
            level = rng.gauss(0, 5)
        v.append(round(level + rng.gauss(0, 0.5), 3))
    return v


def test_pruned_recursion_equals_the_whole_one():
    rng = random.Random(1)
    for _ in range(60):
        v, penalty = curve(rng, rng.randrange(1, 90)), rng.choice([0.1, 2.0, 30.0])
        p = ChangePoints()
        held = 0
        for k, x in enumerate(v):
            p.eval({"curve_id": 7, "us": k, "value": x}, penalty)
            held = max(held, len(p.starts))
        low, cuts = unpruned(v, penalty)
        got = list(p.terminate())
        assert abs(p.best[-1] - low) < 1e-6 and [(r[2], r[3] + 1) for r in got] == cuts and sum(r[4] for r in got) == len(v)


def test_segments_of_many_curves(spark):
    rng = random.Random(3)
    curves = {i: curve(rng, rng.randrange(1, 120)) for i in range(25)}
    rows = [(i, T0 + dt.timedelta(minutes=k), x) for i, v in curves.items() for k, x in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (3, None, 1.0), (None, T0, 1.0), (4, T0, None)], "curve_id long, ts timestamp_ntz, value double").repartition(7)
    got = {}
    for r in change_points(df, 4.0).orderBy("curve_id", "segment").collect():
        got.setdefault(r.curve_id, []).append((r.first_ts, r.last_ts, r.n))
    want = {i: [(T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=z - 1), z - a) for a, z in unpruned(v, 4.0)[1]] for i, v in curves.items()}
    assert got == want and max(map(len, got.values())) > 3
    assert change_points(df.limit(0), 4.0).count() == 0


def test_merged_sketches_equal_direct_ones_within_their_bounds(spark):
    rng = random.Random(5)
    rows = [(i, T0 + dt.timedelta(hours=rng.randrange(24 * 40)), round(rng.gauss(i, 3), 2)) for i in range(3) for _ in range(4000)] + [(9, T0, 2.5), (1, T0, None), (1, None, 3.0)]
    df = spark.createDataFrame(rows, "curve_id long, ts timestamp_ntz, value double").repartition(5)
    days = sketches.daily_sketches(df)
    up = {r.curve_id: r for r in sketches.estimates(sketches.merged(sketches.merged(days.withColumn("month", F.month("day")), ["curve_id", "month"]), ["curve_id"]), ["curve_id"]).collect()}
    known = df.where("ts is not null")
    direct = {r.curve_id: r for r in sketches.estimates(sketches.sketched(known, ["curve_id"]), ["curve_id"]).collect()}
    assert set(up) == set(direct) == {0, 1, 2, 9}
    for i, r in up.items():
        v = sorted(x for j, t, x in rows if j == i and t and x is not None)
        assert (r.n, r.low, r.high) == (len(v), v[0], v[-1]) == (direct[i].n, direct[i].low, direct[i].high)
        assert abs(r.n_distinct / len(set(v)) - 1) < 4 * 1.04 / 2**6 and r.n_distinct == direct[i].n_distinct
        for rank in (0.1, 0.5, 0.9):
            for q in (r[f"q{round(100 * rank)}"], direct[i][f"q{round(100 * rank)}"]):
                a, z = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
                assert a - 0.0266 <= rank <= z + 0.0266  # twice the bound, for the many that are tried
