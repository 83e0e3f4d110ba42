"""Robust trends of curves: Mann-Kendall's test and the Theil-Sen slope, by counting inversions.

Both are statements about all pairs of a curve's samples, but no list of pairs
is needed. A pair falls where the later value is lower: an inversion, counted
by merging sorted halves. A pair's slope is above `low` and at most `high` where
its order by value - low * time is kept and its order by value - high * time is
not, an inversion again; so the middle slopes are closed in on by counting, and
only those of a narrow range are made. The time is that of a few dozen sorts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a range that are made at once, for each sample.
FEW = 64
#: Where the range is cut: not at its middle, lest cuts fall on round slopes that many pairs share.
CUT = 0.4990231
DDL = "curve_id bigint, n bigint, s bigint, z double, slope_per_hour double"


def _levels(v: np.ndarray, ties: bool):  # noqa: ANN202
    """For each size of halves: items in order of their halves, and for each right item its place and the range of left items that are larger (ties: or equal)."""
    n = len(v)
    rank = np.unique(v, return_inverse=True)[1].astype(np.int64)
    at, size = np.arange(n), 1
    while size < n:
        block, side = np.arange(n) // (2 * size), (np.arange(n) // size) % 2
        key = block * (n + 1) + rank[at]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        first = np.searchsorted(key[left], key[right], "left" if ties else "right")
        last = np.searchsorted(key[left], (block[right] + 1) * (n + 1))
        yield at, left, right, first, last
        at = at[np.argsort(key, kind="stable")]
        size *= 2


def inversions(v: np.ndarray, ties: bool = False) -> int:
    """Pairs i < j with v[i] > v[j] (ties: v[i] >= v[j])."""
    return sum(int((last - first).sum()) for *_, first, last in _levels(v, ties))


def inverted_pairs(v: np.ndarray, ties: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that `inversions` counts."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, left, right, first, last in _levels(v, ties):
        k = last - first
        place = np.repeat(first, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        i.append(at[left[place]])
        j.append(at[np.repeat(right, k)])
    return np.concatenate(i), np.concatenate(j)


def ranked_slope(t: np.ndarray, v: np.ndarray, rank: int) -> float:
    """The slope of this rank (from 0) among those of all pairs of samples; times increase.

    Exact, but where more than FEW slopes a sample lie within 1e-12 of each
    other: then to that.
    """
    n = len(t)
    step = np.diff(v) / np.diff(t)
    wide = float(step.max() - step.min()) or 1.0
    low, high = float(step.min()) - wide * 1e-3, float(step.max()) + wide * 1e-3  # every slope is a mean of steps
    below, within = 0, n * (n - 1) // 2
    while within > FEW * n:
        cut = low + (high - low) * CUT
        if not low < cut < high or high - low <= 1e-12 * max(abs(low), abs(high)):
            return low + (high - low) / 2
        k = inversions(v - cut * t, ties=True)  # slopes up to the cut
        if k <= rank:
            low, below, within = cut, k, within - (k - below)
        else:
            high, within = cut, k - below
    order = np.lexsort((-t, v - low * t))  # a slope above low keeps its pair in this order, one up to high turns it
    i, j = (order[x] for x in inverted_pairs((v - high * t)[order], ties=True))
    return float(np.sort((v[j] - v[i]) / (t[j] - t[i]))[rank - below])


def trend(t: np.ndarray, v: np.ndarray) -> tuple[int, float, float | None]:
    """Mann-Kendall's S and z (corrected for equal values and for continuity), and the median slope of all pairs (null for one sample)."""
    n = len(t)
    pairs = n * (n - 1) // 2
    same = np.unique(v, return_counts=True)[1].astype(float)
    s = pairs - 2 * inversions(v) - int((same * (same - 1) / 2).sum())
    var = (n * (n - 1) * (2 * n + 5) - (same * (same - 1) * (2 * same + 5)).sum()) / 18
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    if not pairs:
        return s, z, None
    upper = ranked_slope(t, v, pairs // 2)
    return s, z, upper if pairs % 2 else (upper + ranked_slope(t, v, pairs // 2 - 1)) / 2


def robust_trends(curves: DataFrame) -> DataFrame:
    """Of each curve (curve_id, ts, value): n, Mann-Kendall's s and z, and the Theil-Sen slope per hour.

    Samples at one time count as one, their mean; samples with a null curve,
    time or value are left out. A curve of one sample has s and z 0 and a null
    slope. A curve is sorted in one task.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = curves.where("curve_id is not null and ts is not null and value is not null").groupBy(F.col("curve_id").cast("bigint").alias("curve_id"), us.alias("us")).agg(F.avg("value").alias("v"))

    def run(t: pa.Table) -> pa.Table:
        us, v = t.column("us").to_numpy(), t.column("v").to_numpy()
        order = np.argsort(us)
        s, z, slope = trend((us[order] - us.min()) / 3.6e9, v[order])
        return pa.table({"curve_id": t.column("curve_id").slice(0, 1), "n": pa.array([len(v)], pa.int64()), "s": pa.array([s], pa.int64()), "z": pa.array([round(float(z), 6)]), "slope_per_hour": pa.array([None if slope is None else round(slope, 6)], pa.float64())})

    return rows.groupBy("curve_id").applyInArrow(run, DDL)
