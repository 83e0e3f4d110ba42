"""Time warping with lower bounds, and class templates as barycentres under it.

Warped distances (a band around the diagonal, summed squared differences) cost
the square of a curve's length, so a cascade of bounds comes first: the ends
must be matched with each other, and every value of a curve with one inside the
template's envelope. A template is compared in full only where its bound does
not exceed the best distance so far, nearest bounds first; the result is the
same as with all comparisons.

A barycentre of a class is renewed by aligning its members with it and taking
the mean of the values aligned with each place: one pass over the curves a
round, with sums by fold, class and place, so all folds' templates come from
the same passes and each fold's from the other folds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import written

#: Largest number of values of all templates (folds x classes x length), which meet on the driver.
MAX_VALUES = 1_000_000
Templates = list[tuple[str, np.ndarray]]


def costs(x: np.ndarray, t: np.ndarray, band: int) -> np.ndarray:
    """Cumulated costs (length of x + 1, length of t + 1, rows) of aligning each row of x with t; infinite outside the band."""
    n, m = x.shape[1], len(t)
    band = max(band, abs(n - m))
    d = np.full((n + 1, m + 1, len(x)), np.inf)
    d[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            d[i, j] = (x[:, i - 1] - t[j - 1]) ** 2 + np.minimum(np.minimum(d[i - 1, j - 1], d[i - 1, j]), d[i, j - 1])
    return d


def warped(x: np.ndarray, t: np.ndarray, band: int) -> np.ndarray:
    """The warped distance of each row of x to t."""
    n, m = x.shape[1], len(t)
    band = max(band, abs(n - m))
    prev = np.full((m + 1, len(x)), np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        row = np.full((m + 1, len(x)), np.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            row[j] = (x[:, i - 1] - t[j - 1]) ** 2 + np.minimum(np.minimum(prev[j - 1], prev[j]), row[j - 1])
        prev = row
    return prev[m]


def envelope(t: np.ndarray, n: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of t that each of n places may be aligned with."""
    band = max(band, abs(n - len(t)))
    own = [t[max(0, i - band) : min(len(t), i + band + 1)] for i in range(n)]
    return np.array([v.min() for v in own]), np.array([v.max() for v in own])


def lower_bounds(x: np.ndarray, t: np.ndarray, band: int) -> np.ndarray:
    """What each row's warped distance to t is at least: its values outside the envelope, and the two ends matched as they must be."""
    low, high = envelope(t, x.shape[1], band)
    out = np.maximum(np.maximum(low - x, x - high), 0.0) ** 2
    out[:, 0] = np.maximum(out[:, 0], (x[:, 0] - t[0]) ** 2)
    out[:, -1] = np.maximum(out[:, -1], (x[:, -1] - t[-1]) ** 2)
    return out.sum(1)


def nearest_warped(x: np.ndarray, templates: Templates, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest template of each row (ties: the first), its distance, and how many were compared in full."""
    bound = np.stack([lower_bounds(x, t, band) for _, t in templates], axis=1)
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(x))
    best, who, full = np.full(len(x), np.inf), np.full(len(x), len(templates)), np.zeros(len(x), np.int64)
    for k in range(len(templates)):
        of = order[:, k]
        # a little slack: a bound and a distance that are equal may differ in their last digits
        live = bound[rows, of] <= best * (1 + 1e-12) + 1e-12
        for c in np.unique(of[live]):
            own = np.flatnonzero(live & (of == c))
            d = warped(x[own], templates[c][1], band)
            full[own] += 1
            better = (d < best[own]) | ((d == best[own]) & (c < who[own]))
            best[own[better]], who[own[better]] = d[better], c
    return who, best, full


def aligned_sums(x: np.ndarray, t: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values aligned with each place of t, over the rows of x (of equal paths: diagonal, then along x)."""
    d = costs(x, t, band)
    i, j = np.full(len(x), x.shape[1]), np.full(len(x), len(t))
    total, count, rows = np.zeros(len(t)), np.zeros(len(t)), np.arange(len(x))
    while len(rows):
        a, b = i[rows], j[rows]
        np.add.at(total, b - 1, x[rows, a - 1])
        np.add.at(count, b - 1, 1)
        step = np.stack([d[a - 1, b - 1, rows], d[a - 1, b, rows], d[a, b - 1, rows]]).argmin(0)
        i[rows], j[rows] = a - (step < 2), b - (step != 1)
        rows = rows[(i[rows] > 0) & (j[rows] > 0)]
    return total, count


def packed_shapes(shapes: DataFrame) -> DataFrame:
    """(curve_id, vec) of shapes (curve_id, bucket, value): the values that are not null, in order of bucket."""
    known = shapes.where("bucket is not null and value is not null")
    return known.groupBy("curve_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "value"))), lambda s: s["value"].cast("double")).alias("vec"))


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their values."""
    size = np.diff(col.offsets.to_numpy())
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        yield rows, col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def assign_warped(vectors: DataFrame, templates: Templates, band: int = 3) -> DataFrame:
    """curve_id, class, distance and compared of each row of vectors (curve_id, vec): the nearest template, and how many were compared in full.

    Equal distances go to the template that comes first; without templates
    class and distance are null.
    """
    kind = vectors.schema["curve_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, dist, full = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            for rows, x in _by_length(b.column(1)) if templates else ():
                who, best, full[rows] = nearest_warped(x, templates, band)
                name[rows], dist[rows] = [templates[k][0] for k in who], np.round(best, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name.tolist(), pa.string()), pa.array(dist.tolist(), pa.float64()), pa.array(full)], ["curve_id", "class", "distance", "compared"])

    return vectors.select("curve_id", "vec").mapInArrow(run, f"curve_id {kind}, class string, distance double, compared bigint")


def barycenters(rows: DataFrame, length: int, rounds: int = 3, band: int = 3) -> dict[int, Templates]:
    """For each fold the barycentre of each class over the other folds: rows has vec, class and fold, none of them null.

    A centre starts as the mean of the members that have `length` values (a
    class without such a member in the other folds has no template).
    """
    cells = rows.where(F.size("vec") == length).select("fold", "class", F.posexplode("vec").alias("at", "x"))
    start = cells.groupBy("fold", "class", "at").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())  # a row a fold

    def renewed(table: DataFrame, of_others: bool) -> dict[int, Templates]:
        """Means by fold: of the sums of all other folds, or of those already made for a fold."""
        got = table.collect()  # a row a fold, class and place
        names = sorted({r["class"] for r in got})
        at = {c: k for k, c in enumerate(names)}
        if len(folds) * len(names) * length > MAX_VALUES:
            raise ValueError(f"templates of {len(folds)} folds and {len(names)} classes have more than {MAX_VALUES} values")
        sums = {f: np.zeros((2, len(names), length)) for f in folds}
        for r in got:
            sums[r["fold"]][:, at[r["class"]], r["at"]] += r["s"], r["n"]
        if of_others:
            whole = sum(sums.values(), np.zeros((2, len(names), length)))
            sums = {f: whole - own for f, own in sums.items()}
        return {f: [(c, sums[f][0, k] / sums[f][1, k]) for c, k in at.items() if (sums[f][1, k] > 0).all()] for f in folds}

    known = renewed(start, True)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(known)  # MAX_VALUES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, str], np.ndarray] = {}
            for b in batches:
                fold, cls = b.column(1).to_numpy(), np.array(b.column(2).to_pylist(), object)
                for at, x in _by_length(b.column(0)):
                    for f, templates in shared.value.items():  # noqa: B023
                        for c, t in templates:
                            own = (fold[at] != f) & (cls[at] == c)
                            if own.any():
                                sums.setdefault((f, c), np.zeros((2, length)))[:] += aligned_sums(x[own], t, band)
            for (f, c), v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([f] * length, pa.int32()), pa.array([c] * length), pa.array(np.arange(length, dtype=np.int32)), pa.array(v[0]), pa.array(v[1].astype(np.int64))], ["fold", "class", "at", "s", "n"])

        sums = rows.select("vec", F.col("fold").cast("int"), "class").mapInArrow(run, "fold int, class string, at int, s double, n bigint")
        known = renewed(sums.groupBy("fold", "class", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), False)
    return known


def warped_by_fold(shapes: DataFrame, labels: DataFrame, length: int = 16, rounds: int = 3, band: int = 3) -> DataFrame:
    """Nearest class barycentre of each labelled curve, learned from the other folds: curve_id, fold, label, prediction, distance, compared.

    labels: curve_id, class and fold, one row a curve. Rows without a fold are
    left out; rows without a class learn nothing. A curve beside which no
    class has a template has a null prediction.
    """
    named = labels.where("fold is not null").select("curve_id", F.col("class").cast("string").alias("class"), F.col("fold").cast("int").alias("fold"))
    rows = written(packed_shapes(shapes).join(named, "curve_id"), "warped")
    known = barycenters(rows.where("class is not null"), length, rounds, band)
    out = None
    for f in sorted(r[0] for r in rows.select("fold").distinct().collect()):  # a row a fold
        own = assign_warped(rows.where(F.col("fold") == f), known.get(f, []), band).withColumn("fold", F.lit(f))
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = assign_warped(rows, [], band).withColumn("fold", F.lit(None).cast("int"))
    return out.join(rows.select("curve_id", F.col("class").alias("label")), "curve_id").select("curve_id", "fold", "label", F.col("class").alias("prediction"), "distance", "compared")
