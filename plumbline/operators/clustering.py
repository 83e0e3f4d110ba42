"""Clusters of curve shapes that do not depend on a shift in time: k-Shape, with its distance and assignment.

The distance of two scaled shapes x and y is 1 - max over shifts s of
sum x[i] * y[i - s] / (|x| |y|): 0 for the same shape, up to a shift, and at
most 2. A cluster's centre is the unit shape that its members, shifted onto the
centre before, agree with best: the first eigenvector of their scatter matrix.
Tasks add up the scatter matrices of their own curves, one matrix a cluster, so
a round is one pass over the shapes and one small reduction; only matrices
(clusters x slices^2) and centres reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import written

#: Largest number of cells of all scatter matrices, which meet on the driver (8 bytes each).
MAX_CELLS = 4_000_000


def scaled_shapes(shapes: DataFrame, buckets: int = 16) -> DataFrame:
    """(curve_id, vec) of shapes (curve_id, bucket, value): an array of `buckets` values of mean 0 and deviation 1.

    A slice without a value, or with a null one, has the curve's mean, 0. A
    constant curve is all zeros. Slices outside 0 .. buckets - 1 are left out.
    """
    own = shapes.where(F.col("bucket").between(0, buckets - 1)).groupBy("curve_id").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_d"), F.map_from_entries(F.array_agg(F.struct("bucket", "value"))).alias("_v"))
    at = lambda b: F.element_at("_v", b.cast("int"))
    z = lambda b: F.when(F.col("_d") > 1e-12, F.coalesce((at(b) - F.col("_m")) / F.col("_d"), F.lit(0.0))).otherwise(F.lit(0.0))
    return own.select("curve_id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), z).alias("vec"))


def correlations(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best normed cross-correlation of each row of x with each centre (0 where one is all zeros), and the shift that brings x onto it.

    Among equal correlations the shift that is smallest in size wins, then the one to the left.
    """
    m = x.shape[1]
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centers, axis=1)[None, :]
    best, shift = np.full((len(x), len(centers)), -np.inf), np.zeros((len(x), len(centers)), np.int64)
    for s in sorted(range(1 - m, m), key=lambda s: (abs(s), s)):
        c = x[:, max(0, -s) : m - max(0, s)] @ centers[:, max(0, s) : m - max(0, -s)].T
        more = c > best + 1e-12
        best, shift = np.where(more, c, best), np.where(more, s, shift)
    return np.divide(best, norm, out=np.zeros_like(best), where=norm > 1e-12), shift


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (ties, up to 1e-12: the first), distance and shift of each row of x."""
    c, shift = correlations(x, centers)
    k = (c >= c.max(1, keepdims=True) - 1e-12).argmax(1)
    at = np.arange(len(x))
    return k, 1 - c[at, k], shift[at, k]


def shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Each row moved right by its shift (left if negative), zeros moving in."""
    m = x.shape[1]
    at = np.arange(m)[None, :] - shift[:, None]
    return np.where((at >= 0) & (at < m), np.take_along_axis(x, np.clip(at, 0, m - 1), 1), 0.0)


def center_of(scatter: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The unit shape of mean 0 with the largest sum of squared agreements, on the side of the members' mean."""
    m = len(scatter)
    q = np.eye(m) - 1.0 / m
    _, v = np.linalg.eigh(q @ scatter @ q)
    c = v[:, -1]
    towards = c @ mean
    if towards < -1e-12 or (abs(towards) <= 1e-12 and c[np.abs(c).argmax()] < 0):
        c = -c
    return c


@dataclass(frozen=True)
class Shapes:
    """Centres of clusters, one a row; an empty cluster that never had a member is all zeros."""

    centers: np.ndarray
    rounds: int
    settled: bool

    def assign(self, vectors: DataFrame) -> DataFrame:
        """curve_id, cluster, distance and shift of each row of vectors (curve_id, vec): the nearest centre, the first among equal ones."""
        centers = self.centers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, d, s = nearest(_matrix(b.column(1), centers.shape[1]), centers)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k.astype(np.int32)), pa.array(np.round(d, 6)), pa.array(s.astype(np.int32))], ["curve_id", "cluster", "distance", "shift"])

        kind = vectors.schema["curve_id"].dataType.simpleString()
        return vectors.select("curve_id", "vec").mapInArrow(run, f"curve_id {kind}, cluster int, distance double, shift int")


def _matrix(col: pa.Array, m: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def _round(vectors: DataFrame, k: int, m: int, first: Column | None, now: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Scatter matrices, sums and sizes of the clusters, and how many curves changed theirs; a row a cluster and task is reduced."""
    given = first is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((k, m * m + m + 2))  # scatter matrix, sum, size, moved
        for b in batches:
            x = _matrix(b.column(0), m)
            if given:
                at, shift, moved = b.column(1).to_numpy(), np.zeros(len(x), np.int64), np.ones(len(x), bool)
            else:
                at, _, shift = nearest(x, now)
                moved = np.ones(len(x), bool) if before is None else nearest(x, before)[0] != at
            y = shifted(x, shift)
            for c in np.unique(at):
                own = y[at == c]
                cells[c] += np.concatenate([(own.T @ own).ravel(), own.sum(0), [len(own), moved[at == c].sum()]])
        some = np.flatnonzero(cells[:, -2])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells[some].tolist(), pa.list_(pa.float64()))], ["cluster", "cells"])

    rows = vectors.select("vec", *([first.alias("first")] if given else [])).mapInArrow(run, "cluster int, cells array<double>")
    cells = rows.select("cluster", F.posexplode("cells").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    packed = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.array_agg(F.struct("at", "x"))), lambda c: c["x"]).alias("cells"))
    out = np.zeros((k, m * m + m + 2))
    for r in packed.collect():  # a row a cluster
        out[r["cluster"]] = r["cells"]
    return out[:, : m * m].reshape(k, m, m), out[:, m * m : -2], out[:, -2], int(out[:, -1].sum())


def k_shape(vectors: DataFrame, k: int, rounds: int = 20) -> Shapes:
    """Centres of k clusters of vectors (curve_id, vec, all of one length).

    Curves start in clusters by a hash of their id, so a run can be repeated.
    A round moves each curve to its nearest centre and renews the centres; it
    ends when no curve moves, or after `rounds`. A cluster that loses all its
    members keeps its centre. No curves: all centres are zero.
    """
    vectors = written(vectors.select("curve_id", "vec"), "shapes")
    head = vectors.first()
    m = len(head["vec"]) if head else 1
    if k * m * m > MAX_CELLS:
        raise ValueError(f"{k} clusters of {m} slices need more than {MAX_CELLS} matrix cells")
    start = F.pmod(F.xxhash64("curve_id"), F.lit(k)).cast("int")
    now, before, done = np.zeros((k, m)), None, 0
    if not head:
        return Shapes(now, 0, True)
    while done < rounds:
        scatter, total, size, moved = _round(vectors, k, m, start if not done else None, now, before)
        if done > 1 and not moved:
            return Shapes(now, done, True)
        before = now if done else None
        now = np.stack([center_of(scatter[c], total[c]) if size[c] else now[c] for c in range(k)])
        done += 1
    return Shapes(now, done, False)


def shape_clusters(shapes: DataFrame, k: int, buckets: int = 16, rounds: int = 20) -> DataFrame:
    """curve_id, cluster, distance and shift of every curve of shapes (curve_id, bucket, value), by k-Shape over them."""
    vectors = scaled_shapes(shapes, buckets)
    return k_shape(vectors, k, rounds).assign(vectors)
