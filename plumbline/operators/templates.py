"""Class assignment by reference shapes, with a reject class for the rest.

A class table is a handful of reference rows per class. It is broadcast only
when its measured size stays under MAX_TEMPLATE_ROWS; beyond that Spark plans
the join itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.curves import curve_resample

#: Largest template table that is broadcast, in rows (class x bucket).
MAX_TEMPLATE_ROWS = 100_000
#: Most class means that are broadcast as one row.
MAX_CLASSES = 1_000


def _small(templates: DataFrame) -> DataFrame:
    n = templates.limit(MAX_TEMPLATE_ROWS + 1).count()
    return F.broadcast(templates) if n <= MAX_TEMPLATE_ROWS else templates


def shape_vectors(curves: DataFrame, buckets: int = 16) -> DataFrame:
    """Resampled and min-max scaled shape, long form (curve_id, bucket, value)."""
    from pyspark.sql import Window

    w = Window.partitionBy("curve_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    scaled = F.when(hi > lo, (F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0)
    return curve_resample(curves, buckets).select("curve_id", "bucket", scaled.alias("value"))


def template_assign(shapes: DataFrame, templates: DataFrame, tau: float, reject: str = "extra") -> DataFrame:
    """Nearest template class of each shape by mean squared difference over shared buckets.

    Equal distances go to the class that sorts first. A shape farther than
    `tau` from every template, or sharing no bucket with one, gets `reject`
    and is_target false; it is kept, not dropped.
    """
    t = _small(templates).select("class", "bucket", F.col("value").alias("tv"), "is_target")
    d = (
        shapes.join(t, "bucket")
        .groupBy("curve_id", "class", "is_target")
        .agg(F.avg((F.col("value") - F.col("tv")) * (F.col("value") - F.col("tv"))).alias("d"))
    )
    best = d.groupBy("curve_id").agg(F.min(F.struct("d", "class", "is_target")).alias("m"))
    far = F.col("m").isNull() | (F.col("m.d") > F.lit(float(tau)))
    return shapes.select("curve_id").distinct().join(best, "curve_id", "left").select(
        "curve_id",
        F.when(far, F.lit(reject)).otherwise(F.col("m.class")).alias("class"),
        F.when(far, F.lit(False)).otherwise(F.col("m.is_target")).alias("is_target"),
        F.round("m.d", 6).alias("distance"),
    )


def template_assign_by_fold(shapes: DataFrame, labels: DataFrame, tau: float | None = None, reject: str = "extra") -> DataFrame:
    """Nearest class mean of each labelled shape, where the means are those of the other folds only.

    labels: curve_id, class, fold, one row a curve. The mean of a class is
    taken bucket by bucket; distance and ties are as in template_assign. A
    shape farther than tau, or without any class in other folds, gets
    `reject`. Rows without a class or fold learn nothing; those without a fold
    are left out. A mean of the other folds is the total less the own fold's part,
    one row a class, bucket and fold, so folds never meet each other.
    """
    own = shapes.join(labels.select("curve_id", F.col("class").alias("_class"), "fold").where("fold is not null"), "curve_id")
    sums = own.where("_class is not null").groupBy(F.col("_class").alias("nearest"), "bucket", "fold").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    total = sums.groupBy("nearest", "bucket").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    met = own.join(total, "bucket").join(sums, ["nearest", "bucket", "fold"], "left")
    others = F.col("_tn") - F.coalesce("_n", F.lit(0))
    gap = F.col("value") - (F.coalesce("_ts", F.lit(0.0)) - F.coalesce("_s", F.lit(0.0))) / others
    d = met.where(others > 0).groupBy("curve_id", "nearest").agg(F.avg(gap * gap).alias("d"))
    best = d.where("d is not null").groupBy("curve_id").agg(F.min(F.struct("d", "nearest")).alias("m"))
    far = F.col("m").isNull() if tau is None else F.col("m").isNull() | (F.col("m.d") > F.lit(float(tau)))
    return own.select("curve_id", "fold").distinct().join(best, "curve_id", "left").select(
        "curve_id", "fold", F.when(far, F.lit(reject)).otherwise(F.col("m.nearest")).alias("class"), F.round("m.d", 6).alias("distance"))


def nearest_centroid(vectors: DataFrame, id_col: str, vec_col: str, class_col: str) -> DataFrame:
    """Nearest class mean of each dense vector; the class means are learned from the labelled rows.

    Equal distances go to the class that sorts first; null and empty vectors
    have no row. A dimension that the vector or the mean lacks, or has as null,
    adds nothing to a distance.
    """
    long = vectors.where(F.col(class_col).isNotNull()).select(class_col, F.posexplode(vec_col).alias("bucket", "x"))
    means = long.groupBy(class_col, "bucket").agg(F.avg("x").alias("c")).groupBy(F.col(class_col).alias("nearest")).agg(F.array_sort(F.collect_list(F.struct("bucket", "c"))).alias("m"))
    means = means.select("nearest", F.transform("m", lambda s: s["c"]).alias("c"))
    gap = lambda x, c: F.coalesce((x - c) * (x - c), F.lit(0.0))
    to = lambda c: F.aggregate(F.zip_with(vec_col, c, gap), F.lit(0.0), lambda a, d: a + d)
    rows = vectors.where(F.size(vec_col) > 0)
    if means.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES:  # one broadcast row of all means, one row a vector
        table = means.agg(F.collect_list(F.struct("nearest", "c")).alias("_means"))
        near = F.array_min(F.transform("_means", lambda s: F.struct(to(s["c"]).alias("d"), s["nearest"].alias("nearest"))))
        best = rows.join(F.broadcast(table), F.lit(True)).select(id_col, near.alias("m")).where("m is not null")
    else:
        best = rows.join(means, F.lit(True)).select(id_col, F.struct(to(F.col("c")).alias("d"), "nearest").alias("m")).groupBy(id_col).agg(F.min("m").alias("m"))
    return best.select(id_col, F.col("m.nearest").alias("nearest"), F.round("m.d", 4).alias("distance"))


def _dtw(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Banded dynamic time warping cost of each row of a to b; the recurrence runs over all rows at once."""
    n, m = a.shape[1], len(b)
    band = max(band, abs(n - m))
    prev = np.full((m + 1, len(a)), np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        row = np.full((m + 1, len(a)), np.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            row[j] = np.abs(a[:, i - 1] - b[j - 1]) + np.minimum(np.minimum(prev[j - 1], prev[j]), row[j - 1])
        prev = row
    return prev[m]


def dtw_assign(shapes: DataFrame, templates: DataFrame, tau: float, band: int = 3, reject: str = "extra") -> DataFrame:
    """Like template_assign, by time warping inside a band. Each shape is one small array, so batches stay bounded."""
    rows = templates.orderBy("class", "bucket").limit(MAX_TEMPLATE_ROWS + 1).collect()
    if len(rows) > MAX_TEMPLATE_ROWS:
        raise ValueError(f"more than {MAX_TEMPLATE_ROWS} template rows; use template_assign")
    known: dict[str, tuple[bool, list[float]]] = {}
    for r in rows:
        known.setdefault(r["class"], (r["is_target"], []))[1].append(r["value"])
    table = [(c, t, np.asarray(v)) for c, (t, v) in sorted(known.items())]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf.vec.map(len)
            for n in sorted(size.unique()):  # curves of one length together
                own = pdf[size == n]
                a = np.array([np.asarray(v, float) for v in own.vec]).reshape(len(own), n)
                cost = np.stack([_dtw(a, v, band) for _, _, v in table]) if table else np.full((1, len(own)), np.inf)
                best = cost.argmin(0)  # classes are sorted: ties go to the first
                low = cost.min(0)
                near = (low <= tau) & bool(table)
                yield pd.DataFrame({
                    "curve_id": own.curve_id.to_numpy(), "class": [table[k][0] if ok else reject for k, ok in zip(best, near)],
                    "is_target": [bool(table[k][1]) if ok else False for k, ok in zip(best, near)], "distance": np.round(low, 6)})

    packed = shapes.groupBy("curve_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "value"))), lambda s: s["value"]).alias("vec"))
    return packed.mapInPandas(assign, "curve_id bigint, class string, is_target boolean, distance double")
