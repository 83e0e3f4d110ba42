"""Per-curve time-series operators over (curve_id, ts, value).

Each shuffles once, on curve_id; a window over the same key reuses that
partitioning. Null values are ignored by the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import hours, micros, ratio, slope


def curve_features(curves: DataFrame) -> DataFrame:
    """Size, range, median, relative time to the (first) peak and slope per hour of each curve.

    A single-point or zero-duration curve has null rel_peak and slope.
    """
    t = curves.where("value is not null").withColumn("us", micros("ts")).withColumn("h", hours("ts"))
    return (
        t.groupBy("curve_id")
        .agg(
            F.count("*").alias("n"),
            F.min("value").alias("v_min"),
            F.max("value").alias("v_max"),
            F.median("value").alias("v_med"),
            F.min("us").alias("t0"),
            F.max("us").alias("t1"),
            F.max_by("us", F.struct(F.col("value"), -F.col("us"))).alias("tp"),
            slope(F.col("value"), F.col("h")).alias("b"),
        )
        .select(
            "curve_id", "n", "v_min", "v_max",
            F.round("v_med", 6).alias("v_median"),
            F.round(ratio(F.col("tp") - F.col("t0"), F.col("t1") - F.col("t0")), 6).alias("rel_peak"),
            F.round("b", 6).alias("slope_per_hour"),
        )
    )


def curve_normalize(curves: DataFrame) -> DataFrame:
    """Min-max scaled value of every sample; null on a constant curve."""
    w = Window.partitionBy("curve_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return curves.select("curve_id", "ts", F.round(ratio(F.col("value") - lo, hi - lo), 6).alias("scaled"))


def curve_resample(curves: DataFrame, buckets: int = 16) -> DataFrame:
    """Mean value in each of `buckets` equal time slices of a curve; empty slices give no row."""
    w = Window.partitionBy("curve_id")
    us = micros("ts")
    rel = ratio(us - F.min(us).over(w), F.max(us).over(w) - F.min(us).over(w))
    b = F.least(F.floor(F.coalesce(rel, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")
    return (
        curves.select("curve_id", b.alias("bucket"), "value")
        .groupBy("curve_id", "bucket")
        .agg(F.round(F.avg("value"), 6).alias("value"))
    )


def curve_daily_grid(curves: DataFrame) -> DataFrame:
    """One row per curve and day from its first to its last sample, with the day's mean (null: no sample)."""
    day = F.to_date("ts")
    daily = curves.groupBy("curve_id", day.alias("day")).agg(F.avg("value").alias("v"))
    span = daily.groupBy("curve_id").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    grid = span.select("curve_id", F.explode(F.sequence("d0", "d1")).alias("day"))
    return grid.join(daily, ["curve_id", "day"], "left").select("curve_id", "day", F.round("v", 6).alias("value"))


def curve_ffill(curves: DataFrame) -> DataFrame:
    """Daily grid with gaps filled by the last known day."""
    w = Window.partitionBy("curve_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return curve_daily_grid(curves).select(
        "curve_id", "day", F.last_value("value", True).over(w).alias("value"))


def rolling_rows(curves: DataFrame, preceding: int = 4) -> DataFrame:
    """Mean over the sample and the `preceding` ones before it (ties in ts broken by value)."""
    w = Window.partitionBy("curve_id").orderBy("ts", "value").rowsBetween(-preceding, 0)
    return curves.select("curve_id", "ts", "value", F.round(F.avg("value").over(w), 6).alias("rolling"))


def rolling_range(curves: DataFrame, days: int = 1) -> DataFrame:
    """Mean over the samples of the `days` before and including a sample."""
    w = Window.partitionBy("curve_id").orderBy(micros("ts")).rangeBetween(-days * 86_400_000_000, 0)
    return curves.select("curve_id", "ts", "value", F.round(F.avg("value").over(w), 6).alias("rolling"))


def sessionize_gaps(curves: DataFrame, gap_hours: float = 12.0) -> DataFrame:
    """Split each curve where two samples lie more than `gap_hours` apart; one row per piece."""
    w = Window.partitionBy("curve_id").orderBy("ts")
    us = micros("ts")
    new = F.when(us - F.lag(us).over(w) > F.lit(int(gap_hours * 3.6e9)), 1).otherwise(0)
    return (
        curves.withColumn("new", new)
        .withColumn("session", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("bigint"))
        .groupBy("curve_id", "session")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
