"""Structured Streaming forms of the curve operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_curves(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet folder as a stream; a zone-less time becomes a timestamp, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_features(curves: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, range and mean of each curve per time window.

    In append mode a window appears once the watermark has passed its end, so
    the last windows of a finished input stay unemitted.
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    if curves.isStreaming:
        curves = curves.withWatermark("ts", late)
    return (
        curves.groupBy("curve_id", w.alias("w"))
        .agg(F.count("*").alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"))
        .select("curve_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "v_min", "v_max", F.round("v_mean", 6).alias("v_mean"))
    )


def sessions(curves: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Activity periods of each curve, closed after a gap."""
    if curves.isStreaming:
        curves = curves.withWatermark("ts", late)
    return (
        curves.groupBy("curve_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("curve_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.round("total", 6).alias("total"))
    )


def matched_streams(left: DataFrame, right: DataFrame, key: str, before: str = "1 hour", after: str = "0 seconds", late: str = "1 hour") -> DataFrame:
    """Rows of left with rows of right of the same key, at `right_ts` from `before` earlier to `after` later than ts.

    Both have ts (timestamp) and key; the other columns of right must not be
    named as columns of left. On streams each side waits `late` for late rows
    and keeps a row only while the other side's watermark can still meet it,
    so state is bounded by the rows of before + after + late. Null times and
    keys match nothing.
    """
    r = right.withColumnsRenamed({"ts": "right_ts", key: "_key"})
    if left.isStreaming:
        left = left.withWatermark("ts", late)
    if right.isStreaming:
        r = r.withWatermark("right_ts", late)
    near = (F.col("right_ts") >= F.col("ts") - F.expr(f"interval {before}")) & (F.col("right_ts") <= F.col("ts") + F.expr(f"interval {after}"))
    return left.join(r, (F.col(key) == F.col("_key")) & near).drop("_key")


def first_seen(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows of a stream without those whose keys came before within the watermark's delay; on a batch, one row a key, the earliest ts.

    On a stream a key is forgotten once the watermark has passed its row by
    `late`, so state is bounded; a repeat after that is a new row.
    """
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])
