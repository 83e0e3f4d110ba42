"""Daily sketches of each curve that are stored once and merged upward: distinct values and quantiles.

A day's sketch is built from its samples alone. Months, curves or the whole
collection are merges of days, so a new day costs its own samples, and no
question reads the others again. Distinct counts are HyperLogLog sketches
(relative standard error about 1.04 / 2^(lg / 2)), quantiles KLL sketches
(rank error under 1.33 % for k = 200, at 99 % confidence); merged sketches keep
the bounds of one built directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers (logarithm) of a distinct sketch, and size of a quantile sketch.
LG, K = 12, 200


def _built(value: str, lg: int, k: int) -> list:
    x = F.col(value).cast("double")
    return [F.count(value).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.hll_sketch_agg(F.col(value).cast("string"), lg).alias("distinct"), F.kll_sketch_agg_double(x, k).alias("quantiles")]


def daily_sketches(curves: DataFrame, lg: int = LG, k: int = K) -> DataFrame:
    """curve_id, day, n, low, high, distinct and quantiles (sketches) of each curve and day with a value; nulls are left out."""
    known = curves.where("value is not null and ts is not null")
    return known.groupBy("curve_id", F.to_date("ts").alias("day")).agg(*_built("value", lg, k))


def sketched(rows: DataFrame, by: list[str], value: str = "value", lg: int = LG, k: int = K) -> DataFrame:
    """The same columns, built from the rows of each group directly."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(*_built(value, lg, k))


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles", k).alias("quantiles"))


def estimates(sketches: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """by, n, low, high, n_distinct and a column q<percent> for each rank."""
    q = [F.kll_sketch_get_quantile_double("quantiles", F.lit(r)).alias(f"q{round(100 * r)}") for r in ranks]
    return sketches.select(*by, "n", "low", "high", F.hll_sketch_estimate("distinct").alias("n_distinct"), *q)
