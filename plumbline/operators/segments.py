"""Change points of a curve, as a table function over each curve's rows in order.

A segmentation into stretches of constant level costs the squared deviations
from each stretch's mean plus a penalty a stretch. The best one up to a sample
follows from the best ones up to earlier samples; an earlier sample whose cost
already exceeds the best can start no later stretch and is passed over for good
(pruned dynamic programming), which leaves a few starts where changes recur.
The function takes rows one by one, so a curve streams through it: what it
holds is a few numbers a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

OUT = "curve_id bigint, segment int, first_us bigint, last_us bigint, n bigint, level double"


class ChangePoints:
    """Rows (curve_id, us, value) of one curve in order of time, and the penalty of a stretch."""

    def __init__(self) -> None:
        self.curve = None
        self.us: list[int] = []
        self.total, self.square = [0.0], [0.0]  # running sums of values and squares
        self.best, self.back = [0.0], [0]  # cost of the best segmentation up to a sample, and where its last stretch starts
        self.starts = [0]

    def eval(self, row: Row, penalty: float) -> None:
        self.curve = row["curve_id"]
        self.us.append(row["us"])
        v, n = row["value"], len(self.us)
        self.total.append(self.total[-1] + v)
        self.square.append(self.square[-1] + v * v)
        costs = [self.best[s] + self.cost(s, n) for s in self.starts]
        low = min(costs)
        self.best.append(low + penalty)
        self.back.append(self.starts[costs.index(low)])
        self.starts = [s for s, c in zip(self.starts, costs) if c <= low + penalty + 1e-9 * (1 + abs(low))]
        self.starts.append(n)

    def cost(self, a: int, z: int) -> float:
        """Squared deviations of the samples a .. z - 1 from their mean."""
        s = self.total[z] - self.total[a]
        return max(0.0, self.square[z] - self.square[a] - s * s / (z - a))

    def terminate(self) -> Iterator[tuple]:
        cuts, z = [], len(self.us)
        while z:
            cuts.append((self.back[z], z))
            z = self.back[z]
        for k, (a, z) in enumerate(reversed(cuts)):
            yield self.curve, k, self.us[a], self.us[z - 1], z - a, (self.total[z] - self.total[a]) / (z - a)


def change_points(curves: DataFrame, penalty: float) -> DataFrame:
    """Stretches of constant level of each curve (curve_id, ts, value): curve_id, segment, first_ts, last_ts, n, level.

    Among equally good segmentations the one whose last stretch starts first
    is taken. Samples with a null curve, time or value are left out; samples
    at one time go in order of value.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = curves.where("curve_id is not null and ts is not null and value is not null").select(F.col("curve_id").cast("bigint").alias("curve_id"), us.alias("us"), F.col("value").cast("double").alias("value"))
    found = F.udtf(ChangePoints, returnType=OUT)(rows.asTable().partitionBy("curve_id").orderBy("us", "value"), F.lit(float(penalty)))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("curve_id", "segment", at("first_us").alias("first_ts"), at("last_us").alias("last_ts"), "n", F.round("level", 6).alias("level"))
