"""Scans in order over keys of any size: running sums, the last known value, rolling means.

A window by key sorts a key's rows in one task. Here rows are dealt by ranges
of (key, order), so a key that holds a third of all rows covers many pieces. A
scan runs within the pieces; what a piece hands on (its sum, its last value,
its last few rows) is one row a (key, piece), and a second scan over those
rows, with the key's earlier pieces, gives each piece what it starts from.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import written


@dataclass(frozen=True)
class Pieces:
    """Rows with the number of their piece in column _piece, written once so that the pieces stay as they are."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]

    def within(self, start: int = Window.unboundedPreceding):  # noqa: ANN201
        """From `start` rows before up to the row, in its piece."""
        return Window.partitionBy("_piece", self.key).orderBy(*self.order).rowsBetween(start, 0)

    def handed_on(self, made: Column, before: Column) -> DataFrame:
        """key, _piece and _from: `before`, over the `made` (_m) of the key's earlier pieces."""
        ends = self.rows.groupBy(self.key, "_piece").agg(made.alias("_m"))
        return ends.select(F.col(self.key).alias("_k"), F.col("_piece").alias("_p"), before.alias("_from"))

    def with_start(self, rows: DataFrame, ends: DataFrame) -> DataFrame:
        """rows with the _from of their key and piece; there are about as many of those as keys and pieces."""
        return rows.join(ends, (F.col("_piece") == F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k")), "left").drop("_k", "_p")

    def earlier(self, pieces: int | None = None):  # noqa: ANN201
        return Window.partitionBy(self.key).orderBy("_piece").rowsBetween(Window.unboundedPreceding if pieces is None else -pieces, -1)


def pieces(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> Pieces:
    """Deal the rows of df into ranges of (key, order). order must tell a key's rows apart, or ties fall either way."""
    dealt = df.repartitionByRange(parts, key, *order) if parts else df.repartitionByRange(key, *order)
    return Pieces(written(dealt.withColumn("_piece", F.spark_partition_id()), "pieces"), key, tuple(order))


def running_sum(t: Pieces, value: str, out: str) -> Pieces:
    """out: the sum of the key's values up to the row; null before the first value, as a window's sum."""
    ends = t.handed_on(F.sum(value), F.sum("_m").over(t.earlier()))
    own = t.with_start(t.rows.withColumn("_own", F.sum(value).over(t.within())), ends)
    total = F.when(F.col("_own").isNull(), F.col("_from")).otherwise(F.col("_own") + F.coalesce("_from", F.lit(0)))
    return replace(t, rows=own.withColumn(out, total).drop("_own", "_from"))


def last_known(t: Pieces, value: str, out: str) -> Pieces:
    """out: the key's last value that is not null, up to the row."""
    last = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*t.order)))
    ends = t.handed_on(last, F.last_value("_m", True).over(t.earlier()))
    own = t.with_start(t.rows.withColumn("_own", F.last_value(value, True).over(t.within())), ends)
    return replace(t, rows=own.withColumn(out, F.coalesce("_own", "_from")).drop("_own", "_from"))


def rolling_mean(t: Pieces, value: str, preceding: int, out: str) -> Pieces:
    """out: the mean of the key's values over the row and `preceding` rows before it; null where all of them are.

    A piece hands on its last `preceding` rows. A piece has a row of the key at
    least, so as many pieces back are enough.
    """
    rank = F.row_number().over(Window.partitionBy("_piece", t.key).orderBy(*[F.desc(c) for c in t.order]))
    tail = t.rows.withColumn("_back", rank).where(F.col("_back") <= preceding)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("b"), F.col(value).alias("v")))), lambda s: s["v"])
    ends = replace(t, rows=tail).handed_on(F.transform(listed, lambda v: F.struct(v.alias("v"))), F.flatten(F.collect_list("_m").over(t.earlier(preceding))))
    own = t.rows.withColumn("_n", F.row_number().over(Window.partitionBy("_piece", t.key).orderBy(*t.order))).withColumn(
        "_sum", F.sum(value).over(t.within(-preceding))).withColumn("_count", F.count(value).over(t.within(-preceding)))
    own = t.with_start(own, ends)
    need = F.lit(preceding + 1) - F.col("_n")  # rows that are still wanted from earlier pieces
    had = F.coalesce("_from", F.expr("cast(array() as array<struct<v: double>>)"))
    some = F.when(need > 0, F.slice(had, F.greatest(F.size(had) - need + 1, F.lit(1)), F.greatest(need, F.lit(0)))).otherwise(F.slice(had, 1, 0))
    seen = F.filter(F.transform(some, lambda s: s["v"].cast("double")), lambda v: v.isNotNull())
    total = F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)) + F.aggregate(seen, F.lit(0.0), lambda a, v: a + v)
    count = F.col("_count") + F.size(seen)
    return replace(t, rows=own.withColumn(out, F.when(count > 0, F.try_divide(total, count))).drop("_n", "_sum", "_count", "_from"))
