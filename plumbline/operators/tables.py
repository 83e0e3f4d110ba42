"""Relational building blocks around curves: joins on intervals, filters by another table, roll-ups, ranked rows, documents of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import written

#: Levels of the dyadic tree over cells; the highest nodes hold all others.
LEVELS = 62
#: Points or spans of a key that are tried on each other without a tree, and spans that are broadcast.
PAIRS = 1024
#: Microseconds of a cell.
WIDTHS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = 1) -> DataFrame:
    """Points with every span of their key that holds them: start <= at < end, all whole numbers.

    Rows are counted a key first. Keys of at most PAIRS points and PAIRS spans
    are joined as they are, so that no row is copied and none is tried on more
    than PAIRS others; the rest, if any, goes through `_tree_join`. Joins are
    by sorting, as Spark's sizes are of stored columns and miss the copies of a
    tree: what it takes for small need not fit the driver. Only a table of at
    most PAIRS spans is broadcast. Nulls match nothing; a span that ends before
    it starts holds nothing. spans must not share column names with points
    except the key.
    """
    points, spans = points.where(F.col(at).isNotNull()), spans.where(F.col(start) < F.col(end))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    if spans.limit(PAIRS + 1).count() <= PAIRS:
        return points.join(F.broadcast(spans), key).where(inside)
    rows = points.select(key, F.lit(1).alias("_p"), F.lit(0).alias("_s")).unionByName(spans.select(key, F.lit(0).alias("_p"), F.lit(1).alias("_s")))
    often = rows.groupBy(key).agg(F.sum("_p").alias("_p"), F.sum("_s").alias("_s")).where((F.least("_p", "_s") > 0) & (F.greatest("_p", "_s") > PAIRS))
    often = written(often.select(key), "often")
    if often.isEmpty():
        return points.join(spans.hint("merge"), key).where(inside)
    few = points.join(often, key, "left_anti").join(spans.join(often, key, "left_anti").hint("merge"), key).where(inside)
    return few.unionByName(_tree_join(points.join(often, key, "left_semi"), spans.join(often, key, "left_semi"), key, at, start, end, width))


def _tree_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """`range_join` of keys with many rows.

    Numbers fall into cells of `width`, the leaves of a dyadic tree. A span is
    cut into the fewest tree nodes that cover its cells, at most two a level,
    so a span of any length makes a logarithmic number of rows; a point is
    joined by its ancestors on the levels that some span uses (counted first,
    LEVELS at most). A span covers a point by one node, so no pair comes twice.
    A long span meets many points only where it holds them, but for its two
    outer cells.
    """
    lo, hi = F.floor(F.col(start) / F.lit(width)), F.floor((F.col(end) - 1) / F.lit(width)) + 1
    if width == 1:
        lo, hi = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    cells = spans.withColumn("_lo", lo).withColumn("_hi", hi)

    def nodes(level: Column) -> Column:
        # what the levels below have not covered, in nodes of this one: [up, down)
        up = -F.call_function("shiftright", -F.col("_lo"), level)
        down = F.call_function("shiftright", F.col("_hi"), level)
        left = F.when((up < down) & (F.pmod(up, F.lit(2)) == 1), up)
        right = F.when((up < down) & (F.pmod(down, F.lit(2)) == 1), down - 1)
        return F.transform(F.filter(F.array(left, right), lambda n: n.isNotNull()), lambda n: F.struct(level.alias("level"), n.alias("node")))

    top = F.least(F.floor(F.log2(F.col("_hi") - F.col("_lo"))).cast("int") + 1, F.lit(LEVELS))  # no node is larger than its span
    cut = F.flatten(F.transform(F.sequence(F.lit(0), top), nodes))
    cells = cells.select(*spans.columns, F.inline(cut).alias("_level", "_node"))
    used = sorted(r[0] for r in cells.select("_level").distinct().collect())  # LEVELS + 1 rows at most
    cell = F.floor(F.col(at) / F.lit(width)) if width > 1 else F.col(at).cast("bigint")
    above = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col("_cell"), n).alias("node")) for n in used]).cast("array<struct<level: int, node: bigint>>")
    laid = points.withColumn("_cell", cell).select(*points.columns, F.inline(above).alias("_level", "_node"))
    return laid.join(cells.hint("merge"), [key, "_level", "_node"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_node")


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: str = "day") -> DataFrame:
    """`range_join` of timestamps, in cells of a minute, an hour or a day."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p = points.withColumn("_at", us(at))
    s = spans.withColumn("_start", us(start)).withColumn("_end", us(end))
    return range_join(p, s, key, "_at", "_start", "_end", WIDTHS[width]).drop("_at", "_start", "_end")


def with_match(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df that have a partner in other (each once)."""
    return df.join(other, on, "left_semi")


def without_match(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df that have no partner in other; rows with a null key have none."""
    return df.join(other, on, "left_anti")


def roll_up(df: DataFrame, keys: list[str], aggs: list[Column], sets: str = "rollup") -> DataFrame:
    """Aggregates over keys and their subtotals ("rollup": prefixes, "cube": all subsets); `level` is grouping_id()."""
    return getattr(df, sets)(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *aggs)


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Rows by `row`, one count column a value of `col`; the values are given, so nothing is scanned to learn them."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0, values)


def top_rows(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def to_document(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id and a JSON document of the fields (null fields are left out)."""
    return df.select(id_col, F.to_json(F.struct(*fields)).alias("doc"))


def from_document(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """id and the typed fields of a JSON document column `doc`; absent ones are null."""
    parsed = F.from_json("doc", ", ".join(f"{k} {t}" for k, t in fields.items()))
    return df.select(id_col, parsed.alias("_d")).select(id_col, *[F.col(f"_d.{k}").alias(k) for k in fields])


def approx_distinct(df: DataFrame, by: str, col: str, error: float = 0.02) -> DataFrame:
    """About how many distinct values each group has (HyperLogLog++, relative standard error)."""
    return df.groupBy(by).agg(F.approx_count_distinct(col, error).alias("n_distinct"))
