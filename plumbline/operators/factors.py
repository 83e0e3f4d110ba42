"""Response tiers and joins of curves to factor tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.storage import written

TIERS = ("weak", "medium", "strong")
#: Most folds that get cut points of their own; counts and cut points of each go through the driver.
MAX_FOLDS = 1_000


def strength_tier(df: DataFrame, id_col: str, value_col: str, cuts: tuple[float, float] | None = None) -> DataFrame:
    """Weak, medium or strong by value: fixed cut points, or thirds of the ranked rows.

    Without cuts the thirds equal ntile(3) over (value, id). A global ntile
    would sort every row in one task, so rows are dealt by ranges once, counted
    by range, and only the ranges that hold one of the two boundary rows are
    sorted; the rest is a comparison. Tiers order responses; they are not a
    measure of damage. A null value has no tier; no rows give no rows.
    """
    x = F.col(value_col)
    if cuts is None:
        rows = written(df.where(x.isNotNull()).select(x.alias("v"), F.col(id_col).alias("i")).repartitionByRange("v", "i").withColumn("part", F.spark_partition_id()), "ranges")
        sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # a row a partition
        n = sum(sizes.values())
        edges, before = [], 0
        for part in sorted(sizes):
            for rank in sorted({n // 3 + (n % 3 > 0), 2 * (n // 3) + n % 3}):
                if before <= rank < before + sizes[part]:
                    ranked = rows.where(F.col("part") == part).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("v", "i")))
                    edges.append(tuple(ranked.where(F.col("k") == rank - before + 1).select("v", "i").first()))
            before += sizes[part]
        below = [(x < v) | ((x == v) & (F.col(id_col) < i)) for v, i in edges]
        below += [F.lit(True)] * (2 - len(below))
        tier = F.when(x.isNull(), None).when(below[0], TIERS[0]).when(below[1], TIERS[1]).otherwise(TIERS[2])
    else:
        tier = F.when(x.isNull(), None).when(x < cuts[0], TIERS[0]).when(x < cuts[1], TIERS[1]).otherwise(TIERS[2])
    return df.select(id_col, value_col, tier.alias("tier"))


def strength_tier_by_fold(df: DataFrame, id_col: str, value_col: str, fold_col: str) -> DataFrame:
    """Weak, medium or strong by thirds of the rows of all other folds, so that no fold takes part in its own cut points.

    A cut point is the value of the first row of a third over (value, id), as
    in strength_tier; a value equal to it belongs above. Rows are dealt by
    ranges once and counted by range and fold; only the ranges that hold a cut
    point are sorted, once for all folds. A null value or fold has no tier, nor has a fold beside
    which there is no row. Raises an error for more than MAX_FOLDS folds.
    """
    x, fold = F.col(value_col), F.col(fold_col)
    rows = written(df.where(x.isNotNull() & fold.isNotNull()).select(x.alias("v"), F.col(id_col).alias("i"), fold.alias("f")).repartitionByRange("v", "i").withColumn("part", F.spark_partition_id()), "ranges")
    folds = [r["f"] for r in rows.select("f").distinct().limit(MAX_FOLDS + 1).collect()]
    if len(folds) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds; merge groups with group_folds(k=...)")
    sizes: dict = {}
    for r in rows.groupBy("part", "f").count().toLocalIterator():  # a row a range and fold
        sizes.setdefault(r["part"], {})[r["f"]] = r["count"]
    asked = []
    for f in folds:
        others = [(part, sum(sizes[part].values()) - sizes[part].get(f, 0)) for part in sorted(sizes)]
        n = sum(k for _, k in others)
        for edge, rank in enumerate((n // 3 + (n % 3 > 0), 2 * (n // 3) + n % 3)):
            before = 0
            for part, k in others:
                if before <= rank < before + k:
                    asked.append((f, edge, part, rank - before + 1))
                before += k
    spark = df.sparkSession
    table = spark.createDataFrame(asked, T.StructType([T.StructField("_f", df.schema[fold_col].dataType), *[T.StructField(c, T.IntegerType()) for c in ("edge", "part", "k")]]))
    # ranked once in its range: of its first k + j rows, j are the fold's own where j of these have less than k others before them
    near = written(rows.join(F.broadcast(table.select("part").distinct()), "part", "left_semi").withColumn("_all", F.row_number().over(Window.partitionBy("part").orderBy("v", "i"))).withColumn(
        "_own", F.row_number().over(Window.partitionBy("part", "f").orderBy("v", "i"))), "ranked")
    own = near.select("part", F.col("f").alias("_f"), (F.col("_all") - F.col("_own")).alias("_others"))
    place = F.broadcast(table).join(own, ["part", "_f"], "right").where("k is not null").groupBy("_f", "edge", "part", "k").agg(F.count(F.when(F.col("_others") < F.col("k"), 1)).alias("_j"))
    where = table.join(place, ["_f", "edge", "part", "k"], "left").select("_f", "edge", "part", (F.col("k") + F.coalesce("_j", F.lit(0))).cast("int").alias("_all"))
    found = near.join(F.broadcast(where), ["part", "_all"])
    cuts = {(r["_f"], r["edge"]): r["v"] for r in found.select("_f", "edge", "v").collect()}
    known = spark.createDataFrame([(f, cuts.get((f, 0)), cuts.get((f, 1))) for f in folds if len(folds) > 1],
                                  T.StructType([T.StructField("_f", df.schema[fold_col].dataType), T.StructField("_lo", df.schema[value_col].dataType), T.StructField("_hi", df.schema[value_col].dataType)]))
    below = lambda c: F.col(c).isNull() | (x < F.col(c))
    tier = F.when(x.isNull() | F.col("_f").isNull(), None).when(below("_lo"), TIERS[0]).when(below("_hi"), TIERS[1]).otherwise(TIERS[2])
    return df.select(id_col, value_col, fold_col).join(F.broadcast(known), fold == F.col("_f"), "left").select(id_col, value_col, fold_col, tier.alias("tier"))


def factor_join(curves: DataFrame, factors: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every curve row with its factors; nulls where a factor row is missing (Spark picks the join by size).

    A curve row comes once for each factor row of its key, and a null key has
    none. Names that both sides have, the keys apart, raise an error: rename
    one of them first.
    """
    if both := sorted(set(curves.columns) & set(factors.columns) - {right_key}):
        raise ValueError(f"both sides have {', '.join(both)}")
    return curves.join(factors, curves[left_key] == factors[right_key], "left").drop(factors[right_key])


def factor_coverage(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Rows, and rows with each factor present."""
    aggs = [F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in cols]]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def asof_factor(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before its time.

    Union, sort within the key and carry the last right value forward: one
    shuffle and linear work, where an inequality join is quadratic in the
    rows of a key. Left rows keep their own columns, whatever their names, but
    for one called asof_<value>, which is replaced; unmatched ones get null, and
    so do rows with a null time, unless right has such rows with the key.
    """
    left = left.drop(f"asof_{value}")
    cols = left.columns
    side, held = (next(n for k in itertools.count() if (n := f"_{name}{k}") not in cols) for name in ("side", "v"))
    lhs = left.select(*cols, F.lit(1).alias(side), F.lit(None).cast(right.schema[value].dataType).alias(held))
    rhs = right.select(
        *[(F.col(c) if c in (key, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c)) for c in cols],
        F.lit(0).alias(side), F.col(value).alias(held))
    w = Window.partitionBy(key).orderBy(ts, side).rowsBetween(Window.unboundedPreceding, 0)
    return (
        lhs.unionByName(rhs)
        .select(*cols, side, F.last_value(held, True).over(w).alias(f"asof_{value}"))
        .where(F.col(side) == 1)
        .drop(side)
    )
