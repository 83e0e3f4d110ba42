"""Group-wise validation: folds without leakage, baselines and per-class metrics.

Metrics pool the predictions of all folds unless `per_fold`; a class that is
absent from labels and predictions of a fold scores 0 there. Both are this
library's conventions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.storage import written

#: Folds whose models are fitted at the same time.
AT_ONCE = 4
#: Most groups whose class counts are balanced on the driver, and whose folds are broadcast.
MAX_GROUPS = 100_000


def group_folds(df: DataFrame, group_col: str, k: int | None = None) -> DataFrame:
    """A fold for every row such that no group is on both sides: dense rank of the group, modulo k (default: one fold a group).

    Ranks are given to the distinct groups, so no window gathers all rows. A
    column `fold` of df is replaced; the group must not be called so. Rows with
    a null group have a null fold.
    """
    if group_col == "fold":
        raise ValueError("the group column must not be called fold")
    df = df.drop("fold")
    w = Window.orderBy(group_col)
    groups = df.select(group_col).where(F.col(group_col).isNotNull()).distinct()
    ranked = groups.withColumn("fold", (F.dense_rank().over(w) - 1).cast("int"))
    if k:
        ranked = ranked.withColumn("fold", F.pmod("fold", F.lit(k)).cast("int"))
    return df.join(ranked, group_col, "left")


def balanced_folds(df: DataFrame, group_col: str, label_col: str, k: int) -> DataFrame:
    """A fold for every row such that no group is split and the folds' class counts are as even as a greedy choice makes them.

    Groups go one after the other, the one with most rows first (ties: group
    that sorts first), to the fold where the squared distance of all class
    counts from an even share grows least, each class measured against its own
    total (ties: fewer rows, then the lower fold). Rows without a label count
    as a class of their own; rows without a group have no fold. A group's
    class counts are one row, and at most MAX_GROUPS of them go to the driver.
    A column `fold` of df is replaced; the group must not be called so.
    """
    if group_col == "fold":
        raise ValueError("the group column must not be called fold")
    df = df.drop("fold")
    counts = df.where(F.col(group_col).isNotNull()).groupBy(group_col, label_col).count()
    rows = counts.groupBy(group_col).agg(F.collect_list(F.struct(label_col, "count")).alias("c")).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups; use group_folds")
    labels = sorted({c[0] for r in rows for c in r["c"]}, key=lambda v: (v is None, v))
    at = {v: i for i, v in enumerate(labels)}
    table = np.zeros((len(rows), len(labels)))
    for i, r in enumerate(rows):
        for c in r["c"]:
            table[i, at[c[0]]] = c[1]
    share = np.maximum(table.sum(0), 1)
    table /= share
    held, size, fold = np.zeros((k, len(labels))), np.zeros(k), {}
    weight = (table * share).sum(1)
    for i in sorted(range(len(rows)), key=lambda i: (-weight[i], rows[i][0])):
        grown = ((held + table[i] - 1 / k) ** 2 - (held - 1 / k) ** 2).sum(1)
        best = min(range(k), key=lambda f: (round(grown[f], 12), size[f], f))
        held[best] += table[i]
        size[best] += weight[i]
        fold[rows[i][0]] = best
    schema = T.StructType([T.StructField(group_col, df.schema[group_col].dataType), T.StructField("fold", T.IntegerType())])
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(fold.items()), schema)), group_col, "left")


def logo_majority(df: DataFrame, group_col: str, label_col: str) -> DataFrame:
    """Leave-one-group-out majority class: the commonest label outside each group (ties: label that sorts first).

    Labels are ranked by their counts over all rows. Outside a group the best
    is either one of its own labels, less its own rows, or the first in rank of
    those it does not have; so groups never meet all labels. A null group is a
    group like others, a null label is no vote, and where nothing lies outside
    n_rest is 0. Ranks are given to the distinct labels, a row a class.
    """
    own = df.groupBy(group_col, label_col).agg(F.count("*").alias("_own"))
    total = own.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.sum("_own").alias("_all"))
    ranked = total.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_all"), label_col)))
    mine = own.join(ranked, label_col, "left").withColumn("_k", F.row_number().over(Window.partitionBy(group_col).orderBy(F.asc_nulls_last("_rank"))))
    best = lambda n, label: F.struct((-n).alias("neg"), label.alias("label"))
    known = F.col("_rank").isNotNull()
    groups = mine.groupBy(group_col).agg(
        F.coalesce(F.min(F.when(known & (F.col("_rank") != F.col("_k")), F.col("_k"))), F.count("_rank") + 1).alias("_other"),
        F.min(F.when(known, best(F.col("_all") - F.col("_own"), F.col(label_col)))).alias("_in"))
    other = ranked.select(F.col("_rank").cast("bigint").alias("_other"), best(F.col("_all"), F.col(label_col)).alias("_out"))
    found = groups.join(other, "_other", "left").select(group_col, F.least("_in", "_out").alias("_m"))
    return found.select(group_col, F.col("_m.label").alias("majority"), F.coalesce(-F.col("_m.neg"), F.lit(0)).cast("bigint").alias("n_rest"))


def confusion(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction", by: str | None = None) -> DataFrame:
    """Counts of each (label, prediction), optionally per fold."""
    keys = [by, label_col, prediction_col] if by else [label_col, prediction_col]
    return pred.groupBy(*keys).agg(F.count("*").alias("n"))


def class_metrics(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction", by: str | None = None) -> DataFrame:
    """Support, recall, precision and F1 of every class seen as label or prediction (0 where undefined)."""
    m = confusion(pred, label_col, prediction_col, by)
    keep = [by] if by else []
    as_label = m.select(*keep, F.col(label_col).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                        F.when(F.col(label_col) == F.col(prediction_col), F.col("n")).otherwise(0).alias("tp"))
    as_pred = m.select(*keep, F.col(prediction_col).alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp"))
    g = as_label.unionByName(as_pred).where("class is not null").groupBy(*keep, "class").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("support", "predicted", "tp")])
    d = lambda c: F.col(c).cast("double")
    zero = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    return g.select(
        *keep, "class", "support", "predicted", "tp",
        F.round(zero(d("tp"), d("support")), 6).alias("recall"),
        F.round(zero(d("tp"), d("predicted")), 6).alias("precision"),
        zero(d("tp") * F.lit(2.0), d("support") + d("predicted")).alias("f1"),
    )


def class_recall(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """Support and recall of every class that occurs as a label; rows without a prediction count as missed."""
    return class_metrics(pred, label_col, prediction_col).where("support > 0").select("class", "support", "recall")


def macro_f1(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction", per_fold: str | None = None) -> DataFrame:
    """Unweighted mean F1 over classes, pooled over all rows, or per fold and then over folds with `per_fold`."""
    m = class_metrics(pred, label_col, prediction_col, per_fold)
    if per_fold:
        classes = m.agg(F.count_distinct("class")).scalar()  # a class that a fold lacks scores 0 there
        return m.groupBy(per_fold).agg(F.sum("f1").alias("_sum")).select(per_fold, F.round(F.col("_sum") / classes, 6).alias("macro_f1"))
    return m.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("n_classes"))


def baseline_report(pred: DataFrame, group_col: str = "fold", label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """Per class: support, recall, precision and F1 of the predictions, and recall of the majority class of the other groups.

    Rows without a group are a group of their own, so every row with a label counts in all columns.
    """
    known = logo_majority(pred, group_col, label_col).select(F.col(group_col).alias("_g"), F.col("majority").alias("_majority"))
    base = pred.select(group_col, label_col).join(known, F.col(group_col).eqNullSafe(F.col("_g")))
    own = class_metrics(pred, label_col, prediction_col).select("class", "support", "recall", "precision", F.round("f1", 6).alias("f1"))
    return own.join(class_metrics(base, label_col, "_majority").select("class", F.col("recall").alias("majority_recall")), "class", "left").na.fill(0.0, ["majority_recall"])


def by_fold(data: DataFrame, folds: list[int], work: Callable[[int, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """work(fold, training rows, rows of the fold) of every fold, AT_ONCE folds at a time; rows of a fold without training rows are passed on by work too."""
    run = lambda f: work(f, data.where(F.col("fold") != f), data.where(F.col("fold") == f))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(data.sparkSession)(run), folds))
    return functools.reduce(DataFrame.unionByName, parts)


def fold_rows(df: DataFrame, features: list[str], label_col: str, group_col: str, k: int) -> tuple[DataFrame, list[int], list[str]]:
    """(row_id, fold, label, features, _x, _y) of the usable rows, written once; the folds; the labels in order.

    Rows with a missing label, group or feature are left out.
    """
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = group_folds(df, group_col, k).where(F.col(label_col).isNotNull() & F.col("fold").isNotNull()).dropna(subset=features)
    rows = rows.select("row_id", "fold", F.col(label_col).cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    indexer = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    data = written(VectorAssembler(inputCols=features, outputCol="_x").transform(indexer.transform(rows)), "folds")
    return data, sorted(r[0] for r in data.select("fold").distinct().collect()), list(indexer.labels)  # a row a fold: a model is grown for each


def grow_forest(train: DataFrame, trees: int, depth: int, seed: int, balanced: bool):  # noqa: ANN201
    """A random forest of (_x, _y); balanced: a row weighs in inverse proportion to its class."""
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed)
    if balanced:
        of = train.groupBy("_y").agg(F.count("*").alias("_c")).withColumn("_w", F.sum("_c").over(Window.partitionBy()) / (F.col("_c") * F.count("*").over(Window.partitionBy())))
        train, forest = train.join(F.broadcast(of.select("_y", "_w")), "_y"), forest.setWeightCol("_w")  # a row a class
    return forest.fit(train)


def forest_grouped_cv(df: DataFrame, features: list[str], label_col: str, group_col: str, k: int = 5, trees: int = 10, depth: int = 4, seed: int = 7, balanced: bool = False) -> DataFrame:
    """Out-of-fold random-forest predictions: (row_id, fold, label, prediction). Each fold's model never sees its groups.

    Label order is learned from all rows, trees only from the training folds;
    with `balanced`, a row weighs in inverse proportion to its class there.
    Rows with a missing label, group or feature are left out; every other row
    comes back, with a null prediction where no other fold has rows. Features
    and folds are computed once and written; AT_ONCE folds are fitted at a time.
    """
    from pyspark.ml.feature import IndexToString

    data, folds, labels = fold_rows(df, features, label_col, group_col, k)

    def work(f: int, train: DataFrame, test: DataFrame) -> DataFrame:
        if train.isEmpty():
            return test.select("row_id", "fold", "label", F.lit(None).cast("string").alias("prediction"))
        model = grow_forest(train, trees, depth, seed, balanced)
        return IndexToString(inputCol="_p", outputCol="prediction", labels=labels).transform(model.transform(test)).select("row_id", "fold", "label", "prediction")

    return by_fold(data, folds, work) if folds else data.select("row_id", "fold", "label", F.lit(None).cast("string").alias("prediction"))
