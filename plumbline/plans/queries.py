"""One query per operator; each takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import attribution, boosting, clustering, curves, factors, scans, segments, sketches, tables, templates, trends, validation, warping
from plumbline.sources import event_curves, table
from plumbline.storage import written

#: Reject distance of the fixture templates, in squared scaled units.
TAU = 0.18


def _templates(spark: SparkSession) -> DataFrame:
    """Three reference shapes over 16 buckets, built in the plan."""
    b = spark.range(16).select(F.col("id").cast("int").alias("bucket"), (F.col("id") / 15.0).alias("x"))
    rise = b.select(F.lit("rise").alias("class"), "bucket", F.col("x").alias("value"), F.lit(True).alias("is_target"))
    fall = b.select(F.lit("fall").alias("class"), "bucket", (F.lit(1.0) - F.col("x")).alias("value"), F.lit(True).alias("is_target"))
    flat = b.select(F.lit("level").alias("class"), "bucket", F.lit(0.5).alias("value"), F.lit(False).alias("is_target"))
    return rise.unionByName(fall).unionByName(flat)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions: an event's type, predicted by the previous type of the same user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("prediction", F.lag("event_type").over(w))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("fold"))
    return e.where("prediction is not null").join(c, e.user_id == c.c_custkey).select(
        F.col("event_id").alias("row_id"), "fold", F.col("event_type").alias("label"), "prediction")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_curves(spark, sf_dir).groupBy("curve_id").agg(F.round(F.avg("value"), 6).alias("mean_value"))


def _factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return factors.factor_join(_means(spark, sf_dir), c, "curve_id", "c_custkey")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return factors.factor_coverage(d.join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "toxic"], "lang")


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(
        F.max("o_totalprice").alias("price"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return factors.asof_factor(e, o, "user_id", "ts", "price")


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.forest_grouped_cv(_class_rows(spark, sf_dir), SHAPE, *CLASS, k=5)


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.boosted_grouped_cv(_class_rows(spark, sf_dir), SHAPE, *CLASS, k=5, rounds=5, balanced=True)


def _class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape features, class (market segment) and group (nation) of each curve."""
    f = curves.curve_features(event_curves(spark, sf_dir)).fillna(0.0)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = factors.factor_join(f, c, "curve_id", "c_custkey").withColumnRenamed("curve_id", "row_id")
    return rows.repartition(8, "row_id").sortWithinPartitions("row_id")


SHAPE = ["v_median", "v_max", "rel_peak", "slope_per_hour"]
CLASS = ("c_mktsegment", "c_nationkey")


def _extra_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the curves that no reference shape fits."""
    shapes = written(_shapes(spark, sf_dir), "shapes")
    extra = templates.template_assign(shapes, _templates(spark), TAU / 2).where("class = 'extra'").select("curve_id")
    return clustering.shape_clusters(shapes.join(extra, "curve_id", "left_semi"), 3)


def _shape_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest reference shape whatever the shift in time: cluster 0 falls, 1 is level, 2 rises."""
    known = clustering.scaled_shapes(_templates(spark).withColumnRenamed("class", "curve_id")).orderBy("curve_id").collect()  # three rows
    model = clustering.Shapes(np.array([r["vec"] for r in known]), 0, True)
    return model.assign(clustering.scaled_shapes(_shapes(spark, sf_dir))).drop("shift")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.baseline_report(_predictions(spark, sf_dir))


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a customer places within 20 days of another (of every seventh: within 700 days)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    days = F.when(F.col("o_orderkey") % 7 == 0, 700).otherwise(20)
    spans = o.select("user_id", F.col("o_orderkey").alias("after"), F.col("at").alias("start"), (F.col("at") + F.make_dt_interval(days)).alias("end"))
    return tables.interval_join(o, spans, "user_id", "at", "start", "end").select("o_orderkey", "after")


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total, last known value and rolling mean of every event of a type: five keys hold all rows."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    t = scans.pieces(e, "event_type", ["ts", "event_id"])
    t = scans.running_sum(t, "value", "total")
    t = scans.last_known(t, "value", "known")
    t = scans.rolling_mean(t, "value", 4, "rolling")
    return t.rows.select("event_id", F.round("total", 4).alias("total"), "known", F.round("rolling", 6).alias("rolling"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return tables.from_document(tables.to_document(c, "c_custkey", ["c_name", "c_acctbal", "c_nationkey"]), "c_custkey", {"c_name": "string", "c_acctbal": "double", "c_nationkey": "int", "absent": "string"})


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(c).alias("up"), F.length(c).alias("n"), F.substring(c, 1, 4).alias("head"), F.regexp_replace(c, "[0-9]+", "#").alias("masked"), F.reverse(c).alias("backward"))


def _set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("id"))
    return o.intersect(e).withColumn("side", F.lit("both")).unionByName(o.subtract(e).withColumn("side", F.lit("orders"))).unionByName(e.subtract(o).withColumn("side", F.lit("events")))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.shape_vectors(event_curves(spark, sf_dir))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve_id, mean_value, class and one of five folds of nations of each curve of a customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("class"))
    rows = _means(spark, sf_dir).join(c, F.col("curve_id") == F.col("c_custkey"))
    return validation.group_folds(rows, "c_nationkey", 5).select("curve_id", "mean_value", "class", "fold")


def _forest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.baseline_report(written(_forest(spark, sf_dir), "predictions"))


def _of_curves(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(event_curves(s, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "curve_features": _of_curves(curves.curve_features),
    "curve_normalize": _of_curves(curves.curve_normalize),
    "curve_resample": _of_curves(curves.curve_resample),
    "curve_daily_grid": _of_curves(curves.curve_daily_grid),
    "curve_ffill": _of_curves(curves.curve_ffill),
    "rolling_rows": _of_curves(curves.rolling_rows),
    "rolling_range": _of_curves(curves.rolling_range),
    "sessionize_gaps": _of_curves(curves.sessionize_gaps),
    "template_assign": lambda s, d: templates.template_assign(_shapes(s, d), _templates(s), TAU),
    "nearest_centroid": lambda s, d: templates.nearest_centroid(table(s, d, "embeddings"), "vec_id", "embedding", "label"),
    "dtw_assign": lambda s, d: templates.dtw_assign(_shapes(s, d), _templates(s), 4.0),
    "strength_tier": lambda s, d: factors.strength_tier(_means(s, d), "curve_id", "mean_value"),
    "strength_tier_by_fold": lambda s, d: factors.strength_tier_by_fold(_folds(s, d).drop("class"), "curve_id", "mean_value", "fold"),
    "template_assign_by_fold": lambda s, d: templates.template_assign_by_fold(_shapes(s, d), _folds(s, d), 2 * TAU),
    "factor_join": _factor_rows,
    "factor_coverage": _coverage,
    "asof_factor": _asof,
    "group_folds": lambda s, d: validation.group_folds(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5),
    "logo_majority": lambda s, d: validation.logo_majority(table(s, d, "customer"), "c_nationkey", "c_mktsegment"),
    "confusion": lambda s, d: validation.confusion(_predictions(s, d)),
    "macro_f1": lambda s, d: validation.macro_f1(_predictions(s, d)),
    "macro_f1_by_fold": lambda s, d: validation.macro_f1(_predictions(s, d), per_fold="fold"),
    "class_recall": lambda s, d: validation.class_recall(_predictions(s, d)),
    "linear_shapley": lambda s, d: attribution.linear_shapley(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", "c_nationkey", "c_acctbal"),
    "baseline_report": _report,
    "interval_join": _interval,
    "hot_key_scan": _running,
    "balanced_folds": lambda s, d: validation.balanced_folds(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment", 5).groupBy("fold", "c_nationkey").agg(F.count("*").alias("n")),
    "with_match": lambda s, d: tables.with_match(table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
    "without_match": lambda s, d: tables.without_match(table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey"),
    "roll_up": lambda s, d: tables.roll_up(table(s, d, "customer"), ["c_mktsegment", "c_nationkey"], [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")]),
    "cube": lambda s, d: tables.roll_up(table(s, d, "customer"), ["c_mktsegment", "c_nationkey"], [F.count("*").alias("n")], "cube"),
    "pivot_counts": lambda s, d: tables.pivot_counts(table(s, d, "customer"), "c_nationkey", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]),
    "top_rows": lambda s, d: tables.top_rows(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 3),
    "documents_of_fields": _documents,
    "string_functions": _names,
    "set_operations": _set_operations,
    "approx_distinct": lambda s, d: tables.approx_distinct(table(s, d, "events"), "event_type", "user_id"),
    "forest_grouped_cv": _forest,
    "forest_report": _forest_report,
    "boosted_grouped_cv": _boosted,
    "boosted_report": lambda s, d: validation.baseline_report(written(_boosted(s, d), "predictions")),
    "tree_shapley": lambda s, d: attribution.forest_shapley_by_fold(_class_rows(s, d), SHAPE, *CLASS),
    "boosted_shapley": lambda s, d: attribution.boosted_shapley_by_fold(_class_rows(s, d), SHAPE, *CLASS, rounds=3, depth=2),
    "robust_trends": _of_curves(trends.robust_trends),
    "change_points": lambda s, d: segments.change_points(event_curves(s, d), 4000.0),
    "curve_sketches": lambda s, d: sketches.estimates(sketches.merged(sketches.daily_sketches(event_curves(s, d)), ["curve_id"]), ["curve_id"]),
    "extra_clusters": _extra_clusters,
    "warped_by_fold": lambda s, d: warping.warped_by_fold(_shapes(s, d), _folds(s, d)),
    "shape_assign": _shape_assign,
}
