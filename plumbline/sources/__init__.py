"""Table scans and sinks. Every reader takes an explicit schema or Parquet's own; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CURVES = T.StructType([
    T.StructField("curve_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()),
])
TEMPLATES = T.StructType([
    T.StructField("class", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("is_target", T.BooleanType()),
])
FORMATS = ("parquet", "orc", "json", "csv")
#: Text formats keep microseconds.
TEXT = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read curves or templates in one of FORMATS. Text formats need the schema, so that no pass infers it."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs an explicit schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**TEXT).load(path) if fmt in ("csv", "json") else reader.load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.options(**TEXT) if fmt in ("csv", "json") else writer).save(path)


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the role of curves: one curve per user."""
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "events").select(F.col("user_id").alias("curve_id"), "ts", "value")
