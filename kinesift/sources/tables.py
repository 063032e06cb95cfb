"""JSON lines, result files, window tables and fitted parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.operators.cards import CardBounds
from kinesift.operators.centroids import Centroids
from kinesift.sources.delimited import read_csv  # noqa: F401  (the counterpart of write_csv)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped and a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled so that any text comes back whole."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="", **kept).csv(path)


def write_windows(windows: DataFrame, path: str) -> DataFrame:
    """Windows partitioned by dataset and split; returns the counts, read from the written table."""
    windows.write.mode("overwrite").partitionBy("dataset_id", "split").parquet(path)
    written = windows.sparkSession.read.parquet(path)
    return written.groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("windows"))


def save_bounds(bounds: CardBounds, spark: SparkSession, path: str) -> None:
    bounds.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_bounds(spark: SparkSession, path: str) -> CardBounds:
    return CardBounds.from_table(spark.read.parquet(path))


def save_centroids(model: Centroids, spark: SparkSession, path: str) -> None:
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> Centroids:
    return Centroids.from_table(spark.read.parquet(path))
