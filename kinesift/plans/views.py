"""Views of the given tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesift.operators.benchmark import build_benchmark, build_hard_benchmark
from kinesift.operators.cards import evidence_cards
from kinesift.operators.segments import segment_runs, sliding_windows, subject_split

DAY_US = 24 * 3600 * 1_000_000
EVENT_CHANNELS = ["acc_x", "acc_y", "acc_z"]
GRID_CHANNELS = ["acc_x", "acc_y", "acc_z", "gyro_x"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a 3-channel log: value, props.k and hour of day per user."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        F.floor(F.col("event_id") / 500).cast("string").alias("activity"),
        F.unix_micros(ts).alias("us"),
        "event_id",
        F.array(
            F.col("value"),
            F.regexp_extract("props", r"(\d+)", 1).cast("double"),
            F.hour(ts).cast("double"),
        ).alias("values"),
    )


def runs(spark: SparkSession, sf_dir: str, activity: str | None = None, max_gap: int | None = DAY_US) -> DataFrame:
    return segment_runs(samples(spark, sf_dir), order=["us", "event_id"], activity=activity, time="us", max_gap=max_gap)


def event_windows(spark: SparkSession, sf_dir: str, size: int = 8, stride: int = 4) -> DataFrame:
    """Windows of the event log with split and a readable id."""
    split = subject_split(samples(spark, sf_dir))
    cut = sliding_windows(runs(spark, sf_dir), size=size, stride=stride, first_of=["us", "event_id", "activity"])
    return cut.withColumn("split", split).select(
        F.concat_ws("-", F.lit("wisdm"), "split", "subject_id", F.col("seq_no").cast("string"), F.col("win_no").cast("string")).alias(
            "window_id"
        ),
        F.lit("wisdm").alias("dataset_id"),
        "split",
        F.col("activity").alias("label"),
        "subject_id",
        "seq_no",
        "win_no",
        "us",
        "event_id",
        "sensor",
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = event_windows(spark, sf_dir).drop("seq_no", "win_no", "us", "event_id")
    return evidence_cards(windows, names=EVENT_CHANNELS, sample_rate=20.0)


def grid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings reshaped to windows of 16 samples and 4 channels."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("ucihar_%06d", F.col("vec_id")).alias("window_id"),
        F.lit("ucihar").alias("dataset_id"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("label").cast("string").alias("label"),
        (F.col("vec_id") % 12).cast("string").alias("subject_id"),
        "vec_id",
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(doubles, t * 4 + 1, 4)).alias("sensor"),
    )


def tone_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of 64 samples on one channel."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("tone_%06d", F.col("vec_id")).alias("window_id"),
        "vec_id",
        F.transform("embedding", lambda x: F.array(x.cast("double"))).alias("sensor"),
    )


def hard_records(spark: SparkSession, sf_dir: str, variant: str = "v3") -> DataFrame:
    return build_hard_benchmark(build_benchmark(cards(spark, sf_dir)), variant)
