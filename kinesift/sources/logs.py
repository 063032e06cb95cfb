"""Raw sensor logs in, with file order kept.

Row order comes from ``src`` (file), ``block`` (split start) and ``ord`` (position id inside the scan), so it
needs no global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinesift.functions.phrases import ACTIVITY_LABELS_6, ACTIVITY_LABELS_12, worded
from kinesift.operators.segments import segment_runs

# Positions of the 21 kept values in a 23-value line, as (first, count), 1-based.
KEPT_VALUES = [(1, 3), (6, 18)]

# Channel -> file stem of the pre-windowed set.
MATRIX_FILES = {
    "acc_x": "body_acc_x",
    "acc_y": "body_acc_y",
    "acc_z": "body_acc_z",
    "gyro_x": "body_gyro_x",
    "gyro_y": "body_gyro_y",
    "gyro_z": "body_gyro_z",
}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, src, block, ord. The id is taken in the scan's own projection, before any filter."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
    )


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_log3(value: Column) -> Column:
    """STRUCT<subject_id, activity, ts_ns, values> of ``user,activity,ts,x,y,z;`` - NULL for a bad line."""
    text = stripped(value)
    text = F.when(text.endswith(";"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    parts = F.transform(F.split(text, ",", -1), stripped)
    user = F.get(parts, F.lit(0)).try_cast("bigint")
    ts = F.get(parts, F.lit(2)).try_cast("bigint")
    values = F.transform(F.slice(parts, 4, 3), lambda v: v.try_cast("double"))
    good = (F.size(parts) == 6) & user.isNotNull() & ts.isNotNull() & ~F.exists(values, lambda v: v.isNull())
    return F.when(
        good,
        F.struct(
            user.cast("string").alias("subject_id"),
            F.replace(F.lower(F.get(parts, F.lit(1))), F.lit(" "), F.lit("_")).alias("activity"),
            ts.alias("ts_ns"),
            values.alias("values"),
        ),
    )


def parse_log21(value: Column) -> Column:
    """STRUCT<activity, values> of a whitespace line of 23+ values and a label id; label 0 or unknown is NULL."""
    parts = F.split(stripped(value), r"\s+")
    numbers = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.try_cast("double"))
    label = F.element_at(parts, -1).try_cast("double").try_cast("int")
    activity = worded(label, ACTIVITY_LABELS_12)
    good = (F.size(parts) >= 24) & ~F.exists(numbers, lambda v: v.isNull()) & activity.isNotNull()
    kept = F.concat(*[F.slice(numbers, first, count) for first, count in KEPT_VALUES])
    return F.when(good, F.struct(activity.alias("activity"), kept.alias("values")))


def file_subject(file_name: Column) -> Column:
    """All digits of the file stem as a number; 0 without digits."""
    digits = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), r"\D", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0)).cast("string")


def _parsed(lines: DataFrame, parsed: Column) -> DataFrame:
    return lines.filter(F.col("value").rlike(r"\S")).withColumn("_p", parsed)


def read_log3(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Samples of the 3-channel log; bad lines are left out (see :func:`rejected_lines`)."""
    rows = _parsed(read_lines(spark, path), parse_log3(F.col("value"))).filter(F.col("_p").isNotNull())
    return rows.select("_p.*", "src", "block", "ord")


def read_log21(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Samples of the 21-channel logs; the subject is in the file name and there is no time."""
    rows = _parsed(read_lines(spark, path), parse_log21(F.col("value"))).filter(F.col("_p").isNotNull())
    return rows.select(file_subject(F.col("file_name")).alias("subject_id"), "_p.*", "src", "block", "ord")


def rejected_lines(lines: DataFrame, parsed: Column) -> DataFrame:
    """Count of lines that do not parse, per file."""
    bad = _parsed(lines, parsed).filter(F.col("_p").isNull())
    return bad.groupBy("src").agg(F.count(F.lit(1)).alias("rejected"))


def log3_runs(samples: DataFrame, max_gap: int | None = 250_000_000) -> DataFrame:
    """Runs of the 3-channel log in file order: a run ends with the user, the activity or the time.

    The log is cut into ranges of lines, so tasks share it evenly whoever wrote most of it.
    """
    tagged = samples.select("*", F.lit("log").alias("_log"), F.concat_ws("\u0001", "subject_id", "activity").alias("_who"))
    runs = segment_runs(
        tagged, order=["src", "block", "ord"], subject="_log", activity="_who", time="ts_ns", max_gap=max_gap
    )
    return runs.drop("_log", "_who")


def log21_runs(samples: DataFrame) -> DataFrame:
    """Runs of the 21-channel logs: per file, a run ends with the activity. Dropped lines do not end it."""
    return segment_runs(samples, order=["block", "ord"], subject="src", activity="activity")


def number_lines(lines: DataFrame, of: str = "src") -> DataFrame:
    """Adds ``line_no`` (0-based, dense per value of ``of``) over the rows given, in order of ``src`` and place.

    Counts per split are added up over the splits of a file; only those counts are ordered across splits.
    """
    keys = list(dict.fromkeys([of, "src", "block"]))
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(of).orderBy("src", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy("ord")
    placed = lines.withColumn("_i", F.row_number().over(inside) - 1)
    return placed.join(offsets, keys).withColumn("line_no", F.col("_offset") + F.col("_i")).drop("_offset", "_i")


def read_matrices(
    spark: SparkSession, base: str, split: str, dataset_id: str = "ucihar", max_windows: int | None = None
) -> DataFrame:
    """Windows of the pre-windowed set: one file per channel, labels and subjects, all aligned by line.

    The files are read together and meet in one grouping by line number. A file may be a directory of parts that follow
    each other by name, as Spark writes them.
    """
    names = {f"{stem}_{split}.txt": channel for channel, stem in MATRIX_FILES.items()}
    paths = [f"{base}/{split}/Inertial Signals/{name}" for name in names]
    paths += [f"{base}/{split}/y_{split}.txt", f"{base}/{split}/subject_{split}.txt"]
    plain = F.replace(F.col("src"), F.lit("%20"), F.lit(" "))
    stem = F.regexp_extract(plain, rf"([^/]+_{split}\.txt)(/[^/]*)?$", 1)
    named = read_lines(spark, paths).filter(F.col("value").rlike(r"\S")).withColumn("_file", stem)
    lines = number_lines(named, "_file")
    if max_windows is not None and max_windows >= 0:
        lines = lines.filter(F.col("line_no") < max_windows)

    def line_of(file: str) -> Column:
        return F.max(F.when(F.col("_file") == file, stripped(F.col("value"))))

    rows = lines.groupBy("line_no").agg(
        *[line_of(file).alias(channel) for file, channel in names.items()],
        line_of(f"y_{split}.txt").alias("_y"),
        line_of(f"subject_{split}.txt").alias("_s"),
    )
    signals = [F.transform(F.split(c, r"\s+"), lambda v: v.cast("double")).alias(c) for c in MATRIX_FILES]
    label = F.col("_y").try_cast("double").try_cast("int")
    wide = rows.select("line_no", *signals, label.alias("_l"), F.col("_s").try_cast("double").try_cast("int").cast("string").alias("subject_id"))
    sensor = F.transform(
        F.arrays_zip(*MATRIX_FILES), lambda row: F.array(*[row[c] for c in MATRIX_FILES])
    )
    return wide.select(
        F.format_string(f"{dataset_id}_{split}_%06d", F.col("line_no")).alias("window_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(split).alias("split"),
        worded(F.col("_l"), ACTIVITY_LABELS_6, F.col("_l").cast("string")).alias("label"),
        "subject_id",
        sensor.alias("sensor"),
    )
