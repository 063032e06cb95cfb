"""Runs of samples, count-based sliding windows, window numbers and subject splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.hashing import hash_cutoff, order_hash
from kinesift.operators.scan import prefix_scan
from kinesift.session import durable


def _differs(values: pa.Array) -> np.ndarray:
    """Whether a value is another one than the value before it (null equals null)."""
    now, before = values.slice(1), values.slice(0, len(values) - 1)
    other = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    return other | (nulls[1:] != nulls[:-1])


def _steps(values: pa.Array) -> np.ndarray:
    """Differences of neighbours; one with a null counts as 0."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    return np.where(known[1:] & known[:-1], np.diff(numbers), 0)


STATE = ["_subject", "_activity", "_time", "_line"]


def _run_starts(rows: pa.Table, max_gap: int | None, dense_lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every row but the first: whether its subject is a new one, and whether it starts a run."""
    subject, activity, time, line = (rows.column(c).combine_chunks() for c in STATE)
    new = _differs(subject)
    step = _steps(time)
    starts = new | _differs(activity) | (step < 0)
    if max_gap is not None:
        starts |= step > max_gap
    if dense_lines:
        starts |= _steps(line) != 1
    return new, starts


def _local_runs(max_gap: int | None, dense_lines: bool):
    """Numbers the runs of a sorted partition: ``seq_no`` from 1 per subject, ``pos`` from 0 per run.

    ``_head`` marks the rows of the partition's first subject, which an earlier partition may have begun.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, pos, head = None, 0, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select(STATE)
            new, starts = _run_starts(pa.concat_tables([last if last is not None else own.slice(0, 1), own]), max_gap, dense_lines)
            if last is None:
                starts[0], seq = True, 0
            at = np.arange(batch.num_rows)
            runs = np.cumsum(starts)
            begun = np.maximum.accumulate(np.where(new, at, -1))
            numbers = np.where(begun >= 0, runs - runs[begun] + 1, seq + runs)
            from_start = np.maximum.accumulate(np.where(starts, at, -1))
            places = np.where(from_start >= 0, at - from_start, pos + 1 + at)
            first = head & (begun < 0)
            last, seq, pos, head = own.slice(own.num_rows - 1), int(numbers[-1]), int(places[-1]), bool(first[-1])
            added = [pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array(first)]
            names = ["seq_no", "pos", "_head"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return run


def segment_runs(
    samples: DataFrame,
    *,
    order: list[str],
    subject: str = "subject_id",
    activity: str | None = "activity",
    time: str | None = None,
    max_gap: int | None = None,
    line_no: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number the unbroken runs of every subject: adds ``seq_no`` (from 1) and ``pos`` (from 0).

    A run ends when the activity changes, time steps back, a gap exceeds ``max_gap`` (None: any gap
    is fine), or another subject's line lies between (``line_no`` must then be dense).

    Samples are shuffled once, by ranges of (subject, order) with about equal numbers of rows, however bursty a
    subject is, and numbered there as a sorted stream. A partition sums up to one row - first and last sample,
    number and length of the last run - and these rows are added up in order. Only the first subject of a
    partition goes on from an earlier one, so one correction per partition is broadcast. Results do not depend
    on the partitions.
    """

    def state(name: str | None, kind: str) -> Column:
        return (F.col(name) if name else F.lit(None)).cast(kind)

    kinds = ["string", "string", "bigint", "bigint"]
    known = [state(n, k).alias(c) for n, k, c in zip([subject, activity, time, line_no], kinds, STATE, strict=True)]
    keys = [F.col(subject), *[F.col(c) for c in order]]
    stated = samples.select("*", *known)
    ranged = stated.repartitionByRange(partitions, *keys) if partitions else stated.repartitionByRange(*keys)
    sorted_rows = ranged.sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    extra = [F.lit(0).cast("bigint").alias("seq_no"), F.lit(0).cast("bigint").alias("pos"), F.lit(True).alias("_head")]
    numbered = durable(sorted_rows.mapInArrow(_local_runs(max_gap, line_no is not None), sorted_rows.select("*", *extra).schema))
    row = F.struct(*STATE, "seq_no", "pos", "_head")
    # Of the first subject, rows grow in (run, place); of all, the last one is the last in order.
    place = F.struct(*keys, "seq_no", "pos")
    ends = numbered.groupBy("_range").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    fixes, carry = [], None
    for r in ends.orderBy("_range").toLocalIterator():
        seq = place_before = 0
        if carry is not None and carry["state"][0] == r["first"]["_subject"]:
            both = pa.Table.from_pylist([dict(zip(STATE, s, strict=True)) for s in (carry["state"], [r["first"][c] for c in STATE])], _STATES)
            joined = not _run_starts(both, max_gap, line_no is not None)[1][0]
            seq = carry["seq"] - joined
            place_before = carry["pos"] + 1 if joined else 0
            fixes.append((r["_range"], seq, place_before))
        end = r["last"]
        here = end["_head"]
        carry = {
            "state": [end[c] for c in STATE],
            "seq": end["seq_no"] + (seq if here else 0),
            "pos": end["pos"] + (place_before if here and end["seq_no"] == 1 else 0),
        }
    fixed = samples.sparkSession.createDataFrame(fixes, "_range int, _seq bigint, _before bigint")
    joined = numbered.join(F.broadcast(fixed), "_range", "left")
    seq = F.when(F.col("_head"), F.coalesce("_seq", F.lit(0))).otherwise(0)
    before = F.when(F.col("_head") & (F.col("seq_no") == 1), F.coalesce("_before", F.lit(0))).otherwise(0)
    return joined.select(*samples.columns, (F.col("seq_no") + seq).alias("seq_no"), (F.col("pos") + before).alias("pos"))


_STATES = pa.schema([("_subject", pa.string()), ("_activity", pa.string()), ("_time", pa.int64()), ("_line", pa.int64())])

#: Windows of samples that :func:`sliding_windows` keeps together, in lengths of a window.
BLOCK_SIZES = 8


def sliding_windows(
    runs: DataFrame,
    *,
    size: int = 128,
    stride: int = 64,
    keys: list[str] = ["subject_id", "seq_no"],
    values: str = "values",
    carry: list[str] = [],
    first_of: list[str] = [],
) -> DataFrame:
    """Windows of exactly ``size`` samples every ``stride`` samples of a run; the partial tail is dropped.

    Runs are cut into blocks of several windows. A sample goes to its block, and only the overlap - the first
    ``size - stride`` samples of a block, an eighth of it at most - also to the block before, whose last windows
    reach into it. So about every sample is shuffled once, a long run spreads over as many tasks as it has blocks,
    and a block is of fixed size. ``carry`` columns are constant in a run; ``first_of`` columns are taken at
    the window's first sample. Output: keys, ``win_no``, carry, first_of, ``sensor``.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if stride <= 0:
        raise ValueError("stride must be positive")
    per_block = max(1, -(-BLOCK_SIZES * size // stride))
    span = per_block * stride
    block = F.floor(F.col("pos") / span)
    shared = (block > 0) & (F.col("pos") - block * span < size - stride)
    homes = F.when(shared, F.array(block, block - 1)).otherwise(F.array(block))
    sample = F.struct(F.col("pos").alias("_pos"), F.col(values).alias("_v"), *[F.col(c).alias(f"_f_{c}") for c in first_of])
    dealt = runs.select(*keys, *carry, sample.alias("_s"), F.explode(homes).alias("_block"))
    blocks = dealt.groupBy(*keys, *carry, "_block").agg(F.array_sort(F.collect_list("_s")).alias("_rows"))
    fits = F.least(F.lit(per_block), F.floor((F.size("_rows") - size) / stride) + 1)

    def window(i: Column) -> Column:
        begin = (i * stride).cast("int")
        return F.struct(
            (F.col("_block") * per_block + i).alias("win_no"),
            *[F.get("_rows", begin)[f"_f_{c}"].alias(c) for c in first_of],
            F.transform(F.slice("_rows", begin + 1, size), lambda s: s["_v"]).alias("sensor"),
        )

    cut = F.when(F.size("_rows") >= size, F.transform(F.sequence(F.lit(0).cast("bigint"), fits - 1), window))
    found = blocks.select(*keys, *carry, F.explode_outer(cut).alias("_w")).filter(F.col("_w").isNotNull())
    return found.select(*keys, "_w.win_no", *carry, *[F.col(f"_w.{c}") for c in first_of], "_w.sensor")


#: Windows of a run that share one row of offsets.
OFFSET_WINDOWS = 1024


def number_windows(
    windows: DataFrame, *, keys: list[str], start: list[str], dataset_id: str, split: str = "split"
) -> DataFrame:
    """Dense numbers per split in log order: adds ``window_no`` and ``window_id`` like ``wisdm_train_000012``.

    ``start`` orders the runs (it must be unique over runs). Only one row per run is scanned; a
    window's number is its run's offset plus its place in the run. The offset is joined by run and block of
    ``OFFSET_WINDOWS`` windows, so one run that holds most windows spreads over tasks.
    """
    runs = windows.groupBy(*keys, split).agg(
        F.count(F.lit(1)).alias("_windows"), *[F.min_by(c, "win_no").alias(c) for c in start]
    )
    scanned = prefix_scan(runs, [split, *start], {"_through": F.col("_windows")})
    bases = scanned.groupBy(split).agg(F.min(F.col("_through") - F.col("_windows")).alias("_base"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_windows") - 1) / OFFSET_WINDOWS))
    offsets = scanned.join(F.broadcast(bases), split).select(
        *keys, split, (F.col("_through") - F.col("_windows") - F.col("_base")).alias("_offset"), F.explode(blocks).alias("_block")
    )
    placed = windows.withColumn("_block", F.floor(F.col("win_no") / OFFSET_WINDOWS))
    numbered = placed.join(offsets, [*keys, split, "_block"]).withColumn("window_no", F.col("_offset") + F.col("win_no"))
    return numbered.drop("_offset", "_block").withColumn(
        "window_id", F.format_string(f"{dataset_id}_%s_%06d", F.col(split), F.col("window_no"))
    )


def cap_windows(windows: DataFrame, caps: dict[str, int | None], split: str = "split") -> DataFrame:
    """Keep the first N windows of a split by number; None or a negative N keeps all."""
    keep = F.lit(True)
    for name, cap in caps.items():
        if cap is not None and cap >= 0:
            keep = keep & ((F.col(split) != name) | (F.col("window_no") < cap))
    return windows.filter(keep)


def subject_split(
    samples: DataFrame, *, subject: str = "subject_id", test_ratio: float = 0.2, seed: int = 42
) -> Column:
    """A column that says ``test`` or ``train`` by subject; no subject is in both.

    The test side is the ``clamp(round-half-even(n * ratio), 1, n-1)`` subjects smallest in hash order, and
    everything is ``train`` with fewer than two subjects. The result is a plain comparison against one
    cutoff hash, so the big table is not joined.
    """
    subjects = samples.select(F.col(subject).cast("string").alias("s")).filter(F.col("s").isNotNull()).distinct()
    def test_count(n: int) -> int:
        return 0 if n <= 1 else max(1, min(n - 1, round(n * test_ratio)))

    cutoff = hash_cutoff(subjects, order_hash(seed, F.col("s")), test_count)
    if cutoff is None:
        return F.lit("train")
    return F.when(order_hash(seed, F.col(subject)) <= cutoff, "test").otherwise("train")


def pad_or_crop(sensor: Column, length: int, channels: int) -> Column:
    """``sensor`` cut or zero-filled to ``length`` rows of ``channels`` values."""

    def fit(a: Column, n: int, filler: Column) -> Column:
        return F.concat(F.slice(a, 1, n), F.array_repeat(filler, F.greatest(F.lit(0), n - F.size(a))))

    rows = F.transform(sensor, lambda r: fit(r, channels, F.lit(0.0)))
    return fit(rows, length, F.array_repeat(F.lit(0.0), channels))


def sensor_shape(windows: DataFrame, sensor: str = "sensor") -> DataFrame:
    """One row: the longest window and the widest channel count."""
    return windows.agg(
        F.max(F.size(sensor)).alias("length"), F.max(F.size(F.get(F.col(sensor), F.lit(0)))).alias("channels")
    )
