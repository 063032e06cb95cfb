"""Running sums, dense row numbers and exact quantiles without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesift.session import durable


def _sort_columns(order: list[str]) -> list[Column]:
    return [F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc() for name in order]


#: Binary digits that a running sum of doubles keeps below the largest value; with up to 2**40 rows it fits a decimal.
SUM_BITS = 86


def _fixed_point(value: Column, top: int) -> Column:
    """A double below 2**top as a whole number of 2**(top - SUM_BITS) units; what is smaller is cut off."""
    high, low = 40, SUM_BITS - 40
    first = F.floor(value * F.lit(2.0 ** (high - top)))
    rest = value - first.cast("double") * F.lit(2.0 ** (top - high))
    second = F.floor(rest * F.lit(2.0 ** (SUM_BITS - top)))
    return (first.cast("decimal(14,0)") * F.lit(1 << low).cast("decimal(15,0)") + second.cast("decimal(15,0)")).cast("decimal(27,0)")


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def prefix_scan(
    df: DataFrame,
    order: list[str],
    sums: dict[str, Column] | None = None,
    index: str = "row_index",
    partitions: int | None = None,
    within: str | None = None,
) -> DataFrame:
    """Add ``index`` (0-based, dense) and inclusive running ``sums`` in ``order`` over all rows, or over those with the
    same value of ``within``.

    ``order`` must end in a unique key; a leading ``-`` means descending. Rows are split by range, so
    even a key that holds a third of the table spreads over tasks. The split is written before use:
    its sampled bounds could differ if a lost task computed it again. Only one row per range
    partition (and per value of ``within`` in it) takes part in the cross-partition sum.

    Sums of doubles are the same to the last bit however the rows are split: every value is read as a whole number of
    units, ``SUM_BITS`` binary digits below the largest one, and whole numbers add up alike in any order.
    """
    sums = sums or {}
    groups = [within] if within else []
    columns = _sort_columns([*groups, *order])
    measured = df.select("*", *[expr.alias(f"_m_{name}") for name, expr in sums.items()])
    ranged = (
        measured.repartitionByRange(partitions, *columns) if partitions else measured.repartitionByRange(*columns)
    )
    held = durable(ranged.withColumn("_range", F.spark_partition_id()))
    doubles = [name for name in sums if dict(held.dtypes)[f"_m_{name}"] in ("double", "float")]
    units: dict[str, float] = {}
    if doubles:
        value = {name: F.col(f"_m_{name}").cast("double") for name in doubles}
        tops = held.agg(*[F.max(F.when(_finite(v), F.abs(v))).alias(name) for name, v in value.items()]).first()
        for name, v in value.items():
            # Far from the ends of the doubles, where a unit would leave their range.
            top = min(1000, max(-900, math.frexp(tops[name] or 0.0)[1]))
            units[name] = 2.0 ** (top - SUM_BITS)
            held = held.withColumn(f"_o_{name}", F.when(_finite(v), 0.0).otherwise(v))
            held = held.withColumn(f"_m_{name}", F.when(_finite(v), _fixed_point(v, top)))
    parts = [f"_m_{name}" for name in sums] + [f"_o_{name}" for name in doubles]
    totals = held.groupBy("_range", *groups).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t{c}") for c in parts])
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *[F.col(c).alias(f"_g_{c}") for c in groups],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in parts],
    )
    inside = Window.partitionBy("_range", *groups).orderBy(*_sort_columns(order))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lit(True)
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    right = offsets.withColumnRenamed("_range", "_r")
    joined = held.join(F.broadcast(right) if not groups else right, (F.col("_range") == F.col("_r")) & same)

    def total(c: str) -> Column:
        return F.col(f"_b{c}") + F.coalesce(F.sum(c).over(running), F.lit(0))

    def result(name: str) -> Column:
        if name not in units:
            return total(f"_m_{name}")
        return total(f"_m_{name}").cast("double") * F.lit(units[name]) + total(f"_o_{name}")

    return joined.select(
        *df.columns,
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias(index),
        *[result(name).alias(name) for name in sums],
    )


#: Bits of a value that the passes of :func:`exact_quantiles` tell apart, 64 in all.
DIGITS = (16, 12, 12, 12, 12)


def _sort_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; all NaNs are one value above the others."""
    clean = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = clean.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _from_sort_key(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _histograms(wanted: list[tuple[int, int]], digit: int, shift: int):
    """Counts, least and greatest key by the next digit of values whose leading digits are wanted.

    ``wanted``: (column, leading digits); ``shift``: the bits behind the next digit. One small table per task.
    """
    ahead = shift + digit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for c in sorted({c for c, _ in wanted}):
                keys = np.sort(_sort_keys(batch.column(c).drop_null().to_numpy(zero_copy_only=False)))
                for _, lead in (w for w in wanted if w[0] == c):
                    low, high = lead << ahead, (lead + 1 << ahead) - 1
                    own = keys[np.searchsorted(keys, np.uint64(low)) : np.searchsorted(keys, np.uint64(high), "right")]
                    if not len(own):
                        continue
                    digits = own >> np.uint64(shift) & np.uint64((1 << digit) - 1)
                    first = np.flatnonzero(np.diff(digits, prepend=np.uint64(1 << digit)))
                    for at, end in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                        seen = found.setdefault((c, lead, int(digits[at])), [0, 1 << 64, 0])
                        seen[0] += end - at
                        seen[1], seen[2] = min(seen[1], int(own[at])), max(seen[2], int(own[end - 1]))
        if found:
            names, rows = zip(*found.items(), strict=True)
            columns = [[n[0] for n in names], [str(n[1]) for n in names], [n[2] for n in names]]
            columns += [[r[0] for r in rows], *[[f"{r[i]:020d}" for r in rows] for i in (1, 2)]]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["c", "lead", "digit", "n", "low", "high"])

    return run


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of several columns, exact at any size, without moving a value.

    Radix selection: doubles are read as numbers in the same order; a pass counts the next digit of those
    values that may still be the ones looked for, per task first, and keeps the bin that holds the rank. After five
    passes at most (fewer where a bin holds one value) the value at a rank is known. A pass moves one row per task
    and bin, so neither rows nor distinct values bound it. Nulls do not count; NaN is above every number.
    """
    # Passes read the written columns; what they are computed from runs once.
    held = durable(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    known: dict[tuple[int, int], int] = {}  # (column, rank) -> key
    ranks: dict[tuple[int, int], tuple[int, int]] = {}  # (column, rank) -> leading digits, rank among their values
    sizes: dict[int, int] = {}
    wanted, shift = [(c, 0) for c in range(len(columns))], 64
    for digit in DIGITS:
        shift -= digit
        bins = held.mapInArrow(_histograms(wanted, digit, shift), "c int, lead string, digit int, n long, low string, high string")
        summed = bins.groupBy("c", "lead", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        table: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for r in summed.collect():
            table.setdefault((r["c"], int(r["lead"])), []).append((r["digit"], r["n"], int(r["low"]), int(r["high"])))
        if not sizes:
            sizes = {c: sum(n for _, n, _, _ in table.get((c, 0), [])) for c in range(len(columns))}
            missing = [columns[c] for c, n in sizes.items() if not n]
            if missing:
                raise ValueError(f"no values to take quantiles of: {missing}")
            lows = {(c, math.floor(p * (n - 1))) for c, n in sizes.items() for p in probabilities}
            ranks = {(c, r): (0, r) for c, low in lows for r in (low, min(low + 1, sizes[c] - 1))}
        left_open = {}
        for (c, rank), (lead, left) in ranks.items():
            for value, n, low, high in sorted(table[c, lead]):
                if left < n:
                    break
                left -= n
            if low == high:
                known[c, rank] = low
            else:
                left_open[c, rank] = (lead << digit | value, left)
        ranks = left_open
        wanted = sorted({(c, lead) for (c, _), (lead, _) in ranks.items()})
        if not wanted:
            break

    def quantile(c: int, p: float) -> float:
        place = p * (sizes[c] - 1)
        low = math.floor(place)
        a, b = (_from_sort_key(known[c, r]) for r in (low, min(low + 1, sizes[c] - 1)))
        return a if a == b or place == low else a + (b - a) * (place - low)

    return {name: [quantile(c, p) for p in probabilities] for c, name in enumerate(columns)}


def cyclic_successor(df: DataFrame, key: str, hashed: Column, carry: list[str], prefix: str = "next_") -> DataFrame:
    """Add ``carry`` columns of the row that follows in hash order; the last row gets the first.

    With two rows or more no row is its own successor; keys are unique. Only keys and hashes go round the ring: rows
    follow each other inside 65,536 hash prefixes (even by nature), the heads of these inside 256 shorter ones, and of
    those one list of 256 heads closes the ring. ``carry`` is joined to the pairs of keys afterwards.
    """
    ring = df.select(F.col(key).alias("_key"), hashed.alias("_h")).withColumn("_slot", F.substring("_h", 1, 4))
    heads = ring.groupBy("_slot").agg(F.min(F.struct("_h", "_key"))["_key"].alias("_head"))
    heads = heads.withColumn("_range", F.substring("_slot", 1, 2))
    firsts = heads.groupBy("_range").agg(F.min(F.struct("_slot", "_head"))["_head"].alias("_first"))
    listed = firsts.agg(F.array_sort(F.collect_list(F.struct("_range", "_first"))).alias("_all"))
    turned = listed.select(F.posexplode("_all").alias("_i", "_at"), "_all").select(
        "_at._range", F.get("_all", (F.col("_i") + 1) % F.size("_all"))["_first"].alias("_turn")
    )
    in_range = Window.partitionBy("_range").orderBy("_slot")
    following = heads.withColumn("_lead", F.lead("_head").over(in_range)).join(F.broadcast(turned), "_range").select(
        "_slot", F.coalesce("_lead", "_turn").alias("_following")
    )
    in_slot = Window.partitionBy("_slot").orderBy("_h", "_key")
    pairs = ring.withColumn("_inner", F.lead("_key").over(in_slot)).join(following, "_slot").select(
        "_key", F.coalesce("_inner", "_following").alias("_next")
    )
    lent = df.select(F.col(key).alias("_next"), *[F.col(c).alias(prefix + c) for c in carry])
    return df.join(pairs, F.col(key) == F.col("_key")).join(lent, "_next").select(*df.columns, *[prefix + c for c in carry])


def unique_rows(df: DataFrame, key: str, on_duplicate: str = "error", order: str | None = None) -> DataFrame:
    """One row per key. A repeated key fails the job (``error``) or keeps the row largest in ``order`` (``last``).

    The check groups by the join key, so a join that follows needs no further shuffle.
    """
    others = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in others])
    if on_duplicate == "last":
        if not order:
            raise ValueError("on_duplicate='last' needs an order column")
        kept = df.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_row"))
    elif on_duplicate == "error":
        counted = df.groupBy(key).agg(F.first(row).alias("_row"), F.count(F.lit(1)).alias("_n"))
        message = F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))
        kept = counted.select(key, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_row")).alias("_row"))
    else:
        raise ValueError(f"unknown on_duplicate: {on_duplicate}")
    return kept.select(key, *[F.col("_row")[c].alias(c) for c in others])
