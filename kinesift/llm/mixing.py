"""Mixing sources to target weights by fitting a budget of words.

Every source gets a target by weighted shares with a ceiling. Whole passes over the source come first; what
is left of the target is met by a subset of its documents: documents are counted by exact length, an
even share of every length is taken, and a bounded-knapsack program over the spare documents fits the
remaining budget. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesift.llm.text import stored, word_count
from kinesift.operators.scan import prefix_scan

SEED = 17
CEILING = 3
#: Seeded slices that a length of a source is dealt into, so no slice of a hot length is a task's burden.
SLICES = 1024
#: Rounding is made good length by length down to half of this many words, then by the knapsack program.
PROGRAM_WORDS = 1 << 17
#: Sums that the program tells apart; larger ones are counted in a coarser unit, and what its rounding leaves is fitted again.
PROGRAM_SUMS = 1 << 24


def fit_subset(budget: int, lengths: np.ndarray, spare: np.ndarray, above: bool = False) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as they can
    without passing it, or (``above``) without staying below it; bounded knapsack over binary-split counts.

    ``first[s]`` is the item that first made the sum s reachable. Items with a smaller number made the rest
    of that sum, so following it down uses no item twice.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    # The smallest sum from ``budget`` on is passed by one document, so it is less than the longest above it.
    top = budget + int(lengths[spare > 0].max(initial=1)) - 1 if above else budget
    unit = 1 + top // PROGRAM_SUMS
    if unit > 1:
        budget, top, lengths = budget // unit, top // unit, -(-lengths // unit)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    first = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for k, (size, most) in enumerate(zip(lengths.tolist(), spare.tolist(), strict=True)):
        left, part = min(most, top // size) if size else 0, 1
        while left > 0 and not reached[budget]:
            part = min(part, left)
            step = size * part
            new = reached[: top + 1 - step] & ~reached[step:]
            at = np.flatnonzero(new) + step
            first[at] = len(items)
            reached[at] = True
            items.append((k, part))
            left -= part
            part *= 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    s = int(sums[min(np.searchsorted(sums, budget), len(sums) - 1)] if above else sums[np.searchsorted(sums, budget, "right") - 1])
    while s:
        k, part = items[first[s]]
        taken[k] += part
        s -= int(lengths[k]) * part
    return taken


def fitted(rest: int, lengths: np.ndarray, counts: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """``extra`` changed so that its words come near to ``rest``, from below or above.

    Documents are added up to what is missing, or beyond it and then others taken out again.
    """

    def change(now: np.ndarray, above: bool) -> np.ndarray:
        off = rest - int((lengths * now).sum())
        spare, sign = (counts - now, 1) if off > 0 else (now, -1)
        use = (lengths > 0) & (spare > 0)
        new = now.copy()
        new[use] += sign * fit_subset(abs(off), lengths[use], spare[use], above)
        return new

    def miss(now: np.ndarray) -> int:
        return abs(rest - int((lengths * now).sum()))

    while miss(extra):
        options = [change(extra, False)]
        if miss(options[0]):
            options.append(change(extra, True))
            options += [change(o, False) for o in options if miss(o)]
        best = min(options, key=miss)
        if miss(best) >= miss(extra):
            break
        extra = best
    return extra


def plan_lengths(target: float, lengths: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(passes, extra): every document ``passes`` times, and of each length ``extra`` documents once more.

    An even share, rounded down, is taken of every length; then one more of the lengths that lost most by
    rounding (ties in a seeded order), while it fits; then the knapsack program meets the rest.
    """
    total = int((lengths * counts).sum())
    want = int(round(target))
    extra = np.zeros(len(lengths), np.int64)
    if total <= 0:
        return 0, extra
    passes, rest = divmod(want, total)
    share = counts * (rest / total)
    extra = np.minimum(np.floor(share).astype(np.int64), counts)
    extra[lengths <= 0] = 0
    left = rest - int((lengths * extra).sum())
    mark = (lengths.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    mark = (mark ^ (mark >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    for k in np.lexsort((mark, extra - share)):
        if left <= PROGRAM_WORDS // 2:
            break
        if 0 < lengths[k] <= left and extra[k] < counts[k]:
            extra[k] += 1
            left -= int(lengths[k])
    return passes, fitted(rest, lengths, counts, extra)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = CEILING) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: weighted shares of all words, none above ``ceiling`` times the size.

    Sources weigh ``weights`` in code-point order, null last, over and over. Raising the common level to where
    the shares below their ceiling take up what the others leave is the fixed point of sharing the excess anew.
    Only sums over the sources leave the table.
    """
    totals = totals.withColumn("_last", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    ranked = prefix_scan(totals, ["_last", "_name"], index="_rank")
    levels = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(
        ranked.select("source", "source_size", F.get(levels, (F.col("_rank") % len(weights)).cast("int")).alias("_w")), "sources"
    )
    cap = F.col("source_size") * float(ceiling)
    level = 0.0
    while True:
        full = F.col("_w") * level >= cap
        got = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(~full, F.col("_w")).otherwise(0.0)).alias("open"),
        ).first()
        if not got["all"] or not got["open"]:
            break
        raised = (got["all"] - got["held"]) / got["open"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return weighed.select("source", "source_size", F.least(cap, F.col("_w") * level).alias("target"))


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, slice, order) of every document, written once."""
    mark = F.xxhash64(F.lit(SEED), F.col(key), F.col(source))
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        F.pmod(mark, F.lit(SLICES)).cast("int").alias("slice"),
        F.xxhash64(F.lit(SEED + 1), mark).alias("order"),
    )
    return stored(rows, "sizes")


def _same(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return out


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, times): ``times`` says how often the mix takes a document.

    It is never above the ceiling. Null texts and texts without a word have size 0 and are taken as often as their
    source has whole passes; their source may have size and target 0. Rows that repeat a key count as documents of
    their own. Ties of the seeded order fall to equal rows only. An empty table gives an empty one.
    """
    rows = sized(docs, key, text, source)
    slices = stored(rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "slices")
    lengths = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = slices.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(totals), "targets")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        passes, extra = plan_lengths(float(group["target"].iloc[0]), group["size"].to_numpy(), group["n"].to_numpy())
        return group[["source", "size", "source_size", "target"]].assign(passes=passes, extra=extra)

    counted = lengths.alias("l").join(targets.alias("r"), _same("source")).select("l.*", "r.source_size", "r.target")
    planned = counted.groupBy("source").applyInPandas(
        plan, "source string, size long, source_size long, target double, passes long, extra long"
    )
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    need = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))))
    by_slice = stored(
        slices.alias("l")
        .join(planned.alias("r"), _same("source", "size"))
        .select("l.source", "l.size", "l.slice", "l.n", "r.source_size", "r.target", "r.passes", "r.extra")
        .withColumn("need", need)
        .drop("extra"),
        "mix-plan",
    )
    found = rows.alias("l").join(by_slice.alias("r"), _same("source", "size", "slice")).select("l.*", *[f"r.{c}" for c in ("n", "source_size", "target", "passes", "need")])
    split = (F.col("need") > 0) & (F.col("need") < F.col("n"))
    place = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("order", "key"))
    whole = found.filter(~split).withColumn("more", (F.col("need") > 0).cast("long"))
    partly = found.filter(split).withColumn("more", (place <= F.col("need")).cast("long"))
    both = whole.unionByName(partly)
    return both.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("passes") + F.col("more")).alias("times")
    )


def draw(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as ``mixed`` takes it, with its columns as they are.

    Rows that repeat a key are drawn as often as the rows of that key together, dealt evenly and the first text
    hashes first.
    """
    times = mixed(docs, key, text, source).groupBy(key).agg(F.sum("times").alias("t"), F.count(F.lit(1)).alias("n"))
    times = times.select(F.col(key).alias("_key"), "t", "n")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_key"))
    taken = rows.alias("l").join(times.filter("t > 0").alias("r"), F.col("l._key").eqNullSafe(F.col("r._key"))).select("l.row", "l._key", "r.t", "r.n")
    single = taken.filter("n = 1").select("row", F.col("t").cast("int").alias("times"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(f"row.{text}"))) - 1
    several = taken.filter("n > 1").select("row", (F.floor(F.col("t") / F.col("n")) + (place < F.col("t") % F.col("n")).cast("long")).cast("int").alias("times"))
    return single.union(several).select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
