"""Hash-based order and buckets: the same in any partitioning and in any engine.

Where a seeded shuffle is called for, rows or array items are ordered by
``md5(seed:key[:position])`` instead of by a generator's state, so a result does not
depend on which task saw a row first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.session import durable


def order_hash(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hex_number(hexed: Column, digits: int) -> Column:
    """The first ``digits`` hex digits as a number."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint")


def sha_bucket(key: Column, modulus: int) -> Column:
    """sha256(key), first 12 hex digits, modulo ``modulus``."""
    return F.pmod(hex_number(F.sha2(key.cast("string"), 256), 12), F.lit(modulus))


def hash_unit(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the order hash."""
    return hex_number(order_hash(seed, *keys), 8) / F.lit(4294967296.0)


def shuffled_indices(n: Column, seed: int | str, *keys: Column) -> Column:
    """Positions 0..n-1 in hash order, as an array."""
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    keyed = F.transform(positions, lambda i: F.struct(order_hash(seed, *keys, i).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def pick(items: Column, indices: Column) -> Column:
    """``items`` in the order of 0-based ``indices``."""
    return F.transform(indices, lambda i: F.get(items, i))


SMALL_BIN = 100_000


def hash_cutoff(df: DataFrame, hashed: Column, wanted: int | Callable[[int], int]) -> str | None:
    """The n-th smallest hash of ``df``, so that ``hash <= cutoff`` keeps exactly n rows; None for n = 0.

    ``wanted`` is n or a function of the row count. Rows are counted by 4-digit prefix (at most 65,536
    numbers reach the driver), then again inside the one prefix that holds the n-th hash until few
    rows share it; only those are sorted. Hashes must be distinct.
    """
    # Only the hashes are kept: every further pass reads them, not what the rows are computed from.
    hashes = durable(df.select(hashed.alias("h")))
    prefix, left, digits = "", None, 4
    while True:
        counts = hashes.groupBy(F.substring("h", 1, digits).alias("p")).count().collect()
        if left is None:
            total = sum(r["count"] for r in counts)
            left = wanted(total) if callable(wanted) else wanted
            if left <= 0:
                return None
            if left > total:
                return "g"
        for row in sorted(counts, key=lambda r: r["p"]):
            if left <= row["count"]:
                prefix = row["p"]
                break
            left -= row["count"]
        hashes = hashes.filter(F.substring("h", 1, digits) == prefix)
        if row["count"] <= SMALL_BIN:
            return hashes.orderBy("h").limit(left).agg(F.max("h")).first()[0]
        digits += 4
