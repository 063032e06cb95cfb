"""What the operators of this folder share: words, tables, stored intermediate results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesift.session import stage_path

#: White space between words; a word is any other run of characters.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the written copy."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a table that tells which hashes of a set may occur.
TABLE_BITS = 26


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of 2**TABLE_BITS bits (8 MB, whatever the rows): the bits of the one long column's values are set.

    It lets through all rows of a set and few others before a join; where it fills up it only stops saving.
    """
    place = F.pmod(F.col(hashes.columns[0]), F.lit(1 << TABLE_BITS))
    table = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    parts = hashes.groupBy(F.shiftright(place, 15).cast("int").alias("k")).agg(
        F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("bits")
    )
    for row in parts.toLocalIterator():
        table[row["k"] * 4096 : (row["k"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    spot = hashes & ((1 << TABLE_BITS) - 1)
    return ((table[spot >> 3] >> (spot & 7)) & 1).astype(bool)


#: Bytes of text that a worker holds in arrays at once; a longer text is held alone.
PART_BYTES = 4 << 20


def parts(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``text`` of each part has ``PART_BYTES`` or one row at most."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def least_places(hashes: np.ndarray, width: int, bits: int = 24) -> np.ndarray:
    """For every ``width`` hashes in a row, the first place of the least one.

    The low ``bits`` of a hash give way to its place, so there may be 2**bits hashes at most.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = np.uint64(bits)
    whole = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(hashes)] = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    table = whole.reshape(-1, width)
    up = np.minimum.accumulate(table, axis=1).ravel()
    down = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(hashes) - width + 1
    least = np.minimum(down[:n], up[width - 1 : width - 1 + n])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)
