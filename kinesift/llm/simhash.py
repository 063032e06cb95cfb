"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits and two of them link at three or fewer differing bits, so in one of two
31-bit halves (bits 0-30 and 32-62) they differ in at most one. In each half the anchors are the words
of the [31, 26] Hamming code, whose covering radius is 1: every half lies within 1 of exactly one
anchor, its home. A half that differs from another in at most one bit lies within 1 + 1 = 2 of the
other's home. So each fingerprint is replicated to all anchors within radius plus threshold (16 of
the 2**26, or 1 where the half is an anchor itself), and per anchor those at home are compared with
those replicated to it. No link is lost: the two halves leave no other case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.llm.components import components
from kinesift.llm.text import stored

SEED = 42
LINK_BITS = 3
HALF_BITS = 31
#: Hashes whose bits are counted at once.
BLOCK = 16384


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """Bitwise majority of the XXH64 hashes of word shingles; no word gives 0, fewer than ``width`` one shingle.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` parts at the six ASCII white-space characters.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if n > 1 or len(words) == width else [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every text as a signed long. Null text counts as empty."""
    key_type = docs.schema[key].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["key", "fp"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(measure, T.StructType([T.StructField("key", key_type), T.StructField("fp", T.LongType())]))


def _flips() -> np.ndarray:
    """Row s: the 16 bit masks that lead from a word with syndrome s to anchors at distance 1 and 2."""
    out = np.zeros((32, 16), np.int64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        out[s] = [1 << (s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs)]
    return out


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(half.shape, np.int64)
    for p in range(1, HALF_BITS + 1):
        out ^= ((half >> (p - 1)) & 1) * p
    return out


def anchors(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``marks`` (fp) -> homes and replicas, both (anchor, fp); the anchor's bit 31 tells the half."""
    flips = _flips()

    def spread(near: bool):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    fp = batch.column(0).to_numpy(zero_copy_only=False)[at : at + BLOCK]
                    for side in (0, 1):
                        half = (fp.view(np.uint64) >> np.uint64(32 * side)).astype(np.int64) & (2**HALF_BITS - 1)
                        s = _syndrome(half)
                        masks = flips[s] if near else flips[s][:, :1]
                        keep = np.ones(masks.shape, bool)
                        keep[s == 0, 1:] = False
                        key = (half[:, None] ^ masks) | (side << HALF_BITS)
                        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(np.repeat(fp, keep.sum(1)))], ["anchor", "fp"])

        return emit

    shape = "anchor long, fp long"
    return marks.select("fp").mapInArrow(spread(False), shape), marks.select("fp").mapInArrow(spread(True), shape)


def links(marks: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """(a, b): pairs of different fingerprints at ``bits`` (3 at most) or fewer differing bits."""
    if not 0 <= bits <= LINK_BITS:
        raise ValueError("two halves with one differing bit each cover three bits at most")
    home, near = anchors(marks)
    # A side has up to 32 rows for one of ``marks``, which Spark's estimate does not know: never broadcast it.
    h, v = home.alias("h"), near.hint("merge").alias("v")
    close = (F.col("h.fp") < F.col("v.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("v.fp"))) <= bits)
    return h.join(v, (F.col("h.anchor") == F.col("v.anchor")) & close).select(F.col("h.fp").alias("a"), F.col("v.fp").alias("b"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = LINK_BITS) -> DataFrame:
    """One row per document: (key, fp, component_id), component_id being the smallest key reachable over links.

    Equal fingerprints link too, so exact copies share one row of the fingerprint table from here on. Texts
    without a word have fingerprint zero and link like any other. Repeated rows give repeated rows; null keys
    take part and are never a component's id unless it has no other. An empty table gives an empty one.
    """
    marks = stored(with_fingerprints(docs, key, text, width), "fingerprints")
    rooted = _rooted(marks, bits)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = stored(rooted.join(ids, "root").select("fp", "component_id"), "components")
    return marks.join(by_mark, "fp").select(F.col("key").alias(key), "fp", "component_id")


def _rooted(marks: DataFrame, bits: int) -> DataFrame:
    """(fp, least, root): every fingerprint, its smallest key, and the smallest fingerprint reachable over links."""
    distinct = stored(marks.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    roots = stored(components(links(distinct, bits)), "roots")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """One row of each group, with all columns as they are: the one with the smallest key (null last), then text hash.

    The group itself is what rows share, not a key, so rows without a key, or with the key of a row of another group, stay as any others.
    """
    hashed = F.xxhash64(F.col(text).cast("string"))
    rows = docs.select(F.struct(F.col(key).alias("key"), hashed.alias("hash")).alias("id"), F.col(text).alias("text"))
    marks = stored(with_fingerprints(rows, "id", "text").select("key.key", "key.hash", "fp"), "fingerprints")
    by_root = stored(_rooted(marks, bits).select("fp", "root"), "groups")
    each = marks.join(by_root, "fp").groupBy("root", "key", "hash").agg(F.count(F.lit(1)).alias("n"))
    heads = each.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash", "n")).alias("head"))
    stay = stored(heads.select("root", "head.key", "head.hash", "head.n"), "staying").alias("h")
    # Equal keys and text hashes are equal texts and so in one group: no row heads two groups.
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_key"), hashed.alias("_hash")).alias("d")
    same = F.col("d._key").eqNullSafe(F.col("h.key")) & (F.col("d._hash") == F.col("h.hash"))
    kept = named.join(stay, same).select("d.row", "h.root", "d._hash")
    if not stay.filter("n > 1").isEmpty():
        kept = kept.groupBy("root").agg(F.min_by("row", "_hash").alias("row"))
    return kept.select("row.*")
