"""Repeated byte strings across all texts: distributed prefix doubling over blocks of positions.

A string of ``LENGTH`` bytes that starts at two places repeats. Ranking every position of a corpus writes
many times its size, so positions enter in blocks. The anchor of a string is the leftmost place in it where
the hash of ``GRAM`` bytes is least; it depends on the string alone, so equal strings have equal anchors, at
the same distance from their start. The starts that share an anchor lie next to each other: a block.

Every step ranks blocks by the bytes that all strings of a block share - first the ``GRAM`` bytes at the
anchor - and Spark sorts (rank, bytes of the whole block) pairs:

* a rank that occurs once: none of the block's strings repeats, it drops out;
* a block whose bytes occur twice as a whole: all of its strings repeat, it is settled;
* otherwise the block is cut into parts of ``WIDTHS`` starts, whose shared bytes reach further on both
  sides. Parts of one start share all ``LENGTH`` bytes, and the ranking ends there.

Ranks are 64-bit digests and the bytes behind them a second one, so strings count as equal on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesift.llm.text import least_places, parts, stored

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes that the first ranks stand for. A power of two, 8 or more.
GRAM = 32
#: Starts in a part, step by step.
WIDTHS = (64, 16, 4, 1)
#: Documents and rows looked at to find ranks that a large share of rows has. They decide where such rows are
#: sent, not what becomes of them.
SAMPLE = 20_000
#: A rank is spread over tasks when it has this share of the sampled rows (so there are 1 / SHARE at most).
SHARE = 1e-3

#: A block: first start << 24 | further starts << 12 | least distance from a start to the anchor.
ROWS = "rank long, u long, doc long, mark long, block long, at long, settled boolean"


def row_mark(text: Column) -> Column:
    """With the document's id, the identity of a row; rows equal in both have equal results."""
    return F.xxhash64(text)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at every place, by doubling."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = wide * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    reach = 8
    while reach < gram:
        h = h[:-reach] * np.uint64(0xBF58476D1CE4E5B9) + h[reach:]
        h ^= h >> np.uint64(32)
        reach *= 2
    return h * np.uint64(0x94D049BB133111EB)


#: Texts are hashed so many bytes at a time.
PIECE = 4 << 20


def blocks_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, gram hash) of every block of texts that lie one after another.

    ``ends`` are the places behind each text; no string reaches over one.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    h = _gram_hashes(data, gram)
    anchor = least_places(h, length - gram + 1)
    fits = np.zeros(len(anchor), bool)
    begins = np.concatenate([[0], ends[:-1]])
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= length:
            fits[b : e - length + 1] = True
    starts = np.flatnonzero(fits)
    if not len(starts):
        return none
    anchor = anchor[starts]
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(starts)]]) - 1
    return anchor[first], starts[first], starts[last], h[anchor[first]]


def _lots(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, first byte, piece) in lots of about ``PIECE`` bytes; every string of a text starts in one piece."""
    lot, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            if lot and size + len(piece) > PIECE:
                yield lot
                lot, size = [], 0
            lot.append((i, at, piece))
            size += len(piece)
    if lot:
        yield lot


def _first_blocks(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            docs, marks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for lot in _lots(batch.column(2).cast(pa.binary()).to_pylist(), length):
                data = b"".join(p for _, _, p in lot)
                ends = np.cumsum([len(p) for _, _, p in lot])
                anchor, first, last, h = blocks_of(np.frombuffer(data, np.uint8), ends, length, gram)
                owner = np.searchsorted(ends, first, "right")
                lo, span = anchor - last, last - first
                shift = np.array([at - (ends[k] - len(p)) for k, (_, at, p) in enumerate(lot)], np.int64)
                row = np.array([i for i, _, _ in lot], np.int64)[owner]
                digest = xxhash.xxh3_64_intdigest
                u = np.fromiter(
                    (digest(data[s : e + length], d) for s, e, d in zip(first.tolist(), last.tolist(), lo.tolist(), strict=True)),
                    np.uint64,
                    len(first),
                )
                at = (first + shift[owner]) << 24 | span << 12 | lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (h.view(np.int64), u.view(np.int64), [docs[i] for i in row], marks[row], at, at)]
                    + [pa.array(np.zeros(len(at), bool))],
                    names=["rank", "u", "doc", "mark", "block", "at", "settled"],
                )

    return run


def _common(sample: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The few values of ``keys`` that hold a large share of the sampled rows."""
    least = max(8, SHARE * sample.count())
    counted = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") >= least).select(*keys, F.lit(True).alias(name))


def _sorted_ranks(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """``rows`` (``ROWS``) whose rank repeats, with ``repeats`` (the block's bytes do) and ``open`` (to be cut).

    Of blocks with the same bytes only one stays open. Rows of a common rank are told to repeat by the
    sample that found them, and are spread by their bytes; rows with common bytes, by their place.
    """
    ranks = F.broadcast(_common(sample, ["rank"], "_rank_common"))
    pairs = F.broadcast(_common(sample, ["rank", "u"], "_pair_common"))
    known, often = F.coalesce("_pair_common", F.lit(False)), F.coalesce("_rank_common", F.lit(False))
    spread = (
        F.when(known, F.xxhash64("doc", "mark", "block", "at"))
        .when(often, F.xxhash64("rank", "u"))
        .otherwise(F.col("rank"))
    )
    dealt = rows.join(ranks, "rank", "left").join(pairs, ["rank", "u"], "left").select(
        spread.alias("part"), "u", "doc", "mark", "block", "at", "settled", known.alias("known"), often.alias("often")
    )
    by_u = Window.partitionBy("part").orderBy("u", "settled")
    whole = by_u.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag("u").over(by_u), F.lead("u").over(by_u)
    twice = F.col("known") | F.coalesce(before == F.col("u"), F.lit(False)) | F.coalesce(after == F.col("u"), F.lit(False))
    seen = dealt.select(
        "*",
        twice.alias("repeats"),
        F.coalesce(before != F.col("u"), F.lit(True)).alias("_first"),
        (F.first("u").over(whole) != F.last("u").over(whole)).alias("_many"),
    )
    waits = F.max(~F.col("settled") & ~F.col("repeats")).over(Window.partitionBy("part"))
    found = seen.select("*", waits.alias("_waits"))
    cut = F.col("_first") & ~F.col("known") & (F.col("often") | (F.col("_many") & F.col("_waits")))
    kept = found.select("doc", "mark", "block", "at", "settled", "repeats", cut.alias("open")).filter("repeats or open")
    # Common bytes: the smallest of the sampled blocks stands for all of them.
    chosen = F.min(F.struct("doc", "mark", "block", "at"))
    stand_in = sample.join(pairs, ["rank", "u"]).groupBy("rank", "u").agg(chosen.alias("c")).select(
        "c.*", F.lit(True).alias("settled"), F.lit(True).alias("repeats"), F.lit(True).alias("open")
    )
    return kept.unionByName(stand_in)


def _block_texts(length: int):
    """(doc, mark, text, [open blocks]) -> (doc, mark, block, settled, bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            docs, marks, texts, lists = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))
            out = []
            for doc, mark, text, items in zip(docs, marks, texts, lists, strict=True):
                for item in items:
                    at = item["at"]
                    start, span = at >> 24, at >> 12 & 4095
                    out.append((doc, mark, at, item["settled"], text[start : start + span + length]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)],
                    names=["doc", "mark", "block", "settled", "bytes"],
                )

    return run


def _cut_blocks(width: int, length: int):
    """(doc, mark, block, bytes, [open parts]) -> the ranks of their parts of ``width`` starts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for doc, mark, block, data, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                far = (block & 4095) + (block >> 12 & 4095)  # from the first start to the anchor
                for item in items:
                    at = item["at"]
                    low = at & 4095
                    high = low + (at >> 12 & 4095)
                    for base in range(low // width * width, high + 1, width):
                        x, y = max(low, base), min(high, base + width - 1)
                        rank = digest(data[far - base : far - base - width + 1 + length], base)
                        u = digest(data[far - y : far - x + length], length + x)
                        part = ((block >> 24) + far - y) << 24 | (y - x) << 12 | x
                        out.append((rank, u, doc, mark, block, part, item["settled"]))
            if out:
                rank, u, *rest = zip(*out, strict=True)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (rank, u)]
                yield pa.RecordBatch.from_arrays(
                    signed + [pa.array(x, t) for x, t in zip(rest, [pa.int64()] * 4 + [pa.bool_()], strict=True)],
                    names=["rank", "u", "doc", "mark", "block", "at", "settled"],
                )

    return run


def _with_open(held: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``held`` with the list of their open blocks in ``items``; rows without one go."""
    item = F.struct("at", (F.col("settled") | F.col("repeats")).alias("settled"))
    lists = ranked.filter("open").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.collect_set(item).alias("items"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "doc" else F.col(k) == F.col(f"_{k}"))
    return held.join(lists, same)


def repeated_blocks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, mark, at): blocks of starts of strings that also start elsewhere; ``docs`` has doc_id and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), row_mark(F.col("text")).alias("mark"), "text").filter(
        F.octet_length("text") >= length
    )
    share = max(1, -(-docs.count() // SAMPLE))
    some = texts.filter(F.pmod(F.xxhash64("mark", "doc", F.lit(7)), F.lit(share)) == 0)
    sample = stored(some.mapInArrow(_first_blocks(length, gram), ROWS), "suffix-sample")
    found = stored(_sorted_ranks(texts.mapInArrow(_first_blocks(length, gram), ROWS), sample), "suffix-ranks")
    lost = found.filter("repeats and not settled").select("doc", "mark", "at")

    held = _with_open(texts, found, ["doc", "mark"]).select("doc", "mark", "text", "items")
    blocks = stored(
        held.mapInArrow(_block_texts(length), "doc long, mark long, block long, settled boolean, bytes binary"), "suffix-blocks"
    )
    opened = blocks.select("doc", "mark", "block", F.col("block").alias("at"), "settled", F.lit(False).alias("repeats"), F.lit(True).alias("open"))
    for width in (w for w in WIDTHS if w < length):
        ready = _with_open(blocks, opened, ["doc", "mark", "block"]).select("doc", "mark", "block", "bytes", "items")
        rows = stored(ready.mapInArrow(_cut_blocks(width, length), ROWS), "suffix-parts")
        share = max(1, -(-rows.count() // (10 * SAMPLE)))
        some = rows.filter(F.pmod(F.xxhash64("mark", "doc", "block", F.lit(7)), F.lit(share)) == 0)
        opened = stored(_sorted_ranks(rows, some), "suffix-ranks")
        lost = lost.unionByName(opened.filter("repeats and not settled").select("doc", "mark", "at"))
    return lost


def _without(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            texts, lists = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            for i, text in enumerate(texts):
                text = text or b""
                at = np.unique(lists[i].values.to_numpy()) if lists[i].is_valid else np.zeros(0, np.int64)
                first = at >> 24
                ends = np.maximum.accumulate(first + (at >> 12 & 4095) + length) if len(at) else first
                gap = np.flatnonzero(first[1:] > ends[:-1]) + 1
                begins = first[np.concatenate([[0], gap])] if len(at) else first
                stops = ends[np.concatenate([gap - 1, [len(at) - 1]])] if len(at) else first
                n_bytes.append(len(text))
                n_removed.append(int((stops - begins).sum()))
                n_spans.append(len(begins))
                if len(begins):
                    edges = [0, *np.stack([begins, stops], 1).ravel().tolist(), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): texts without every byte of a string of ``length`` bytes that also starts elsewhere.

    ``docs`` has doc_id (long; null or repeated ids are fine) and text; all columns but the text come back in
    ``row``, whatever their names. ``n_spans`` counts removed runs; ``kept`` holds the remaining bytes and may cut
    a character. Null texts count as empty; strings never cross documents; equal rows are removed alike. Very
    long texts are hashed in overlapping pieces. An empty table gives an empty one.
    """
    lost = repeated_blocks(docs, length)
    lists = lost.groupBy("doc", "mark").agg(F.collect_list("at").alias("lost"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(row, "text", F.col("doc_id").cast("long").alias("_doc"), row_mark(F.col("text")).alias("_mark"))
    both = rows.join(lists, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_mark") == F.col("mark")), "left")
    schema = both.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return both.select("row", "text", "lost").mapInArrow(_without(length), schema)


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per document, the kept bytes as a digest."""
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
