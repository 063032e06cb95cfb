"""Line dedup by an exact set-similarity join.

A line is the set of its words. Of all lines whose Jaccard similarity to an earlier line (in the order of
documents and lines) is 0.8 or more, none is kept. Equal sets meet by a hash of the set; for the others

1. words are counted, and a line's words are ordered by rarity (ties by hash, so the order is the same everywhere);
2. similar lines share a word among their first n - ceil(0.8 n) + 1, so only these prefixes meet, and of
   them only words that occur in more than one line;
3. where they meet, lengths, positions and the parity of words over 128 bits bound the possible overlap; of the
   smaller of two sets the first n - ceil(8/9 n) + 1 words will do;
4. the pairs left over are verified on their words.

Sets are numbered in the order of their first lines, so two of them tell by their numbers which one is earlier.

Word counts are kept for hashed words in a table of fixed size: sharing a counter can make a word seem less
rare than it is, which costs candidates, never results. Words are compared by 44 bits of a 64-bit hash.
Sets with a word that many lines have meet by bands of length besides, as only lengths within 4 to 5 can be alike.
Groups of many similar lines are met in two steps, see ``similar_to_earlier``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesift.llm.text import bit_table, may_hold, parts, stored

#: Bits of the word hash, and of the number of its counter.
WORD_BITS, COUNTER_BITS = 44, 22
SLICE = 1 << 16
#: Words that more lines than this have are met by bands of length.
FEW = 64
#: Bytes of text whose words are found at once.
CHUNK = 1 << 18
#: Shares that the sets of a word are dealt into for the first step, and how many sets before it each meets there.
SALTS = 16
NEIGHBOURS = 4


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class LineReader:
    """Finds words and lines of Arrow batches with array operations; keeps its tables of powers."""

    base = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.gap = np.zeros(256, bool)
        self.gap[[9, 10, 11, 12, 13, 32]] = True
        self.power = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            inverse = pow(self.base, -1, 1 << 64)
            self.power = np.cumprod(np.full(n, self.base, np.uint64))
            self.back = np.cumprod(np.full(n, inverse, np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every word of the texts that begin at ``starts``; a hash is a polynomial of the bytes."""
        gap = self.gap[data]
        begin = ~gap
        begin[1:] &= gap[:-1]
        first = starts[starts < len(data)]
        begin[first] = ~gap[first]
        end = ~gap
        end[:-1] &= gap[1:]
        last = first[first > 0] - 1
        end[last] = ~gap[last]
        at, to = np.flatnonzero(begin), np.flatnonzero(end)
        out = np.empty(len(at), np.uint64)
        done = 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(to, at[done] + CHUNK, "right")))
            a, b = at[done:upto] - at[done], to[done:upto] - at[done]
            size = int(b[-1]) + 1
            self._powers(size)
            total = np.cumsum((data[at[done] : at[done] + size].astype(np.uint64) + np.uint64(1)) * self.power[:size])
            before = np.where(a > 0, total[a - 1], np.uint64(0))
            out[done:upto] = _mix((total[b] - before) * self.back[a])
            done = upto
        return at, out

    def lines(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The lines with a word: ``doc`` (place in the batch), ``line`` (number in the text), ``start`` of their words,
        ``n``; and ``word``, the distinct words of all lines, in order of lines."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        at, h = self.words(data, offsets[:-1])
        if not len(at):
            none = np.zeros(0, np.int64)
            return {"doc": none, "line": none, "start": none, "n": none, "word": none.astype(np.uint64)}
        breaks = np.cumsum(data == 10, dtype=np.int32)
        doc = np.searchsorted(offsets, at, "right") - 1
        before = np.where(offsets[:-1] > 0, breaks[np.maximum(offsets[:-1] - 1, 0)], 0)
        line = breaks[at] - before[doc]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        place = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        out = {"doc": doc[first], "line": line[first]}
        words = []
        counts = np.zeros(len(first), np.int64)
        step = 1 << (64 - WORD_BITS)
        for low in range(0, len(first), step):
            a = first[low]
            b = first[low + step] if low + step < len(first) else len(at)
            key = np.sort(((place[a:b] - low).astype(np.uint64) << np.uint64(WORD_BITS)) | (h[a:b] >> np.uint64(64 - WORD_BITS)))
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            words.append(key & np.uint64((1 << WORD_BITS) - 1))
            found = np.bincount((key >> np.uint64(WORD_BITS)).astype(np.int64))
            counts[low : low + len(found)] = found
        return out | {"n": counts, "start": np.cumsum(counts) - counts, "word": np.concatenate(words)}


def _set_ids(found: dict[str, np.ndarray]) -> np.ndarray:
    sums = np.add.reduceat(_mix(found["word"] + np.uint64(1)), found["start"]) if len(found["n"]) else np.zeros(0, np.uint64)
    return _mix(sums + found["n"].astype(np.uint64)).view(np.int64)


def _counter(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(WORD_BITS - COUNTER_BITS)).astype(np.int64)


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts in 12 bits and in their order: exact up to 2,048, in steps of 1.1 % from there to any number of lines."""
    return np.where(counts <= 2048, counts, np.minimum(4095, 2048 + np.floor(64 * np.log2(np.maximum(counts, 2048) / 2048)))).astype(np.uint16)


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """In how many lines each counter's words occur, as a code of 12 bits: a table of 2**COUNTER_BITS numbers.

    Every task counts its lines (up to 65,535 each) and sends its table in slices; the slices are added up in parallel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total, waiting, held = LineReader(), np.zeros(1 << COUNTER_BITS, np.int64), [], 0
        for batch in parts(batches, 0):
            waiting.append(_counter(reader.lines(batch.column(0))["word"]))
            held += len(waiting[-1])
            if held > 1 << COUNTER_BITS:
                total += np.bincount(np.concatenate(waiting), minlength=len(total))
                waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
        if total.any():
            slices = np.minimum(total, 65535).astype(np.uint16).reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([p.tobytes() for p in slices], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.uint16).astype(np.int64)
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_code(t).tobytes()], pa.binary())], ["slice", "counts"])

    shape = "slice int, counts binary"
    sent = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, shape)
    table = np.zeros((1 << COUNTER_BITS) // SLICE * SLICE, np.uint16)
    for row in sent.repartition("slice").mapInArrow(add, shape).toLocalIterator():
        table[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.uint16)
    return table


LINE_SHAPE = "doc {key}, mark long, line int, n_lines int, set long, n int, p0 long, p1 long, rare int, prefix array<int>"


def with_prefixes(docs: DataFrame, key: str, text: str, counts: np.ndarray) -> DataFrame:
    """Every line with a word: its place, how many its text has (0 but at the first of them), the hash of its word set, their number, their parity over 128 bits, and
    the prefix words that other lines may share, rarest first; ``rare`` of them are in few lines."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shape = LINE_SHAPE.format(key=docs.schema[key].dataType.simpleString())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for batch in parts(batches, 2):
            found = reader.lines(batch.column(2))
            n, start, word = found["n"], found["start"], found["word"]
            if not len(n):
                continue
            place = np.repeat(np.arange(len(n)), n)
            often = shared.value[_counter(word)].astype(np.uint64)
            rank = (often << np.uint64(32)) | (word >> np.uint64(WORD_BITS - 32))
            order = np.empty(len(word), np.uint64)
            step = 1 << 20
            for low in range(0, len(n), step):
                a, b = start[low], start[low + step] if low + step < len(n) else len(word)
                order[a:b] = np.sort(((place[a:b] - low).astype(np.uint64) << np.uint64(WORD_BITS)) | rank[a:b])
            order &= np.uint64((1 << WORD_BITS) - 1)
            often = (order >> np.uint64(32)).astype(np.int64)
            prefix = n - (4 * n + 4) // 5 + 1
            use = (np.arange(len(word)) - start[place] < prefix[place]) & (often > 1)
            kept = np.bincount(place[use], minlength=len(n))
            rare = np.bincount(place[use & (often <= FEW)], minlength=len(n)).astype(np.int32)
            single = np.uint64(1) << (word & np.uint64(63))
            half = (word >> np.uint64(6)) & np.uint64(1)
            parity = [pa.array(np.bitwise_xor.reduceat(np.where(half == k, single, np.uint64(0)), start).view(np.int64)) for k in (0, 1)]
            ends = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((order[use] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            at = pa.array(found["doc"])
            first = np.concatenate(([True], found["doc"][1:] != found["doc"][:-1]))
            lines_of = np.where(first, np.bincount(found["doc"])[found["doc"]], 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(found["line"].astype(np.int32)), pa.array(lines_of), pa.array(_set_ids(found)), pa.array(n.astype(np.int32)), *parity, pa.array(rare), lists],
                ["doc", "mark", "line", "n_lines", "set", "n", "p0", "p1", "rare", "prefix"],
            )

    return _keyed(docs, key, text).mapInArrow(emit, shape)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(key).alias("doc"), F.xxhash64(t).alias("mark"), t.alias("text"))


def words_of_sets(docs: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """(at, words) of the asked sets (set, at, mark). Bit tables of fixed size let through the texts that the sets first occur in,
    and of these the sets' lines, and few others, before the join."""
    shared = docs.sparkSession.sparkContext.broadcast((bit_table(asked.select("set")), bit_table(asked.select("mark"))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        sets, marks = shared.value
        wanted = (b.filter(pa.array(may_hold(marks, b.column(1).to_numpy(zero_copy_only=False)))) for b in batches)
        for batch in parts(wanted, 0):
            found = reader.lines(batch.column(0))
            ids = _set_ids(found)
            hit = np.flatnonzero(may_hold(sets, ids))
            _, once = np.unique(ids[hit], return_index=True)
            hit = hit[once]
            sizes = found["n"][hit]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            take = np.repeat(found["start"][hit] - ends[:-1], sizes) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found["word"][take].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), lists], ["set", "words"])

    t = F.col(text).cast("string")
    lines = docs.select(t.alias("text"), F.xxhash64(t).alias("mark")).mapInArrow(emit, "set long, words array<long>")
    return lines.join(asked.drop("mark"), "set").groupBy("at").agg(F.first("words").alias("words"))


def _apart(a: str, b: str) -> Column:
    """In how many parity bits two sets differ: no more than the words that only one of them has."""
    return sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in ("p0", "p1")), F.lit(0))


def _possible(a: str, b: str, n1: Column, n2: Column, p1: Column, p2: Column) -> Column:
    """Length, position and parity filters for Jaccard 0.8: overlap at least 4/9 of both sizes together."""
    return (
        (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2))
        & (9 * F.least(n1 - p1, n2 - p2) >= 4 * (n1 + n2))
        & (9 * _apart(a, b) <= n1 + n2)
    )


def _skipped() -> Column:
    """Prefix words of a set that no other line has; they come first in its order."""
    return (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - F.size("prefix")).cast("int")


def _entries(sets: DataFrame, *more: str) -> DataFrame:
    """A row for each shareable prefix word of each set; ``pos`` is its place in the set's order,
    ``rare`` whether few lines have it."""
    every = sets.select("at", "n", "p0", "p1", *more, F.col("rare").alias("_r"), _skipped().alias("_s"), F.posexplode("prefix").alias("_p", "word"))
    return every.select("word", "at", "n", "p0", "p1", *more, (F.col("_p") + F.col("_s")).alias("pos"), (F.col("_p") < F.col("_r")).alias("rare"))


def _band(n: Column) -> Column:
    """The band of a length: lengths within 4 to 5 are in one band or in two that follow each other."""
    return F.floor(F.log(n) / F.lit(math.log(1.25))).cast("int")


def _pairs(entries: DataFrame) -> DataFrame:
    """(b, a, apart): open sets with the earlier ones that they may be similar to.

    A word of few lines brings all its sets together; of any other word, the smaller set goes to the bands of the lengths
    that it may be similar to. Rows multiply, so neither side is ever broadcast. Word and band are one number: Spark
    sorts by one number without comparing rows.
    """
    low, high = (_band(x) + 1 for x in (F.col("n"), F.floor(F.col("n") * 5 / 4)))
    bands = F.when(F.col("rare"), F.array(F.lit(0))).otherwise(F.sequence(low, high))
    meet = lambda band: F.shiftleft(F.col("word").cast("long"), 8).bitwiseOR(band).alias("meet")
    # Length, place and state are shuffled as one number, too.
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    kept = ["at", packed.alias("x"), "p0", "p1"]
    l = entries.select("*", F.explode(bands).alias("band")).select(meet(F.col("band")), *kept).alias("l")
    r = entries.select(meet(F.when(F.col("rare"), 0).otherwise(low)), *kept).hint("merge").alias("r")
    n1, n2 = (F.shiftright(F.col(f"{side}.x"), 32) for side in "lr")
    p1, p2 = (F.shiftright(F.col(f"{side}.x"), 1).bitwiseAND(F.lit((1 << 31) - 1)) for side in "lr")
    smaller = (n1 < n2) | ((n1 == n2) & (F.col("l.at") < F.col("r.at")))
    short = p1 < n1 - F.ceil(n1 * 8 / 9) + 1
    later = F.when(F.col("l.at") < F.col("r.at"), F.col("r.x")).otherwise(F.col("l.x"))
    waits = later.bitwiseAND(F.lit(1)) == 1
    found = l.join(r, (F.col("l.meet") == F.col("r.meet")) & smaller & short & waits & _possible("l", "r", n1, n2, p1, p2))
    return found.select(
        F.greatest("l.at", "r.at").alias("b"), F.least("l.at", "r.at").alias("a"), _apart("l", "r").cast("int").alias("apart")
    ).distinct()


def _neighbours(sets: DataFrame) -> DataFrame:
    """(b, a, apart): each set against a few earlier ones with its last prefix word, and with its middle one: those that
    occur last before it, among a salted share, and the one that most lines have. Where all are similar to each other, or
    all to a common line of which they are variants, the first of each share is left unsettled, and the few that differ
    in both words."""
    last = F.size("prefix") - 1
    two = F.array_distinct(F.array(F.get("prefix", last), F.get("prefix", F.floor(last / 2).cast("int"))))
    mine = sets.filter(last >= 0).select(F.explode(two).alias("word"), "at", "n", "p0", "p1")
    # The word they meet at may not be the first that two sets share, so its place bounds nothing.
    row = F.struct("at", "n", "p0", "p1", F.lit(0).alias("pos"))
    common = _entries(sets.filter("copies > 1"), "copies").groupBy("word").agg(F.max_by(row, F.struct("copies", "at")).alias("hub"))
    salt = F.pmod("at", F.lit(SALTS)).cast("int")
    # A hub goes to those shares of its word that have a set.
    used = mine.groupBy("word").agg(F.bit_or(F.pow(F.lit(2), salt).cast("int")).alias("used"))
    every = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("used", k) == 1)
    hubs = common.join(used, "word").select("word", F.explode(every).alias("salt"), "hub")
    dealt = mine.select("word", salt.alias("salt"), row.alias("r"), F.lit(None).cast(hubs.schema["hub"].dataType).alias("hub"))
    both = dealt.unionByName(hubs.select("word", "salt", F.lit(None).cast(hubs.schema["hub"].dataType).alias("r"), "hub"))
    # Nulls first: the hub's row stands before the sets.
    w = Window.partitionBy("word", "salt").orderBy("r.at")
    near = both.select("r", F.first("hub").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("l0"), *[F.lag("r", k).over(w).alias(f"l{k}") for k in range(1, NEIGHBOURS + 1)])
    each = near.filter("r is not null").select("r", F.explode(F.array(*[f"l{k}" for k in range(NEIGHBOURS + 1)])).alias("l")).filter("l.at < r.at")
    sizes = [F.col(c) for c in ("l.n", "r.n", "l.pos", "r.pos")]
    return each.filter(_possible("l", "r", *sizes)).select(F.col("r.at").alias("b"), F.col("l.at").alias("a"), _apart("l", "r").cast("int").alias("apart")).distinct()


def _words(docs: DataFrame, text: str, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(at, words) of the sets of the pairs."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct().join(sets.select("at", "set", F.col("first.mark").alias("mark")), "at")
    return stored(words_of_sets(docs, text, stored(asked, "asked-lines")), "words-of-lines")


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (b, a) whose words are alike."""
    both = pairs.join(words.select(F.col("at").alias("a"), F.col("words").alias("wa")), "a").join(
        words.select(F.col("at").alias("b"), F.col("words").alias("wb")), "b"
    )
    overlap = F.size(F.array_intersect("wa", "wb"))
    return both.filter(9 * overlap >= 4 * (F.size("wa") + F.size("wb"))).select("a", "b")


def _best(pairs: DataFrame) -> DataFrame:
    """(b, a): the most promising earlier partner ``a`` of each later set ``b``."""
    return stored(pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")), "best-partners")


def _settled(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(at): the later sets of the pairs that are verified."""
    return stored(_verified(pairs, words).select(F.col("b").alias("at")).distinct(), "settled-lines")


def similar_to_earlier(docs: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """(at): sets that are similar to another one which first occurs earlier.

    Of a group of many similar lines each needs one earlier partner, not all pairs. So each set first
    meets a few that share its last or its middle prefix word; those with a verified one are settled, and only the others
    meet all sets with which they share a prefix word. Of the partners found, each set is verified against the
    most promising one, and against all the others only if that one fails.
    """
    sets = sets.withColumn("open", F.lit(True))
    found = []
    near = stored(_neighbours(sets), "near-lines")
    if not near.isEmpty():
        best = _best(near)
        found.append(_settled(best, _words(docs, text, best, sets)))
        done = found[0].withColumn("done", F.lit(True))
        sets = sets.join(done, "at", "left").withColumn("open", F.col("done").isNull()).drop("done")
    pairs = stored(_pairs(_entries(sets, "open")), "line-pairs")
    words = _words(docs, text, pairs, sets)
    found.append(_settled(_best(pairs), words))
    rest = stored(pairs.join(reduce(DataFrame.union, found).withColumnRenamed("at", "b"), "b", "left_anti"), "open-pairs")
    if not rest.isEmpty():
        found.append(_verified(rest.select("b", "a"), words).select(F.col("b").alias("at")))
    return reduce(DataFrame.union, found).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, n_lines, removed): of every document with a word its lines with a word, and the numbers (from 0, in
    order) of those that repeat an earlier line.

    Earlier means a smaller key (null first), then a smaller text hash ``mark``, then a smaller line number. Lines
    without a word take no part. Rows that repeat a key and text count as one. An empty table gives an empty one.
    """
    lines = stored(with_prefixes(docs, key, text, word_counts(docs, text)), "lines")
    place = F.struct("doc", "mark", "line")
    grouped = lines.groupBy("set").agg(
        F.min(place).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("n", "p0", "p1", "rare", "prefix")],
    )
    # Numbered by range and place in it: in the order of the first lines.
    ordered = grouped.repartitionByRange("first").sortWithinPartitions("first").withColumn("at", F.monotonically_increasing_id())
    sets = stored(ordered, "line-sets")
    gone = similar_to_earlier(docs, sets, text).withColumn("gone", F.lit(True))
    verdict = sets.select("at", "set", "first").join(gone, "at", "left").drop("at")
    marked = lines.select("doc", "mark", "line", "n_lines", "set").join(verdict, "set")
    repeat = F.coalesce("gone", F.lit(False)) | (F.col("first") < place)
    # The first line of a text counts its lines; of the others only those that repeat go on.
    return marked.filter(repeat | (F.col("n_lines") > 0)).groupBy("doc", "mark").agg(
        F.max("n_lines").cast("long").alias("n_lines"), F.array_sort(F.collect_set(F.when(repeat, F.col("line")))).alias("removed")
    )


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; ``size``, if there is such a column, follows the text.

    Documents that lose every line with a word go: nothing of their own is left. Those without a word stay as
    they are, as do all other columns.
    """
    found = repeated_lines(docs, key, text).filter(F.size("removed") > 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_k"), F.xxhash64(F.col(text).cast("string")).alias("_m"))
    both = rows.alias("l").join(found.alias("r"), F.col("_k").eqNullSafe(F.col("doc")) & (F.col("_m") == F.col("mark")), "left")
    cut = F.split(f"row.{text}", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), F.col("removed"))
    shorter = (
        both.filter("removed is null or size(removed) < n_lines")
        .select("row", "removed", F.when(F.col("removed").isNotNull(), cut).alias("_cut"))
        .select("row", "_cut", F.when(F.col("removed").isNotNull(), kept).alias("_kept"))
        .select("row", F.coalesce(F.array_join(F.transform("_kept", lambda i: F.get("_cut", i)), "\n"), F.col(f"row.{text}")).alias("_text"))
    )
    new = {text: F.col("_text")}
    if size in docs.columns:
        new[size] = F.when(F.col("_text").isNotNull(), F.char_length("_text")).cast(docs.schema[size].dataType)
    return shorter.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])
