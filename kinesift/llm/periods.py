"""Stretches of words that repeat with a period: found by minimizers at many scales, collapsed to one period.

A run is a stretch of words with smallest period q (words q apart are equal), of at least ``TIMES`` periods and
``SHORTEST`` words, that no neighbouring word extends. Periods up to ``DIRECT`` are read off the words that equal
the one so many places before. Longer ones are taken scale by scale, periods above s and up to 2s at scale s:
among every s places the one whose next 2s words have the least hash is a minimizer. Inside a run the same
minimizers come back after exactly one period, and not sooner, because 2s words hold a whole period. So pairs of a
minimizer and the next equal one are seeds; a seed is extended word by word to both sides and kept if it is long
enough. A text is one row, so the work is per row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.llm.text import least_places, parts, words_of

#: Fewest periods and fewest words of a run.
TIMES = 4
SHORTEST = 6
#: Periods up to this are looked for at every place; the scales double from here.
DIRECT = 8

Run = tuple[int, int, int]


def _stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(first, number) of at least ``least`` places in a row that are set."""
    at = np.flatnonzero(equal)
    if len(at) >= least:
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        for k in np.flatnonzero(last - first >= least).tolist():
            yield int(at[first[k]]), int(last[k] - first[k])


def _extended(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """(first, number) of the places around ``at`` whose word equals the one ``period`` later."""
    end, step = at, period
    while end + period < len(ids):
        same = ids[end : min(end + step, len(ids) - period)] == ids[end + period : end + period + step]
        stop = int(np.argmin(same)) if not same.all() else len(same)
        end += stop
        if stop < len(same):
            break
        step *= 2
    first, step = at, period
    while first > 0:
        low = max(0, first - step)
        same = ids[low:first] == ids[low + period : first + period]
        stop = int(np.argmin(same[::-1])) if not same.all() else len(same)
        first -= stop
        if stop < len(same):
            break
        step *= 2
    return first, end - first


def _least_equal(period: int) -> int:
    """How many equal places a run of ``period`` has at least."""
    return max(SHORTEST, TIMES * period) - period


def runs_of(ids: np.ndarray, sizes: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of texts that lie one after another, in order of start and period.

    ``ids`` has a number per word and behind each text one that occurs nowhere else; ``sizes`` counts the words
    of the texts, which must not grow.
    """
    found: dict[tuple[int, int], int] = {}

    def take(first: int, equal: int, period: int) -> None:
        if equal >= _least_equal(period):
            span = (first, equal + period)
            found[span] = min(period, found.get(span, period))

    for period in range(1, DIRECT + 1):
        for first, equal in _stretches(ids[period:] == ids[:-period], _least_equal(period)):
            take(first, equal, period)
    ends = np.cumsum(sizes + 1)
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    reach, scale = 1, DIRECT
    while True:
        fit = int(np.searchsorted(-sizes, -(TIMES * (scale + 1)), "right"))
        if not fit:
            break
        ids, h = ids[: ends[fit - 1]], h[: ends[fit - 1]]
        while reach < 2 * scale:
            h = h[:-reach] * np.uint64(0xBF58476D1CE4E5B9) + h[reach:]
            h ^= h >> np.uint64(32)
            reach *= 2
        if len(h) <= scale:
            break
        places = np.unique(least_places(h, scale, max(24, len(h).bit_length())))
        marks = h[places]
        order = np.argsort(marks, kind="stable")
        ranked, at = marks[order], places[order]
        step = np.diff(at)
        seed = np.flatnonzero((ranked[1:] == ranked[:-1]) & (step > scale) & (step <= 2 * scale))
        known: dict[int, int] = {}
        for place, period in sorted(zip(at[seed].tolist(), step[seed].tolist(), strict=True)):
            if place >= known.get(period, 0):
                first, equal = _extended(ids, place, period)
                known[period] = first + equal
                take(first, equal, period)
        scale *= 2
    return sorted((first, length, period) for (first, length), period in found.items())


def _best(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1):
        words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = pa.array([w for k in order.tolist() for w in words[k]], pa.binary()).dictionary_encode()
        ends = np.cumsum(sizes[order] + 1)
        ids = np.zeros(len(flat) + len(words), np.int64)
        behind = np.zeros(len(ids), bool)
        behind[ends - 1] = True
        ids[~behind] = flat.indices.to_numpy()
        ids[behind] = np.arange(len(words)) + len(flat.dictionary)
        runs: list[list[Run]] = [[] for _ in words]
        for first, length, period in runs_of(ids, sizes[order]):
            k = int(np.searchsorted(ends, first, "right"))
            begin = int(ends[k] - sizes[order[k]] - 1)
            runs[order[k]].append((first - begin, length, period))
        texts = []
        for text, own in zip(words, runs, strict=True):
            if own:
                kept = np.ones(len(text), bool)
                for first, length, period in own:
                    kept[first + period : first + length] = False
                text = [text[i] for i in np.flatnonzero(kept).tolist()]
            texts.append(b" ".join(text))
        names = ("start", "length", "period")
        rows = [[dict(zip(names, r, strict=True)) for r in own] for own in runs]
        best = [b and dict(zip(names, b, strict=True)) for b in map(_best, runs)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(rows, pa.list_(RUN)), pa.array(best, RUN), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["row", "n_words", "runs", "best", "collapsed"],
        )


def collapsed(docs: DataFrame) -> DataFrame:
    """(row, n_words, runs, best, collapsed): the runs of every text, and the text with one period of each run.

    ``runs`` are (start, length, period) in words from 0, by start and period; ``best`` is the one of most periods
    (ties: first start, then shorter period), null without a run. ``collapsed`` holds the words outside of runs and
    the first period of each run, one space between; a word goes if any run has it behind its first period.
    All columns but ``text`` come back in ``row``. Null texts have no words and an empty ``collapsed``; an empty
    table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(row, "text")
    run = "struct<start: long, length: long, period: long>"
    schema = rows.select("row", *[F.lit(None).cast(t).alias(n) for n, t in (("n_words", "long"), ("runs", f"array<{run}>"), ("best", run), ("collapsed", "string"))]).schema
    return rows.mapInArrow(_collapse, schema)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text of the registered query: in a tenth of the documents the words from one place on repeat.

    ``crc32(doc_id)`` chooses document, place and period. Null ids are left alone.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(text)
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the best run, digests of all runs and of the collapsed text."""
    found = collapsed(docs.select("doc_id", with_planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
