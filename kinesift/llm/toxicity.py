"""Toxicity by class-conditional backoff bigrams.

Two bigram models, of toxic and of ordinary texts, score every text; what counts is the difference of their
log-likelihoods per word. A class's counts are discounted towards what it shares with the other class: of a word, the count that both
classes together let expect; of a bigram, the one that its words' models let expect. The discount is ``DISCOUNT`` standard errors
of a count, so an expression that either class has seen too seldom is explained by the shared counts, and says nothing;
the more texts hold it, the more of the difference is left. An expression counts once a text.

Every expression of all labelled texts outside the held-out fifth is counted, and every one that says something is in the model,
however many there are. The model is a distributed table: texts meet it by a join, but for its ``COMMON`` most used
expressions, which travel with the tasks (the join's hot keys).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.llm.text import bit_table, may_hold, parts, stored

FOLDS = 5
#: Standard errors of a count that are taken off its distance from the shared counts.
DISCOUNT = 2.0
#: Expressions that travel with the tasks at most, the most used ones.
COMMON = 1 << 16
NEWTON_STEPS = 12
#: A text counts as if so many words that say nothing followed: few words are weak evidence.
PADDING = 10
#: Words that a task holds before it sends their counts on.
HELD = 1 << 20
#: Weights are whole numbers of this unit, so that their sums don't depend on the order.
UNIT = 2.0**-20


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of the labelled rows outside the held-out fold. Several labels of a key count as
    toxic if one is. A bit table of the labels' keys spares most other texts the shuffle."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(known.select(F.xxhash64("key"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(table.value, batch.column(1).to_numpy(zero_copy_only=False))))

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"), F.col(text).cast("string").alias("text"))
    # Labels grow with the texts, so they are never broadcast: the same join at every size.
    return rows.mapInArrow(pick, rows.schema).join(known.hint("merge"), "key").select("text", "toxic")


_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _hashes(words: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word, in their order; the same in every process."""
    return pd.util.hash_array(np.array(list(words), object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


def _numbered(texts: pa.Array, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of every word, how many words each text has); new words are added to ``words``."""
    found = [[words.setdefault(w, len(words)) for w in words_in(t.as_py())] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum())), sizes


def pair_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The number of a bigram; ``_pair_code`` is the same of columns."""
    s = second.view(np.uint64)
    return first ^ ((s << np.uint64(17)) | (s >> np.uint64(47))).view(np.int64)


def _pair_code(first: str, second: str) -> Column:
    return F.col(first).bitwiseXOR(F.shiftleft(second, 17).bitwiseOR(F.shiftrightunsigned(second, 47)))


def counts(train: DataFrame) -> DataFrame:
    """(first, second, n): how many texts hold the word ``second``, or hold it after ``first``; ``n`` is the number of ordinary
    ones and 2**32 times that of toxic ones, one number to save room. Rows without ``second`` have the sums over all words of
    ordinary (``first`` 0) and toxic texts (1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        waiting: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            # A word has the number 0 before it, and words are numbered from 1 here.
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            toxic = (codes & 1).astype(bool)
            hashes = np.concatenate(([0], _hashes(words)))
            first, second = codes >> 32, (codes >> 1) & 0x7FFFFFFF
            alone = first == 0
            columns = [
                pa.array(np.append(hashes[first], [0, 1]), mask=np.append(alone, [False, False])),
                pa.array(np.append(hashes[second], [0, 0]), mask=np.append(np.zeros(len(n), bool), [True, True])),
                pa.array(np.append(n << np.where(toxic, 32, 0), [n[alone & (toxic == k)].sum() for k in (False, True)]).astype(np.int64)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["first", "second", "n"])

        for batch in parts(batches, 0):
            w, sizes = _numbered(batch.column(0), words)
            w += 1
            ends = np.cumsum(sizes)
            for a, b, toxic in zip(ends - sizes, ends, batch.column(1).to_pylist(), strict=True):
                mine = w[a:b]
                waiting.append((np.unique(np.concatenate((mine, (mine[:-1] << 31) | mine[1:]))) << 1) | toxic)
            held += len(w)
            if held > HELD:
                yield out()
                words, waiting, held = {}, [], 0
        if held:
            yield out()

    return train.mapInArrow(count, "first long, second long, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


def _weight(n: tuple[Column, Column], expected: tuple[Column, Column]) -> Column:
    """Log-likelihood ratio (toxic to ordinary) that is left of the counts' distance from the expected ones."""

    def log_left(n: Column, e: Column) -> Column:
        far = F.greatest(F.abs(n - e) - DISCOUNT * F.sqrt(F.greatest(n, e, F.lit(1.0))), F.lit(0.0))
        return F.log((e + F.signum(n - e) * far) / e)

    return F.round((log_left(n[1], expected[1]) - log_left(n[0], expected[0])) / UNIT) * UNIT


def fit(train: DataFrame) -> DataFrame | None:
    """(code, uses, weight) of every word and bigram of the labelled texts that says something; None where a class has no word."""
    # A count of DISCOUNT ** 2 or less is never farther from an expected one than its discount, and so has no weight.
    split = F.col("n").bitwiseAND(0xFFFFFFFF), F.shiftright("n", 32)
    stored_counts = stored(counts(train).filter((split[0] + split[1] > DISCOUNT**2) | F.col("second").isNull()), "expressions")
    total = {row["first"]: row["n"] for row in stored_counts.filter("second is null").collect()}
    if not total.get(0) or not total.get(1):
        return None
    share = [total[k] / (total[0] + total[1]) for k in (0, 1)]
    seen = stored_counts.filter("second is not null").select("first", "second", split[0].alias("n0"), split[1].alias("n1"))
    uses = F.col("n0") + F.col("n1")
    n = F.col("n0").cast("double"), F.col("n1").cast("double")
    single = _weight(n, (uses * share[0], uses * share[1]))
    words = stored(seen.filter("first is null").select(F.col("second").alias("code"), "n0", "n1", single.alias("weight")), "words")
    before = words.select(F.col("code").alias("first"), F.col("n0").alias("f0"), F.col("n1").alias("f1"))
    pairs = seen.filter("first is not null").join(before.hint("merge"), "first").join(words.select(F.col("code").alias("second"), "weight").hint("merge"), "second")
    odds = (F.col("f1") + share[1] / 2) * F.exp("weight") / (F.col("f0") + share[0] / 2)
    both = _weight(n, (uses / (1 + odds), uses * odds / (1 + odds)))
    every = words.select("code", uses.alias("uses"), "weight").union(pairs.select(_pair_code("first", "second"), uses, both))
    return stored(every.filter("weight <> 0"), "weights")


def _most_used(model: DataFrame) -> Column:
    """Whether an expression is one of the ``COMMON`` that travel with the tasks: those of the highest powers of the root of 2 that fit."""
    step = F.floor(2 * F.log2("uses"))
    room, least = COMMON, 1 << 30
    for row in model.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    return step >= least


def differences(docs: DataFrame, model: DataFrame | None, key: str, text: str) -> DataFrame:
    """(key, x): the model's mean difference for every text, over its words and the padding. An empty text has 0."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if model is None:
        return rows.select("key", F.lit(0.0).alias("x"))
    common = _most_used(model)
    near = model.filter(common).select("code", "weight").orderBy("code").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((bit_table(model.select("code")), near["code"].to_numpy(np.int64), near["weight"].to_numpy(float)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codes, weights = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in parts(batches, 1):
            words: dict[str, int] = {}
            w, sizes = _numbered(batch.column(1), words)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            h = _hashes(words)[w]
            follows = doc[1:] == doc[:-1]
            at, code = np.concatenate((doc, doc[1:][follows])), np.concatenate((h, pair_code(h[:-1], h[1:])[follows]))
            hit = may_hold(table, code)
            at, code = at[hit], code[hit]
            order = np.lexsort((code, at))
            at, code = at[order], code[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
            at, code = at[new], code[new]
            spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            known = codes[spot] == code if len(codes) else np.zeros(len(code), bool)
            sums = np.bincount(at[known], weights[spot[known]], len(sizes)).astype(float)
            ends = np.concatenate(([0], np.cumsum(np.bincount(at[~known], minlength=len(sizes))))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(code[~known]))
            ids = pa.array(number + np.arange(len(sizes)))
            number += len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(sizes), pa.array(sums), rest], ["key", "id", "n", "sum", "rest"])

    shape = rows.select("key").schema.add("id", "long").add("n", "long").add("sum", "double").add("rest", T.ArrayType(T.LongType()))
    met = stored(rows.mapInArrow(meet, shape), "met")
    others = model.filter(~common).select("code", "weight")
    more = met.select("id", F.explode("rest").alias("code")).join(others.hint("merge"), "code").groupBy("id").agg(F.sum("weight").alias("more"))
    return met.drop("rest").join(more, "id", "left").select("key", ((F.col("sum") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + PADDING)).alias("x"))


def calibrate(rows: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y) rows by Newton steps; each is one aggregate.

    A weak pull of the slope towards 0 keeps separable rows finite. Without both classes the slope is 0.
    """
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.stddev_pop("x").alias("s")).first()
    n, p = got["n"] or 0, got["p"] or 0
    offset = math.log((p + 0.5) / (n - p + 0.5))
    scale = got["s"] or 0.0
    if not 0 < p < n or scale == 0.0:
        return 0.0, offset
    slope, pull = 0.0, 1e-4 * n
    z = F.col("x") / scale
    for _ in range(NEWTON_STEPS):
        q = 1 / (1 + F.exp(-(z * slope + offset)))
        v, e = q * (1 - q), F.col("y") - q
        g = rows.agg(F.sum(e * z), F.sum(e), F.sum(v * z * z), F.sum(v * z), F.sum(v)).first()
        a, b = g[0] - pull * slope, g[1]
        aa, ab, bb = g[2] + pull, g[3], g[4] + 1e-9
        det = aa * bb - ab * ab
        step = ((bb * a - ab * b) / det, (aa * b - ab * a) / det)
        slope, offset = slope + step[0], offset + step[1]
        if max(map(abs, step)) < 1e-6:
            break
    return slope / scale, offset


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every text; labels are learnt from outside the held-out fold only.

    Null texts are empty, and empty texts get the score of a text that says nothing either way. Repeated rows repeat;
    rows without a key are scored and not learnt from. Without both classes every text gets the share of toxic
    training rows (one half if there are none). An empty table gives an empty one.
    """
    train = labelled(docs, labels, key, text, label)
    x = stored(differences(docs, fit(train), key, text), "differences")
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    slope, offset = calibrate(stored(x.join(known, "key").select("x", "y"), "calibration"))
    score = 1 / (1 + F.exp(-(F.col("x") * slope + offset)))
    out = x.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
