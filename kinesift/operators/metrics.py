"""Accuracy, rejection, calibration, bootstrap and paired significance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.arrays import first_argmax
from kinesift.operators.scan import prefix_scan, unique_rows


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Share of equal pairs, 0 for an empty table."""
    same = F.coalesce(F.col(truth) == F.col(guess), F.lit(False)).cast("int")
    return rows.agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def selection_accuracy(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """Share of rows whose first best score is the answer."""
    right = (F.coalesce(first_argmax(F.col("caption_scores")), F.lit(0)) == F.col("caption_answer_index")).cast("int")
    return rows.groupBy(*by).agg(
        F.coalesce(F.avg(right), F.lit(0.0)).alias("caption_selection_accuracy"), F.count(F.lit(1)).alias("n_eval_records")
    )


def _at_least_one(c: Column) -> Column:
    return F.greatest(F.lit(1), c)


def precision_of(tp: Column, fp: Column) -> Column:
    return tp / _at_least_one(tp + fp)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = tp / _at_least_one(tp + fp), tp / _at_least_one(tp + fn)
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def cells(truth: Column, positive: Column) -> dict[str, Column]:
    """tp, fp, fn, tn as sums (map-side combined)."""
    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    return {
        "tp": count((truth == 1) & positive),
        "fp": count((truth == 0) & positive),
        "fn": count((truth == 1) & ~positive),
        "tn": count((truth == 0) & ~positive),
    }


def rejection_columns(c: dict[str, Column], prefix: str = "") -> list[Column]:
    total = c["tp"] + c["fp"] + c["fn"] + c["tn"]
    return [
        ((c["tp"] + c["tn"]) / _at_least_one(total)).alias(prefix + "accuracy"),
        precision_of(c["tp"], c["fp"]).alias(prefix + "precision"),
        (c["tp"] / _at_least_one(c["tp"] + c["fn"])).alias(prefix + "recall"),
        f1_of(c["tp"], c["fp"], c["fn"]).alias(prefix + "f1"),
    ]


def rejection_metrics(rows: DataFrame, truth: str, score: str, threshold: float = 0.5, by: list[str] = []) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``score >= threshold``; empty denominators count as 1."""
    counted = rows.groupBy(*by).agg(*[v.alias(k) for k, v in cells(F.col(truth), F.col(score) >= threshold).items()])
    return counted.select(*by, *rejection_columns({k: F.col(k) for k in ("tp", "fp", "fn", "tn")}))


def support_cells(threshold: float = 0.5) -> Column:
    """STRUCT<tp, fp, fn, tn> of one row's judged statements (``support_predictions``)."""
    pairs = F.arrays_zip(
        F.transform("support_items", lambda s: s["supported"]).alias("t"), F.col("support_predictions").alias("p")
    )

    def count(t: bool, p: bool) -> Column:
        return F.size(F.filter(pairs, lambda x: (x["t"] == t) & (x["p"] == p))).cast("bigint")

    return F.struct(
        count(True, True).alias("tp"),
        count(False, True).alias("fp"),
        count(True, False).alias("fn"),
        count(False, False).alias("tn"),
    )


def support_rows(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per judged statement: window_id, pos, kind, text, changed_facts, truth, score, predicted."""
    judged = (
        F.col("support_predictions")
        if "support_predictions" in rows.columns
        else F.transform("support_probabilities", lambda p: p >= threshold)
    )
    score = (
        F.col("support_probabilities")
        if "support_probabilities" in rows.columns
        else F.transform("support_predictions", lambda p: p.cast("double"))
    )
    zipped = F.arrays_zip(F.col("support_items").alias("s"), judged.alias("p"), score.alias("v"))
    opened = rows.select("window_id", F.posexplode_outer(zipped).alias("pos", "x")).filter(F.col("pos").isNotNull())
    return opened.select(
        "window_id",
        "pos",
        F.col("x.s.kind").alias("kind"),
        F.col("x.s.text").alias("text"),
        F.col("x.s.changed_fact").alias("changed_fact"),
        F.col("x.s.changed_facts").alias("changed_facts"),
        F.col("x.s.supported").cast("int").alias("truth"),
        F.col("x.v").alias("score"),
        F.col("x.p").alias("predicted"),
    )


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over every label seen as truth or guess."""
    pairs = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")

    def side(label: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    miss = F.col("n") - hit
    sides = pairs.select(F.inline(F.array(side("t", hit, none, miss), side("g", none, miss, none))))
    per_label = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return per_label.agg(
        F.coalesce(F.avg(f1_of(F.col("tp"), F.col("fp"), F.col("fn"))), F.lit(0.0)).alias("macro_f1"),
        F.count(F.lit(1)).alias("labels"),
    )


def brier(rows: DataFrame, truth: str, score: str) -> DataFrame:
    gap = F.col(score) - F.col(truth)
    return rows.agg(F.coalesce(F.avg(gap * gap), F.lit(0.0)).alias("brier"))


def bin_edges(n_bins: int = 10) -> list[float]:
    """The doubles of an evenly spaced grid, so a score on an edge falls as it does there."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def in_bin(score: Column, i: int, n_bins: int = 10) -> Column:
    """Whether a score is in bin ``i``; the last one is closed on the right."""
    low, high = bin_edges(n_bins)[i : i + 2]
    return (score >= low) & ((score <= high) if i == n_bins - 1 else (score < high))


def calibration_bins(rows: DataFrame, truth: str, score: str, n_bins: int = 10) -> DataFrame:
    """Count, accuracy and confidence per bin; scores outside [0, 1] are in the null bin."""
    place = F.lit(None).cast("int")
    for i in range(n_bins):
        place = F.when(in_bin(F.col(score), i, n_bins), i).otherwise(place)
    return rows.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(truth).alias("accuracy"), F.avg(score).alias("confidence")
    )


def expected_calibration_error(rows: DataFrame, truth: str, score: str, n_bins: int = 10) -> DataFrame:
    """Weighted gap of accuracy and confidence over equal bins, the last closed on the right."""
    bins = calibration_bins(rows, truth, score, n_bins)
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).otherwise(0.0)
    return bins.agg(F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("ece"))


def risk_curves(rows: DataFrame, curve: str, truth: str, score: str, key: str) -> DataFrame:
    """(``curve``, risk_coverage_auc): one minus the area under risk over coverage for every value of ``curve``, rows in
    order of confidence (ties by ``key``).

    Risk at a rank needs only the running count of right rows, and the trapezoid at a rank only that rank's
    row, so nothing is gathered: the order of all curves comes from one :func:`prefix_scan`.
    """
    s = F.col(score)
    ranked = rows.select(
        curve,
        key,
        F.greatest(s, 1 - s).alias("_conf"),
        (F.when(s >= 0.5, 1).otherwise(0) == F.col(truth)).cast("bigint").alias("_right"),
    )
    run = prefix_scan(ranked, ["-_conf", key], {"_cum": F.col("_right")}, index="_i", within=curve)
    i = F.col("_i")
    risk = 1.0 - F.col("_cum") / (i + 1)
    before = F.when(i > 0, 1.0 - (F.col("_cum") - F.col("_right")) / i)
    area = F.sum(F.coalesce((risk + before) / 2.0, F.lit(0.0))) / F.count(F.lit(1))
    auc = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - area)), F.lit(0.0))
    return run.groupBy(curve).agg(auc.alias("risk_coverage_auc"))


def risk_coverage(rows: DataFrame, truth: str, score: str, key: str) -> DataFrame:
    """The area of :func:`risk_curves` over all rows; 0 for an empty table."""
    curves = risk_curves(rows.withColumn("_curve", F.lit(0)), "_curve", truth, score, key)
    return curves.agg(F.coalesce(F.max("risk_coverage_auc"), F.lit(0.0)).alias("risk_coverage_auc"))


def majority_label(rows: DataFrame, label: str) -> DataFrame:
    """The most frequent label; the smallest on ties."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(1)


def best_f1_threshold(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """The lowest threshold with the highest F1 among a fixed grid and every score that occurs.

    Scores are counted first; running counts from the top then give every threshold's cells in one pass.
    """
    # Thresholds that are always tried.
    grid = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    spark = rows.sparkSession
    tried = spark.createDataFrame([(t, 0, 0) for t in grid], "threshold double, pos bigint, neg bigint")
    seen = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(truth) == 1).cast("bigint")).alias("pos"), F.sum((F.col(truth) == 0).cast("bigint")).alias("neg")
    )
    points = seen.unionByName(tried).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = prefix_scan(points, ["-threshold"], {"tp": F.col("pos"), "fp": F.col("neg")})
    positives = run.agg(F.sum("pos")).first()[0] or 0
    if run.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] in (None, 0):
        return spark.createDataFrame([(0.5, 0.0)], "threshold double, f1 double")
    scored = run.withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.lit(positives) - F.col("tp")))
    return scored.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


# ---- Bootstrap ---------------------------------------------------------------------------------

#: Rows of one outcome that share one uniform number; more rows take several, so the table below stays small.
LOT = 1 << 30


def poisson_counts(n: int, uniforms: np.ndarray) -> np.ndarray:
    """Poisson(n) counts: the inverse of the distribution function at every uniform number.

    The terms follow from the largest one by their ratios, 12 square roots of n to both sides; what lies beyond is
    below double precision.
    """
    low, high = max(0, int(n - 12 * math.sqrt(n) - 20)), int(n + 12 * math.sqrt(n) + 40)
    k = np.arange(low, high + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log1p((n - k[1:]) / k[1:]))])
    terms = np.exp(logs - logs.max())
    return low + np.searchsorted(np.cumsum(terms) / terms.sum(), uniforms, "right")


def _uniform(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0**52


def _drawn(n_bootstrap: int, seed: int):
    """(label, n, values) of outcomes -> their weighted sums per replicate, added up within a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]
            sums = np.zeros((1 + len(values), n_bootstrap + 1))
            for i, (label, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                weight = np.zeros(n_bootstrap + 1)
                weight[0] = n
                for lot in range(-(-n // LOT)):
                    tail = f":{lot}" if lot else ""
                    u = np.array([_uniform(f"{seed}:{label}:{b}{tail}") for b in range(n_bootstrap)])
                    weight[1:] += poisson_counts(min(LOT, n - lot * LOT), u)
                sums[0] += weight
                for k, v in enumerate(values, start=1):
                    sums[k] += weight * v[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, n_bootstrap)), *[pa.array(x) for x in sums]], names=["_b", "_n", *batch.schema.names[2:]]
            )

    return run


def _replicates(rows: DataFrame, values: list[str], n_bootstrap: int, seed: int) -> DataFrame:
    """Weighted sums per replicate; replicate -1 is the table itself.

    Weighing every row by an own Poisson(1) count and adding up rows with equal values is a Poisson(n) count for
    each of these outcomes. So rows are counted by outcome first, and a replicate costs one draw per outcome
    (two for one right-or-wrong column), whatever the rows.
    """
    label = F.concat_ws(",", *[F.col(v).cast("string") for v in values])
    outcomes = rows.select(*values).na.drop().groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
    schema = ", ".join(["_b long", "_n double", *[f"`{v}` double" for v in values]])
    sums = outcomes.select(label.alias("_label"), "_n", *values).mapInArrow(_drawn(n_bootstrap, seed), schema)
    return sums.groupBy("_b").agg(*[F.sum(c).alias(c) for c in ["_n", *values]])


def _interval(replicates: DataFrame, value: Column, alpha: float) -> DataFrame:
    """One row: point (replicate -1 weighs every row once), interval and tail shares of the others."""
    drawn = F.when((F.col("_b") >= 0) & (F.col("_n") > 0), value)
    whole = F.when(F.col("_b") < 0, value)
    q = F.percentile(drawn, [alpha / 2, 1 - alpha / 2])
    return replicates.agg(
        F.coalesce(F.max(whole), F.lit(0.0)).alias("point"),
        F.coalesce(F.get(q, F.lit(0)), F.lit(0.0)).alias("lower"),
        F.coalesce(F.get(q, F.lit(1)), F.lit(0.0)).alias("upper"),
        F.avg((drawn <= 0).cast("int")).alias("low_tail"),
        F.avg((drawn >= 0).cast("int")).alias("high_tail"),
        F.coalesce(F.max(F.when(F.col("_b") < 0, F.col("_n"))), F.lit(0)).cast("bigint").alias("n"),
    )


def bootstrap_ci(rows: DataFrame, correct: str, n_bootstrap: int = 500, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Mean of ``correct`` with a percentile interval over Poisson-weighted replicates of the rows. Nulls are left out."""
    boot = _replicates(rows, [correct], n_bootstrap, seed)
    return _interval(boot, F.col(correct) / F.col("_n"), alpha).select("point", "lower", "upper", "n")


def paired_bootstrap(
    pairs: DataFrame, left: str, right: str, n_bootstrap: int = 500, seed: int = 42, alpha: float = 0.05
) -> DataFrame:
    """Difference of two means on the same rows: point, interval and one-sided tail share."""
    boot = _replicates(pairs, [left, right], n_bootstrap, seed)
    spread = _interval(boot, (F.col(left) - F.col(right)) / F.col("_n"), alpha)
    tail = F.when(F.col("point") >= 0, F.col("low_tail")).otherwise(F.col("high_tail"))
    return spread.select("point", "lower", "upper", F.coalesce(tail, F.lit(1.0)).alias("p_value"), "n")


def caption_samples(rows: DataFrame) -> DataFrame:
    """key, correct per row that has a prediction (rows without one are left out)."""
    return rows.filter(F.col("caption_prediction").isNotNull()).select(
        F.col("window_id").alias("key"),
        (F.col("caption_prediction") == F.col("caption_answer_index")).cast("int").alias("correct"),
    )


# ---- Paired significance -----------------------------------------------------------------------


def log_factorial(k: Column) -> Column:
    """ln k!: a table up to 16, Stirling's series beyond."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(17)])
    x = k.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(k <= 16, F.get(table, F.least(k, F.lit(16)).cast("int"))).otherwise(series)


def mcnemar_columns(primary_only: Column, challenger_only: Column) -> list[Column]:
    """Exact two-sided and mid-p values of the discordant counts.

    The tail is summed downwards from its largest term as ratios to it. Terms further than 10 square roots
    of n away are below double precision, so the sum stays short at any n, and nothing overflows.
    """
    n = (primary_only + challenger_only).cast("bigint")
    s = F.least(primary_only, challenger_only).cast("bigint")
    top = F.exp(log_factorial(n) - log_factorial(s) - log_factorial(n - s) - n * math.log(2.0))
    terms = F.least(s, F.ceil(10 * F.sqrt(n.cast("double"))).cast("bigint") + 100)
    tail = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(0).cast("bigint"), terms - 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["t"] * (s - j) / (n - s + j + 1)).alias("t"),
            (acc["sum"] + acc["t"] * (s - j) / (n - s + j + 1)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    exact = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * top * tail))
    mid = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * top * (tail - 0.5)))
    return [n.alias("discordant_count"), exact.alias("two_sided_p_value"), mid.alias("midp_value")]


def paired_comparison(primary: DataFrame, challenger: DataFrame, on_duplicate: str = "error", by: list[str] = []) -> DataFrame:
    """Agreement counts of two systems with McNemar values, per group of ``by`` (columns of ``primary``). A missing
    prediction is wrong."""
    right = lambda: F.coalesce(F.col("caption_prediction") == F.col("caption_answer_index"), F.lit(False))
    own = primary.select("window_id", *by, right().alias("_p"))
    other = unique_rows(challenger.select("window_id", right().alias("_c")), "window_id", on_duplicate)
    joined = own.join(other, "window_id", "left")
    p, c = F.col("_p"), F.col("_c")

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    counts = joined.groupBy(*by).agg(
        count(c.isNotNull()).alias("n_pairs"),
        count(c.isNull()).alias("missing_challenger"),
        count(p & c).alias("both_correct"),
        count(~p & ~c).alias("both_wrong"),
        count(p & ~c).alias("primary_only_correct"),
        count(~p & c).alias("challenger_only_correct"),
    )
    n = _at_least_one(F.col("n_pairs"))
    mine = (F.col("both_correct") + F.col("primary_only_correct")) / n
    theirs = (F.col("both_correct") + F.col("challenger_only_correct")) / n
    return counts.select(
        "*",
        mine.alias("primary_accuracy"),
        theirs.alias("challenger_accuracy"),
        (theirs - mine).alias("delta"),
        *mcnemar_columns(F.col("primary_only_correct"), F.col("challenger_only_correct")),
    )


def pairwise_rejection(rows: DataFrame, margin: float = 0.0) -> DataFrame:
    """Share of counterfactuals below the positive by more than ``margin``, one sure hit added per record that
    has any, and the mean gap."""
    below = F.size(F.filter("counterfactual_scores", lambda s: s < F.col("positive_score") - margin))
    n = F.size("counterfactual_scores")
    gap = F.aggregate(
        "counterfactual_scores", F.lit(0.0), lambda acc, s: acc + (F.col("positive_score") - s)
    )
    sure = (n > 0).cast("int")
    return rows.agg(
        (F.sum(below + sure) / _at_least_one(F.sum(n + sure))).alias("cf_pairwise_reject_accuracy"),
        F.coalesce(F.sum(gap) / F.sum(n), F.lit(0.0)).alias("cf_pairwise_margin_mean"),
        F.count(F.lit(1)).alias("n_eval_records"),
    )


def support_summary(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Support accuracy, both recalls, balanced accuracy, F1 and the all-negative baseline."""
    s = support_rows(rows, threshold)
    c = s.agg(*[v.alias(k) for k, v in cells(F.col("truth"), F.col("predicted")).items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    total = _at_least_one(tp + fp + fn + tn)
    pos, neg = tp / _at_least_one(tp + fn), tn / _at_least_one(tn + fp)
    return c.select(
        ((tp + tn) / total).alias("support_accuracy"),
        pos.alias("positive_recall"),
        neg.alias("negative_recall"),
        ((pos + neg) / 2.0).alias("balanced_accuracy"),
        f1_of(tp, fp, fn).alias("support_f1"),
        ((fp + tn) / total).alias("all_negative_accuracy"),
        total.alias("n_support_items"),
    )
