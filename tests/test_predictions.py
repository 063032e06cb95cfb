"""Combining, metrics and reports on small tables with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesift.operators import combine, metrics, reports

ROW = "window_id string, caption_prediction int, caption_answer_index int, caption_scores array<double>, candidate_index_map array<int>"


def rows(spark, data, schema=ROW):
    return spark.createDataFrame(data, schema)


def test_selection_accuracy(spark):
    df = rows(spark, [("a", None, 1, [0.2, 0.8, 0.1], None), ("b", None, 0, [0.4, 0.7, 0.1], None)])
    assert metrics.selection_accuracy(df).first()[0] == 0.5
    zeros = rows(spark, [("a", None, 0, [0.0, 0.0], None)])
    assert metrics.selection_accuracy(zeros).first()[0] == 1.0


def test_rejection_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.7), (0, 0.8), (0, 0.2)], "t int, s double")
    acc, p, r, f1 = metrics.rejection_metrics(df, "t", "s").first()
    assert (acc, round(p, 3), r, round(f1, 3)) == (0.75, 0.667, 1.0, 0.8)


def test_brier_and_ece(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2)], "t int, s double")
    assert math.isclose(metrics.brier(df, "t", "s").first()[0], 0.025)
    two = spark.createDataFrame([(1, 0.9), (0, 0.6)], "t int, s double")
    assert math.isclose(metrics.expected_calibration_error(two, "t", "s", 2).first()[0], 0.25)
    empty = two.filter("t > 5")
    assert metrics.brier(empty, "t", "s").first()[0] == 0.0 and metrics.expected_calibration_error(empty, "t", "s").first()[0] == 0.0


def test_ece_counts_scores_outside_only_in_the_total(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 1.5), (1, 1.0)], "t int, s double")
    assert math.isclose(metrics.expected_calibration_error(df, "t", "s").first()[0], 0.5 / 3)


def test_risk_coverage_equals_numpy(spark):
    rng = np.random.default_rng(0)
    t, s = rng.integers(0, 2, 300), rng.random(300).round(2)
    order = sorted(range(300), key=lambda i: (-max(s[i], 1 - s[i]), i))
    right = np.array([float((s[i] >= 0.5) == t[i]) for i in order])
    k = np.arange(1, 301)
    want = 1 - np.trapezoid(1 - np.cumsum(right) / k, k / 300)
    df = spark.createDataFrame([(i, int(t[i]), float(s[i])) for i in range(300)], "id int, t int, s double")
    assert math.isclose(metrics.risk_coverage(df, "t", "s", "id").first()[0], want)


def test_best_threshold_equals_a_scan(spark):
    rng = random.Random(3)
    data = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(200)]
    best, at = -1.0, 0.5
    for t in sorted({0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, *[s for _, s in data]}):
        tp = sum(y == 1 and s >= t for y, s in data)
        fp = sum(y == 0 and s >= t for y, s in data)
        fn = sum(y == 1 and s < t for y, s in data)
        p, r = tp / max(1, tp + fp), tp / max(1, tp + fn)
        f = 0.0 if p + r == 0 else 2 * p * r / (p + r)
        if f > best:
            best, at = f, t
    got = metrics.best_f1_threshold(spark.createDataFrame(data, "t int, s double"), "t", "s").first()
    assert got[0] == at and math.isclose(got[1], best)


@pytest.mark.parametrize("a,b", [(0, 0), (1, 20), (30, 6), (5, 5), (400, 420), (600, 700)])
def test_mcnemar_equals_the_binomial_sum(spark, a, b):
    n, s = a + b, min(a, b)
    exact = sum(math.comb(n, k) for k in range(s + 1))
    want = (1.0, 1.0) if n == 0 else (min(1.0, 2 * exact / 2**n), min(1.0, (2 * exact - math.comb(n, s)) / 2**n))
    got = spark.createDataFrame([(a, b)], "a long, b long").select(*metrics.mcnemar_columns(F.col("a"), F.col("b"))).first()
    assert got[0] == n and np.allclose(got[1:], want, rtol=1e-9)


def test_mcnemar_stays_finite_at_scale(spark):
    got = spark.createDataFrame([(10**9, 10**9 + 90000)], "a long, b long").select(*metrics.mcnemar_columns(F.col("a"), F.col("b"))).first()
    assert 0.03 < got["two_sided_p_value"] < 0.06


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("correct"))
    point, low, high, n = metrics.bootstrap_ci(df, "correct", n_bootstrap=300).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / 4000)
    assert point == 0.25 and n == 4000 and abs((high - low) / 2 - half) < 0.35 * half and low < 0.25 < high


@pytest.mark.parametrize("n", [1000, 1_000_000])
def test_bootstrap_equals_resampled_rows(spark, n):
    """Quantiles of the replicate means against plain resampling of rows, within Monte Carlo error at any size."""
    df = spark.range(n).select(((F.col("id") * 7919) % 10 < 3).cast("int").alias("correct"))
    _, low, high, rows = metrics.bootstrap_ci(df, "correct", n_bootstrap=2000).first()
    rng = np.random.default_rng(1)
    ones = rng.binomial(n, 0.3, 20000) / n  # a resampled row is right with the share of right rows
    want = np.quantile(ones, [0.025, 0.975])
    error = 4 * math.sqrt(0.3 * 0.7 / n) / math.sqrt(2000 * 0.025 * 0.975) * 1.5
    assert rows == n and abs(low - want[0]) < error and abs(high - want[1]) < error


def test_poisson_counts_are_the_inverse():
    for n in (1, 3, 40, 5000, 1 << 30):
        u = (np.arange(20000) + 0.5) / 20000
        k = metrics.poisson_counts(n, u)
        assert (np.diff(k) >= 0).all() and abs(k.mean() - n) < 0.02 * math.sqrt(n) and abs(k.var() / n - 1) < 0.02
    assert metrics.poisson_counts(1, np.array([0.0, 0.367, 0.368, 0.735, 0.736])).tolist() == [0, 0, 1, 1, 2]


def test_many_lots_of_one_outcome(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).cast("double").alias("v"))
    whole = metrics.bootstrap_ci(df, "v", n_bootstrap=400).first()
    monkeypatch.setattr(metrics, "LOT", 100)
    cut = metrics.bootstrap_ci(df, "v", n_bootstrap=400).first()
    assert whole.point == cut.point == 0.5 and abs((whole.upper - whole.lower) / (cut.upper - cut.lower) - 1) < 0.25


def test_paired_bootstrap_signs(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("key"), F.lit(1).alias("a"), (F.col("id") % 10 > 0).cast("int").alias("b")
    )
    point, low, high, p, n = metrics.paired_bootstrap(df, "a", "b", n_bootstrap=200).first()
    assert math.isclose(point, 0.1) and low > 0 and high < 0.2 and p == 0.0 and n == 1000


def test_macro_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "t string, g string")
    assert math.isclose(metrics.macro_f1(df, "t", "g").first()[0], (2 / 3 + 2 / 3 + 0 + 0) / 4)


def test_vote_ties_go_to_the_earliest_run(spark):
    data = [("a", 0, 2, 2), ("a", 1, 1, 2), ("a", 2, 1, 2), ("a", 3, 2, 2), ("b", 0, None, 0), ("b", 1, 3, 0), ("c", 1, 1, 1), ("d", 0, None, 0)]
    df = spark.createDataFrame(data, "window_id string, run int, caption_prediction int, caption_answer_index int")
    got = {r["window_id"]: r for r in combine.vote_rows(df).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["caption_prediction"] == 2
    assert got["b"]["caption_prediction"] == 3 and got["b"]["caption_scores"] == [0.0]
    assert got["d"]["caption_prediction"] is None


def test_vote_remaps(spark):
    data = [("a", 0, 0, 1, [3, 1]), ("a", 1, 1, 1, [3, 1]), ("a", 2, 5, 1, [3, 1])]
    df = spark.createDataFrame(data, "window_id string, run int, caption_prediction int, caption_answer_index int, candidate_index_map array<int>")
    r = combine.vote_rows(df).first()
    assert r["vote_predictions"] == [3, 1, 5] and r["caption_prediction"] == 3 and r["caption_answer_index"] == 1
    assert r["caption_scores"] == [0.0, 0.0, 0.0, 1.0]


def gate_tables(spark):
    primary = rows(spark, [("a", 0, 0, None, None), ("b", 1, 0, None, None), ("c", 0, 0, None, None)])
    alternate = rows(spark, [("a", 0, 0, [3.0, 0.0], None), ("b", 0, 0, [4.0, 0.0], None), ("c", 1, 0, [0.0, 1.0], None)])
    return primary, alternate


def test_gate_sweep(spark):
    primary, alternate = gate_tables(spark)
    got = {r["threshold"]: r for r in combine.gate_sweep(primary, alternate, [0.0, 2.0, 5.0]).collect()}
    assert math.isclose(got[0.0]["caption_selection_accuracy"], 2 / 3) and got[0.0]["alternate_count"] == 3
    assert got[2.0]["caption_selection_accuracy"] == 1.0 and got[5.0]["alternate_count"] == 0
    assert combine.choose_gate(combine.gate_sweep(primary, alternate, [0.0, 2.0, 3.0, 5.0])).first()["threshold"] == 3.0


def test_gate_is_strict_and_refuses_bad_maps(spark):
    primary = rows(spark, [("a", 1, 0, [0.0, 1.0], None), ("b", 1, 0, None, None), ("c", 1, 1, None, None)])
    alternate = rows(spark, [("a", 0, 0, [2.0, 0.0], None), ("b", 4, 0, [9.0, 0.0], [0, 1])])
    assert [r["caption_gate_source"] for r in combine.gate_rows(primary, alternate, 2.0).orderBy("window_id").collect()] == ["primary"] * 3
    got = combine.gate_rows(primary, alternate, 1.9).orderBy("window_id").collect()
    assert [r["caption_gate_source"] for r in got] == ["alternate", "primary", "primary"]
    assert got[0]["caption_scores"] == [2.0, 0.0] and got[1]["caption_gate_bad_alternate_map"] and got[2]["caption_gate_alternate_margin"] is None


def test_duplicate_alternates_fail(spark):
    primary, alternate = gate_tables(spark)
    with pytest.raises(Exception, match="duplicate window_id"):
        combine.gate_rows(primary, alternate.union(alternate), 1.0).collect()


def test_empty_split_side_fails(spark):
    primary, alternate = gate_tables(spark)
    with pytest.raises(Exception, match="split is empty"):
        combine.calibrate_gate(primary, alternate, 100000, [0]).collect()
    with pytest.raises(ValueError):
        combine.dev_split(primary, alternate, 1)


def test_hybrid(spark):
    structured = rows(
        spark,
        [("a", 1, 1, [0.0, 1.0, 0.0], None), ("b", 0, 2, [1.0, 0.0, 1.0], None), ("c", 0, 0, [0.0, 0.0], None), ("d", 0, 1, [0.0, 0.0], None)],
    )
    direct = rows(spark, [("b", 1, 0, None, [0, 2]), ("c", None, 0, None, None), ("d", 7, 0, None, [0])])
    got = combine.hybrid_rows(structured, direct)
    assert [(r["caption_prediction"], r["caption_source"]) for r in got.orderBy("window_id").collect()] == [
        (1, "structured"), (2, "direct_fallback"), (0, "direct_fallback"), (7, "direct_fallback"),
    ]
    s = combine.hybrid_summary(got).first()
    assert s["caption_selection_accuracy"] == 0.75 and s["caption_fallback_count"] == 3 and s["missing_direct_count"] == 1


def test_hybrid_plateau(spark):
    sweep = spark.createDataFrame(
        [(0.4, 0.8, 0.5), (0.45, 0.9, 0.5), (0.55, 0.9, 0.5), (0.6, 0.9, 0.5)], "threshold double, caption_selection_accuracy double, cf_reject_f1 double"
    )
    r = combine.choose_hybrid(sweep).first()
    assert (r["threshold"], r["plateau_low"], r["plateau_high"]) == (0.45, 0.45, 0.6)


def test_paired_comparison(spark):
    primary, alternate = gate_tables(spark)
    r = metrics.paired_comparison(primary, alternate.filter("window_id <> 'c'")).first()
    assert (r["n_pairs"], r["missing_challenger"], r["both_correct"], r["challenger_only_correct"]) == (2, 1, 1, 1)
    assert r["delta"] == 0.5 and r["two_sided_p_value"] == 1.0 and r["midp_value"] == 0.5


def test_margin_buckets_keep_empty_ones(spark):
    alternate = rows(spark, [("a", 0, 0, [1.0, 1.0], None), ("b", 0, 1, [3.0, 1.0], [1, 0]), ("c", 5, 0, [30.0, 1.0], [0])])
    got = {r["bucket"]: r for r in reports.margin_buckets(alternate).collect()}
    assert len(got) == 7 and got["(-inf, 0]"]["alternate_accuracy"] == 1.0 and got["(3, 5]"]["count"] == 0
    assert got["(1, 2]"]["alternate_accuracy"] == 0.0 and got["(10, inf)"]["valid_count"] == 0
    literal = {r["bucket"]: r for r in reports.margin_buckets(alternate, literal=True).collect()}
    assert literal["(1, 2]"]["alternate_accuracy"] == 1.0


def test_metric_family_of_one_run(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.2), ("y", 0.4)], "f string, m double")
    got = {r["f"]: r for r in reports.metric_family(df, "f", ["m"]).collect()}
    assert got["x"]["m_std"] == 0.0 and math.isclose(got["y"]["m_std"], math.sqrt(0.02))
