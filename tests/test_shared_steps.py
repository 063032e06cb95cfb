"""Steps that several queries share compute an expression once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from kinesift.functions import textfields as tf
from kinesift.functions.phrases import FIELDS
from kinesift.operators import audit, signals
from kinesift.operators.logistic import fit_logistic

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_signal_measures_are_not_repeated_inside_lambdas(spark):
    df = spark.createDataFrame([([[1.0, -1.0, 0.0], [2.0, -2.0, 0.0], [0.0, 0.0, 0.0]],)], "c array<array<double>>")
    pair = df.select(signals.strongest_pair(F.col("c"), 3).alias("p"))
    assert plan_of(pair).count("sqrt") <= 2
    p = pair.first()["p"]
    assert (p["i"], p["j"]) == (0, 1) and abs(p["r"] - 1.0) < 1e-12
    trend = df.select(signals.trend_segments(F.col("c")[0], F.sqrt(F.col("c")[0][0])).alias("t"))
    assert plan_of(trend).count("sqrt") == 1 and len(trend.first()["t"]) == 3


def test_first_of_equally_strong_pairs_whatever_the_rounding(spark):
    """Channels with two values that change together: |r| is 1 for every pair, but for rounding."""
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        at = rng.randint(1, 7)
        channels = [[a] * at + [b] * (8 - at) for a, b in ((round(rng.uniform(0, 100), 2), round(rng.uniform(0, 100), 2)) for _ in range(3))]
        rows.append(([[x - sum(c) / 8 for x in c] for c in channels],))
    pairs = spark.createDataFrame(rows, "c array<array<double>>").select("c", signals.strongest_pair(F.col("c"), 3).alias("p")).collect()
    assert {(r.p["i"], r.p["j"]) for r in pairs} == {(0, 1)}
    assert all((r.p["r"] > 0) == (r.c[0][0] * r.c[1][0] > 0) for r in pairs)


def test_features_are_computed_once_and_null_rows_left_out(spark):
    seen = spark.sparkContext.accumulator(0)

    def features(i: int) -> list[float] | None:
        seen.add(1)
        return None if i == 7 else [float(i % 5), float(i % 3)]

    rows = spark.range(40).select(F.udf(features, "array<double>")("id").alias("features"), (F.col("id") % 2).alias("label"), F.lit(1.0).alias("weight"))
    got = fit_logistic(rows)
    assert seen.value == 40
    plain = spark.createDataFrame([([float(i % 5), float(i % 3)], i % 2, 1.0) for i in range(40) if i != 7], "features array<double>, label int, weight double")
    want = fit_logistic(plain.coalesce(1))
    assert max(abs(a - b) for a, b in zip([*got.weights, got.intercept], [*want.weights, want.intercept], strict=True)) < 1e-9
    with pytest.raises(ValueError):
        fit_logistic(plain.filter(F.lit(False)))


def test_a_task_searches_a_text_once_over_all_its_batches(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def fields(texts: pa.Array) -> dict[str, pa.Array]:
        seen.add(len(texts))
        return {f: texts for f in FIELDS}

    texts = ["a", "b", None]
    df = spark.createDataFrame([(i, texts[i % 3]) for i in range(300)], "i int, t string").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = df.select("i", tf._read_batches(F.col("t"), False, fields).alias("c")).collect()
        assert all(tuple(r["c"]) == (texts[r["i"] % 3],) * len(FIELDS) for r in got) and seen.value == 3
        monkeypatch.setattr(tf, "KEPT_TEXTS", 12)
        many = df.select("i", F.concat(F.lit("t"), (F.col("i") * 7 % 25).cast("string")).alias("t"))
        got = many.select("i", tf._read_batches(F.col("t"), False, fields).alias("c")).collect()
        assert all(r["c"][0] == f"t{r['i'] * 7 % 25}" for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_runs_are_compared_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(x: int) -> int:
        seen.add(1)
        return x

    def run(xs):
        return spark.createDataFrame([(x,) for x in xs], "x int").select(F.udf(mark, "int")("x").alias("x"))

    got = audit.changed_rows(run([1, 1, 1, 2, None]), run([1, 3, None, None])).collect()
    assert sorted((r["x"] or 0, r["side"]) for r in got) == [(0, "after"), (1, "before"), (1, "before"), (2, "before"), (3, "after")]
    assert seen.value == 9


def test_choices_are_read_once_by_both_sides(spark):
    assert "evalpython" not in plan_of(QUERIES["failure_examples"](spark, SMALL))


def test_scores_before_are_computed_once(spark):
    plan = plan_of(QUERIES["score_invariance"](spark, SMALL))
    assert plan.count("evalpython") == 1 and "md5" not in plan


def test_vector_sums_are_taken_by_batches(spark):
    assert "aggregate(" not in plan_of(QUERIES["statement_vectors"](spark, SMALL)).replace("aggregate [", "")
