"""Claims read from arrays of texts."""

from pyspark.sql import functions as F

from kinesift.functions import phrases as ph
from kinesift.functions import textfields as tf
from kinesift.operators import subsets


def test_arrays_of_texts_are_read_like_single_texts(spark):
    texts = [
        "strongest activity on\x0b acc_y, and the dominant frequency is\n high",
        "strongest activity on nothing; the dominant movement axis is  gyro_x",
        "overall, the motion shows forceful energy, a loose rhythm, slow cadence, and an even profile.",
        "without a single clearly dominant channel, vertical acceleration trace",
        "", None, "überall nichts",
    ]
    rows = [(0, texts), (1, []), (2, None), (3, texts[::-1] + texts), (4, [None])]
    df = spark.createDataFrame(rows, "k int, ts array<string>").repartition(3)
    for read in (tf.caption_claims, tf.statement_claims):
        own = [(i, t) for i, t in enumerate(texts)]
        single = spark.createDataFrame(own, "i int, t string").select("i", read(F.col("t")).alias("c"))
        known = {t: tuple(r["c"]) for r in single.collect() for i, t in own if i == r["i"]}
        got = {r["k"]: r["c"] for r in df.select("k", read(F.col("ts"), each=True).alias("c")).collect()}
        for k, ts in rows:
            assert got[k] is None if ts is None else [tuple(c) for c in got[k]] == [known[t] for t in ts]
        assert known[None] == known[""] == (None,) * len(ph.FIELDS)
    said = dict(zip(ph.FIELDS, known[texts[0]], strict=True))
    assert (said["dominant_axis"], said["dominant_frequency"]) == ("acc_y", "high")
    assert dict(zip(ph.FIELDS, known[texts[1]], strict=True))["dominant_axis"] == "gyro_x"


def test_claims_are_searched_once_per_batch_and_not_in_row_expressions(spark):
    """Phrases are not looked for by an expression per text and phrase: the plan evaluates a batch."""
    df = spark.createDataFrame([(["a"],)], "ts array<string>").select(tf.caption_claims(F.col("ts"), each=True).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "contains" not in plan.lower()


def test_balance_is_measured_once_per_record(spark):
    """Ranking by range reads its rows twice; what they are computed from must run once."""
    seen = spark.sparkContext.accumulator(0)

    def mark(k: str) -> str:
        seen.add(1)
        return k

    ranges = [F.col("id").cast("double").alias(c) for c in ("length_range", "evidence_overlap_range", "balance_score")]
    features = spark.range(40).select(F.udf(mark)(F.col("id").cast("string")).alias("window_id"), *ranges)
    kept = subsets.balanced_subset(features, 0.5, max_length_range=29.0)
    assert sorted(int(r["window_id"]) for r in kept.collect()) == list(range(15))
    assert seen.value == 30
