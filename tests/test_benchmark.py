"""Benchmark tables, controls, subsets and text fields."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesift.functions import phrases as ph
from kinesift.functions import textfields as tf
from kinesift.functions.scores import field_match_score, probability_score, rule_score, statement_vector
from kinesift.operators import audit
from kinesift.operators import benchmark as bm
from kinesift.operators import cards as cd
from kinesift.operators import controls, evaluate, subsets
from kinesift.operators.scan import unique_rows
from kinesift.session import durable


@pytest.fixture(scope="module")
def cards(spark):
    rng = np.random.default_rng(8)
    t = np.arange(32) / 20.0
    rows = []
    for i in range(40):
        w = rng.normal(size=(32, 3)) * rng.uniform(0.1, 2, size=3)
        w[:, i % 3] += rng.uniform(0, 4) * np.sin(2 * np.pi * (1 + i % 4) * t)
        rows.append((f"w{i:03d}", "wisdm", "train" if i % 4 else "test", "walk", str(i % 5), w.tolist()))
    df = spark.createDataFrame(
        rows, "window_id string, dataset_id string, split string, label string, subject_id string, sensor array<array<double>>"
    )
    return durable(cd.evidence_cards(df, names=["acc_x", "acc_y", "acc_z"], sample_rate=20.0))


@pytest.fixture(scope="module")
def base(cards):
    return durable(bm.build_benchmark(cards))


@pytest.fixture(scope="module")
def hard(base):
    return durable(bm.build_hard_benchmark(base, "v3"))


def test_records_hold_one_supported_choice(base, hard):
    for records in (base, hard):
        for r in records.collect():
            cs = r["caption_selection"]
            flags = [c["supported"] for c in cs["candidates"]]
            assert len(flags) == 4 and sum(flags) == 1 and flags[cs["answer_index"]]
            assert cs["candidates"][cs["answer_index"]]["text"] == r["positive"]["text"]
            texts = [c["text"] for c in r["counterfactuals"]]
            assert len(texts) == 5 and r["positive"]["text"] not in texts


def test_v3_edits_change_the_named_fields(hard):
    got = hard.first()["counterfactuals"]
    assert [c["changed_facts"] for c in got] == [
        ["intensity", "dominant_frequency"], ["periodicity", "burstiness"], ["dominant_axis", "periodicity"],
        ["burstiness", "dominant_frequency"], ["intensity"],
    ]
    assert all(c["changed_fact"] == "+".join(c["changed_facts"]) for c in got)


def test_variants_and_unknown_variant(base):
    for v in ("v1", "v2"):
        r = bm.build_hard_benchmark(base, v).first()
        assert r["evidence_text"].startswith("The window shows ") and r["difficulty"].startswith("natural_language_near_miss")
    with pytest.raises(ValueError):
        bm.build_hard_benchmark(base, "v9")


@pytest.mark.parametrize("value,text", [(0.3125, "0.312"), (0.1875, "0.188"), (3.0625, "3.062"), (0.1234567, "0.123"), (2.0005, "2.001")])
def test_three_decimals_round_as_in_c(spark, value, text):
    got = spark.createDataFrame([(value,)], "v double").select(ph.fixed_point(F.col("v"), 3)).first()[0]
    assert got == text


def test_controls(hard):
    n = hard.count()
    for mode in controls.CONTROL_MODES:
        rows = controls.control_records(hard, mode).collect()
        assert len(rows) == n and {r["evidence_control"] for r in rows} == {mode}
        if mode in ("shuffled", "numeric-swap"):
            assert all(r["evidence_source_window_id"] != r["window_id"] for r in rows)
            assert sorted(r["evidence_source_window_id"] for r in rows) == sorted(r["window_id"] for r in rows)
    assert all("<num>" in r["evidence_text"] for r in controls.control_records(hard, "numeric_mask").collect())
    with pytest.raises(ValueError):
        controls.control_records(hard, "other")


def test_stress_and_masks(spark, hard):
    lone = hard.limit(1)
    kept = controls.stress_records(lone, "shuffled_evidence").first()
    assert kept["evidence_text"] == lone.first()["evidence_text"]
    df = spark.createDataFrame([("x1 is -3.5, +2 and v2.0 at 7.",)], "t string")
    text = df.first()["t"]
    assert df.select(tf.mask_numbers(F.col("t"))).first()[0] == re.sub(r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])", "<num>", text)
    assert df.select(tf.mask_all_numbers(F.col("t"))).first()[0] == re.sub(r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?", "<num>", text)


def test_reorder_never_keeps_the_order(hard):
    for seed in range(6):
        for r in bm.reorder_choices(hard, seed).select("caption_selection", "caption_order_original_keys").collect():
            keys = [c["text"] for c in r["caption_selection"]["candidates"]]
            assert not all(k in o for k, o in zip(keys, r["caption_order_original_keys"]))
            assert r["caption_selection"]["candidates"][r["caption_selection"]["answer_index"]]["supported"]


def test_sampling(spark, hard):
    assert bm.sample_records(hard, 7).count() == 7
    assert bm.sample_records(hard, 0).count() == 0 and bm.sample_records(hard, 999).count() == hard.count()
    with pytest.raises(ValueError):
        bm.sample_records(hard, -1)
    a = {r[0] for r in bm.sample_records(hard.repartition(3), 7).select("window_id").collect()}
    assert a == {r[0] for r in bm.sample_records(hard, 7).select("window_id").collect()}


def test_cutoff_refines_crowded_prefixes(spark, monkeypatch):
    from kinesift.functions import hashing

    monkeypatch.setattr(hashing, "SMALL_BIN", 2)
    df = spark.range(400).select(F.concat(F.lit("abcd"), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("h"))
    hashes = sorted(r[0] for r in df.collect())
    for n in (1, 57, 399, 400):
        assert hashing.hash_cutoff(df, F.col("h"), n) == hashes[n - 1]
    assert hashing.hash_cutoff(df, F.col("h"), 401) == "g" and hashing.hash_cutoff(df, F.col("h"), 0) is None


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(Exception, match="duplicate k"):
        unique_rows(df, "k").collect()
    assert sorted(map(tuple, unique_rows(df, "k", "last", "v").collect())) == [("a", 2), ("b", 3)]


def test_missing_window_fails(hard):
    w = hard.select("window_id", "split", "label", "subject_id", F.array(F.array(F.lit(1.0))).alias("sensor"))
    assert bm.join_windows(hard, w).count() == hard.count()
    with pytest.raises(Exception, match="no raw window"):
        bm.join_windows(hard, w.filter("window_id <> 'w003'")).select("raw_sensor").collect()


def test_text_numerics(spark):
    text = (
        "RMS energy is 0.102, below the lower reference band. The repeatability scores are autocorrelation 0.297 and FFT "
        "concentration 0.084, near the repeatability reference. The dominant spectral peak is 0.781 Hz, inside the middle "
        "reference band. Peak count is 7, with the profile outside."
    )
    n = spark.createDataFrame([(text,)], "t string").select(tf.text_numerics(F.col("t")).alias("n")).first()["n"]
    assert tuple(n) == (0.102, 0.297, 0.084, 0.781, 7.0)


def test_claims_take_the_longest_axis(spark):
    text = "the largest per-axis energy is on the ankle forward-back acceleration trace, slow cadence"
    df = spark.createDataFrame([(text,), ("without a single clearly dominant channel, short spikes",), ("rather than spiky",)], "t string")
    a, b, c = [r["c"] for r in df.select(tf.caption_claims(F.col("t")).alias("c")).collect()]
    assert a["dominant_axis"] == "ankle_acc_x" and a["dominant_frequency"] == "low" and a["intensity"] is None
    assert b["dominant_axis"] == "uncertain" and b["burstiness"] == "bursty" and all(v is None for v in c)
    said = df.select(tf.evidence_fields(F.col("t")).alias("f")).collect()[2]["f"]
    assert said["burstiness"] == "bursty"


@pytest.mark.parametrize(
    "answer,want",
    [('{"answer_index": 2}', 2), ('{"answer_index": 9, "index": 1}', 1), ("I pick C.", None), ("pick C.", 2), ("option 3", 3), ("none", None), ("7", None)],
)
def test_choice_index(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "t string").select(tf.choice_index(F.col("t"), F.lit(4))).first()[0]
    assert got == want


@pytest.mark.parametrize(
    "answer,want",
    [('{"supported": [true, "no"]}', [True, False]), ("[1, 0]", [True, False]), ("S0: yes\nS1: rejected", [True, False]), ("S0: yes", None), ('{"supported": [true]}', None)],
)
def test_support_labels(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "t string").select(tf.support_labels(F.col("t"), F.lit(2))).first()[0] == want


def test_rule_score_is_by_substring(spark):
    card = {f: F.lit(v) for f, v in zip(ph.FIELDS, ("low", "strong", "acc_x", "high", "smooth"))}
    card["trend_segments"] = F.array(F.lit("rise"), F.lit("rise"), F.lit("fall"))
    df = spark.createDataFrame([("a slow, weak one that will rise",)], "t string")
    b1, m1 = df.select(rule_score(card, F.col("t"), "B1"), rule_score(card, F.col("t"), "M1")).first()
    # "low" is in "slow"; "weak" contradicts the rhythm and "low" the cadence; two of three trend steps are said.
    assert b1 == (1 - 0.5 - 0.5) / 5 and abs(m1 - (1 - 0.75 - 0.75 + 2 / 3) / 6) < 1e-12
    assert abs(df.select(rule_score(card, F.col("t"), "B2")).first()[0] - 2 / 3) < 1e-12


def test_vectors_and_field_match(spark, hard):
    s = evaluate.statement_vectors(bm.statements(hard)).select("label", "kind", "features", field_match_score(F.col("features")).alias("m")).collect()
    assert {len(r["features"]) for r in s} == {6 + 40 + 3 + 40 + 15}
    assert all(r["m"] == 1.0 for r in s if r["kind"] == "positive") and all(r["m"] <= 0.1 for r in s if r["kind"] == "counterfactual")
    none = F.struct(*[F.lit(None).cast("string").alias(f) for f in ph.FIELDS])
    v = hard.select(statement_vector(F.col("evidence"), none, "numeric_only").alias("v")).first()["v"]
    assert len(v) == 6 + 40 + 15 and v[-15:-10] == [1.0] * 5
    with pytest.raises(ValueError):
        statement_vector(F.col("evidence"), none, "other")


def test_classifier_learns_the_match(hard):
    train, test = hard.filter("split = 'train'"), hard.filter("split = 'test'")
    for kind in ("logistic_regression", "random_forest"):
        model = evaluate.fit_statement_classifier(bm.statements(train), kind)
        rows = evaluate.classifier_rows(test, model).collect()
        right = sum(r["caption_prediction"] == r["caption_answer_index"] for r in rows)
        assert right / len(rows) > 0.9 and len(rows[0]["support_probabilities"]) == 6


def test_forest_trains_on_written_rows(hard, monkeypatch):
    seen = []

    class Trainer:
        def __init__(self, **given):
            self.given = given

        def fit(self, rows):
            seen.append((self.given["cacheNodeIds"], rows._jdf.queryExecution().optimizedPlan().toString()))

    monkeypatch.setattr(evaluate, "RandomForestClassifier", Trainer)
    for bound in (1 << 22, 0):
        monkeypatch.setattr(evaluate, "NODE_IDS", bound)
        evaluate.fit_statement_classifier(bm.statements(hard), "random_forest")
    assert [kept for kept, _ in seen] == [True, False]
    assert all("parquet" in plan and "explode" not in plan.lower() for _, plan in seen)


def test_probability_score_skips_unknown(spark):
    probs = F.create_map(F.lit("intensity"), F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)))
    claims = F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(ph.FIELDS, ("high", "weak", None, None, None))])
    assert spark.range(1).select(probability_score(claims, probs)).first()[0] == 0.5


def test_scores_do_not_see_the_card(spark, hard):
    even = {f: [1.0 / len(w)] * len(w) for f, w in ph.VOCABULARY.items()}
    entries = [x for f, p in even.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in p]))]
    records = hard.withColumn("field_probabilities", F.create_map(*entries))
    altered = records.withColumn("evidence", F.col("evidence").withField("intensity", F.lit("low")))
    a, b = (evaluate.probability_rows(r).select("window_id", "caption_scores", "support_probabilities") for r in (records, altered))
    assert audit.changed_rows(a, b).count() == 0


def test_user_model_row_count_is_checked(spark):
    df = spark.range(10)
    assert evaluate.apply_model(df, lambda p: p.assign(s=p["id"] * 2.0), "id long, s double").count() == 10
    with pytest.raises(Exception, match="rows for"):
        evaluate.apply_model(df, lambda p: p.iloc[:-1].assign(s=1.0), "id long, s double").count()
    with pytest.raises(Exception, match="lacks"):
        evaluate.apply_model(df, lambda p: p, "id long, s double").count()


def test_subset_keeps_or_reports_the_gold(hard):
    bounds = tf.fit_numeric_bounds(hard)
    rows = evaluate.structured_rows(hard, bounds)
    s = subsets.constrained_subset(hard, rows, top_k=1, strict=False).collect()
    assert any(r["gold_lost"] for r in s)
    for r in s:
        kept = r["caption_selection"]["answer_index"]
        assert r["gold_lost"] == (kept < 0)
    with pytest.raises(Exception, match="lost the right choice"):
        subsets.constrained_subset(hard, rows, top_k=1).collect()


def test_balanced_subset_counts(hard):
    f = subsets.balance_features(hard)
    assert subsets.balanced_subset(f, 0.5).count() == 20 and subsets.balanced_subset(f, 0.001).count() == 1
    with pytest.raises(ValueError):
        subsets.balanced_subset(f, 0.0)


def test_audit_counts(hard):
    assert sum(r["n"] for r in audit.answer_positions(hard).collect()) == 40
    facts = {r["fact"]: r["n"] for r in audit.changed_fact_counts(hard).collect()}
    assert facts == {"intensity": 80, "dominant_frequency": 80, "periodicity": 80, "burstiness": 80, "dominant_axis": 40}


def test_audit_finds_phrases_and_shared_subjects(spark, hard):
    """Rows that are not zero: a phrase that every other record holds, a subject on both sides of one dataset only."""
    marked = hard.withColumn("evidence_text", F.when(F.crc32("window_id") % 2 == 0, F.concat("evidence_text", F.lit(" AS EXPECTED"))).otherwise(F.col("evidence_text")))
    half = hard.filter(F.crc32("window_id") % 2 == 0).count()
    rows = [("d1", "train", "a"), ("d1", "test", "a"), ("d1", "test", "b"), ("d1", "train", None), ("d2", "train", "b"), ("d2", None, "c")]
    windows = spark.createDataFrame(rows, "dataset_id string, split string, subject_id string")
    got = {(r["dataset_id"], r["check"], r["item"]): r["n"] for r in audit.audit_report(marked, windows, ["as expected", "never there"]).collect()}
    own = hard.first()["dataset_id"]
    assert got[own, "shortcut_phrase", "as expected"] == half > 0 and got[own, "shortcut_phrase", "never there"] == 0
    assert got["d1", "subject_overlap", "subjects"] == 1 and got["d2", "subject_overlap", "subjects"] == 0
    assert got["d1", "windows", "test"] == 2 and got["d1", "windows", "train"] == 2 and got["d2", "windows", None] == 1
    assert got[own, "records", "all"] == hard.count() and sum(n for (d, c, _), n in got.items() if c == "answer_position") == 40
    found = {r["phrase"]: r["records"] for r in audit.shortcut_hits(marked, ["as expected", "never there"]).collect()}
    assert found == {"as expected": half, "never there": 0}
