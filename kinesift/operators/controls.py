"""Evidence controls and stress variants of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions import captions
from kinesift.functions.hashing import order_hash
from kinesift.functions.phrases import HIDDEN_CONTROL_TEXT, HIDDEN_STRESS_TEXT, other_axis
from kinesift.functions.textfields import mask_all_numbers, mask_numbers
from kinesift.operators.benchmark import shown_evidence
from kinesift.operators.scan import cyclic_successor
from kinesift.session import stored

CONTROL_MODES = ["visible", "shuffled", "numeric-mask", "numeric-swap", "axis-permutation", "trend-flip", "hidden"]
STRESS_VARIANTS = ["numeric_mask", "shuffled_evidence", "hidden_evidence"]


def _borrowed(records: DataFrame, seed: int, carry: dict[str, Column]) -> DataFrame:
    """Every record with ``src_*`` columns of another record: the next one in hash order.

    The records are written once: the ring reads their keys, the pairs then their texts.
    """
    named = stored(records.select("*", *[c.alias(f"_c_{name}") for name, c in carry.items()]), "lent")
    paired = cyclic_successor(
        named, "window_id", order_hash(seed, F.col("window_id")), [f"_c_{name}" for name in carry], prefix="src"
    )
    return paired.drop(*[f"_c_{name}" for name in carry])


def _v3(evidence: Column) -> Column:
    return captions.hard_evidence_text(captions.card_of(evidence), "v3")


def control_records(records: DataFrame, mode: str, seed: int = 42) -> DataFrame:
    """The benchmark under one evidence control; ``_`` and ``-`` are the same in mode names."""
    mode = mode.replace("_", "-")
    own = F.col("window_id")
    text = shown_evidence(F.col("evidence_text"), F.col("evidence"))
    evidence = F.col("evidence")

    def done(df: DataFrame, source: Column) -> DataFrame:
        return df.withColumn("evidence_control", F.lit(mode)).withColumn("evidence_source_window_id", source)

    if mode == "visible":
        return done(records.withColumn("evidence_text", text), own)
    if mode == "numeric-mask":
        return done(records.withColumn("evidence_text", mask_numbers(text)), own)
    if mode == "hidden":
        return done(records.withColumn("evidence_text", F.lit(HIDDEN_CONTROL_TEXT)), F.lit(None).cast("string"))
    if mode == "axis-permutation":
        moved = evidence.withField("dominant_axis", other_axis(evidence["dataset_id"], evidence["dominant_axis"]))
        return done(records.withColumn("evidence", moved).withColumn("evidence_text", _v3(evidence)), own)
    if mode == "trend-flip":
        flipped = evidence.withField(
            "trend_segments",
            F.transform(
                evidence["trend_segments"], lambda t: F.when(t == "rise", "fall").when(t == "fall", "rise").otherwise(t)
            ),
        )
        return done(records.withColumn("evidence", flipped).withColumn("evidence_text", _v3(evidence)), own)
    if mode == "shuffled":
        paired = _borrowed(records, seed, {"window_id": own, "evidence": evidence, "text": text})
        swapped = paired.withColumn("evidence", F.col("src_c_evidence")).withColumn("evidence_text", F.col("src_c_text"))
        return done(swapped, F.col("src_c_window_id")).drop("src_c_window_id", "src_c_evidence", "src_c_text")
    if mode == "numeric-swap":
        paired = _borrowed(records, seed, {"window_id": own, "numeric": evidence["numeric"]})
        mixed = paired.withColumn("evidence", evidence.withField("numeric", F.col("src_c_numeric")))
        return done(mixed.withColumn("evidence_text", _v3(evidence)), F.col("src_c_window_id")).drop(
            "src_c_window_id", "src_c_numeric"
        )
    raise ValueError(f"unknown evidence control mode: {mode}")


def stress_records(records: DataFrame, variant: str, seed: int = 42) -> DataFrame:
    """Stress variants touch the evidence text only; a lone record keeps its own text under shuffling."""
    text = F.coalesce("evidence_text", F.lit(""))
    if variant == "numeric_mask":
        changed = records.withColumn("evidence_text", mask_all_numbers(text))
    elif variant == "hidden_evidence":
        changed = records.withColumn("evidence_text", F.lit(HIDDEN_STRESS_TEXT))
    elif variant == "shuffled_evidence":
        paired = _borrowed(records, seed, {"window_id": F.col("window_id"), "text": text})
        changed = (
            paired.withColumn("evidence_text", F.col("src_c_text"))
            .withColumn("stress_source_window_id", F.col("src_c_window_id"))
            .drop("src_c_text", "src_c_window_id")
        )
    else:
        raise ValueError(f"unknown stress variant: {variant}")
    return changed.withColumn("stress_variant", F.lit(variant))
