"""Benchmark tables from cards: captions, counterfactuals, questions, multiple choice, hard variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions import captions
from kinesift.functions.hashing import hash_cutoff, order_hash, pick, shuffled_indices
from kinesift.functions.phrases import EASY_EDITS, HARD_EDITS, VOCABULARY, other_axis, other_than, worded
from kinesift.operators.scan import unique_rows

CANDIDATE = "struct<text:string,supported:boolean,changed_fact:string,changed_facts:array<string>>"
EASY_AXES = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
DIFFICULTY = {
    "v1": "natural_language_near_miss",
    "v2": "natural_language_near_miss_v2",
    "v3": "numeric_partial_contradiction_v3",
}


def candidate(text: Column, supported: bool, facts: list[str], listed: bool = False) -> Column:
    """A statement; ``listed`` also fills ``changed_facts``."""
    return F.struct(
        text.alias("text"),
        F.lit(supported).alias("supported"),
        F.lit("+".join(facts) if facts else None).cast("string").alias("changed_fact"),
        (F.array(*[F.lit(f) for f in facts]) if listed else F.lit(None)).cast("array<string>").alias("changed_facts"),
    )


def _edited(card: captions.Card, edits: dict) -> dict[str, Column]:
    return {field: worded(card[field], table, F.lit(default)) for field, (table, default) in edits.items()}


def _flip_burst(card: captions.Card) -> Column:
    return F.when(card["burstiness"] == "bursty", "smooth").otherwise("bursty")


def easy_edits(card: captions.Card) -> dict[str, Column]:
    """Five contradicting values, one per field."""
    changed = _edited(card, EASY_EDITS)
    return {
        "intensity": changed["intensity"],
        "periodicity": changed["periodicity"],
        "dominant_axis": other_than(card["dominant_axis"], EASY_AXES),
        "dominant_frequency": changed["dominant_frequency"],
        "burstiness": _flip_burst(card),
    }


def hard_edits(card: captions.Card, dataset_id: Column) -> dict[str, Column]:
    changed = _edited(card, HARD_EDITS)
    return {
        "intensity": changed["intensity"],
        "periodicity": changed["periodicity"],
        "dominant_axis": other_axis(dataset_id, card["dominant_axis"]),
        "dominant_frequency": changed["dominant_frequency"],
        "burstiness": _flip_burst(card),
    }


def _with_choice(df: DataFrame, seed: int) -> DataFrame:
    """Adds ``caption_selection``: the positive and the first three counterfactuals in hash order."""
    offered = F.concat(F.array("positive"), F.slice("counterfactuals", 1, 3))
    order = shuffled_indices(F.size(offered), seed, F.col("window_id"))
    shuffled = df.withColumn("_order", order).withColumn("_candidates", pick(offered, F.col("_order")))
    return shuffled.withColumn(
        "caption_selection",
        F.struct(
            F.col("window_id"),
            F.col("_candidates").alias("candidates"),
            (F.array_position("_order", 0).cast("int") - 1).alias("answer_index"),
        ),
    ).drop("_order", "_candidates")


def questions(card: captions.Card) -> Column:
    def qa(question: str, answer: Column, fact: str) -> Column:
        return F.struct(F.lit(question).alias("question"), answer.alias("answer"), F.lit(fact).alias("fact"))

    return F.array(
        qa("Which sensor axis carries the strongest movement?", card["dominant_axis"], "dominant_axis"),
        qa("Is the motion evidence periodic?", card["periodicity"], "periodicity"),
        qa("What intensity level is supported by the sensor evidence?", card["intensity"], "intensity"),
        qa(
            "Which statement type should be rejected if it contradicts one evidence field?",
            F.lit("counterfactual"),
            "task_understanding",
        ),
    )


def build_benchmark(cards: DataFrame, seed: int = 42) -> DataFrame:
    """One record per card: caption, 2 paraphrases, 5 one-field counterfactuals, 4-way choice, 4 questions."""
    evidence = F.struct(*[F.col(c) for c in cards.columns])
    card = captions.card_of(F.col("evidence"))
    edits = easy_edits(card)
    identity = [c for c in ("window_id", "dataset_id", "split", "label", "subject_id") if c in cards.columns]
    base = cards.select(*identity, evidence.alias("evidence")).select(
        *identity,
        "evidence",
        F.lit(None).cast("string").alias("evidence_text"),
        candidate(captions.evidence_text(card), True, []).alias("positive"),
        F.array(*[candidate(t, True, []) for t in captions.paraphrase_texts(card)]).alias("paraphrases"),
        F.array(
            *[candidate(captions.evidence_text({**card, f: v}), False, [f]) for f, v in edits.items()]
        ).alias("counterfactuals"),
        questions(card).alias("qa"),
    )
    return _with_choice(base, seed)


def build_hard_benchmark(base: DataFrame, variant: str = "v1", seed: int = 42) -> DataFrame:
    """Harder records for the windows of ``base``: natural wording (v1, v2) or numbers and 1-2 edits (v3)."""
    if variant not in DIFFICULTY:
        raise ValueError(f"unknown variant: {variant}")
    card = captions.card_of(F.col("evidence"))
    edits = hard_edits(card, F.col("dataset_id"))
    if variant == "v3":
        changed = [
            ["intensity", "dominant_frequency"],
            ["periodicity", "burstiness"],
            ["dominant_axis", "periodicity"],
            ["burstiness", "dominant_frequency"],
            ["intensity"],
        ]
        contradictions = [
            candidate(captions.hard_positive_text({**card, **{f: edits[f] for f in fs}}, "v3"), False, fs, listed=True)
            for fs in changed
        ]
    else:
        contradictions = [
            candidate(captions.hard_counterfactual_text(f, v, variant), False, [f]) for f, v in edits.items()
        ]
    identity = [c for c in ("window_id", "dataset_id", "split", "label", "subject_id") if c in base.columns]
    rows = base.select(
        *identity,
        "evidence",
        captions.hard_evidence_text(card, variant).alias("evidence_text"),
        candidate(captions.hard_positive_text(card, variant), True, []).alias("positive"),
        F.array().cast(f"array<{CANDIDATE}>").alias("paraphrases"),
        F.array(*contradictions).alias("counterfactuals"),
        F.lit(DIFFICULTY[variant]).alias("difficulty"),
    )
    return _with_choice(rows, seed)


def first_records(records: DataFrame, n: int | None, key: str = "window_id") -> DataFrame:
    """The first N records by key; None or a negative N keeps all."""
    if n is None or n < 0:
        return records
    return records.orderBy(key).limit(n)


def sample_records(records: DataFrame, n: int, key: str = "window_id", seed: int = 42) -> DataFrame:
    """Exactly n records without replacement (all when there are fewer), smallest in hash order."""
    if n < 0:
        raise ValueError("sample size must be non-negative")
    hashed = order_hash(seed, F.col(key))
    cutoff = hash_cutoff(records, hashed, n)
    return records.filter(F.lit(False)) if cutoff is None else records.filter(hashed <= cutoff)


def shown_evidence(record_text: Column, evidence: Column) -> Column:
    """The record's evidence text, or the rich rendering of its card when it has none."""
    rich = captions.evidence_text(captions.card_of(evidence))
    return F.when(F.coalesce(F.length(record_text), F.lit(0)) > 0, record_text).otherwise(rich)


def reorder_choices(records: DataFrame, seed: int = 5151) -> DataFrame:
    """Choices in another order, never the given one when there are two or more; the answer and map follow."""
    cs = F.col("caption_selection")
    n = F.size(cs["candidates"])
    hashed = shuffled_indices(n, seed, F.col("window_id"), F.lit("caption"))
    given = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rotated = F.concat(F.slice(hashed, 2, F.greatest(n - 1, F.lit(0))), F.slice(hashed, 1, 1))
    order = records.withColumn("_hashed", hashed).withColumn(
        "_order", F.when((n > 1) & (hashed == given), rotated).otherwise(F.col("_hashed"))
    )
    picked = order.withColumn("caption_order_original_answer_index", cs["answer_index"]).withColumn(
        "caption_order_original_keys", F.transform(cs["candidates"], lambda c: F.to_json(c))
    )
    if "candidate_index_map" in records.columns:
        picked = picked.withColumn("candidate_index_map", pick(F.col("candidate_index_map"), F.col("_order")))
    return (
        picked.withColumn(
            "caption_selection",
            F.struct(
                cs["window_id"].alias("window_id"),
                pick(cs["candidates"], F.col("_order")).alias("candidates"),
                (F.array_position("_order", cs["answer_index"]).cast("int") - 1).alias("answer_index"),
            ),
        )
        .withColumn("caption_order_seed", F.lit(seed))
        .drop("_order", "_hashed")
    )


def statements(records: DataFrame) -> DataFrame:
    """One row per positive, paraphrase (label 1) and counterfactual (label 0)."""
    def tagged(items: Column, kind: str) -> Column:
        return F.transform(
            items, lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), c["text"].alias("text"))
        )

    rows = F.concat(
        tagged(F.array("positive"), "positive"),
        tagged(F.coalesce("paraphrases", F.array().cast(f"array<{CANDIDATE}>")), "paraphrase"),
        tagged(F.col("counterfactuals"), "counterfactual"),
    )
    return records.select("window_id", "evidence", F.inline_outer(rows)).withColumn(
        "label", (F.col("kind") != "counterfactual").cast("int")
    )


def support_items(seed: int | None = None, negative_count: int | None = None) -> Column:
    """ARRAY of the positive and the counterfactuals, as given or (with ``seed``) in hash order."""
    negatives = F.col("counterfactuals")
    if negative_count is not None and negative_count >= 0:
        negatives = F.slice(negatives, 1, negative_count)

    def item(c: Column, kind: str, position: Column, supported: bool) -> Column:
        single = F.when(c["changed_fact"].isNotNull(), F.array(c["changed_fact"])).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(
            F.lit(kind).alias("kind"),
            position.cast("int").alias("original_index"),
            c["text"].alias("text"),
            F.lit(supported).alias("supported"),
            c["changed_fact"].alias("changed_fact"),
            F.coalesce(c["changed_facts"], single).alias("changed_facts"),
        )

    items = F.concat(
        F.array(item(F.col("positive"), "positive", F.lit(0), True)),
        F.transform(negatives, lambda c, i: item(c, "counterfactual", i, False)),
    )
    if seed is None:
        return items
    return pick(items, shuffled_indices(F.size(items), seed, F.col("window_id"), F.lit("support")))


def join_windows(records: DataFrame, windows: DataFrame, strict: bool = True) -> DataFrame:
    """Records with their raw window. In strict mode a record without a window fails the job; else it is dropped."""
    raw = unique_rows(
        windows.select(
            "window_id",
            F.col("sensor").alias("raw_sensor"),
            F.col("split").alias("raw_sensor_split"),
            F.col("label").alias("raw_sensor_label"),
            F.col("subject_id").alias("raw_sensor_subject_id"),
        ),
        "window_id",
    )
    if not strict:
        return records.join(raw, "window_id")
    missing = F.raise_error(F.concat(F.lit("no raw window for "), F.col("window_id")))
    return records.join(raw, "window_id", "left").withColumn(
        "raw_sensor", F.when(F.col("raw_sensor").isNull(), missing).otherwise(F.col("raw_sensor"))
    )


def records_without_window(records: DataFrame, windows: DataFrame) -> DataFrame:
    return records.join(windows.select("window_id"), "window_id", "left_anti")


def training_targets(evidence: Column, vocabulary: dict[str, list[str]] = VOCABULARY) -> Column:
    """STRUCT of the vocabulary position of each card field; a value outside the vocabulary is 0."""
    return F.struct(
        *[
            F.greatest(
                F.coalesce(F.array_position(F.array(*[F.lit(w) for w in words]), evidence[f]).cast("int"), F.lit(0)) - 1,
                F.lit(0),
            ).alias(f)
            for f, words in vocabulary.items()
        ]
    )
