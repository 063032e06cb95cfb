"""Benchmark subsets: ambiguous choices, voted choices, balanced choices, rows to annotate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.arrays import item
from kinesift.functions.hashing import hash_cutoff, order_hash, pick
from kinesift.functions.phrases import FIELDS
from kinesift.functions.textfields import caption_claims, token_set
from kinesift.operators.benchmark import shown_evidence
from kinesift.operators.combine import mapped
from kinesift.operators.scan import prefix_scan, unique_rows
from kinesift.session import stored


def soft_score(claims: Column, fields: Column) -> Column:
    """STRUCT<matches, mismatches (negated)> over the claims whose field the evidence has."""
    agree, clash = F.lit(0), F.lit(0)
    for f in FIELDS:
        agree = agree + F.coalesce(claims[f] == fields[f], F.lit(False)).cast("int")
        clash = clash + F.coalesce(claims[f] != fields[f], F.lit(False)).cast("int")
    return F.struct(agree.alias("matches"), (-clash).alias("clashes"))


def constrained_subset(
    records: DataFrame, structured: DataFrame, top_k: int = 3, ambiguous_only: bool = True, strict: bool = True
) -> DataFrame:
    """Records whose structured scores do not single out one choice, cut to the choices still open.

    Open are all choices scored .5 or more when there are several, else the ``top_k`` by field agreement.
    Losing the right choice, or a record without structured scores, fails the job; with ``strict=False`` such rows
    stay, marked by ``gold_lost`` and ``verdict_missing``, the latter with all their choices.
    """
    verdicts = unique_rows(structured.select("window_id", "caption_scores", "evidence_fields"), "window_id")
    joined = records.join(verdicts.withColumn("_told", F.lit(True)), "window_id", "left").withColumn("_told", F.col("_told").isNotNull())
    cs = F.col("caption_selection")
    indexed = F.transform("caption_scores", lambda s, i: F.when(s >= 0.5, i))
    claims = joined.withColumn("_positive", F.filter(indexed, lambda i: i.isNotNull())).withColumn(
        "_claims", caption_claims(F.transform(cs["candidates"], lambda c: F.lower(c["text"])), each=True)
    )
    ambiguous = ~F.col("_told") | (F.size("_positive") != 1)
    kept = claims.filter(ambiguous) if ambiguous_only else claims
    ranked = F.transform(
        "_claims",
        lambda c, i: F.struct(
            -soft_score(c, F.col("evidence_fields"))["matches"],
            -soft_score(c, F.col("evidence_fields"))["clashes"],
            i.alias("i"),
        ),
    )
    best = F.transform(F.slice(F.array_sort(ranked), 1, max(1, top_k)), lambda r: r["i"])
    selected = kept.withColumn("_ambiguous", ambiguous).withColumn(
        "_selected",
        F.when(~F.col("_told"), F.transform(cs["candidates"], lambda _, i: i)).when(F.size("_positive") > 1, F.col("_positive")).otherwise(best),
    )
    answer = F.array_position("_selected", cs["answer_index"]).cast("int") - 1
    lost = answer < 0
    if strict:
        fail = F.raise_error(F.concat(F.lit("no structured scores for "), F.col("window_id")))
        answer = F.when(~F.col("_told"), fail).otherwise(answer)
        answer = F.when(lost, F.raise_error(F.concat(F.lit("subset lost the right choice of "), F.col("window_id")))).otherwise(answer)
    return (
        selected.withColumn("gold_lost", lost)
        .withColumn("verdict_missing", ~F.col("_told"))
        .withColumn("original_candidate_count", F.size(cs["candidates"]))
        .withColumn(
            "caption_selection",
            F.struct(
                cs["window_id"].alias("window_id"),
                pick(cs["candidates"], F.col("_selected")).alias("candidates"),
                answer.alias("answer_index"),
            ),
        )
        .withColumn("candidate_index_map", F.col("_selected"))
        .withColumn("ambiguous_window", F.col("_ambiguous"))
        .drop("_positive", "_claims", "_selected", "_ambiguous", "_told", "caption_scores", "evidence_fields")
    )


def vote_subset(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records cut to the choices that some run voted for, in run order; all choices when nobody voted.

    The answer is -1 when no run chose it. ``runs`` has window_id, run, caption_prediction and a map.
    """
    cs = F.col("caption_selection")
    n = F.size(cs["candidates"])
    own_map = (
        F.coalesce(F.col("candidate_index_map"), F.sequence(F.lit(0), n - 1))
        if "candidate_index_map" in records.columns
        else F.sequence(F.lit(0), n - 1)
    )
    index_map = F.col("candidate_index_map") if "candidate_index_map" in runs.columns else F.lit(None).cast("array<int>")
    votes = (
        runs.select("window_id", "run", mapped(F.col("caption_prediction"), index_map).alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("window_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "v"))), lambda s: s["v"]).alias("_votes"))
    )
    joined = records.join(votes, "window_id", "left").withColumn("_map", own_map)
    cast = joined.withColumn(
        "_votes",
        F.filter(F.coalesce("_votes", F.array().cast("array<int>")), lambda v: F.array_contains(F.col("_map"), v)),
    ).withColumn("_selected", F.when(F.size("_votes") > 0, F.array_distinct("_votes")).otherwise(F.col("_map")))
    gold = item(F.col("_map"), cs["answer_index"])
    places = F.transform("_selected", lambda v: F.array_position("_map", v).cast("int") - 1)
    answer = F.coalesce(F.array_position("_selected", gold).cast("int") - 1, F.lit(-1))
    return (
        cast.withColumn("vote_count", F.size("_votes"))
        .withColumn("unique_vote_count", F.size("_selected"))
        .withColumn("gold_in_vote_candidates", answer >= 0)
        .withColumn(
            "caption_selection",
            F.struct(
                cs["window_id"].alias("window_id"),
                pick(cs["candidates"], places).alias("candidates"),
                answer.alias("answer_index"),
            ),
        )
        .withColumn("candidate_index_map", F.col("_selected"))
        .drop("_votes", "_map", "_selected")
    )


def balance_features(records: DataFrame) -> DataFrame:
    """Per record: range and deviation of the choices' token-set sizes and of their overlap with the evidence."""
    shown = records.select(
        "window_id",
        token_set(F.lower(F.coalesce("evidence_text", F.lit("")))).alias("_evidence"),
        F.transform(F.col("caption_selection")["candidates"], lambda c: token_set(F.lower(c["text"]))).alias("_sets"),
    )
    measured = shown.select(
        "window_id",
        F.size("_sets").alias("candidate_count"),
        F.transform("_sets", lambda s: F.size(s).cast("double")).alias("_len"),
        F.transform(
            "_sets",
            lambda s: F.when(F.size(s) > 0, F.size(F.array_intersect(s, F.col("_evidence"))) / F.size(s)).otherwise(
                F.lit(0.0)
            ),
        ).alias("_lap"),
    )

    def spread(name: str) -> Column:
        return F.coalesce(F.array_max(name) - F.array_min(name), F.lit(0.0))

    def deviation(name: str) -> Column:
        n = F.size(name)
        mean = F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x) / n
        return F.when(n > 0, F.sqrt(F.aggregate(name, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n)).otherwise(
            F.lit(0.0)
        )

    return measured.select(
        "window_id",
        "candidate_count",
        spread("_len").alias("length_range"),
        deviation("_len").alias("length_std"),
        spread("_lap").alias("evidence_overlap_range"),
        deviation("_lap").alias("evidence_overlap_std"),
    ).withColumn("balance_score", F.col("length_range") / 20.0 + F.col("evidence_overlap_range"))


def balanced_subset(
    features: DataFrame,
    target_fraction: float,
    max_length_range: float | None = None,
    max_overlap_range: float | None = None,
) -> DataFrame:
    """The ``max(1, round-half-even(n * fraction))`` most balanced rows after the range limits."""
    if not 0.0 < target_fraction <= 1.0:
        raise ValueError("target_fraction must be in (0, 1]")
    kept = features
    if max_length_range is not None:
        kept = kept.filter(F.col("length_range") <= max_length_range)
    if max_overlap_range is not None:
        kept = kept.filter(F.col("evidence_overlap_range") <= max_overlap_range)
    # Written once: a split by range reads its rows twice, once for the bounds.
    kept = stored(kept, "balance")
    ranked = prefix_scan(kept, ["balance_score", "length_range", "evidence_overlap_range", "window_id"], index="_rank")
    n = kept.count()
    return ranked.filter(F.col("_rank") < max(1, round(n * target_fraction))).drop("_rank")


def annotation_subset(
    records: DataFrame, votes: DataFrame, gated: DataFrame, target_count: int, seed: int = 42
) -> DataFrame:
    """``target_count`` rows to annotate: where vote and gate disagree first, then others, each in hash order."""
    first = unique_rows(votes.select("window_id", F.col("caption_prediction").alias("_vote")), "window_id")
    second = unique_rows(gated.select("window_id", F.col("caption_prediction").alias("_gate")), "window_id")
    joined = records.join(first, "window_id", "left").join(second, "window_id", "left")
    differ = F.coalesce(F.col("_vote") != F.col("_gate"), F.lit(False))
    rows = joined.select(
        "dataset_id",
        "window_id",
        "label",
        F.when(differ, "vote_gated_disagreement").otherwise("random_hard_sample").alias("selection_reason"),
        shown_evidence(F.col("evidence_text"), F.col("evidence")).alias("evidence_text"),
        F.col("positive")["text"].alias("model_caption"),
        F.array_join(F.transform(F.col("caption_selection")["candidates"], lambda c: c["text"]), " ||| ").alias(
            "candidate_texts"
        ),
        F.col("caption_selection")["answer_index"].alias("gold_answer_index"),
        F.lit("").alias("human_caption"),
        F.lit("").alias("support_evidence"),
        F.lit("").alias("counterfactual_validity"),
        F.lit("").alias("annotator_notes"),
        # Hex digits sort below letters, so disagreements ("0") come before the rest ("1").
        F.concat(F.when(differ, "0").otherwise("1"), order_hash(seed, F.col("window_id"))).alias("_h"),
    )
    cutoff = hash_cutoff(rows, F.col("_h"), target_count)
    kept = rows.filter(F.lit(False)) if cutoff is None else rows.filter(F.col("_h") <= cutoff)
    return kept.orderBy("_h").drop("_h")
