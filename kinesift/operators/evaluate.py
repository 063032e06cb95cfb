"""Prediction rows from benchmark records: rules, structured verifier, probabilities, cosine, model answers.

A prediction row has ``window_id``, ``caption_prediction``, ``caption_answer_index``, ``caption_scores`` and, where
statements are judged, ``support_items`` with ``support_predictions`` or ``support_probabilities``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.functions.arrays import first_argmax, item
from kinesift.functions.captions import card_of
from kinesift.functions.scores import (
    claim_matches,
    cosine,
    field_match,
    predicted_fields,
    probability_score,
    rule_answer,
    rule_score,
    statement_vector,
)
from kinesift.functions.phrases import VOCABULARY
from kinesift.functions.textfields import (
    NumericBounds,
    caption_claims,
    choice_index,
    evidence_fields,
    fields_complete,
    model_fields,
    statement_claims,
    support_labels,
    supports,
)
from kinesift.operators.benchmark import shown_evidence, support_items
from kinesift.operators.logistic import Logistic, fit_logistic
from kinesift.operators.scan import unique_rows
from kinesift.session import stored


def _lowered(items: Column) -> Column:
    return F.transform(items, lambda c: F.lower(c["text"]))


def _judged(
    records: DataFrame,
    keep: list[str],
    score: Callable[[Column], Column],
    read: Callable[[Column], Column] = lambda t: t,
    to: str = "support_probabilities",
) -> DataFrame:
    """Scores the candidates and the support items of every record.

    ``read`` turns an array of lower-case texts into an array of what ``score`` takes; it runs once per text, in a
    step of its own, because an expression repeated inside one lambda would be computed each time.
    """
    kept = [c for c in dict.fromkeys(["window_id", *keep]) if c in records.columns]
    listed = records.select(
        *kept,
        F.col("caption_selection")["answer_index"].alias("caption_answer_index"),
        _lowered(F.col("caption_selection")["candidates"]).alias("_candidates"),
        support_items().alias("support_items"),
    )
    understood = listed.select(
        *kept,
        "caption_answer_index",
        "support_items",
        read(F.col("_candidates")).alias("_candidates"),
        read(_lowered(F.col("support_items"))).alias("_statements"),
    )
    return understood.select(
        *kept,
        "caption_answer_index",
        "support_items",
        F.transform("_candidates", score).alias("caption_scores"),
        F.transform("_statements", score).alias(to),
    ).withColumn("caption_prediction", first_argmax(F.col("caption_scores")))


def rule_rows(records: DataFrame, system: str) -> DataFrame:
    """Rule scorer B1, B2, B3 or M1 on every candidate and statement; also the questions it gets right."""
    card = card_of(F.col("evidence"))
    scored = _judged(records, ["dataset_id", "evidence", "qa"], lambda t: rule_score(card, t, system))
    right = F.filter(
        "qa", lambda q: F.lower(rule_answer(card, q["fact"], system)) == F.lower(q["answer"])
    )
    return (
        scored.withColumn("qa_correct", F.size(right))
        .withColumn("qa_total", F.size("qa"))
        .drop("qa", "evidence")
    )


def structured_rows(
    records: DataFrame,
    bounds: NumericBounds | None,
    fields: Column | None = None,
) -> DataFrame:
    """Structured verifier: a statement holds when its claims equal the fields read from the evidence text.

    ``fields`` replaces the text parser (model answers). ``bounds`` come from a table that the caller names.
    """
    text = shown_evidence(F.col("evidence_text"), F.col("evidence"))
    read = records.withColumn("evidence_fields", fields if fields is not None else evidence_fields(text, bounds))
    own = F.col("evidence_fields")
    held = _judged(
        read,
        ["dataset_id", "evidence_fields", "candidate_index_map"],
        lambda c: supports(c, own),
        partial(caption_claims, each=True),
        to="support_predictions",
    )
    return held.withColumn(
        "caption_scores", F.transform("caption_scores", lambda h: F.when(h, 1.0).otherwise(0.0))
    ).select("*", fields_complete(own).alias("parse_complete"))


def structured_rows_from_answers(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Structured verifier on fields from model answers (``window_id``, ``response``)."""
    joined = records.join(unique_rows(answers.select("window_id", "response"), "window_id"), "window_id", "left")
    return structured_rows(joined, None, model_fields(F.col("response"), F.col("dataset_id")))


def probability_rows(records: DataFrame, probabilities: str = "field_probabilities") -> DataFrame:
    """Scores from field probabilities (a MAP column); card values serve only the field accuracy."""
    rows = _judged(
        records,
        ["dataset_id", probabilities, "evidence"],
        lambda c: probability_score(c, F.col(probabilities)),
        partial(statement_claims, each=True),
    )
    told = rows.withColumn("evidence_predictions", predicted_fields(F.col(probabilities)))
    guess, card = F.col("evidence_predictions"), F.col("evidence")
    right, known = F.lit(0), F.lit(0)
    for f in VOCABULARY:
        right = right + F.coalesce(guess[f] == card[f], F.lit(False)).cast("int")
        known = known + card[f].isNotNull().cast("int")
    return told.select("*", right.alias("fields_correct"), known.alias("fields_total")).drop("evidence", probabilities)


def cosine_rows(vectors: DataFrame) -> DataFrame:
    """Cosine of an evidence vector with candidate, positive and counterfactual vectors (array columns)."""
    own = F.col("evidence_vector")
    scored = vectors.select(
        "window_id",
        F.col("answer_index").alias("caption_answer_index"),
        F.transform("candidate_vectors", lambda v: cosine(own, v)).alias("caption_scores"),
        cosine(own, F.col("positive_vector")).alias("positive_score"),
        F.transform("counterfactual_vectors", lambda v: cosine(own, v)).alias("counterfactual_scores"),
    )
    return scored.withColumn("caption_prediction", first_argmax(F.col("caption_scores")))


def cosine_judgements(rows: DataFrame) -> DataFrame:
    """(window_id, truth, score): the positive and the counterfactual cosines of :func:`cosine_rows` as judged statements."""
    one = lambda truth, score: F.struct(F.lit(truth).alias("truth"), score.alias("score"))
    stated = F.concat(F.array(one(1, F.col("positive_score"))), F.transform("counterfactual_scores", lambda s: one(0, s)))
    return rows.select("window_id", F.explode_outer(stated).alias("s")).select("window_id", "s.truth", "s.score")


def _answer_key(records: DataFrame) -> DataFrame:
    n = F.size(F.col("caption_selection")["candidates"])
    mapped = "candidate_index_map" if "candidate_index_map" in records.columns else None
    return records.select(
        "window_id",
        F.col("caption_selection")["answer_index"].alias("caption_answer_index"),
        n.alias("candidate_count"),
        *([mapped] if mapped else [F.lit(None).cast("array<int>").alias("candidate_index_map")]),
    )


def margin_rows(records: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates ranked by yes/no scores: rows (window_id, pos, margin, positive_logprob, negative_logprob)."""
    value = F.coalesce(
        F.col("margin"),
        F.coalesce("positive_logprob", F.lit(0.0)) - F.coalesce("negative_logprob", F.lit(0.0)),
    )
    listed = scored.groupBy("window_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda s: s["v"]).alias(
            "caption_scores"
        )
    )
    return _answer_key(records).join(listed, "window_id", "left").withColumn(
        "caption_prediction", first_argmax(F.col("caption_scores"))
    )


def choice_rows(records: DataFrame, scored: DataFrame, strict: bool = True) -> DataFrame:
    """Forced choice by log-probability: ``scored`` has window_id and ``logprobs`` (one per candidate).

    A wrong count or a value that is not finite fails the job in strict mode; otherwise ``violation`` names it.
    """
    joined = _answer_key(records).join(
        unique_rows(scored.select("window_id", F.col("logprobs").alias("caption_scores")), "window_id"), "window_id", "left"
    )
    infinite = F.exists("caption_scores", lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))
    violation = (
        F.when(F.col("caption_scores").isNull() | (F.size("caption_scores") != F.col("candidate_count")), "candidate count")
        .when(infinite, "not finite")
    )
    rows = joined.withColumn("violation", violation)
    if strict:
        message = F.concat(F.col("violation"), F.lit(" for "), F.col("window_id"))
        failed = F.when(F.col("violation").isNotNull(), F.raise_error(message))
        rows = rows.withColumn("caption_scores", F.coalesce(failed.cast("array<double>"), F.col("caption_scores")))
    chosen = F.when(F.col("violation").isNull(), first_argmax(F.col("caption_scores")))
    return rows.withColumn("caption_prediction", chosen)


def answer_rows(
    records: DataFrame,
    answers: DataFrame,
    seed: int = 42,
    negative_count: int | None = None,
    caption_only: bool = False,
) -> DataFrame:
    """Direct answers (window_id, caption_response, support_response) read into predictions.

    An unreadable choice scores zero everywhere; unreadable support labels count as all false.
    """
    columns = ["window_id", "caption_response", *([] if caption_only else ["support_response"])]
    key = _answer_key(records)
    if not caption_only:
        key = key.join(records.select("window_id", support_items(seed, negative_count).alias("support_items")), "window_id")
    joined = key.join(unique_rows(answers.select(*columns), "window_id"), "window_id", "left")
    read = joined.withColumn("caption_prediction", choice_index(F.col("caption_response"), F.col("candidate_count")))
    places = F.when(F.col("candidate_count") > 0, F.sequence(F.lit(0), F.col("candidate_count") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    scored = read.withColumn(
        "caption_scores",
        F.transform(places, lambda i: F.coalesce((i == F.col("caption_prediction")).cast("double"), F.lit(0.0))),
    )
    if caption_only:
        return scored.withColumn("parsed", F.col("caption_prediction").isNotNull())
    labelled = scored.withColumn("_labels", support_labels(F.col("support_response"), F.size("support_items")))
    return (
        labelled.withColumn("support_parse_succeeded", F.col("_labels").isNotNull())
        .withColumn(
            "support_predictions",
            F.coalesce("_labels", F.transform("support_items", lambda _: F.lit(False))),
        )
        .withColumn("parsed", F.col("caption_prediction").isNotNull() & F.col("support_parse_succeeded"))
        .drop("_labels")
    )


def apply_model(
    df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Run a user's batch model (generation, scoring, embedding, field probabilities) over ``df`` by Arrow batches.

    The model gets a batch and must return one row per input row with the columns of ``schema``.
    """
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = model(part)
            if len(out) != len(part):
                raise ValueError(f"model returned {len(out)} rows for {len(part)}")
            missing = [n for n in names if n not in out.columns]
            if missing:
                raise ValueError(f"model output lacks {missing}")
            yield out[names]

    return df.mapInPandas(batches, schema)


def statement_vectors(statements: DataFrame, feature_mode: str = "oracle_fields") -> DataFrame:
    """Adds ``features`` (array) to statement rows (evidence, text)."""
    claimed = statements.withColumn("_claims", statement_claims(F.lower("text")))
    return claimed.withColumn("features", statement_vector(F.col("evidence"), F.col("_claims"), feature_mode)).drop("_claims")


def field_match_rows(records: DataFrame) -> DataFrame:
    """Statements scored by matches over claims; needs no training."""
    card = F.col("evidence")
    return _judged(
        records,
        ["dataset_id", "evidence"],
        lambda c: field_match(*claim_matches(card, c)),
        partial(statement_claims, each=True),
    ).drop("evidence")


#: Statements up to which training a forest keeps the node that each tree has a row in (1.2 KB a row; the trees are the same).
NODE_IDS = 1 << 22


def fit_statement_classifier(
    statements: DataFrame, model_type: str = "logistic_regression", feature_mode: str = "oracle_fields", seed: int = 42
):
    """A model on labelled statements with balanced class weights n / (2 * n_class): :class:`Logistic` or a Spark ML forest."""
    rows = statement_vectors(statements, feature_mode).select("features", F.col("label").cast("double").alias("label"))
    if model_type == "random_forest":
        # Training reads its rows several times; what they are computed from runs once.
        rows = stored(rows, "statement-vectors")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(counts.values())
    weight = F.lit(0.0)
    for label, count in counts.items():
        weight = F.when(F.col("label") == label, n / (len(counts) * count)).otherwise(weight)
    weighted = rows.withColumn("weight", weight)
    if model_type == "logistic_regression":
        return fit_logistic(weighted)
    if model_type == "random_forest":
        trainer = RandomForestClassifier(
            numTrees=300, maxDepth=20, seed=seed, weightCol="weight", featuresCol="features", labelCol="label", cacheNodeIds=n <= NODE_IDS
        )
        return trainer.fit(weighted.withColumn("features", array_to_vector("features")))
    raise ValueError(f"unknown model_type: {model_type}")


def classifier_rows(records: DataFrame, model, feature_mode: str = "oracle_fields") -> DataFrame:
    """Classifier scores of every candidate and statement, gathered back to one row per record."""
    listed = records.select(
        "window_id",
        "evidence",
        F.col("caption_selection")["answer_index"].alias("caption_answer_index"),
        support_items().alias("support_items"),
        F.transform(
            F.col("caption_selection")["candidates"],
            lambda c, i: F.struct(F.lit("choice").alias("part"), i.alias("pos"), c["text"].alias("text")),
        ).alias("_c"),
    )
    texts = listed.select(
        "window_id",
        "evidence",
        F.inline_outer(
            F.concat(
                F.col("_c"),
                F.transform(
                    F.col("support_items"),
                    lambda s, i: F.struct(F.lit("support").alias("part"), i.alias("pos"), s["text"].alias("text")),
                ),
            )
        ),
    )
    vectors = statement_vectors(texts, feature_mode)
    if isinstance(model, Logistic):
        scored = vectors.select("window_id", "part", "pos", model.probability(F.col("features")).alias("p"))
    else:
        judged = model.transform(vectors.withColumn("features", array_to_vector("features")))
        scored = judged.select("window_id", "part", "pos", item(vector_to_array("probability"), F.lit(1)).alias("p"))

    def gathered(part: str) -> Column:
        own = F.collect_list(F.when(F.col("part") == part, F.struct("pos", "p")))
        return F.transform(F.array_sort(own), lambda s: s["p"])

    lists = scored.groupBy("window_id").agg(
        gathered("choice").alias("caption_scores"), gathered("support").alias("support_probabilities")
    )
    return (
        listed.drop("_c", "evidence")
        .join(lists, "window_id")
        .withColumn("caption_prediction", first_argmax(F.col("caption_scores")))
    )
