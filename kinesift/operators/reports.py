"""Breakdowns and summary tables over prediction rows and metric tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesift.functions.arrays import first_argmax, item, top_margin
from kinesift.operators.combine import bad_map, mapped
from kinesift.operators.metrics import bin_edges, cells, f1_of, in_bin, rejection_columns, risk_curves, support_rows
from kinesift.operators.scan import unique_rows
from kinesift.session import stored

# Edges of the margin buckets.
MARGIN_EDGES = [0.0, 1.0, 2.0, 3.0, 5.0, 10.0]


def candidate_fact(candidates: Column, index: Column) -> Column:
    """What the chosen candidate changed: its facts joined by ``+``, ``supported``, ``out_of_range`` or ``unknown``."""
    chosen = item(candidates, index)
    facts = chosen["changed_facts"]
    return (
        F.when(candidates.isNull() | index.isNull(), "unknown")
        .when((index < 0) | (index >= F.size(candidates)), "out_of_range")
        .when(F.size(facts) > 0, F.array_join(facts, "+"))
        .otherwise(F.coalesce(chosen["changed_fact"], F.lit("supported")))
    )


def _facts_of(records: DataFrame, literal: bool) -> DataFrame:
    """window_id, candidates and the map that turns an original position into one of ``records``."""
    index_map = (
        F.col("candidate_index_map")
        if "candidate_index_map" in records.columns and not literal
        else F.lit(None).cast("array<int>")
    )
    return unique_rows(
        records.select("window_id", F.col("caption_selection")["candidates"].alias("_candidates"), index_map.alias("_map")),
        "window_id",
    )


def _place(index: Column) -> Column:
    """Rows count in original positions; a subset record is looked up through its map."""
    return F.when(F.col("_map").isNull(), index).otherwise(F.array_position("_map", index).cast("int") - 1)


def failure_changes(primary: DataFrame, gated: DataFrame, records: DataFrame, literal: bool = False) -> DataFrame:
    """Per window: corrected, regressed, unchanged_correct or unchanged_wrong, with the wrong choice's fact.

    ``literal=True`` takes positions as they stand even when ``records`` are a subset with a map.
    """
    other = unique_rows(
        gated.select(
            "window_id",
            F.col("caption_prediction").alias("gated_prediction"),
            *([F.col("caption_gate_source")] if "caption_gate_source" in gated.columns else []),
        ),
        "window_id",
    )
    joined = (
        primary.select("window_id", "caption_answer_index", F.col("caption_prediction").alias("primary_prediction"))
        .join(other, "window_id")
        .join(_facts_of(records, literal), "window_id", "left")
    )
    was = F.coalesce(F.col("primary_prediction") == F.col("caption_answer_index"), F.lit(False))
    now = F.coalesce(F.col("gated_prediction") == F.col("caption_answer_index"), F.lit(False))
    kind = (
        F.when(~was & now, "corrected")
        .when(was & ~now, "regressed")
        .when(was, "unchanged_correct")
        .otherwise("unchanged_wrong")
    )
    wrong = F.when(kind == "corrected", F.col("primary_prediction")).when(kind == "regressed", F.col("gated_prediction"))
    fact = F.when(kind.isin("corrected", "regressed"), candidate_fact(F.col("_candidates"), _place(wrong)))
    return joined.withColumn("kind", kind).withColumn("wrong_fact", fact).drop("_candidates", "_map")


def failure_taxonomy(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind", "wrong_fact").agg(F.count(F.lit(1)).alias("n"))


def failure_examples(changes: DataFrame, max_examples: int = 8) -> DataFrame:
    """The first examples of each kind; Spark keeps at most that many per task before the shuffle."""
    first = Window.partitionBy("kind").orderBy("window_id")
    return (
        changes.filter(F.col("kind").isin("corrected", "regressed"))
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= max_examples)
        .drop("_n")
    )


def per_fact_accuracy(rows: DataFrame, records: DataFrame, literal: bool = False) -> DataFrame:
    """Accuracy overall, by the right choice's fact, and counts by the wrong choice's fact."""
    joined = rows.select("window_id", "caption_prediction", "caption_answer_index").join(
        _facts_of(records, literal), "window_id", "left"
    )
    right = F.coalesce(F.col("caption_prediction") == F.col("caption_answer_index"), F.lit(False))

    def group(grouping: str, fact: Column) -> Column:
        return F.struct(F.lit(grouping).alias("grouping"), fact.alias("fact"))

    gold = candidate_fact(F.col("_candidates"), _place(F.col("caption_answer_index")))
    chosen = candidate_fact(F.col("_candidates"), _place(F.col("caption_prediction")))
    groups = F.concat(
        F.array(group("overall", F.lit("all")), group("gold", gold)),
        F.when(right, F.array().cast("array<struct<grouping:string,fact:string>>")).otherwise(
            F.array(group("predicted_wrong", chosen))
        ),
    )
    named = joined.select(right.cast("int").alias("right"), groups.alias("g"))
    opened = named.select("right", F.explode_outer("g").alias("g"))
    return opened.groupBy(F.col("g.grouping").alias("grouping"), F.col("g.fact").alias("fact")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("right").alias("accuracy")
    )


def margin_buckets(rows: DataFrame, edges: list[float] = MARGIN_EDGES, literal: bool = False) -> DataFrame:
    """Count, valid count and accuracy per margin bucket, empty buckets included.

    Prediction and answer are both taken to original positions; ``literal=True`` leaves the answer as it stands.
    """
    index_map = F.col("candidate_index_map") if "candidate_index_map" in rows.columns else F.lit(None).cast("array<int>")
    guess = mapped(F.col("caption_prediction"), index_map, strict=True)
    answer = F.col("caption_answer_index") if literal else mapped(F.col("caption_answer_index"), index_map)
    valid = guess.isNotNull() & ~bad_map(F.col("caption_prediction"), index_map)
    facts = rows.select(
        top_margin(F.col("caption_scores")).alias("m"), valid.alias("v"), (valid & (guess == answer)).alias("r")
    )
    bounds = [(None, edges[0]), *zip(edges, edges[1:]), (edges[-1], None)]
    cells_ = []
    for low, high in bounds:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("m") > low)
        if high is not None:
            inside = inside & (F.col("m") <= high)

        def count(cond: Column) -> Column:
            return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

        label = f"({'-inf' if low is None else f'{low:g}'}, {'inf)' if high is None else f'{high:g}]'}"
        cells_.append(
            F.struct(
                F.lit(label).alias("bucket"),
                F.lit(low).cast("double").alias("lower"),
                F.lit(high).cast("double").alias("upper"),
                count(inside).alias("count"),
                count(inside & F.col("v")).alias("valid_count"),
                (count(inside & F.col("r")) / F.greatest(F.lit(1), count(inside & F.col("v")))).alias("alternate_accuracy"),
            )
        )
    return facts.agg(F.array(*cells_).alias("b")).select(F.inline("b"))


def field_rejection(rows: DataFrame) -> DataFrame:
    """Positives supported and counterfactuals rejected, in total and per changed fact (a pair counts for both)."""
    s = support_rows(rows)
    none = F.array(F.coalesce("changed_fact", F.lit("unknown")))
    facts = F.when(F.size("changed_facts") > 0, F.col("changed_facts")).otherwise(none)
    groups = F.when(F.col("kind") == "positive", F.array(F.lit("*positive"))).otherwise(
        F.concat(F.array(F.lit("*counterfactual")), facts)
    )
    ok = F.when(F.col("kind") == "positive", F.col("predicted")).otherwise(~F.col("predicted"))
    return (
        s.select(F.explode_outer(groups).alias("field"), ok.cast("int").alias("ok"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("ok").alias("right"), F.avg("ok").alias("recall"))
    )


def metric_family(metrics: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for one run) of metric columns over the runs of a family."""
    out = [F.count(F.lit(1)).alias("count")]
    for c in columns:
        out.append(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"))
        out.append(F.coalesce(F.when(F.count(c) > 1, F.stddev_samp(c)), F.lit(0.0)).alias(f"{c}_std"))
    return metrics.groupBy(family).agg(*out)


def subset_accuracy(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Per system: accuracy on all windows and on the selected ones, and the difference."""
    chosen = selected.select("window_id").distinct().withColumn("_in", F.lit(True))
    right = F.coalesce(F.col("caption_prediction") == F.col("caption_answer_index"), F.lit(False)).cast("int")
    marked = rows.join(chosen, "window_id", "left").withColumn("_right", right)
    inside = F.when(F.col("_in"), F.col("_right"))
    return (
        marked.groupBy("system")
        .agg(
            F.avg("_right").alias("full_accuracy"),
            F.avg(inside).alias("balanced_accuracy"),
            F.count(inside).alias("balanced_n"),
            F.count(F.lit(1)).alias("full_n"),
        )
        .withColumn("delta_balanced_minus_full", F.col("balanced_accuracy") - F.col("full_accuracy"))
    )


def control_table(metrics: DataFrame, gap: float = 0.03) -> DataFrame:
    """dataset x condition with choice, gated and no-gate accuracy, the change against ``visible`` and risk flags.

    ``metrics``: dataset, condition, kind (choice, gated, nogate), caption_selection_accuracy, n_eval_records, alternate_count.
    """

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    acc = "caption_selection_accuracy"
    wide = metrics.groupBy("dataset", "condition").agg(
        of("choice", acc).alias("choice_accuracy"),
        of("gated", acc).alias("gated_accuracy"),
        of("nogate", acc).alias("nogate_accuracy"),
        of("choice", "n_eval_records").alias("n_eval_records"),
        (of("gated", "alternate_count") / F.nullif(of("gated", "n_eval_records"), F.lit(0))).alias("gated_coverage"),
    )
    # A dataset has a handful of conditions, so this window is a handful of rows wide.
    same = Window.partitionBy("dataset")
    seen = F.max(F.when(F.col("condition") == "visible", F.col("choice_accuracy"))).over(same)
    seen_gated = F.max(F.when(F.col("condition") == "visible", F.col("gated_accuracy"))).over(same)
    other = F.col("condition") != "visible"
    return wide.select(
        "*",
        (F.col("choice_accuracy") - seen).alias("choice_delta_vs_visible"),
        F.coalesce(other & (seen - F.col("choice_accuracy") < gap), F.lit(False)).alias("choice_risk"),
        F.coalesce(other & (seen_gated - F.col("gated_accuracy") < gap), F.lit(False)).alias("gated_risk"),
    )


def position_prior_table(metrics: DataFrame, limit: float = 0.35) -> DataFrame:
    """Position-only accuracy against full choice accuracy per dataset; a prior at the limit or above is flagged."""
    prior = metrics.filter(F.col("kind") == "position_prior").select(
        "dataset", F.col("caption_selection_accuracy").alias("position_prior_acc"), "n_eval_records"
    )
    choice = metrics.filter(F.col("kind") == "choice").select(
        "dataset", F.col("caption_selection_accuracy").alias("choice_acc")
    )
    return prior.join(choice, "dataset", "full").select(
        "dataset",
        "position_prior_acc",
        "choice_acc",
        (F.col("choice_acc") - F.col("position_prior_acc")).alias("choice_minus_position"),
        "n_eval_records",
        F.coalesce(F.col("position_prior_acc") >= limit, F.lit(False)).alias("high_prior"),
    )


def override_cost(metrics: DataFrame) -> DataFrame:
    """Prompts needed, prompts used and their share per dataset (metrics of kind choice and gated)."""

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    return metrics.groupBy("dataset").agg(
        of("gated", "n_eval_records").alias("n_eval_records"),
        of("choice", "n_scoring_prompts").alias("full_choice_prompts"),
        of("gated", "alternate_count").alias("effective_override_prompts"),
        (of("gated", "alternate_count") / F.nullif(of("gated", "n_eval_records"), F.lit(0))).alias("gate_coverage"),
    )


def system_table(metrics: DataFrame, paired: DataFrame) -> DataFrame:
    """One row per dataset: choice, gated and no-gate accuracy next to the paired difference and mid-p value."""
    wide = (
        metrics.filter(F.col("kind").isin("choice", "gated", "nogate"))
        .groupBy("dataset")
        .pivot("kind", ["choice", "gated", "nogate"])
        .agg(F.max("caption_selection_accuracy").alias("acc"), F.max("alternate_count").alias("alt"), F.max("n_eval_records").alias("n"))
    )
    return wide.join(paired.select("dataset", "delta", "midp_value"), "dataset", "left").select(
        "dataset",
        F.col("choice_acc").alias("choice_accuracy"),
        F.col("gated_acc").alias("gated_accuracy"),
        F.col("nogate_acc").alias("nogate_accuracy"),
        F.col("delta").alias("delta_vs_primary"),
        F.col("midp_value").alias("mcnemar_midp"),
        F.col("gated_alt").alias("gate_alternate_count"),
        F.coalesce("gated_n", "choice_n").alias("n_eval_records"),
    )


def _listed(row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]))
    )


def _report(rows: DataFrame, counted: dict[str, Column], judged: Column, sets: list[str], results: dict[str, Column]) -> DataFrame:
    """(metric, value) rows from two aggregates and one ranking over one written table.

    ``judged`` is the row's array of (set, key, truth, score, label, guess); ``counted`` are sums over the rows of
    ``rows`` and ``results`` what is told of these and of the per-set sums. All sums - squared gaps, calibration
    bins, cells, label counts - come from one conditional aggregate by (set, label, guess); all risk-coverage
    curves from one ranking in which a curve is a segment.
    """
    own = F.struct(*[c.alias(name) for name, c in counted.items()])
    items = stored(rows.select(own.alias("_own"), F.posexplode_outer(judged).alias("_i", "_j")), "judged").select(
        F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_own")).alias("_own"), "_j.*"
    )
    gap = F.col("score") - F.col("truth")
    n_bins = len(bin_edges()) - 1
    bins = [
        F.sum(F.when(in_bin(F.col("score"), i), F.col(c))).cast("double").alias(f"{c}{i}") for i in range(n_bins) for c in ("truth", "score")
    ]
    held = cells(F.col("truth"), F.col("guess") == 1)
    cell = items.groupBy("set", "label", "guess").agg(
        F.count("set").cast("double").alias("n"),
        F.count(gap).cast("double").alias("known"),
        F.sum(gap * gap).alias("squared"),
        *bins,
        *[c.cast("double").alias(k) for k, c in held.items()],
        *[F.sum(F.col("_own")[name]).cast("double").alias(f"own_{name}") for name in counted],
    )
    by_set = []
    for name in sets:

        def total(c: str, here: Column = F.col("set") == name) -> Column:
            return F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0.0))

        gaps = [F.abs(total(f"truth{i}") - total(f"score{i}")) for i in range(n_bins)]
        by_set += [
            (total("squared") / F.greatest(F.lit(1.0), total("known"))).alias(f"{name}_brier"),
            (reduce(add, gaps) / F.greatest(F.lit(1.0), total("n"))).alias(f"{name}_ece"),
            *[total(k).alias(f"{name}_{k}") for k in held],
        ]
    labels = F.collect_list(F.when((F.col("set") == sets[0]) & (F.col("n") > 0), F.struct("label", "guess", "n")))
    told = cell.agg(*by_set, *[F.coalesce(F.sum(f"own_{c}"), F.lit(0.0)).alias(c) for c in counted], labels.alias("_labels"))
    curves = risk_curves(items.filter(F.col("set").isNotNull()).select("set", "key", "truth", "score"), "set", "truth", "score", "key")
    auc = curves.groupBy().agg(
        *[F.coalesce(F.max(F.when(F.col("set") == name, F.col("risk_coverage_auc"))), F.lit(0.0)).alias(f"{name}_risk_coverage_auc") for name in sets]
    )
    kept = [F.col(f"{name}_{m}") for name in sets for m in ("brier", "ece")]
    # Both sides are single rows.
    return _listed(told.select(*[c.alias(k) for k, c in results.items()], *kept)).unionByName(_listed(auc))


def macro_f1_of(labels: Column) -> Column:
    """Mean F1 over all labels seen as truth or guess, from (label, guess, n) counts."""
    seen = F.array_union(F.transform(labels, lambda x: x["label"]), F.transform(labels, lambda x: x["guess"]))

    def count(keep) -> Column:
        return F.aggregate(F.filter(labels, keep), F.lit(0.0), lambda acc, x: acc + x["n"])

    def f1(label: Column) -> Column:
        return f1_of(
            count(lambda x: (x["label"] == label) & (x["guess"] == label)),
            count(lambda x: (x["label"] != label) & (x["guess"] == label)),
            count(lambda x: (x["label"] == label) & (x["guess"] != label)),
        )

    each = F.transform(seen, f1)
    return F.when(F.size(seen) > 0, F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / F.size(seen)).otherwise(0.0)


def _caption_item() -> Column:
    guess = F.coalesce("caption_prediction", F.lit(0))
    return _item(
        "caption",
        F.col("window_id"),
        (guess == F.col("caption_answer_index")).cast("int"),
        F.coalesce(F.array_max("caption_scores"), F.lit(0.0)),
        F.col("caption_answer_index"),
        guess,
    )


def _item(name: str, key: Column, truth: Column, score: Column, label: Column, guess: Column) -> Column:
    return F.struct(
        F.lit(name).alias("set"),
        key.alias("key"),
        truth.cast("int").alias("truth"),
        score.cast("double").alias("score"),
        label.cast("int").alias("label"),
        guess.cast("int").alias("guess"),
    )


def _counted(rows: DataFrame) -> dict[str, Column]:
    right = (F.coalesce("caption_prediction", F.lit(0)) == F.col("caption_answer_index")).cast("int")
    return {"_rows": F.lit(1), "_right": F.coalesce(right, F.lit(0)), "_correct": F.col("fields_correct"), "_total": F.col("fields_total")}


def _caption_results() -> dict[str, Column]:
    return {
        "caption_selection_accuracy": F.col("_right") / F.greatest(F.lit(1.0), F.col("_rows")),
        "n_eval_records": F.col("_rows"),
    }


def _field_result() -> dict[str, Column]:
    return {"evidence_field_accuracy": F.col("_correct") / F.greatest(F.lit(1.0), F.col("_total"))}


def probability_report(rows: DataFrame, support_threshold: float = 0.5) -> DataFrame:
    """(metric, value) rows for probability predictions: captions, support, rejection, field accuracy."""
    scores = (
        F.col("support_probabilities")
        if "support_probabilities" in rows.columns
        else F.transform("support_predictions", lambda p: p.cast("double"))
    )
    pairs = F.arrays_zip(F.transform("support_items", lambda x: x["supported"].cast("int")).alias("t"), scores.alias("v"))

    def statement(i: Column, truth: Column, score: Column) -> Column:
        key = F.concat_ws(":", F.col("window_id"), F.format_string("%06d", i))
        held = (score >= support_threshold).cast("int")
        own = _item("support", key, truth, score, F.lit(None), held)
        turned = _item("cf_reject", key, F.lit(1), 1.0 - score, F.lit(None), held)
        return F.filter(F.array(own, F.when(truth == 0, turned)), lambda x: x.isNotNull())

    statements = F.flatten(F.transform(pairs, lambda x, i: statement(i, x["t"], x["v"])))
    judged = F.concat(F.array(_caption_item()), F.coalesce(statements, F.array().cast(_ITEMS)))
    rejection = rejection_columns({k: F.col(f"support_{k}") for k in ("tp", "fp", "fn", "tn")}, "cf_reject_")
    results = _caption_results() | {"caption_macro_f1": macro_f1_of(F.col("_labels"))}
    results |= {f"cf_reject_{n}": c for n, c in zip(("accuracy", "precision", "recall", "f1"), rejection, strict=True)} | _field_result()
    return _report(rows, _counted(rows), judged, ["caption", "support", "cf_reject"], results)


_ITEMS = "array<struct<set: string, key: string, truth: int, score: double, label: int, guess: int>>"


def field_probability_report(rows: DataFrame) -> DataFrame:
    """(metric, value) rows: caption accuracy, pooled field accuracy, calibration of the top score."""
    return _report(rows, _counted(rows), F.array(_caption_item()), ["caption"], _caption_results() | _field_result())


def grounding_summary(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for any prediction rows with judged statements: caption accuracy and rejection metrics."""
    def in_row(t: int, positive: bool) -> Column:
        judged = (
            F.col("support_predictions")
            if "support_predictions" in rows.columns
            else F.transform("support_probabilities", lambda p: p >= threshold)
        )
        pairs = F.zip_with("support_items", judged, lambda s, p: (s["supported"] == F.lit(bool(t))) & (p == F.lit(positive)))
        return F.coalesce(F.sum(F.size(F.filter(pairs, lambda x: x))), F.lit(0))

    right = (F.coalesce(first_argmax(F.col("caption_scores")), F.lit(0)) == F.col("caption_answer_index")).cast("int")
    extra = []
    if "qa_correct" in rows.columns:
        extra.append((F.sum("qa_correct") / F.greatest(F.lit(1), F.sum("qa_total"))).alias("qa_accuracy"))
    if "parse_complete" in rows.columns:
        extra.append(F.avg(F.col("parse_complete").cast("int")).alias("evidence_parse_complete_rate"))
    if "parsed" in rows.columns:
        extra.append(F.avg(F.col("parsed").cast("int")).alias("parse_success_rate"))
    counted = rows.agg(
        F.coalesce(F.avg(right), F.lit(0.0)).alias("caption_selection_accuracy"),
        in_row(1, True).alias("tp"),
        in_row(0, True).alias("fp"),
        in_row(1, False).alias("fn"),
        in_row(0, False).alias("tn"),
        F.count(F.lit(1)).alias("n_eval_records"),
        *extra,
    )
    more = [c for c in counted.columns if c not in ("tp", "fp", "fn", "tn", "caption_selection_accuracy", "n_eval_records")]
    return counted.select(
        "caption_selection_accuracy",
        *rejection_columns({k: F.col(k) for k in ("tp", "fp", "fn", "tn")}, "cf_reject_"),
        "n_eval_records",
        *more,
    )
