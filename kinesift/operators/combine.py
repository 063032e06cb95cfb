"""Several systems' predictions combined by window: remap, hybrid, vote, margin gate, threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.arrays import first_argmax, item, top_margin
from kinesift.functions.hashing import sha_bucket
from kinesift.operators.metrics import rejection_columns, support_cells
from kinesift.operators.scan import unique_rows

# Margins tried when a gate is calibrated.
DEFAULT_THRESHOLDS = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0]


def mapped(index: Column, index_map: Column, strict: bool = False) -> Column:
    """A position in a subset as the original position. Outside the map it stays (or, strict, is NULL)."""
    found = item(index_map, index)
    outside = F.lit(None).cast("int") if strict else index.cast("int")
    return F.when(index_map.isNull(), index.cast("int")).otherwise(F.coalesce(found, outside))


def bad_map(index: Column, index_map: Column) -> Column:
    """The prediction exists but its map does not cover it."""
    return index.isNotNull() & index_map.isNotNull() & item(index_map, index).isNull()


def one_hot_scores(n: Column, chosen: Column) -> Column:
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.coalesce((i == chosen).cast("double"), F.lit(0.0)))


def _need(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds missing optional columns as NULL."""
    types = {"candidate_index_map": "array<int>", "caption_scores": "array<double>"}
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast(types[n]))
    return df


def hybrid_rows(structured: DataFrame, direct: DataFrame, threshold: float = 0.5, on_duplicate: str = "error") -> DataFrame:
    """The structured choice where exactly one score reaches the threshold, else the direct one, else the best score.

    Support decisions stay the structured ones.
    """
    other = unique_rows(
        _need(direct, ["candidate_index_map"]).select(
            "window_id",
            F.col("caption_prediction").alias("direct_caption_prediction"),
            F.col("candidate_index_map").alias("direct_candidate_index_map"),
        ),
        "window_id",
        on_duplicate,
    )
    joined = structured.join(other, "window_id", "left")
    return _hybrid_choice(joined, F.lit(threshold))


def _hybrid_choice(joined: DataFrame, threshold: Column) -> DataFrame:
    scores = F.coalesce("caption_scores", F.array().cast("array<double>"))
    reached = F.filter(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"] >= threshold)
    decided = F.when(F.size(reached) == 1, item(reached, F.lit(0))["i"].cast("int"))
    direct = mapped(F.col("direct_caption_prediction"), F.col("direct_candidate_index_map"))
    return (
        joined.withColumn("structured_caption_scores", scores)
        .withColumn("_decided", decided)
        .withColumn(
            "caption_prediction",
            F.when(F.col("_decided").isNotNull(), F.col("_decided"))
            .when(F.col("direct_caption_prediction").isNotNull(), direct)
            .otherwise(first_argmax(scores)),
        )
        .withColumn("caption_source", F.when(F.col("_decided").isNotNull(), "structured").otherwise("direct_fallback"))
        .withColumn("caption_scores", one_hot_scores(F.size("structured_caption_scores"), F.col("caption_prediction")))
        .drop("_decided")
    )


def choice_correct() -> Column:
    """1 when the first best score is the answer; a row of zeros chooses 0."""
    return F.coalesce((F.coalesce(first_argmax(F.col("caption_scores")), F.lit(0)) == F.col("caption_answer_index")), F.lit(False)).cast("int")


def hybrid_summary(rows: DataFrame) -> DataFrame:
    """One row of rates for :func:`hybrid_rows`."""
    fell = F.col("caption_source") == "direct_fallback"
    right = F.coalesce(F.col("caption_prediction") == F.col("caption_answer_index"), F.lit(False))
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    fallback = F.coalesce(F.sum(fell.cast("bigint")), F.lit(0))
    # Rows without judged statements have nothing to reject and no such measures.
    stated = "support_items" in rows.columns
    judged = rows.withColumn("_cells", support_cells()) if stated else rows
    cells = {k: F.coalesce(F.sum(f"_cells.{k}"), F.lit(0)) for k in ("tp", "fp", "fn", "tn")}
    return judged.agg(
        F.coalesce(F.avg(choice_correct()), F.lit(0.0)).alias("caption_selection_accuracy"),
        F.count(F.lit(1)).alias("n_eval_records"),
        fallback.alias("caption_fallback_count"),
        (fallback / n).alias("caption_fallback_rate"),
        F.coalesce(F.sum((fell & F.col("direct_caption_prediction").isNull()).cast("bigint")), F.lit(0)).alias(
            "missing_direct_count"
        ),
        (F.coalesce(F.sum((fell & right).cast("bigint")), F.lit(0)) / F.greatest(F.lit(1), fallback)).alias(
            "caption_fallback_accuracy"
        ),
        (1.0 - fallback / n).alias("structured_decisive_rate"),
        *(rejection_columns(cells, "cf_reject_") if stated else []),
    )


def vote_rows(runs: DataFrame) -> DataFrame:
    """Majority vote over runs (column ``run``); a tie goes to the earliest run's vote; run 0 sets the windows.

    One shuffle by window: each window has at most one row per run.
    """
    rows = _need(runs, ["candidate_index_map"]).select(
        "window_id",
        "run",
        "caption_answer_index",
        "candidate_index_map",
        "caption_prediction",
        mapped(F.col("caption_prediction"), F.col("candidate_index_map")).alias("_vote"),
    )
    base = F.when(
        F.col("run") == 0, F.struct("caption_answer_index", "candidate_index_map", "caption_prediction")
    )
    gathered = rows.groupBy("window_id").agg(
        F.max(F.when(F.col("run") == 0, 1)).alias("_has_base"),
        F.first(base, ignorenulls=True).alias("_base"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_vote").isNotNull(), F.struct("run", "_vote")))), lambda s: s["_vote"]
        ).alias("vote_predictions"),
    ).filter(F.col("_has_base") == 1)
    votes, base_row = F.col("vote_predictions"), F.col("_base")
    tallied = F.transform(
        F.array_distinct(votes),
        lambda v, i: F.struct(
            F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("vote")
        ),
    )
    map_, answer, own = base_row["candidate_index_map"], base_row["caption_answer_index"], base_row["caption_prediction"]
    n = F.when(F.size(map_) > 0, F.array_max(map_) + 1).otherwise(
        F.greatest(F.coalesce(answer, F.lit(0)), F.coalesce(own, F.lit(0))) + 1
    )
    return gathered.select(
        "window_id",
        F.array_max(tallied)["vote"].alias("caption_prediction"),
        mapped(answer, map_).alias("caption_answer_index"),
        n.cast("int").alias("candidate_count"),
        "vote_predictions",
    ).withColumn("caption_scores", one_hot_scores(F.col("candidate_count"), F.col("caption_prediction")))


def _gate_sides(primary: DataFrame, alternate: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """Primary rows with what the gate needs of the alternate: prediction, margin, map state, scores."""
    alt = _need(alternate, ["candidate_index_map", "caption_scores"])
    facts = unique_rows(
        alt.select(
            "window_id",
            mapped(F.col("caption_prediction"), F.col("candidate_index_map"), strict=True).alias("_alt_prediction"),
            bad_map(F.col("caption_prediction"), F.col("candidate_index_map")).alias("_alt_bad"),
            top_margin(F.col("caption_scores")).alias("_alt_margin"),
            F.col("caption_scores").alias("_alt_scores"),
            F.lit(True).alias("_alt_present"),
        ),
        "window_id",
        on_duplicate,
    )
    own = _need(primary, ["candidate_index_map", "caption_scores"])
    return own.withColumn(
        "_own_prediction", mapped(F.col("caption_prediction"), F.col("candidate_index_map"))
    ).join(facts, "window_id", "left")


def _takes_alternate(margin: Column | float) -> Column:
    return F.coalesce(
        F.col("_alt_present") & ~F.col("_alt_bad") & F.col("_alt_prediction").isNotNull() & (F.col("_alt_margin") > margin),
        F.lit(False),
    )


def gate_rows(primary: DataFrame, alternate: DataFrame, min_margin: float, on_duplicate: str = "error") -> DataFrame:
    """The alternate's choice where its top-two margin is above ``min_margin``, else the primary's."""
    sides = _gate_sides(primary, alternate, on_duplicate).withColumn("_take", _takes_alternate(min_margin))
    kept = [c for c in primary.columns if c not in ("caption_prediction", "caption_scores")]
    return sides.select(
        *kept,
        F.when(F.col("_take"), F.col("_alt_prediction")).otherwise(F.col("_own_prediction")).alias("caption_prediction"),
        F.when(F.col("_take"), F.coalesce("_alt_scores", "caption_scores"))
        .otherwise(F.col("caption_scores"))
        .alias("caption_scores"),
        F.when(F.col("_take"), "alternate").otherwise("primary").alias("caption_gate_source"),
        F.col("_alt_margin").alias("caption_gate_alternate_margin"),
        F.coalesce("_alt_bad", F.lit(False)).alias("caption_gate_bad_alternate_map"),
    )


def _chosen_is_answer(prediction: Column) -> Column:
    """A missing choice counts as choice 0."""
    return (F.coalesce(prediction, F.lit(0)) == F.col("caption_answer_index")).cast("int")


def gated_summary(rows: DataFrame) -> DataFrame:
    took = (F.col("caption_gate_source") == "alternate").cast("bigint")
    return rows.agg(
        F.coalesce(F.avg(_chosen_is_answer(F.col("caption_prediction"))), F.lit(0.0)).alias("caption_selection_accuracy"),
        F.count(F.lit(1)).alias("n_eval_records"),
        F.coalesce(F.sum(took), F.lit(0)).alias("caption_gate_alternate_count"),
        (F.coalesce(F.sum(took), F.lit(0)) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("coverage"),
    )


def gate_sweep(primary: DataFrame, alternate: DataFrame, thresholds: list[float] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Accuracy, gain and coverage per threshold: one join and one aggregate for all of them."""
    sides = _gate_sides(primary, alternate)
    own = F.avg(_chosen_is_answer(F.col("caption_prediction")))
    points = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.coalesce(
                F.avg(
                    _chosen_is_answer(
                        F.when(_takes_alternate(t), F.col("_alt_prediction")).otherwise(F.col("_own_prediction"))
                    )
                ),
                F.lit(0.0),
            ).alias("caption_selection_accuracy"),
            F.coalesce(F.sum(_takes_alternate(t).cast("bigint")), F.lit(0)).alias("alternate_count"),
        )
        for t in thresholds
    ]
    one = sides.agg(F.array(*points).alias("p"), F.coalesce(own, F.lit(0.0)).alias("own"), F.count(F.lit(1)).alias("n"))
    return one.select("own", "n", F.inline("p")).select(
        "threshold",
        "caption_selection_accuracy",
        (F.col("caption_selection_accuracy") - F.col("own")).alias("delta_vs_primary"),
        "alternate_count",
        (F.col("alternate_count") / F.greatest(F.lit(1), F.col("n"))).alias("coverage"),
        F.col("n").alias("n_eval_records"),
    )


def choose_gate(sweep: DataFrame) -> DataFrame:
    """The sweep row with the best accuracy, then the fewest alternates, then the lowest threshold."""
    rank = F.struct("caption_selection_accuracy", -F.col("alternate_count"), -F.col("threshold"))
    best = sweep.agg(F.max_by(F.struct(*sweep.columns), rank).alias("b"))
    return best.select("b.*")


def dev_split(primary: DataFrame, alternate: DataFrame, modulus: int, remainders: list[int] = [0]) -> DataFrame:
    """Primary rows that have an alternate, with ``side`` = dev or eval by sha256 of the window id."""
    if modulus <= 1:
        raise ValueError("modulus must be greater than 1")
    side = F.when(sha_bucket(F.col("window_id"), modulus).isin(remainders), "dev").otherwise("eval")
    return primary.join(alternate.select("window_id"), "window_id", "left_semi").withColumn("side", side)


def calibrate_gate(
    primary: DataFrame,
    alternate: DataFrame,
    modulus: int,
    remainders: list[int] = [0],
    thresholds: list[float] = DEFAULT_THRESHOLDS,
) -> DataFrame:
    """Choose the margin on the dev side and measure it on the rest: one row with both.

    Every threshold is measured on both sides in one aggregate; the choice then picks among those few rows.
    """
    split = dev_split(primary, alternate, modulus, remainders)
    sides = _gate_sides(split, alternate)

    def measure(t: float, side: str) -> list[Column]:
        here = F.col("side") == side
        chosen = F.when(_takes_alternate(t), F.col("_alt_prediction")).otherwise(F.col("_own_prediction"))
        return [
            F.sum(F.when(here, _chosen_is_answer(chosen))).alias(f"{side}_right"),
            F.sum(F.when(here, _takes_alternate(t).cast("bigint"))).alias(f"{side}_taken"),
        ]

    points = [F.struct(F.lit(float(t)).alias("threshold"), *measure(t, "dev"), *measure(t, "eval")) for t in thresholds]
    one = sides.agg(
        F.array(*points).alias("p"),
        F.sum((F.col("side") == "dev").cast("bigint")).alias("n_dev"),
        F.sum((F.col("side") == "eval").cast("bigint")).alias("n_eval"),
    )
    checked = one.withColumn(
        "n_dev", F.when(F.coalesce("n_dev", F.lit(0)) == 0, F.raise_error(F.lit("dev split is empty"))).otherwise(F.col("n_dev"))
    ).withColumn(
        "n_eval",
        F.when(F.coalesce("n_eval", F.lit(0)) == 0, F.raise_error(F.lit("eval split is empty"))).otherwise(F.col("n_eval")),
    )
    best = F.array_max(
        F.transform(
            "p", lambda x: F.struct(x["dev_right"].alias("r"), -x["dev_taken"], -x["threshold"], x.alias("at"))
        )
    )["at"]
    return checked.withColumn("_b", best).select(
        F.col("_b.threshold").alias("best_threshold"),
        (F.col("_b.dev_right") / F.col("n_dev")).alias("dev_accuracy"),
        (F.col("_b.dev_taken") / F.col("n_dev")).alias("dev_coverage"),
        "n_dev",
        (F.col("_b.eval_right") / F.col("n_eval")).alias("eval_accuracy"),
        F.col("_b.eval_taken").alias("eval_alternate_count"),
        (F.col("_b.eval_taken") / F.col("n_eval")).alias("eval_coverage"),
        "n_eval",
    )


def hybrid_sweep(structured: DataFrame, direct: DataFrame, step: float = 0.05) -> DataFrame:
    """Accuracy and fallback rate per hybrid threshold, with the (threshold-free) rejection F1; one pass."""
    from kinesift.operators.metrics import f1_of, support_cells

    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    thresholds = [round(i * step, 10) for i in range(int(round(1.0 / step)) + 1)]
    other = unique_rows(
        _need(direct, ["candidate_index_map"]).select(
            "window_id",
            mapped(F.col("caption_prediction"), F.col("candidate_index_map")).alias("_direct"),
        ),
        "window_id",
    )
    ordered = F.sort_array("caption_scores", asc=False)
    best = first_argmax(F.col("caption_scores"))
    joined = structured.join(other, "window_id", "left").select(
        "caption_answer_index",
        F.size("caption_scores").alias("_n"),
        F.get(ordered, F.lit(0)).alias("_first"),
        F.get(ordered, F.lit(1)).alias("_second"),
        best.alias("_best"),
        F.coalesce("_direct", best).alias("_fallback"),
        support_cells().alias("_cells"),
    )

    def decided(t: float) -> Column:
        """Exactly one score reaches t: the best does and the second best does not."""
        alone = F.col("_second").isNull() | (F.col("_second") < t)
        return F.when((F.col("_first") >= t) & alone, F.col("_best"))

    def counted(choice: Column) -> Column:
        return _chosen_is_answer(F.when((choice >= 0) & (choice < F.col("_n")), choice))

    points = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.avg(counted(F.coalesce(decided(t), F.col("_fallback")))).alias("caption_selection_accuracy"),
            F.avg(decided(t).isNull().cast("int")).alias("caption_fallback_rate"),
        )
        for t in thresholds
    ]
    one = joined.agg(
        F.array(*points).alias("p"), *[F.sum(F.col("_cells")[c]).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )
    return one.select(F.inline("p"), f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("cf_reject_f1")).withColumn(
        "structured_decisive_rate", 1.0 - F.col("caption_fallback_rate")
    )


def choose_hybrid(sweep: DataFrame) -> DataFrame:
    """Best by accuracy, F1, closeness to .5, first; with the range of thresholds that reach the same accuracy."""
    rank = F.struct(
        "caption_selection_accuracy", "cf_reject_f1", -F.abs(F.col("threshold") - 0.5), -F.col("threshold")
    )
    points = F.collect_list(F.struct("threshold", "caption_selection_accuracy"))
    best = sweep.agg(F.max_by(F.struct(*sweep.columns), rank).alias("b"), points.alias("p"))
    level = F.transform(
        F.filter("p", lambda x: x["caption_selection_accuracy"] == F.col("b.caption_selection_accuracy")),
        lambda x: x["threshold"],
    )
    return best.select("b.*", F.array_min(level).alias("plateau_low"), F.array_max(level).alias("plateau_high"))
