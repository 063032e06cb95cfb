"""Leakage and balance checks on benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.phrases import SHORTCUT_PHRASES


def _position() -> Column:
    flags = F.transform(F.col("caption_selection")["candidates"], lambda c: F.coalesce(c["supported"], F.lit(False)))
    place = F.array_position(flags, True).cast("int") - 1
    return F.when(place >= 0, F.array(place.cast("string"))).otherwise(F.array().cast("array<string>"))


def _all_text() -> Column:
    return F.lower(
        F.concat_ws(
            "\n",
            F.col("positive")["text"],
            F.transform("counterfactuals", lambda c: c["text"]),
            F.transform(F.col("caption_selection")["candidates"], lambda c: c["text"]),
            F.col("evidence_text"),
        )
    )


def _phrases(phrases: list[str]) -> Column:
    # Bound once: the texts are put together for the row, not for each phrase.
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(p.lower()).alias("low")) for p in phrases])
    found = F.transform(F.array(_all_text()), lambda t: F.filter(listed, lambda x: F.contains(t, x["low"])))
    return F.transform(F.flatten(found), lambda x: x["p"])


def _facts() -> Column:
    def facts(c: Column) -> Column:
        single = F.when(F.length(c["changed_fact"]) > 0, F.array(c["changed_fact"]))
        return F.coalesce(F.when(F.size(c["changed_facts"]) > 0, c["changed_facts"]).otherwise(single), F.array().cast("array<string>"))

    named = F.flatten(F.transform("counterfactuals", facts))
    return F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda f: f.isNotNull())


def _counted(rows: DataFrame, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """(by, check, item, n): how often every item of every check occurs, from one pass over the rows.

    Each row lists its (check, item) pairs; they are counted by the task that reads the row before anything moves.
    """
    def pair(name: str):
        return lambda i: F.struct(F.lit(name).alias("check"), i.alias("item"))

    pairs = [F.transform(items, pair(name)) for name, items in checks.items()]
    listed = rows.select(*by, F.explode_outer(F.concat(*pairs)).alias("_x")).filter(F.col("_x").isNotNull())
    return listed.groupBy(*by, F.col("_x.check").alias("check"), F.col("_x.item").alias("item")).agg(F.count(F.lit(1)).alias("n"))


def answer_positions(records: DataFrame, by: list[str] = []) -> DataFrame:
    """How often each position holds the (first) supported candidate."""
    return _counted(records, by, {"position": _position()}).select(*by, F.col("item").cast("int").alias("position"), "n")


def shortcut_hits(records: DataFrame, phrases: list[str] = SHORTCUT_PHRASES, by: list[str] = []) -> DataFrame:
    """Records that contain each phrase in any of their texts, 0 where none does."""
    found = records.select(*by, _phrases(phrases).alias("_p"))
    hits = [
        F.struct(F.lit(p).alias("phrase"), F.coalesce(F.sum(F.array_contains("_p", p).cast("bigint")), F.lit(0)).alias("records"))
        for p in phrases
    ]
    return found.groupBy(*by).agg(F.array(*hits).alias("_h")).select(*by, F.inline("_h"))


def changed_fact_counts(records: DataFrame, by: list[str] = []) -> DataFrame:
    return _counted(records, by, {"fact": _facts()}).select(*by, F.col("item").alias("fact"), "n")


def subject_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Subjects on both sides of a split."""
    def subjects(df: DataFrame) -> DataFrame:
        return df.select(F.col("subject_id").cast("string").alias("subject_id")).filter(F.col("subject_id").isNotNull())

    return subjects(train).intersect(subjects(test))


def audit_report(records: DataFrame, windows: DataFrame, phrases: list[str] = SHORTCUT_PHRASES) -> DataFrame:
    """(dataset_id, check, item, n) rows: sizes, positions, shortcut phrases, changed facts, subjects in both splits.

    One pass over either table: all checks of a row are counted together. Phrases that no record has are listed with 0.
    """
    key = ["dataset_id"]
    none = F.array().cast("array<string>")
    checks = {
        "records": F.array(F.lit("all")),
        "answer_position": _position(),
        "shortcut_phrase": _phrases(phrases),
        "changed_fact": _facts(),
    }
    subject = F.col("subject_id").cast("string")
    sides = {
        "windows": F.when(F.col("split").isNotNull(), F.array(F.col("split").cast("string"))).otherwise(F.array(F.lit(None).cast("string"))),
        **{
            f"_{side}": F.when(subject.isNotNull() & (F.col("split") == side), F.array(subject)).otherwise(none)
            for side in ("train", "test")
        },
    }
    counted = _counted(records, key, checks)
    seen = _counted(windows, key, sides)
    # Subjects meet by name, datasets by their own name; every dataset gets a row for each phrase and for the overlap.
    named = seen.withColumn("_side", F.when(F.col("check").startswith("_"), F.col("check")))
    met = named.groupBy("dataset_id", F.when(F.col("_side").isNull(), F.col("check")).otherwise("subject_overlap").alias("check"), "item").agg(
        F.sum("n").alias("n"), F.count_distinct("_side").alias("_sides")
    )
    overlap = F.col("check") == "subject_overlap"
    flat = met.select(
        "dataset_id",
        "check",
        F.when(overlap, "subjects").otherwise(F.col("item")).alias("item"),
        F.when(overlap, (F.col("_sides") == 2).cast("bigint")).otherwise(F.col("n")).alias("n"),
    )
    zeros = F.array(*[F.struct(F.lit("shortcut_phrase").alias("check"), F.lit(p).alias("item"), F.lit(0).cast("bigint").alias("n")) for p in phrases])
    padded = counted.filter("check = 'records'").select("dataset_id", F.inline(zeros))
    every = counted.unionByName(flat).unionByName(padded)
    return every.groupBy("dataset_id", "check", "item").agg(F.sum("n").cast("bigint").alias("n"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that two runs do not share, with the side they are on; empty when altering the input had no effect.

    Both runs are read once: copies on the one side less copies on the other.
    """
    names = before.columns
    both = before.withColumn("_sign", F.lit(1)).union(after.withColumn("_sign", F.lit(-1)))
    left = both.groupBy(*names).agg(F.sum("_sign").alias("_left")).filter("_left <> 0")
    copies = F.array_repeat(F.when(F.col("_left") > 0, "before").otherwise("after"), F.abs("_left").cast("int"))
    return left.select(*names, F.explode(copies).alias("side"))
