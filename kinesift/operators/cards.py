"""Evidence cards: window statistics cut into words against train-set bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesift.operators.scan import exact_quantiles
from kinesift.operators.signals import window_statistics
from kinesift.session import durable

BOUNDED = {"rms_energy": "rms_energy", "peak_count": "peak_count", "dominant_frequency": "dominant_frequency_hz"}
NO_RELATION = "no clear relation"


@dataclass(frozen=True)
class CardBounds:
    """Low and high bound per measure: six numbers, used as literals in the plan."""

    bounds: dict[str, tuple[float, float]]
    sample_rate: float = 50.0

    def bucket(self, name: str, value: Column, words: tuple[str, str, str]) -> Column:
        """First word at or below the low bound, third at or above the high one; low is tested first."""
        low, high = self.bounds[name]
        return F.when(value <= low, words[0]).when(value >= high, words[2]).otherwise(words[1])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, float(lo), float(hi), float(self.sample_rate)) for k, (lo, hi) in self.bounds.items()]
        return spark.createDataFrame(rows, "measure string, low double, high double, sample_rate double")

    @staticmethod
    def from_table(table: DataFrame) -> "CardBounds":
        rows = table.collect()
        if {r["measure"] for r in rows} != set(BOUNDED) or len(rows) != len(BOUNDED):
            raise ValueError("a table of card bounds has one row per bounded measure")
        return CardBounds({r["measure"]: (r["low"], r["high"]) for r in rows}, rows[0]["sample_rate"])


def fit_card_bounds(
    statistics: DataFrame, *, sample_rate: float = 50.0, low_quantile: float = 0.33, high_quantile: float = 0.67
) -> CardBounds:
    """Exact quantiles of energy, peak count and dominant frequency over ``statistics`` (train rows)."""
    found = exact_quantiles(statistics, list(BOUNDED.values()), [low_quantile, high_quantile])
    return CardBounds({name: tuple(found[column]) for name, column in BOUNDED.items()}, sample_rate)


def dominant_axis(names: list[str]) -> Column:
    labels = F.array(*[F.lit(n) for n in names])
    return F.when(F.col("axis_contested"), "uncertain").otherwise(F.get(labels, F.col("top_channel")))


def periodicity() -> Column:
    score = F.greatest("autocorr_peak", "fft_dominant_ratio")
    return F.when(score >= 0.55, "strong").when(score >= 0.25, "weak").otherwise("none")


def relation(names: list[str]) -> Column:
    labels = F.array(*[F.lit(n) for n in names])
    pair = F.col("pair")
    text = F.concat_ws(
        " ",
        F.get(labels, pair["i"]),
        F.lit("and"),
        F.get(labels, pair["j"]),
        F.when(pair["r"] > 0, "move synchronously").otherwise("move oppositely"),
    )
    return F.when(pair["strength"] >= 0.45, text).otherwise(NO_RELATION)


def cards_from_statistics(statistics: DataFrame, bounds: CardBounds, names: list[str]) -> DataFrame:
    """One evidence card per row of window statistics; a projection."""
    worded = statistics.select(
        "*",
        bounds.bucket("rms_energy", F.col("rms_energy"), ("low", "medium", "high")).alias("intensity"),
        periodicity().alias("periodicity"),
        dominant_axis(names).alias("dominant_axis"),
        relation(names).alias("cross_channel_relation"),
        F.when(F.col("peak_count") > bounds.bounds["peak_count"][1], "bursty").otherwise("smooth").alias("burstiness"),
    )
    timed = worded.withColumn(
        "dominant_frequency",
        F.when((F.col("dominant_frequency_hz") <= 1e-8) | (F.col("periodicity") == "none"), "uncertain").otherwise(
            bounds.bucket("dominant_frequency", F.col("dominant_frequency_hz"), ("low", "mid", "high"))
        ),
    )
    unsure = (
        (F.col("dominant_axis") == "uncertain").cast("int")
        + (F.col("periodicity") == "none").cast("int")
        + (F.col("dominant_frequency") == "uncertain").cast("int")
        + (F.col("cross_channel_relation") == NO_RELATION).cast("int")
    )
    identity = [c for c in ("window_id", "dataset_id", "split", "label", "subject_id") if c in statistics.columns]
    return timed.select(
        *identity,
        "intensity",
        "periodicity",
        "dominant_axis",
        "dominant_frequency",
        "cross_channel_relation",
        F.lit("no clear lag").alias("lead_lag"),
        "burstiness",
        "trend_segments",
        F.greatest(F.lit(0.1), 1.0 - 0.15 * unsure).alias("confidence"),
        F.struct("rms_energy", "autocorr_peak", "fft_dominant_ratio", "dominant_frequency_hz", "peak_count").alias(
            "numeric"
        ),
    )


def evidence_cards(
    windows: DataFrame, *, names: list[str], sample_rate: float = 50.0, fit_split: str | None = "train"
) -> DataFrame:
    """Fit bounds on the train windows and card every window.

    The statistics (a few numbers per window) are written once, so the signals are read only once for
    fitting and carding.
    """
    statistics = durable(window_statistics(windows, channels=len(names), sample_rate=sample_rate))
    train = statistics.filter(F.col("split") == fit_split) if fit_split else statistics
    return cards_from_statistics(statistics, fit_card_bounds(train, sample_rate=sample_rate), names)
