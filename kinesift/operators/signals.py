"""Signal statistics per window. Every function is a projection: no window leaves its task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.functions.arrays import deviations, dot, first_argmax, mean, once, rms, std_pop, sum_squares

MIN_SAMPLES = 4

# Amplitudes this close (relative) count as equal, so the first bin wins whatever the summation order.
TIE = 1e-9

SPECTRUM = T.StructType(
    [
        T.StructField("hz", T.DoubleType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("autocorr", T.DoubleType()),
    ]
)


def _spectrum_block(block: np.ndarray, sample_rate: float) -> np.ndarray:
    """Dominant frequency, its share and the autocorrelation peak for equal-length centred signals."""
    rows, n = block.shape
    amplitude = np.abs(np.fft.rfft(block, axis=1))[:, 1:]
    out = np.zeros((rows, 3))
    if amplitude.shape[1]:
        whole = amplitude.sum(axis=1)
        peak = amplitude.max(axis=1, keepdims=True)
        first = np.argmax(amplitude >= peak * (1.0 - TIE), axis=1)
        live = whole > TIE
        out[:, 0] = np.where(live, (first + 1) * sample_rate / n, 0.0)
        out[:, 1] = np.where(live, amplitude[np.arange(rows), first] / (whole + 1e-8), 0.0)
    energy = (block * block).sum(axis=1)
    low = max(2, n // 20)
    high = min(max(low + 1, n // 2), n)
    if high > low:
        power = np.abs(np.fft.rfft(block, 2 * n, axis=1)) ** 2
        lagged = np.fft.irfft(power, axis=1)[:, low:high]
        out[:, 2] = np.where(energy > 1e-8, (lagged / (energy + 1e-8)[:, None]).max(axis=1), 0.0)
    return out


def spectrum(signal: Column, sample_rate: float) -> Column:
    """STRUCT<hz, ratio, autocorr> of a centred signal; Fourier work goes batch-wise through NumPy."""

    @F.pandas_udf(SPECTRUM)
    def batch(signals: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(signals), 3))
        lengths = signals.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n > 0:
                out[at] = _spectrum_block(np.stack([np.asarray(signals.iloc[i], dtype=float) for i in at]), sample_rate)
        return pd.DataFrame(out, columns=SPECTRUM.names)

    return batch(signal)


def channel_signals(sensor: Column, channels: int) -> Column:
    """[time][channel] -> [channel][time]."""

    def one(c: int) -> Column:
        return F.transform(sensor, lambda row: F.get(row, F.lit(c)))

    return F.array(*[one(c) for c in range(channels)])


def magnitude(sensor: Column) -> Column:
    return F.transform(sensor, lambda row: F.sqrt(sum_squares(row)))


def window_rms(sensor: Column) -> Column:
    """Root mean square over all values of a window."""
    squares = F.aggregate(sensor, F.lit(0.0), lambda acc, row: acc + sum_squares(row))
    values = F.aggregate(sensor, F.lit(0), lambda acc, row: acc + F.size(row))
    return F.sqrt(squares / values)


def peak_count(signal: Column, limit: Column) -> Column:
    """Inner points above both neighbours and above ``limit``."""
    inner = F.when(F.size(signal) >= 3, F.sequence(F.lit(1), F.size(signal) - 2)).otherwise(F.array().cast("array<int>"))

    def is_peak(i: Column) -> Column:
        here = F.get(signal, i)
        return (here > F.get(signal, i - 1)) & (here > F.get(signal, i + 1)) & (here > limit)

    return F.size(F.filter(inner, is_peak))


def trend_segments(signal: Column, spread: Column, parts: int = 3) -> Column:
    """rise / fall / stable for each of ``parts`` chunks; the first n % parts chunks are one longer."""
    n = F.size(signal)
    base = F.floor(n / F.lit(parts)).cast("int")
    extra = n % parts

    def words(bound: Column) -> Column:
        out = []
        for part in range(parts):
            start = base * part + F.least(F.lit(part), extra)
            length = base + F.when(extra > part, 1).otherwise(0)
            slope = F.get(signal, start + length - 1) - F.get(signal, start)
            out.append(
                F.when(length < 2, "stable").when(slope > bound, "rise").when(slope < -bound, "fall").otherwise("stable")
            )
        return F.array(*out)

    return once((spread + 1e-6) * 0.20, words)


def strongest_pair(centred: Column, channels: int) -> Column:
    """STRUCT<strength, order, r, i, j> of the channel pair with the largest |Pearson r|; NULL if there is none.

    Channels with (population) deviation up to 1e-8 take no part; the first pair wins a tie, and what differs by rounding only is one.
    """
    if channels < 2:
        return F.lit(None).cast("struct<strength:double,order:int,r:double,i:int,j:int>")

    def to_unit(s: Column) -> Column:
        return once(F.sqrt(sum_squares(s)), lambda n: F.when(n / F.sqrt(F.size(s)) > 1e-8, F.transform(s, lambda x: x / n)))

    def one(units: Column, i: int, j: int) -> Column:
        return once(
            dot(F.get(units, F.lit(i)), F.get(units, F.lit(j))),
            lambda r: F.struct(
                F.abs(r).alias("strength"),
                F.lit(-(i * channels + j)).alias("order"),
                r.alias("r"),
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
            ),
        )

    def pairs(units: Column) -> Column:
        return F.filter(F.array(*[one(units, i, j) for i in range(channels) for j in range(i + 1, channels)]), lambda p: p["r"].isNotNull())

    def first_of_strongest(known: Column) -> Column:
        least = F.array_max(F.transform(known, lambda p: p["strength"])) * (1.0 - TIE)
        return once(least, lambda low: F.get(F.filter(known, lambda p: p["strength"] >= low), F.lit(0)))

    known = once(F.transform(centred, to_unit), pairs)
    return once(known, lambda k: F.when(~F.exists(k, lambda p: F.isnan(p["r"])), first_of_strongest(k)))


def window_statistics(
    windows: DataFrame, *, channels: int, sample_rate: float = 50.0, sensor: str = "sensor", keep: list[str] | None = None
) -> DataFrame:
    """All per-window numbers that cards are cut from; the signals themselves are dropped."""
    kept = keep if keep is not None else [c for c in windows.columns if c != sensor]
    by_channel = windows.select(
        *kept, F.col(sensor).alias("_sensor"), channel_signals(F.col(sensor), channels).alias("_raw")
    )
    centred = by_channel.select(
        *kept,
        "_raw",
        magnitude(F.col("_sensor")).alias("_mag"),
        F.transform("_raw", rms).alias("axis_energy"),
        F.transform("_raw", deviations).alias("_centred"),
    )
    located = centred.select(
        *kept,
        "_raw",
        "_mag",
        "_centred",
        "axis_energy",
        F.sqrt(sum_squares(F.col("axis_energy")) / F.size("axis_energy")).alias("rms_energy"),
        first_argmax(F.col("axis_energy")).alias("top_channel"),
        first_argmax(F.transform("_centred", sum_squares)).alias("_spectral_channel"),
        (mean(F.col("_mag")) + 0.75 * std_pop(F.col("_mag"))).alias("_peak_limit"),
    )
    chosen = located.select(
        *kept,
        "axis_energy",
        "rms_energy",
        "top_channel",
        F.get(F.col("_raw"), F.col("top_channel")).alias("_top"),
        peak_count(F.col("_mag"), F.col("_peak_limit")).cast("double").alias("peak_count"),
        F.get(F.col("_centred"), F.col("_spectral_channel")).alias("_signal"),
        F.sort_array("axis_energy", asc=False).alias("_energies"),
        strongest_pair(F.col("_centred"), channels).alias("pair"),
    )
    measured = chosen.select("*", spectrum(F.col("_signal"), sample_rate).alias("_spectrum"))
    return measured.select(
        *kept,
        "axis_energy",
        "rms_energy",
        "top_channel",
        (
            F.get(F.col("_energies"), F.lit(1)) >= F.get(F.col("_energies"), F.lit(0)) * 0.9
            if channels > 1
            else F.lit(False)
        ).alias("axis_contested"),
        F.col("_spectrum.autocorr").alias("autocorr_peak"),
        F.col("_spectrum.ratio").alias("fft_dominant_ratio"),
        F.col("_spectrum.hz").alias("dominant_frequency_hz"),
        "peak_count",
        trend_segments(F.col("_top"), std_pop(F.col("_top"))).alias("trend_segments"),
        "pair",
    )


def split_valid_windows(windows: DataFrame, channels: int, sensor: str = "sensor") -> tuple[DataFrame, DataFrame]:
    """(usable windows, rejected windows with ``reason``): two-dimensional, 4 samples or more, right channel count."""
    rows = F.size(sensor)
    ragged = F.exists(sensor, lambda r: r.isNull() | (F.size(r) != channels))
    reason = (
        F.when(F.col(sensor).isNull(), "missing sensor")
        .when(rows < MIN_SAMPLES, "too short")
        .when(ragged, "channel count")
    )
    checked = windows.withColumn("reason", reason)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def require_valid_windows(windows: DataFrame, channels: int, sensor: str = "sensor") -> DataFrame:
    """The same windows, but the job fails on the first unusable one."""
    bad = (
        F.col(sensor).isNull()
        | (F.size(sensor) < MIN_SAMPLES)
        | F.exists(sensor, lambda r: r.isNull() | (F.size(r) != channels))
    )
    return windows.withColumn(sensor, F.when(bad, F.raise_error(F.lit("unusable sensor window"))).otherwise(F.col(sensor)))


def window_features(windows: DataFrame, *, channels: int, sensor: str = "sensor") -> DataFrame:
    """Adds ``features``: per channel mean, std, min, max, rms, then mean, std and range of the magnitude."""
    prepared = windows.select(
        "*", channel_signals(F.col(sensor), channels).alias("_raw"), magnitude(F.col(sensor)).alias("_mag")
    )
    vector = F.concat(
        F.transform("_raw", mean),
        F.transform("_raw", std_pop),
        F.transform("_raw", F.array_min),
        F.transform("_raw", F.array_max),
        F.transform("_raw", rms),
        F.array(mean(F.col("_mag")), std_pop(F.col("_mag")), F.array_max("_mag") - F.array_min("_mag")),
    )
    return prepared.withColumn("features", vector).drop("_raw", "_mag")
