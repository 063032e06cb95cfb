"""Bags of words over text tables and of tokens over cards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.hashing import hex_number
from kinesift.functions.textfields import tokens


def hashed_bag(texts: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, bucket, weight): token counts in ``dim`` hash buckets at unit length; documents without tokens give no row.

    A document is one row, so its bag and norm are made inside the row: nothing is shuffled.
    """

    @F.pandas_udf("array<double>")
    def bag(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            counts = np.bincount(np.asarray(b if b is not None else [], dtype=np.int64), minlength=dim).astype(float)
            out.append(counts / max(np.sqrt((counts * counts).sum()), 1.0))
        return pd.Series(out)

    buckets = F.transform(tokens(F.col(text)), lambda w: (hex_number(F.md5(w), 8) % dim).cast("int"))
    bags = texts.select(key, F.posexplode(bag(buckets)).alias("bucket", "weight"))
    return bags.filter(F.col("weight") > 0).select(key, F.col("bucket").cast("bigint").alias("bucket"), "weight")


def card_tokens(mode: str = "rich") -> Column:
    """ARRAY of distinct tokens of a card row: words (rich) and trend steps (rich, trend)."""
    named = {
        "intensity": "intensity",
        "periodicity": "periodicity",
        "axis": "dominant_axis",
        "frequency": "dominant_frequency",
        "burstiness": "burstiness",
    }
    words = [F.concat(F.lit(f"{label}:"), F.col(f)) for label, f in named.items()] if mode == "rich" else []
    trend = (
        F.transform("trend_segments", lambda t: F.concat(F.lit("trend:"), t))
        if mode in ("rich", "trend")
        else F.array().cast("array<string>")
    )
    return F.array_distinct(F.concat(F.array(*words).cast("array<string>"), trend))
