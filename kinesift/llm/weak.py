"""Weak supervision: labelers vote or abstain, expectation-maximisation tells how far each can be trusted.

Votes are columns with 1 (for), -1 (against) or 0 (abstains). Only the counts of vote patterns enter the
fit: at most 3**labelers rows, whatever the size of the corpus. Every round is one aggregate over them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.session import durable

ROUNDS = 40
SETTLED = 1e-4
#: Chances of a vote "for" on positive and negative rows before any data are seen. A labeler knows one fault only, so
#: its vote against says much and its vote for little; this start also tells the two classes apart.
START = (0.999, 0.75)
#: Weight of the start against the data, as a share of all rows: it anchors the meaning of the classes.
ANCHOR = 0.05
#: Between these lie the chances of a vote "for" on positive rows. A rule is written so that good rows seldom break it;
#: without the lower bound the fit would rather explain two faults that often meet than separate good from bad.
YES = (0.995, 0.9995)
NO = (0.0005, 0.95)


@dataclass(frozen=True)
class LabelModel:
    """``prior``: share of the positive class. ``rates``: by labeler, the chance that a vote cast on a positive
    (on a negative) row is "for"."""

    prior: float
    rates: dict[str, tuple[float, float]]

    def log_odds(self) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (yes, no) in self.rates.items():
            out = out + (
                F.when(F.col(name) == 1, math.log(yes / no)).when(F.col(name) == -1, math.log((1 - yes) / (1 - no))).otherwise(0.0)
            )
        return out

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def pattern_counts(rows: DataFrame, labelers: list[str], *more: str) -> DataFrame:
    """The distinct vote patterns (and ``more`` columns) with their counts, in one small stored partition."""
    return durable(rows.groupBy(*labelers, *more).agg(F.count(F.lit(1)).alias("n")).coalesce(1))


def fit(
    patterns: DataFrame,
    labelers: list[str],
    first: tuple[float, float] | dict[str, tuple[float, float]] = START,
    yes_bounds: tuple[float, float] = YES,
    no_bounds: tuple[float, float] = NO,
    rounds: int = ROUNDS,
    anchor: float = ANCHOR,
) -> LabelModel:
    """Expectation-maximisation. An empty table gives the model it starts from.

    ``first`` holds the rates before any data are seen, of each labeler or the same for all; it enters each round with
    the weight of ``anchor`` times all rows, so labelers whose faults never occur together still describe one class. The
    bounds keep "for" from ever counting as evidence against.
    """
    begin = {name: first[name] if isinstance(first, dict) else first for name in labelers}
    start = LabelModel(0.5, begin)
    model = start
    for _ in range(rounds):
        p = F.col("n") * F.col("_p")
        q = F.col("n") * (1 - F.col("_p"))
        sums = [F.sum(p).alias("p"), F.sum(q).alias("q")]
        for i, name in enumerate(labelers):
            for side, weight in (("p", p), ("q", q)):
                sums.append(F.sum(F.when(F.col(name) == 1, weight).otherwise(0.0)).alias(f"{side}{i}_for"))
                sums.append(F.sum(F.when(F.col(name) != 0, weight).otherwise(0.0)).alias(f"{side}{i}_cast"))
        got = patterns.withColumn("_p", model.posterior()).agg(*sums).first()
        if got["p"] is None:
            return start
        rates = {}
        for i, name in enumerate(labelers):
            held = anchor * (got["p"] + got["q"])
            yes = (got[f"p{i}_for"] + held * begin[name][0]) / (got[f"p{i}_cast"] + held)
            no = (got[f"q{i}_for"] + held * begin[name][1]) / (got[f"q{i}_cast"] + held)
            rates[name] = (_within(yes, yes_bounds), _within(no, no_bounds))
        prior = min(max(got["p"] / (got["p"] + got["q"]), 0.02), 0.98)
        moved = max([abs(prior - model.prior), *(abs(a - b) for k in labelers for a, b in zip(rates[k], model.rates[k], strict=True))])
        model = LabelModel(prior, rates)
        if moved < SETTLED:
            break
    return model
