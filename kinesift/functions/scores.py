"""Scores and decisions per record, as projections: no record leaves its task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinesift.functions.arrays import dot, first_argmax, once, one_hot, sum_squares, total
from kinesift.functions.captions import Card
from kinesift.functions.phrases import FIELDS, VOCABULARY

# ---- Fixed values: rule systems (fields, penalty) and the words that count as a contradiction ----
RULE_SYSTEMS = {
    "B1": (FIELDS, 0.5),
    "B2": (["trend"], 0.0),
    "B3": ([*FIELDS, "trend"], 0.25),
    "M1": ([*FIELDS, "trend"], 0.75),
}
RIVAL_WORDS = {
    "intensity": ["low", "medium", "high"],
    "periodicity": ["none", "weak", "strong", "non"],
    "dominant_axis": ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"],
    "dominant_frequency": ["low", "mid", "high"],
    "burstiness": ["smooth", "bursty"],
}
# ---- End of fixed values ----


def _any_word(lower: Column, words: list[str]) -> Column:
    found = F.contains(lower, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(lower, F.lit(w))
    return found


def rule_score(card: Card, lower: Column, system: str) -> Column:
    """Share of card values that occur in a (lower-case) text, less a penalty per contradicted field.

    Occurrence is by substring ("low" is in "slow"). At a penalty of .75 or more any contradiction
    holds the score at .35 or below.
    """
    fields, penalty = RULE_SYSTEMS.get(system, RULE_SYSTEMS["B1"])
    hits, against, parts = F.lit(0.0), F.lit(0), 0
    for f in FIELDS:
        if f not in fields:
            continue
        parts += 1
        stated = F.contains(lower, F.lower(card[f]))
        rival = ~stated & _any_word(lower, RIVAL_WORDS[f])
        hits = hits + F.when(stated, 1.0).when(rival, -penalty).otherwise(0.0)
        against = against + rival.cast("int")
    if "trend" in fields:
        parts += 1
        trend = card["trend_segments"]
        said = F.size(F.filter(trend, lambda t: F.contains(lower, F.lower(t))))
        hits = hits + F.least(F.lit(1.0), said / F.greatest(F.lit(1), F.size(trend)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), hits / parts))
    if penalty >= 0.75:
        return F.when(against > 0, F.least(score, F.lit(0.35))).otherwise(score)
    return score


def rule_answer(card: Card, fact: Column, system: str) -> Column:
    """What a rule system answers to a question about ``fact``; the trend-only one knows no card field."""
    known = F.when(fact == "task_understanding", "counterfactual")
    if system != "B2":
        for f in ("dominant_axis", "periodicity", "intensity"):
            known = known.when(fact == f, card[f])
    return known.otherwise("unknown")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the two vectors at unit length (norms under 1e-12 count as 1e-12)."""
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(F.sqrt(sum_squares(a)), floor) * F.greatest(F.sqrt(sum_squares(b)), floor))


def probability_score(
    claims: Column, probabilities: Column, vocabulary: dict[str, list[str]] = VOCABULARY
) -> Column:
    """Mean probability of the claimed values; claims outside the vocabulary or the map are skipped."""
    values = []
    for f, words in vocabulary.items():
        place = F.array_position(F.array(*[F.lit(w) for w in words]), claims[f]).cast("int")
        values.append(F.get(F.try_element_at(probabilities, F.lit(f)), place - 1))
    known = F.filter(F.array(*values), lambda p: p.isNotNull())
    return once(known, lambda k: total(k) / F.greatest(F.size(k), F.lit(1)))


def predicted_fields(probabilities: Column, vocabulary: dict[str, list[str]] = VOCABULARY) -> Column:
    """STRUCT of the most probable word per field (first on ties)."""
    return F.struct(
        *[
            F.get(
                F.array(*[F.lit(w) for w in words]), first_argmax(F.try_element_at(probabilities, F.lit(f)))
            ).alias(f)
            for f, words in vocabulary.items()
        ]
    )


def card_vector(evidence: Column) -> Column:
    """Numbers, confidence, one-hot words and trend counts of a card."""
    numbers = [
        F.coalesce(evidence["numeric"][n], F.lit(0.0))
        for n in ("rms_energy", "autocorr_peak", "fft_dominant_ratio", "dominant_frequency_hz", "peak_count")
    ]

    def trend_count(word: str) -> Column:
        return F.size(F.filter(evidence["trend_segments"], lambda t: t == word)).cast("double")

    return F.concat(
        F.array(*numbers, F.coalesce(evidence["confidence"], F.lit(1.0))),
        *[one_hot(evidence[f], VOCABULARY[f]) for f in FIELDS],
        F.array(*[trend_count(w) for w in ("rise", "fall", "stable")]),
    )


def statement_vector(evidence: Column, claims: Column, feature_mode: str = "oracle_fields") -> Column:
    """Evidence features, claim one-hots, then five each of missing, match and mismatch."""
    if feature_mode not in ("oracle_fields", "numeric_only"):
        raise ValueError(f"unknown feature_mode: {feature_mode}")
    numeric_only = feature_mode == "numeric_only"
    head = F.slice(card_vector(evidence), 1, 6) if numeric_only else card_vector(evidence)
    claimed = [claims[f].isNotNull() for f in FIELDS]
    same = [F.coalesce(claims[f] == evidence[f], F.lit(False)) for f in FIELDS]
    none = F.lit(False)
    match = [none for _ in FIELDS] if numeric_only else same
    clash = [none for _ in FIELDS] if numeric_only else [c & ~s for c, s in zip(claimed, same)]
    flags = [~c for c in claimed] + match + clash
    return F.concat(
        head, *[one_hot(claims[f], VOCABULARY[f]) for f in FIELDS], F.array(*[x.cast("double") for x in flags])
    )


def claim_matches(evidence: Column, claims: Column) -> tuple[Column, Column]:
    """How many claims equal the card and how many do not; a claim on a field that the card lacks does not."""
    same, other = F.lit(0), F.lit(0)
    for f in FIELDS:
        equal = F.coalesce(claims[f] == evidence[f], F.lit(False))
        same = same + equal.cast("int")
        other = other + (claims[f].isNotNull() & ~equal).cast("int")
    return same, other


def field_match(matches: Column, clashes: Column) -> Column:
    """Matches over claims; any mismatch holds it at .1 or below."""
    share = matches / F.greatest(matches + clashes, F.lit(1))
    return F.when(clashes > 0, F.least(share, F.lit(0.1))).otherwise(share)


def field_match_score(vector: Column) -> Column:
    """:func:`field_match` from the last ten places of a statement vector."""
    return field_match(total(F.slice(vector, -10, 5)), total(F.slice(vector, -5, 5)))
