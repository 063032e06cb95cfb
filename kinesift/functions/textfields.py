"""Field values read out of captions, evidence texts and model answers.

Functions that look for phrases take text that is already lower case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.functions.phrases import (
    AXIS_WORDS,
    CLAIM_PHRASES,
    FIELDS,
    NUMERIC_PATTERNS,
    STATEMENT_PHRASES,
    VOCABULARY,
    axis_allowed,
    axis_mentions,
    worded,
)

FIELD_STRUCT = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
#: Texts a task remembers; one batch may hold more.
KEPT_TEXTS = 1 << 15


def _mentions(texts: pa.Array, phrases: list[tuple[str, str]]) -> pa.Array:
    """Value of the first listed phrase that occurs in a text; null when none does."""
    place = np.full(len(texts), len(phrases))
    for i in reversed(range(len(phrases))):
        place[pc.fill_null(pc.match_substring(texts, phrases[i][0]), False).to_numpy(zero_copy_only=False)] = i
    return pa.array([*[v for _, v in phrases], None], pa.string()).take(pa.array(place))


def _named_values(texts: pa.Array, lead: str, vocabulary: list[str]) -> pa.Array:
    words = pc.struct_field(pc.extract_regex(texts, lead + r"[ \t\n\x0b\f\r]+(?P<word>[a-z0-9_]+)"), "word")
    return pc.if_else(pc.is_in(words, value_set=pa.array(vocabulary, words.type)), words, pa.scalar(None, words.type))


def _caption_fields(texts: pa.Array) -> dict[str, pa.Array]:
    values = {f: _mentions(texts, phrases) for f, phrases in CLAIM_PHRASES.items()}
    named = [(p, a) for p, a in axis_mentions() if a != "uncertain"]
    values["dominant_axis"] = _mentions(texts, [("without a single clearly dominant channel", "uncertain"), *named])
    return values


def _statement_fields(texts: pa.Array) -> dict[str, pa.Array]:
    values = {f: _mentions(texts, phrases) for f, phrases in STATEMENT_PHRASES.items()}
    values["dominant_axis"] = pc.coalesce(
        _named_values(texts, "strongest activity on", VOCABULARY["dominant_axis"]),
        _named_values(texts, "dominant movement axis is", VOCABULARY["dominant_axis"]),
        _mentions(texts, [*axis_mentions(), ("strongest activity on uncertain", "uncertain")]),
    )
    values["dominant_frequency"] = pc.coalesce(
        _named_values(texts, "dominant frequency is", VOCABULARY["dominant_frequency"]), values["dominant_frequency"]
    )
    return values


def _read_batches(lower: Column, each: bool, fields: Callable[[pa.Array], dict[str, pa.Array]]) -> Column:
    """``fields`` of a text, or of every text of an array, as a STRUCT.

    A batch is searched phrase by phrase. Texts come again and again: a task keeps the ``KEPT_TEXTS`` it met last with their
    fields, and searches only texts that are new to it.
    """
    kept: list[pa.Array] = []

    def read(texts: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(texts.cast(pa.string()), null_encoding="encode")
        here = coded.dictionary
        known = pc.index_in(here, value_set=kept[0]) if kept else pa.nulls(len(here), pa.int32())
        new = here.filter(pc.is_null(known))
        if len(new):
            values = fields(new)
            found = pa.StructArray.from_arrays([values[f].cast(pa.string()) for f in FIELDS], names=FIELDS)
            if kept and len(kept[0]) + len(new) <= KEPT_TEXTS:
                kept[:] = [pa.concat_arrays([kept[0], new]), pa.concat_arrays([kept[1], found])]
            elif kept and len(new) < len(here):
                old = pc.drop_null(known)
                kept[:] = [pa.concat_arrays([kept[0].take(old), new]), pa.concat_arrays([kept[1].take(old), found])]
            else:
                kept[:] = [new, found]
            known = pc.index_in(here, value_set=kept[0])
        return kept[1].take(known.take(coded.indices)) if kept else pa.array([], pa.struct([(f, pa.string()) for f in FIELDS]))

    def read_each(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.ListArray.from_arrays(offsets, read(lists.flatten()), mask=lists.is_null())

    if each:
        return F.arrow_udf(read_each, T.ArrayType(FIELD_STRUCT))(lower)
    return F.arrow_udf(read, FIELD_STRUCT)(lower)


def first_mention(lower: Column, phrases: list[tuple[str, str]]) -> Column:
    """Value of the first listed phrase that occurs; NULL when none does."""

    def read(texts: pa.Array) -> pa.Array:
        return _mentions(texts, phrases)

    return F.arrow_udf(read, T.StringType())(lower)


def caption_claims(lower: Column, each: bool = False) -> Column:
    """STRUCT of the five fields a caption claims (NULL: not claimed); with ``each``, of every caption of an array."""
    return _read_batches(lower, each, _caption_fields)


def statement_claims(lower: Column, each: bool = False) -> Column:
    """Like :func:`caption_claims` with the wider phrase list and three spelled-out forms that override it."""
    return _read_batches(lower, each, _statement_fields)


def claim_count(claims: Column) -> Column:
    total = F.lit(0)
    for f in FIELDS:
        total = total + claims[f].isNotNull().cast("int")
    return total


def supports(claims: Column, fields: Column) -> Column:
    """At least one claim, and every claim equals the evidence; a field the evidence lacks is a mismatch."""
    agreed = claim_count(claims) > 0
    for f in FIELDS:
        agreed = agreed & (claims[f].isNull() | F.coalesce(claims[f] == fields[f], F.lit(False)))
    return agreed


def text_numerics(text: Column) -> Column:
    """STRUCT of the five numbers written in an evidence text (NULL: not there)."""

    def number(pattern: str) -> Column:
        return F.regexp_extract(text, "(?i)" + pattern, 1).try_cast("double")

    return F.struct(*[number(p).alias(k) for k, p in NUMERIC_PATTERNS.items()])


@dataclass(frozen=True)
class NumericBounds:
    """Midpoints between class means; fills fields that the text does not name. None: not known."""

    intensity: tuple[float, float] | None = None
    periodicity: tuple[float, float] | None = None
    dominant_frequency: tuple[float, float] | None = None
    burstiness: float | None = None

    def infer(self, numerics: Column) -> dict[str, Column]:
        def three(bounds, value: Column, words: list[str]) -> Column:
            if bounds is None:
                return F.lit(None).cast("string")
            return F.when(value < bounds[0], words[0]).when(value < bounds[1], words[1]).when(value.isNotNull(), words[2])

        burst = F.lit(None).cast("string")
        if self.burstiness is not None:
            count = numerics["peak_count"]
            burst = F.when(count >= self.burstiness, "bursty").when(count.isNotNull(), "smooth")
        return {
            "intensity": three(self.intensity, numerics["rms_energy"], ["low", "medium", "high"]),
            "periodicity": three(self.periodicity, numerics["autocorr_peak"], ["none", "weak", "strong"]),
            "dominant_frequency": three(
                self.dominant_frequency, numerics["dominant_frequency_hz"], ["low", "mid", "high"]
            ),
            "burstiness": burst,
        }


_MEASURED = {
    "intensity": ("rms_energy", ["low", "medium", "high"]),
    "periodicity": ("autocorr_peak", ["none", "weak", "strong"]),
    "dominant_frequency": ("dominant_frequency_hz", ["low", "mid", "high"]),
    "burstiness": ("peak_count", ["smooth", "bursty"]),
}


def numeric_bounds_table(fit_on: DataFrame) -> DataFrame:
    """One row: the class means of ``fit_on``, one conditional average per (field, word)."""
    card = F.col("evidence")
    means = [
        F.avg(F.when(card[f] == w, F.coalesce(card["numeric"][m], F.lit(0.0)))).alias(f"{f}_{w}")
        for f, (m, words) in _MEASURED.items()
        for w in words
    ]
    return fit_on.agg(*means)


def fit_numeric_bounds(fit_on: DataFrame) -> NumericBounds:
    """Bounds from benchmark rows; the caller names the rows to fit on."""
    row = numeric_bounds_table(fit_on).first().asDict()
    found: dict[str, object] = {}
    for f, (_, words) in _MEASURED.items():
        means = [row[f"{f}_{w}"] for w in words]
        if any(m is None for m in means):
            continue
        middles = [(a + b) / 2.0 for a, b in zip(means, means[1:])]
        found[f] = middles[0] if len(middles) == 1 else tuple(middles)
    return NumericBounds(**found)


def evidence_fields(text: Column, bounds: NumericBounds | None = None) -> Column:
    """STRUCT of the five fields that an evidence text states.

    Hints are looked for in the whole text, in a fixed order, so one measure's hint can decide another
    field; the published figures contain that effect and it is kept.
    """
    lower = F.lower(text)

    def has(phrase: str) -> Column:
        return F.contains(lower, F.lit(phrase))

    stated = {
        "intensity": F.when(has("lower reference band"), "low")
        .when(has("middle reference band"), "medium")
        .when(has("upper reference band") & has("rms energy"), "high"),
        "periodicity": F.when(has("below the repeatability reference"), "none")
        .when(has("near the repeatability reference"), "weak")
        .when(has("above the repeatability reference"), "strong"),
        "dominant_axis": F.when(
            has("without a clear leader") | has("no single channel clearly dominates"), "uncertain"
        ).otherwise(first_mention(lower, axis_mentions())),
        "dominant_frequency": F.when(
            has("dominant spectral peak"),
            F.when(has("without a stable reference crossing"), "uncertain")
            .when(has("above the upper reference band"), "high")
            .when(has("middle reference band"), "mid")
            .when(has("lower reference band"), "low"),
        ),
        "burstiness": F.when(has("spiky") | has("short spikes"), "bursty").when(has("even profile"), "smooth"),
    }
    if bounds is not None:
        for f, guess in bounds.infer(text_numerics(text)).items():
            stated[f] = F.coalesce(stated[f], guess)
    return F.struct(*[stated[f].alias(f) for f in FIELDS])


def fields_complete(fields: Column) -> Column:
    done = F.lit(True)
    for f in FIELDS:
        done = done & fields[f].isNotNull()
    return done


def _json_span(text: Column, opening: str, closing: str) -> Column:
    span = F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0)
    return F.when(span != "", span)


def model_fields(response: Column, dataset_id: Column) -> Column:
    """STRUCT of the fields in a model's JSON answer: normalised, in vocabulary, axis allowed for the dataset."""
    parsed = F.from_json(_json_span(response, "{", "}"), T.MapType(T.StringType(), T.StringType()))
    phrases = {p: a for p, a in axis_mentions()}
    out = {}
    for f in FIELDS:
        raw = F.lower(F.trim(parsed[f]))
        value = F.translate(raw, "- ", "__")
        if f == "dominant_axis":
            spoken = worded(F.replace(raw, F.lit("_"), F.lit(" ")), phrases)
            out[f] = F.when(axis_allowed(dataset_id, value), value).when(axis_allowed(dataset_id, spoken), spoken)
        else:
            out[f] = F.when(value.isin(VOCABULARY[f]), value)
    return F.struct(*[out[f].alias(f) for f in FIELDS])


# Keys of answers and words for yes and no.
ANSWER_KEYS = ("answer_index", "caption_index", "choice_index", "index")
SUPPORT_KEYS = ("supported", "labels", "answers", "is_supported")
YES_WORDS = ("true", "yes", "supported", "support", "1")
NO_WORDS = ("false", "no", "unsupported", "reject", "rejected", "0")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _whole(span: Column, key: str) -> Column:
    """A JSON member as a whole number: numbers are cut, texts must be whole numbers, the rest is NULL."""
    member = F.try_variant_get(span, f"$.{key}", "variant")
    text = F.regexp_replace(F.try_variant_get(span, f"$.{key}", "string"), r"^\s+|\s+$", "")
    number = F.when(text == "true", 1).when(text == "false", 0).otherwise(text.try_cast("double").try_cast("int"))
    return F.when(_is_text(member), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))).otherwise(number)


def choice_index(response: Column, candidate_count: Column) -> Column:
    """0-based choice in a free answer: a JSON key, else the first lone letter, else the first number.

    The letter is looked for in the upper-cased text, so the article "a" reads as choice 0; that is kept.
    """

    def in_range(value: Column) -> Column:
        return F.when((value >= 0) & (value < candidate_count), value)

    span = F.try_parse_json(_json_span(response, "{", "}"))
    keyed = [in_range(_whole(span, k)) for k in ANSWER_KEYS]
    letter = F.regexp_extract(F.upper(response), r"(?<![\p{L}\p{N}_])([A-Z])(?![\p{L}\p{N}_])", 1)
    lettered = F.when(letter != "", F.ascii(letter) - 65)
    number = F.regexp_extract(response, r"(?<![\p{L}\p{N}_])(\d+)(?![\p{L}\p{N}_])", 1).try_cast("int")
    return F.coalesce(*keyed, in_range(lettered), in_range(number))


def _yes_no(word: Column) -> Column:
    lower = F.lower(F.regexp_replace(word, r"^\s+|\s+$", ""))
    return F.when(lower.isin(*YES_WORDS), True).when(lower.isin(*NO_WORDS), False)


def _yes_no_value(value: Column) -> Column:
    """A JSON value as yes or no; any number but zero is a yes, text is a word."""
    text = F.try_variant_get(value, "$", "string")
    number = F.when(~_is_text(value), text.try_cast("double"))
    return F.coalesce(_yes_no(text), F.when(number.isNotNull(), number != 0))


def support_labels(response: Column, statement_count: Column) -> Column:
    """ARRAY<BOOLEAN> of support labels, or NULL unless every statement has one.

    A JSON list (under one of four keys, or bare) comes first, then ``S<i>: yes/no`` lines.
    """
    span = F.try_parse_json(_json_span(response, "{", "}"))
    listed = [F.try_variant_get(span, f"$.{k}", "array<variant>") for k in SUPPORT_KEYS]
    bare = F.when(span.isNull(), F.try_variant_get(F.try_parse_json(_json_span(response, "[", "]")), "$", "array<variant>"))
    values = F.transform(F.slice(F.coalesce(*listed, bare), 1, F.greatest(statement_count, F.lit(0))), _yes_no_value)
    whole = (F.size(values) == statement_count) & ~F.exists(values, lambda v: v.isNull())

    pattern = r"(?i)\bS?(\d+)\s*[:=-]\s*(supported|unsupported|true|false|yes|no|reject(?:ed)?)\b"
    positions = F.transform(F.regexp_extract_all(response, F.lit(pattern), F.lit(1)), lambda d: d.try_cast("int"))
    words = F.transform(F.regexp_extract_all(response, F.lit(pattern), F.lit(2)), _yes_no)
    said = F.arrays_zip(positions.alias("i"), words.alias("v"))

    def last_said(i: Column) -> Column:
        own = F.filter(said, lambda s: (s["i"] == i) & s["v"].isNotNull())
        return F.when(F.size(own) > 0, F.element_at(own, -1)["v"])

    wanted = F.when(statement_count > 0, F.sequence(F.lit(0), statement_count - 1)).otherwise(F.array().cast("array<int>"))
    lines = F.transform(wanted, last_said)
    return F.when(F.coalesce(whole, F.lit(False)), values).when(~F.exists(lines, lambda v: v.isNull()), lines)


TOKEN = r"[a-zA-Z0-9_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def token_set(lower: Column) -> Column:
    """Different word tokens of a lower-case text."""
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TOKEN})"), F.lit(1)))


def mask_numbers(text: Column) -> Column:
    """Numbers that stand alone become ``<num>``."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_.])-?\p{Nd}+(?:\.\p{Nd}+)?(?![\p{L}\p{N}_.])", "<num>")


def mask_all_numbers(text: Column) -> Column:
    """The stress variant: also takes a leading sign and numbers next to dots; only letters guard."""
    return F.regexp_replace(text, r"(?<![A-Za-z])[-+]?\p{Nd}+(?:\.\p{Nd}+)?", "<num>")
