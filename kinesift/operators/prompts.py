"""Prompt tables for an external batch model. Inference happens outside; see ``evaluate.apply_model``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.functions.phrases import AXIS_WORDS, axis_options
from kinesift.operators.benchmark import shown_evidence, support_items

# ---- Fixed values: instructions by prompt style --------------------------------------------------
CAPTION_STYLES = {
    "strict_json": 'Return JSON only: {"answer_index": <zero-based index of the best supported caption>}.',
    "terse": 'Only output JSON: {"answer_index": <0-based index>}.',
    "chain_then_json": (
        "First briefly identify the evidence fields that rule out wrong options. "
        'Then return a final JSON object on the last line: {"answer_index": <zero-based index>}.'
    ),
    "contrastive_elim_json": (
        "Eliminate captions that conflict with any evidence dimension: intensity, rhythm, channel, cadence, "
        "burstiness, trend, or cross-channel relation. Then choose the remaining caption best entailed by the evidence. "
        'Return only JSON: {"answer_index": <zero-based index>}.'
    ),
    "axis_ledger_json": (
        "Privately build an evidence ledger over these axes: intensity, rhythm/periodicity, dominant channel/axis, "
        "cadence/frequency, burstiness, trend, and cross-channel relation. For each caption, reject any option with "
        "an axis-level contradiction, then choose the caption with the strongest remaining entailment. "
        'Return only JSON: {"answer_index": <zero-based index>}.'
    ),
    "fewshot_json": (
        "Choose the best supported caption. Follow this style example exactly:\n"
        '{"answer_index": 1}'
    ),
}

SUPPORT_STYLES = {
    "strict_json": 'Return JSON only: {"supported": [true_or_false_for_S0, true_or_false_for_S1, ...]}.',
    "terse": 'Only output JSON: {"supported": [true_or_false_for_S0, true_or_false_for_S1, ...]}.',
    "chain_then_json": (
        "First briefly identify which evidence fields each statement matches or contradicts. "
        'Then return a final JSON object on the last line: {"supported": [true_or_false_for_S0, true_or_false_for_S1, ...]}.'
    ),
    "fewshot_json": (
        "Decide support for every statement. Follow this style example exactly:\n"
        '{"supported": [true, false, false]}'
    ),
}

FIELD_STYLES = {
    "strict_json": "Extract a normalized sensor evidence summary. Return JSON only with these keys and enum values.",
    "terse": "Extract the five fields. Only output JSON with the schema keys.",
    "chain_then_json": (
        "Extract the five fields, briefly reason about the numeric clues, "
        "then put the final JSON on the last line."
    ),
    "fewshot_json": (
        "Extract the five fields. Follow this style example exactly:\n"
        '{"intensity":"medium","periodicity":"weak","dominant_axis":"ankle_mag_x","dominant_frequency":"high","burstiness":"smooth"}'
    ),
}

CAPTION_PROMPT = (
    "You are evaluating whether captions are supported by wearable sensor evidence.\n\n"
    "Evidence:\n{evidence}\n\nCaption candidates:\n{options}\n\n{instruction}\n"
)
SUPPORT_PROMPT = (
    "You are checking caption support against wearable sensor evidence.\n\n"
    "Evidence:\n{evidence}\n\nStatements:\n{options}\n\n"
    "For each statement, decide whether it is supported by the evidence. Mark a statement true when its main claim "
    "is entailed by the evidence, even if wording is not identical. Mark it false when it contradicts intensity, "
    "rhythm, channel, cadence, burstiness, or trend evidence.\n{instruction}\n"
)
YES_NO_PROMPT = (
    "You are checking whether one caption is entailed by wearable sensor evidence.\n\n"
    "Evidence:\n{evidence}\n\nCaption:\n{options}\n\nAnswer yes or no. The answer is"
)
CHOICE_PROMPT = (
    "You are selecting the caption best supported by wearable sensor evidence.\n\n"
    "Evidence:\n{evidence}\n\nCaption candidates:\n{options}\n\n"
    "Return only the letter of the best supported caption.\nAnswer:"
)
POSITION_PROMPT = (
    "Choose one option label from this closed set without seeing evidence or caption text.\n\n"
    "Available labels: {options}\n\nReturn only one label.\nAnswer:"
)
FIELD_PROMPT = "{instruction}\n\nSchema:\n{schema}\n\nAxis code hints:\n{options}\n\nEvidence:\n{evidence}\n"
# ---- End of fixed values -------------------------------------------------------------------------


def _fill(template: str, **values: Column | str) -> Column:
    """The template with its named slots replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        value = values[name]
        parts += [F.lit(before), F.lit(value) if isinstance(value, str) else value]
    return F.concat(*parts, F.lit(rest))


def _letter(i: Column) -> Column:
    return F.char(i + 65)


def _lettered(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c, i: F.concat(_letter(i), F.lit(". "), c["text"])), "\n")


def _evidence() -> Column:
    return shown_evidence(F.col("evidence_text"), F.col("evidence"))


def caption_prompts(records: DataFrame, style: str = "strict_json") -> DataFrame:
    return records.select(
        "window_id",
        _fill(
            CAPTION_PROMPT,
            evidence=_evidence(),
            options=_lettered(F.col("caption_selection")["candidates"]),
            instruction=CAPTION_STYLES.get(style, CAPTION_STYLES["strict_json"]),
        ).alias("prompt"),
    )


def support_prompts(
    records: DataFrame, style: str = "strict_json", seed: int = 42, negative_count: int | None = None
) -> DataFrame:
    lines = F.array_join(
        F.transform(
            support_items(seed, negative_count),
            lambda s, i: F.concat(F.lit("S"), i.cast("string"), F.lit(": "), s["text"]),
        ),
        "\n",
    )
    return records.select(
        "window_id",
        _fill(
            SUPPORT_PROMPT,
            evidence=_evidence(),
            options=lines,
            instruction=SUPPORT_STYLES.get(style, SUPPORT_STYLES["strict_json"]),
        ).alias("prompt"),
    )


def yes_no_prompts(records: DataFrame) -> DataFrame:
    """One prompt per candidate."""
    shown = records.select(
        "window_id", _evidence().alias("_e"), F.posexplode_outer(F.col("caption_selection")["candidates"]).alias("pos", "_c")
    )
    return shown.select(
        "window_id", "pos", _fill(YES_NO_PROMPT, evidence=F.col("_e"), options=F.col("_c")["text"]).alias("prompt")
    )


def choice_prompts(records: DataFrame) -> DataFrame:
    return records.select(
        "window_id",
        _fill(CHOICE_PROMPT, evidence=_evidence(), options=_lettered(F.col("caption_selection")["candidates"])).alias(
            "prompt"
        ),
    )


def position_prior_prompts(records: DataFrame) -> DataFrame:
    labels = F.array_join(F.transform(F.col("caption_selection")["candidates"], lambda c, i: _letter(i)), ", ")
    return records.select("window_id", _fill(POSITION_PROMPT, options=labels).alias("prompt"))


def field_prompts(records: DataFrame, style: str = "strict_json") -> DataFrame:
    """Prompts that ask for the five fields; the axis list depends on the dataset."""

    def schema(dataset: str | None) -> str:
        slots = {
            "intensity": "low/medium/high",
            "periodicity": "none/weak/strong",
            "dominant_axis": "/".join(axis_options(dataset)),
            "dominant_frequency": "low/mid/high/uncertain",
            "burstiness": "smooth/bursty",
        }
        return "{" + ", ".join(f'"{k}": "one of {v}"' for k, v in slots.items()) + "}"

    def legend(dataset: str | None) -> str:
        return "\n".join(f"- {axis}: {AXIS_WORDS[axis]}" for axis in axis_options(dataset))

    def by_dataset(text) -> Column:
        known = F.col("dataset_id")
        return F.when(known == "mhealth", text("mhealth")).when(known == "wisdm", text("wisdm")).otherwise(text(None))

    return records.select(
        "window_id",
        _fill(
            FIELD_PROMPT,
            instruction=FIELD_STYLES.get(style, FIELD_STYLES["strict_json"]),
            schema=by_dataset(schema),
            options=by_dataset(legend),
            evidence=_evidence(),
        ).alias("prompt"),
    )
