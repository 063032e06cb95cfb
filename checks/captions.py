"""Benchmark tables, controls, subsets, text fields, audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import ctes as cx
from checks.ctes import hexnum, r6 as q6
from checks.registry import check, r6, tight
from kinesift.functions import captions
from kinesift.functions import phrases as ph
from kinesift.functions import textfields as tf
from kinesift.functions.hashing import hex_number
from kinesift.functions.scores import card_vector, statement_vector
from kinesift.operators import audit, benchmark as bm, controls, evaluate, prompts, subsets
from kinesift.plans import views
from kinesift.session import stored


def hnum(*parts):
    """First 8 hex digits of md5 over the parts, joined without a separator."""
    return hex_number(F.md5(F.concat(*[p.cast("string") for p in parts])), 8)


def easy(spark, d):
    return bm.build_benchmark(views.cards(spark, d))


def hard(spark, d, variant="v3"):
    return views.hard_records(spark, d, variant)


def structured(spark, d):
    records = hard(spark, d)
    bounds = tf.fit_numeric_bounds(records.filter("split = 'train'"))
    return records, evaluate.structured_rows(records, bounds)


# ---- captions -----------------------------------------------------------------------------------


@check("evidence_text", f"SELECT window_id, {cx.easy_text()} AS rich, concat('The sensor signal follows a ', {cx.TREND}, ' trend pattern.') AS trend FROM ev_cards")
def evidence_text(spark, d):
    c = views.cards(spark, d)
    card = {f: F.col(f) for f in captions.CARD_FIELDS}
    return c.select("window_id", captions.evidence_text(card).alias("rich"), captions.evidence_text(card, "trend").alias("trend"))


@check("counterfactuals", "SELECT window_id, CAST(i - 1 AS INT) AS pos, text, fact AS changed_fact FROM easy_items WHERE i > 0")
def counterfactuals(spark, d):
    c = easy(spark, d).select("window_id", F.posexplode_outer("counterfactuals").alias("pos", "c"))
    return c.select("window_id", "pos", "c.text", "c.changed_fact")


@check(
    "paraphrases",
    f"""SELECT window_id, 0 AS pos, concat('This window contains ', intensity, ' motion, ', periodicity, ' rhythm, and strongest activity on ',
    dominant_axis, '.') AS text FROM ev_cards UNION ALL SELECT window_id, 1, concat('The sensor evidence points to a ', burstiness,
    ' movement pattern with ', dominant_frequency, ' frequency and a ', {cx.TREND}, ' trend.') FROM ev_cards""",
)
def paraphrases(spark, d):
    return easy(spark, d).select("window_id", F.posexplode_outer("paraphrases").alias("pos", "c")).select("window_id", "pos", "c.text")


@check(
    "questions",
    """SELECT window_id, 'dominant_axis' AS fact, 'Which sensor axis carries the strongest movement?' AS question, dominant_axis AS answer FROM ev_cards
    UNION ALL SELECT window_id, 'periodicity', 'Is the motion evidence periodic?', periodicity FROM ev_cards
    UNION ALL SELECT window_id, 'intensity', 'What intensity level is supported by the sensor evidence?', intensity FROM ev_cards
    UNION ALL SELECT window_id, 'task_understanding', 'Which statement type should be rejected if it contradicts one evidence field?',
    'counterfactual' FROM ev_cards""",
)
def questions(spark, d):
    return easy(spark, d).select("window_id", F.inline_outer("qa")).select("window_id", "fact", "question", "answer")


def _choices(records):
    c = records.select("window_id", F.col("caption_selection.answer_index").alias("answer"), F.posexplode_outer("caption_selection.candidates").alias("pos", "c"))
    return c.select("window_id", "answer", "pos", "c.text", "c.supported")


def _choice_sql(name: str) -> str:
    return (
        f"SELECT c.window_id, CAST(a.answer AS INT) AS answer, CAST(c.pos AS INT) AS pos, c.text, c.i = 0 AS supported "
        f"FROM {name}_choice c JOIN {name}_answer a ON a.window_id = c.window_id"
    )


@check("multiple_choice", _choice_sql("easy"))
def multiple_choice(spark, d):
    return _choices(easy(spark, d))


for _v in ("v1", "v2", "v3"):

    def _hard_texts(spark, d, v=_v):
        records = hard(spark, d, v)
        rows = records.select("window_id", F.posexplode_outer(F.concat(F.array("positive"), "counterfactuals")).alias("i", "c"))
        return rows.select("window_id", "i", "c.text", F.coalesce("c.changed_fact", F.lit("")).alias("fact"))

    check(f"hard_texts_{_v}", f"SELECT window_id, CAST(i AS INT) AS i, text, coalesce(fact, '') AS fact FROM hard_{_v}_items")(_hard_texts)

    def _hard_choice(spark, d, v=_v):
        return _choices(hard(spark, d, v))

    check(f"hard_choice_{_v}", _choice_sql(f"hard_{_v}"))(_hard_choice)


@check("hard_evidence_v1", f"SELECT window_id, {cx.HARD_EVIDENCE} AS evidence_text FROM ev_cards")
def hard_evidence_v1(spark, d):
    return hard(spark, d, "v1").select("window_id", "evidence_text")


@check("hard_evidence_v3", "SELECT window_id, evidence_text FROM hard_v3_text")
def hard_evidence_v3(spark, d):
    return hard(spark, d).select("window_id", "evidence_text")


@check(
    "edit_values",
    "SELECT window_id, "
    + ", ".join(f"{cx.EDITS[k][f]} AS {k}_{f}" for k in ("easy", "hard") for f in ph.FIELDS)
    + " FROM ev_cards",
)
def edit_values(spark, d):
    c = views.cards(spark, d)
    card = {f: F.col(f) for f in captions.CARD_FIELDS}
    out = [v.alias(f"easy_{f}") for f, v in bm.easy_edits(card).items()]
    out += [v.alias(f"hard_{f}") for f, v in bm.hard_edits(card, F.col("dataset_id")).items()]
    return c.select("window_id", *out)


@check("first_records", "SELECT window_id FROM ev_cards ORDER BY window_id LIMIT 100")
def first_records(spark, d):
    return bm.first_records(views.cards(spark, d), 100).select("window_id")


@check("sample_records", "SELECT doc_id, lang FROM documents ORDER BY md5(concat('42:', doc_id)) LIMIT 150")
def sample_records(spark, d):
    return bm.sample_records(views.table(spark, d, "documents"), 150, "doc_id").select("doc_id", "lang")


REORDER = """SELECT window_id, list(pos ORDER BY md5(concat('5151:', window_id, ':caption:', pos))) AS h FROM hard_v3_choice GROUP BY 1"""


@check(
    "reordered_choices",
    f"""SELECT o.window_id, CAST(list_position(ord, a.answer) - 1 AS INT) AS answer, a.answer::INT AS was, c.text AS first_text FROM
    (SELECT window_id, CASE WHEN h = [0, 1, 2, 3] THEN [1, 2, 3, 0] ELSE h END AS ord FROM ({REORDER})) o
    JOIN hard_v3_answer a ON a.window_id = o.window_id JOIN hard_v3_choice c ON c.window_id = o.window_id AND c.pos = ord[1]""",
)
def reordered_choices(spark, d):
    r = bm.reorder_choices(hard(spark, d))
    return r.select(
        "window_id", F.col("caption_selection.answer_index").alias("answer"), F.col("caption_order_original_answer_index").alias("was"),
        F.col("caption_selection.candidates")[0]["text"].alias("first_text"),
    )


@check(
    "statement_examples",
    """SELECT kind, label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM (SELECT CASE WHEN i = 0 THEN 'positive' ELSE 'counterfactual' END AS kind,
    CAST(i = 0 AS INT) AS label, text FROM hard_v3_items) GROUP BY 1, 2""",
)
def statement_examples(spark, d):
    s = bm.statements(hard(spark, d))
    return s.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("letters"))


@check(
    "support_order",
    """SELECT window_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY md5(concat('42:', window_id, ':support:', i))) AS items FROM hard_v3_items
    WHERE i <= 3 GROUP BY 1""",
)
def support_order(spark, d):
    items = bm.support_items(42, 3)
    place = F.transform(items, lambda s: F.when(s["kind"] == "positive", 0).otherwise(s["original_index"] + 1).cast("string"))
    return hard(spark, d).select("window_id", F.array_join(place, ",").alias("items"))


@check(
    "records_with_windows",
    f"""SELECT w.window_id, w.split AS raw_split, {q6('sum(l.v)')} AS total FROM wins w JOIN ev_long l ON l.window_id = w.window_id
    GROUP BY 1, 2""",
)
def records_with_windows(spark, d):
    joined = bm.join_windows(hard(spark, d), views.event_windows(spark, d))
    total = F.aggregate(F.flatten("raw_sensor"), F.lit(0.0), lambda a, x: a + x)
    return joined.select("window_id", F.col("raw_sensor_split").alias("raw_split"), r6(total).alias("total"))


@check("records_without_window", "SELECT window_id FROM wins WHERE win_no > 0")
def records_without_window(spark, d):
    return bm.records_without_window(hard(spark, d), views.event_windows(spark, d).filter("win_no = 0")).select("window_id")


@check(
    "training_targets",
    "SELECT window_id, "
    + ", ".join(
        f"(CASE {f} " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(ws)) + f" ELSE 0 END) AS {f}"
        for f, ws in ph.VOCABULARY.items()
    )
    + " FROM ev_cards",
)
def training_targets(spark, d):
    return hard(spark, d).select("window_id", bm.training_targets(F.col("evidence")).alias("t")).select("window_id", "t.*")


# ---- prompts ------------------------------------------------------------------------------------

OPTIONS = "(SELECT window_id, string_agg(concat(chr(CAST(65 + pos AS INT)), '. ', text), chr(10) ORDER BY pos) AS options FROM hard_v3_choice GROUP BY 1)"


def _prompt_sql(template: str, **slots: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        slot, _, rest = after.partition("}")
        out += ["'" + before.replace("'", "''") + "'", slots[slot]]
    return "concat(" + ", ".join([*out, "'" + rest.replace("'", "''") + "'"]) + ")"


def _styled(name: str, styles: dict, sql: Callable[[str], str], make: Callable) -> None:
    """One query over all styles of a prompt; the records are written once."""

    def run(spark, d):
        records = stored(hard(spark, d), name)
        parts = [make(records, style).withColumn("style", F.lit(style)) for style in styles]
        return reduce(DataFrame.unionByName, parts)

    check(name, " UNION ALL ".join(f"SELECT *, '{style}' AS style FROM ({sql(text)})" for style, text in styles.items()))(run)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_styled(
    "caption_prompts",
    prompts.CAPTION_STYLES,
    lambda text: "SELECT t.window_id, "
    + _prompt_sql(prompts.CAPTION_PROMPT, evidence="evidence_text", options="options", instruction=_quoted(text))
    + f" AS prompt FROM hard_v3_text t JOIN {OPTIONS} o ON o.window_id = t.window_id",
    lambda records, style: prompts.caption_prompts(records, style),
)


@check(
    "choice_prompts",
    "SELECT t.window_id, "
    + _prompt_sql(prompts.CHOICE_PROMPT, evidence="evidence_text", options="options")
    + f" AS prompt FROM hard_v3_text t JOIN {OPTIONS} o ON o.window_id = t.window_id",
)
def choice_prompts(spark, d):
    return prompts.choice_prompts(hard(spark, d))


_styled(
    "support_prompts",
    prompts.SUPPORT_STYLES,
    lambda text: "SELECT t.window_id, "
    + _prompt_sql(prompts.SUPPORT_PROMPT, evidence="evidence_text", options="options", instruction=_quoted(text))
    + """ AS prompt FROM hard_v3_text t JOIN (SELECT window_id, string_agg(concat('S', rk, ': ', text), chr(10) ORDER BY rk) AS options FROM
    (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY md5(concat('42:', window_id, ':support:', i))) - 1 AS rk FROM hard_v3_items) GROUP BY 1) o
    ON o.window_id = t.window_id""",
    lambda records, style: prompts.support_prompts(records, style),
)


@check(
    "yes_no_prompts",
    "SELECT t.window_id, CAST(pos AS INT) AS pos, "
    + _prompt_sql(prompts.YES_NO_PROMPT, evidence="evidence_text", options="text")
    + " AS prompt FROM hard_v3_text t JOIN hard_v3_choice o ON o.window_id = t.window_id",
)
def yes_no_prompts(spark, d):
    return prompts.yes_no_prompts(hard(spark, d))


@check("position_prior_prompts", "SELECT window_id, " + _prompt_sql(prompts.POSITION_PROMPT, options="'A, B, C, D'") + " AS prompt FROM ev_cards")
def position_prior_prompts(spark, d):
    return prompts.position_prior_prompts(hard(spark, d))


_SCHEMA = (
    '{"intensity": "one of low/medium/high", "periodicity": "one of none/weak/strong", "dominant_axis": "one of acc_x/acc_y/acc_z/uncertain", '
    '"dominant_frequency": "one of low/mid/high/uncertain", "burstiness": "one of smooth/bursty"}'
)
_LEGEND = "\n".join(f"- {a}: {ph.AXIS_WORDS[a]}" for a in ("acc_x", "acc_y", "acc_z", "uncertain"))


_styled(
    "field_prompts",
    prompts.FIELD_STYLES,
    lambda text: "SELECT window_id, "
    + _prompt_sql(prompts.FIELD_PROMPT, instruction=_quoted(text), schema=f"'{_SCHEMA}'", options=f"'{_LEGEND}'", evidence="evidence_text")
    + " AS prompt FROM hard_v3_text",
    lambda records, style: prompts.field_prompts(records, style),
)


# ---- controls -----------------------------------------------------------------------------------

SOURCE = """SELECT window_id, coalesce(lead(window_id) OVER (ORDER BY md5(concat('42:', window_id)), window_id),
    first_value(window_id) OVER (ORDER BY md5(concat('42:', window_id)), window_id)) AS src FROM ev_cards"""
MASKED = "regexp_replace(evidence_text, '\\d+\\.\\d+|\\b\\d+\\b', '<num>', 'g')"
_OWN = "SELECT window_id, {text} AS evidence_text, window_id AS source FROM {src}"
CONTROLS = {
    "visible": "SELECT window_id, evidence_text, window_id AS source FROM hard_v3_text",
    "shuffled": f"SELECT s.window_id, t.evidence_text, s.src AS source FROM ({SOURCE}) s JOIN hard_v3_text t ON t.window_id = s.src",
    "numeric-mask": f"SELECT window_id, regexp_replace({MASKED}, '-<num>', '<num>', 'g') AS evidence_text, window_id AS source FROM hard_v3_text",
    "numeric-swap": f"""SELECT window_id, {cx.V3_EVIDENCE} AS evidence_text, src AS source FROM (SELECT c.* EXCLUDE (rms, ac, ratio, hz, peaks),
    o.rms, o.ac, o.ratio, o.hz, o.peaks, s.src FROM ({SOURCE}) s JOIN ev_cards c ON c.window_id = s.window_id JOIN ev_cards o ON o.window_id = s.src)""",
    "axis-permutation": f"""SELECT window_id, {cx.V3_EVIDENCE} AS evidence_text, window_id AS source FROM (SELECT * REPLACE
    (CASE WHEN dominant_axis = 'acc_x' THEN 'acc_y' ELSE 'acc_x' END AS dominant_axis) FROM ev_cards)""",
    "trend-flip": f"""SELECT window_id, {cx.V3_EVIDENCE} AS evidence_text, window_id AS source FROM (SELECT * REPLACE
    ({", ".join(f"(CASE {t} WHEN 'rise' THEN 'fall' WHEN 'fall' THEN 'rise' ELSE {t} END) AS {t}" for t in ("t0", "t1", "t2"))}) FROM ev_cards)""",
    "hidden": f"SELECT window_id, '{ph.HIDDEN_CONTROL_TEXT}' AS evidence_text, NULL AS source FROM ev_cards",
}
for _mode, _sql in CONTROLS.items():

    def _control(spark, d, m=_mode):
        c = controls.control_records(hard(spark, d), m)
        return c.select("window_id", "evidence_text", F.col("evidence_source_window_id").alias("source"))

    check("control_" + _mode.replace("-", "_"), _sql)(_control)

STRESS = {
    "numeric_mask": f"SELECT window_id, regexp_replace({MASKED}, '[-+]<num>', '<num>', 'g') AS evidence_text FROM hard_v3_text",
    "shuffled_evidence": f"SELECT s.window_id, t.evidence_text FROM ({SOURCE}) s JOIN hard_v3_text t ON t.window_id = s.src",
    "hidden_evidence": f"SELECT window_id, '{ph.HIDDEN_STRESS_TEXT}' AS evidence_text FROM ev_cards",
}
for _mode, _sql in STRESS.items():

    def _stress(spark, d, m=_mode):
        return controls.stress_records(hard(spark, d), m).select("window_id", "evidence_text")

    check("stress_" + _mode, _sql)(_stress)


# ---- text fields --------------------------------------------------------------------------------


def _claims(spark, d, claims):
    s = bm.statements(hard(spark, d)).withColumn("lower", F.lower("text"))
    i = F.when(F.col("kind") == "positive", 0).otherwise(F.col("pos") + 1)
    c = s.select("window_id", i.cast("int").alias("i"), claims(F.col("lower")).alias("c"))
    return c.select("window_id", "i", *[F.coalesce(F.col("c")[f], F.lit("-")).alias(f) for f in ph.FIELDS])


_SHOWN = ", ".join(f"coalesce(c_{f}, '-') AS {f}" for f in ph.FIELDS)


@check("caption_claims", f"SELECT window_id, CAST(i AS INT) AS i, {_SHOWN} FROM v3_claims")
def caption_claims(spark, d):
    return _claims(spark, d, tf.caption_claims)


@check(
    "statement_claims",
    f"""SELECT window_id, CAST(i AS INT) AS i, {_SHOWN} FROM (SELECT window_id, i, {cx.statement_claims('lower(text)')} FROM easy_items
    UNION ALL SELECT window_id, 10 + i, {cx.statement_claims('lower(text)')} FROM hard_v1_items)""",
)
def statement_claims(spark, d):
    base = easy(spark, d)

    def part(records, offset):
        items = F.concat(F.array("positive"), "counterfactuals")
        rows = records.select("window_id", F.posexplode_outer(items).alias("i", "c"))
        named = rows.select("window_id", (F.col("i") + offset).alias("i"), tf.statement_claims(F.lower("c.text")).alias("c"))
        return named.select("window_id", "i", *[F.coalesce(F.col("c")[f], F.lit("-")).alias(f) for f in ph.FIELDS])

    return part(base, 0).unionByName(part(bm.build_hard_benchmark(base, "v1"), 10))


@check("text_numerics", f"SELECT window_id, {q6('n_rms')} AS rms, {q6('n_ac')} AS ac, {q6('n_ratio')} AS ratio, {q6('n_hz')} AS hz, {q6('n_peaks')} AS peaks FROM v3_said")
def text_numerics(spark, d):
    n = hard(spark, d).select("window_id", tf.text_numerics(F.col("evidence_text")).alias("n"))
    return tight(n.select("window_id", *[F.col(f"n.{k}").alias(a) for k, a in zip(ph.NUMERIC_PATTERNS, ("rms", "ac", "ratio", "hz", "peaks"))]))


@check("numeric_bounds", "SELECT " + ", ".join(f"{q6(f'{f}_{w}')} AS {f}_{w}" for f, (_, ws) in cx._MEANS.items() for w in ws) + " FROM class_means")
def numeric_bounds(spark, d):
    return tight(tf.numeric_bounds_table(hard(spark, d).filter("split = 'train'")))


@check("stated_fields", "SELECT window_id, " + ", ".join(f"coalesce(s_{f}, '-') AS {f}" for f in ph.FIELDS) + " FROM v3_said")
def stated_fields(spark, d):
    f = hard(spark, d).select("window_id", tf.evidence_fields(F.col("evidence_text")).alias("f"))
    return f.select("window_id", *[F.coalesce(F.col("f")[x], F.lit("-")).alias(x) for x in ph.FIELDS])


@check("inferred_fields", "SELECT window_id, " + ", ".join(f"coalesce(f_{f}, '-') AS {f}" for f in ph.FIELDS) + " FROM v3_fields")
def inferred_fields(spark, d):
    records = hard(spark, d)
    bounds = tf.fit_numeric_bounds(records.filter("split = 'train'"))
    f = records.select("window_id", tf.evidence_fields(F.col("evidence_text"), bounds).alias("f"))
    return f.select("window_id", *[F.coalesce(F.col("f")[x], F.lit("-")).alias(x) for x in ph.FIELDS])


@check(
    "model_fields",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END END AS intensity,
    CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'acc_x' WHEN event_id % 3 = 1 THEN 'acc_z' END END AS dominant_axis,
    CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN 'bursty' END AS burstiness FROM events""",
)
def model_fields(spark, d):
    e = views.table(spark, d, "events").select("event_id")
    i = F.col("event_id")
    word = F.element_at(F.array(*[F.lit(w) for w in (" Low", "MEDIUM ", "high", "loud")]), (i % 4 + 1).cast("int"))
    axis = F.element_at(F.array(F.lit("ACC X"), F.lit("vertical acceleration trace"), F.lit("gyro_x")), (i % 3 + 1).cast("int"))
    burst = F.when(i % 2 == 0, F.lit('"Bursty"')).otherwise("7")
    body = F.concat(
        F.lit('Sure: {"intensity": "'), word, F.lit('", "dominant_axis": "'), axis, F.lit('", "burstiness": '), burst,
        F.when(i % 5 == 0, F.lit("")).otherwise("} done"),
    )
    f = e.select("event_id", tf.model_fields(body, F.lit("wisdm")).alias("f"))
    return f.select("event_id", "f.intensity", "f.dominant_axis", "f.burstiness")


@check(
    "fixed_point",
    "SELECT event_id, printf('%.3f', (2 * (event_id % 4000) + 1) / 2000.0 - 1) AS tie, printf('%.3f', event_id / 7.0 - 3) AS other FROM events",
)
def fixed_point(spark, d):
    i = F.col("event_id").cast("double")
    tie = (2 * (i % 4000) + 1) / 2000.0 - 1
    return views.table(spark, d, "events").select("event_id", ph.fixed_point(tie, 3).alias("tie"), ph.fixed_point(i / 7.0 - 3, 3).alias("other"))


@check(
    "choice_index",
    """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN CAST(conv_id % 3 AS INT) WHEN (conv_id + turn) % 4 = 1 THEN
    CASE WHEN conv_id % 7 < 4 THEN CAST(conv_id % 7 AS INT) END WHEN (conv_id + turn) % 4 = 2 THEN CASE WHEN turn < 4 THEN CAST(turn AS INT) END
    WHEN conv_id % 5 = 1 THEN 1 WHEN conv_id % 5 = 4 THEN 2 END AS choice FROM conversations""",
)
def choice_index(spark, d):
    c = views.table(spark, d, "conversations").select("conv_id", "turn")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit('so {"answer_index": '), (F.col("conv_id") % 3).cast("string"), F.lit("} then")))
        .when(kind == 1, F.concat(F.lit("option "), F.char(F.col("conv_id") % 7 + 65), F.lit(".")))
        .when(kind == 2, F.concat(F.lit("number "), F.col("turn").cast("string"), F.lit(" fits")))
        .when(F.col("conv_id") % 5 == 0, '{"answer_index": 99999999999}')
        .when(F.col("conv_id") % 5 == 1, '{"answer_index": "no", "index": 1.7}')
        .when(F.col("conv_id") % 5 == 2, '{"choice_index": "NaN"}')
        .when(F.col("conv_id") % 5 == 4, '{"index": "1.7", "choice_index": " 2 "}')
        .otherwise("no idea")
    )
    return c.select("conv_id", "turn", tf.choice_index(answer, F.lit(4)).alias("choice"))


@check(
    "support_labels",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_id % 3 = 1 THEN 'true,false' END ELSE concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,
    CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END) END AS labels FROM events""",
)
def support_labels(spark, d):
    e = views.table(spark, d, "events").select("event_id")
    i = F.col("event_id")
    a, b = i % 2 == 0, i % 3 == 0

    def words(yes, no):
        return [F.when(x, yes).otherwise(no) for x in (a, b)]

    json = F.concat_ws("", F.lit('x {"labels": ['), words("true", "false")[0], F.lit(", "), words("true", "false")[1], F.lit("]}"))
    bare = F.concat_ws("", F.lit('["'), words("Yes", "no")[0], F.lit('", "'), words("support", "rejected")[1], F.lit('"]'))
    lines = F.concat_ws("", F.lit("S0: "), words("Supported", "unsupported")[0], F.lit("\nS1 = "), words("yes", "reject")[1])
    answer = F.when(i % 4 == 0, json).when(i % 4 == 1, bare).when(i % 4 == 2, lines).when(i % 3 == 0, '{"answers": ["2", "no"]}')
    answer = answer.when(i % 3 == 1, '{"answers": [2, 0.0]}').otherwise("S0: yes")
    labels = tf.support_labels(answer, F.lit(2))
    return e.select("event_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


@check(
    "hashed_words",
    f"""WITH_TOKENS SELECT doc_id, bucket, {q6('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))')} AS weight FROM (SELECT doc_id,
    {hexnum('token')} % 256 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+'))) AS token
    FROM documents) GROUP BY 1, 2)""".replace("WITH_TOKENS ", ""),
)
def hashed_words(spark, d):
    from kinesift.operators.words import hashed_bag

    return tight(hashed_bag(views.table(spark, d, "documents"), "doc_id", "text"))


@check(
    "card_tokens",
    """SELECT window_id, 'intensity:' || intensity AS token FROM ev_cards UNION SELECT window_id, 'periodicity:' || periodicity FROM ev_cards
    UNION SELECT window_id, 'axis:' || dominant_axis FROM ev_cards UNION SELECT window_id, 'frequency:' || dominant_frequency FROM ev_cards
    UNION SELECT window_id, 'burstiness:' || burstiness FROM ev_cards UNION SELECT window_id, 'trend:' || t0 FROM ev_cards
    UNION SELECT window_id, 'trend:' || t1 FROM ev_cards UNION SELECT window_id, 'trend:' || t2 FROM ev_cards""",
)
def card_tokens(spark, d):
    from kinesift.operators.words import card_tokens as tokens

    return views.cards(spark, d).select("window_id", F.explode_outer(tokens("rich")).alias("token"))


_ONE_HOTS = [(f, w) for f in ph.FIELDS for w in ph.VOCABULARY[f]]
_VECTOR = (
    "[rms, ac, ratio, hz, peaks, confidence"
    + "".join(f", CAST({f} = '{w}' AS DOUBLE)" for f, w in _ONE_HOTS)
    + "".join(f", CAST(t0 = '{t}' AS DOUBLE) + CAST(t1 = '{t}' AS DOUBLE) + CAST(t2 = '{t}' AS DOUBLE)" for t in ("rise", "fall", "stable"))
    + "".join(f", CAST(coalesce(c_{f} = '{w}', false) AS DOUBLE)" for f, w in _ONE_HOTS)
    + "".join(f", CAST(c_{f} IS NULL AS DOUBLE)" for f in ph.FIELDS)
    + "".join(f", CAST(coalesce(c_{f} = {f}, false) AS DOUBLE)" for f in ph.FIELDS)
    + "".join(f", CAST(coalesce(c_{f} <> {f}, false) AS DOUBLE)" for f in ph.FIELDS)
    + "]"
)


@check(
    "statement_vectors",
    f"""SELECT window_id, CAST(i AS INT) AS i, CAST(len(v) AS INT) AS width, {q6('list_sum(v)')} AS total,
    {q6('list_sum(list_transform(v, lambda x, k: x * k))')} AS weighted FROM (SELECT s.window_id, i, {_VECTOR} AS v FROM
    (SELECT window_id, i, {cx.statement_claims('lower(text)')} FROM hard_v3_items) s JOIN ev_cards c ON c.window_id = s.window_id)""",
)
def statement_vectors(spark, d):
    s = bm.statements(hard(spark, d)).withColumn("c", tf.statement_claims(F.lower("text")))
    i = F.when(F.col("kind") == "positive", 0).otherwise(F.col("pos") + 1).cast("int")
    v = s.select("window_id", i.alias("i"), statement_vector(F.col("evidence"), F.col("c")).alias("v"))

    def sums(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1 if len(vectors) else 0)
        both = [np.zeros(len(x)), np.zeros(len(x))]
        for k in range(x.shape[1]):
            both[0] += x[:, k]
            both[1] += x[:, k] * (k + 1)
        return pa.StructArray.from_arrays([pa.array(b) for b in both], names=["total", "weighted"])

    summed = v.select("window_id", "i", F.size("v").alias("width"), F.arrow_udf(sums, "total double, weighted double")(F.col("v")).alias("s"))
    return tight(summed.select("window_id", "i", "width", "s.total", "s.weighted"))


@check(
    "numeric_vectors",
    f"""SELECT window_id, {q6('rms + 2 * ac + 3 * ratio + 4 * hz + 5 * peaks + 6 * confidence')} AS weighted, CAST(6 + 37 + 0 AS INT) AS head FROM ev_cards""".replace(
        "CAST(6 + 37 + 0 AS INT)", f"{6 + len(_ONE_HOTS) + 15}"
    ),
)
def numeric_vectors(spark, d):
    r = hard(spark, d)
    none = F.struct(*[F.lit(None).cast("string").alias(f) for f in ph.FIELDS])
    v = r.select("window_id", statement_vector(F.col("evidence"), none, "numeric_only").alias("v"), card_vector(F.col("evidence")).alias("c"))
    head = F.aggregate(F.transform(F.slice("v", 1, 6), lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return tight(v.select("window_id", head.alias("weighted"), F.size("v").alias("head")))


# ---- subsets ------------------------------------------------------------------------------------


@check(
    "constrained_subset",
    """SELECT window_id, CAST(list_position(sel, answer) - 1 AS INT) AS answer, array_to_string(sel, ',') AS choices FROM (SELECT r.window_id, r.answer,
    CASE WHEN n_held > 1 THEN (SELECT list(c.pos ORDER BY c.pos) FROM hard_v3_choice c JOIN v3_held h ON h.window_id = c.window_id AND h.i = c.i
    WHERE c.window_id = r.window_id AND h.held = 1) ELSE (SELECT list(c.pos ORDER BY h.agree DESC, h.clash, c.pos)[1:3] FROM hard_v3_choice c
    JOIN v3_held h ON h.window_id = c.window_id AND h.i = c.i WHERE c.window_id = r.window_id) END AS sel FROM v3_rows r WHERE n_held <> 1)""",
)
def constrained_subset(spark, d):
    records, rows = structured(spark, d)
    s = subsets.constrained_subset(records, rows, strict=False)
    return s.select(
        "window_id", F.col("caption_selection.answer_index").alias("answer"),
        F.array_join(F.transform("candidate_index_map", lambda x: x.cast("string")), ",").alias("choices"),
    )


RUN_VOTES = f"""SELECT window_id, r, CASE WHEN {hexnum("concat(window_id, ':n:', r)")} % 5 = 0 THEN NULL ELSE {hexnum("concat(window_id, ':', r)")} % 4 END AS v
    FROM (SELECT window_id, unnest([0, 1, 2]) AS r FROM hard_v3_answer)"""


def run_votes(records):
    r = records.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    return r.withColumn(
        "caption_prediction",
        F.when(hnum(F.col("window_id"), F.lit(":n:"), F.col("run")) % 5 != 0, hnum(F.col("window_id"), F.lit(":"), F.col("run")) % 4).cast("int"),
    )


@check(
    "vote_subset",
    f"""SELECT window_id, CAST(coalesce(list_position(sel, answer), 0) - 1 AS INT) AS answer, array_to_string(sel, ',') AS choices, CAST(n AS INT) AS votes FROM
    (SELECT a.window_id, a.answer, CASE WHEN n > 0 THEN sel ELSE [0, 1, 2, 3] END AS sel, n FROM hard_v3_answer a JOIN (SELECT window_id, sum(k) AS n,
    list(v ORDER BY first) FILTER (v IS NOT NULL) AS sel FROM (SELECT window_id, v, count(v) AS k, min(r) AS first FROM ({RUN_VOTES}) GROUP BY 1, 2) GROUP BY 1) s
    ON s.window_id = a.window_id)""",
)
def vote_subset(spark, d):
    records = hard(spark, d)
    s = subsets.vote_subset(records, run_votes(records))
    return s.select(
        "window_id", F.col("caption_selection.answer_index").alias("answer"),
        F.array_join(F.transform("candidate_index_map", lambda x: x.cast("string")), ",").alias("choices"), F.col("vote_count").alias("votes"),
    )


BALANCE = """SELECT window_id, max(n) - min(n) AS length_range, stddev_pop(n) AS length_std, max(o / n) - min(o / n) AS overlap_range,
    stddev_pop(o / n) AS overlap_std, (max(n) - min(n)) / 20.0 + (max(o / n) - min(o / n)) AS score FROM (SELECT c.window_id, c.pos,
    CAST(len(ct) AS DOUBLE) AS n, CAST(len(list_intersect(ct, et)) AS DOUBLE) AS o FROM (SELECT window_id, pos,
    list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS ct FROM hard_v3_choice) c JOIN (SELECT window_id,
    list_distinct(regexp_extract_all(lower(evidence_text), '[a-zA-Z0-9_]+')) AS et FROM hard_v3_text) t ON t.window_id = c.window_id) GROUP BY 1"""


@check(
    "balance_features",
    f"""SELECT window_id, {q6('length_range')} AS length_range, {q6('length_std')} AS length_std, {q6('overlap_range')} AS evidence_overlap_range,
    {q6('overlap_std')} AS evidence_overlap_std, {q6('score')} AS balance_score FROM ({BALANCE})""",
)
def balance_features(spark, d):
    return tight(subsets.balance_features(hard(spark, d)).drop("candidate_count"))


@check(
    "balanced_subset",
    f"""SELECT window_id FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9), length_range, round(overlap_range, 9), window_id) AS rk, count(*) OVER () AS n FROM
    ({BALANCE}) WHERE length_range <= 8) WHERE rk <= greatest(1, round_even(n * 0.3::DOUBLE, 0))""",
)
def balanced_subset(spark, d):
    f = subsets.balance_features(hard(spark, d))
    near = f.withColumn("balance_score", F.round("balance_score", 9)).withColumn("evidence_overlap_range", F.round("evidence_overlap_range", 9))
    return subsets.balanced_subset(near, 0.3, max_length_range=8.0).select("window_id")


@check(
    "annotation_subset",
    f"""SELECT window_id, reason FROM (SELECT a.window_id, CASE WHEN v0 <> v1 THEN 'vote_gated_disagreement' ELSE 'random_hard_sample' END AS reason,
    CASE WHEN v0 <> v1 THEN 0 ELSE 1 END AS k FROM hard_v3_answer a JOIN (SELECT window_id, max(CASE WHEN r = 0 THEN v END) AS v0,
    max(CASE WHEN r = 1 THEN v END) AS v1 FROM ({RUN_VOTES}) GROUP BY 1) s ON s.window_id = a.window_id)
    ORDER BY k, md5(concat('42:', window_id)) LIMIT 900""",
)
def annotation_subset(spark, d):
    records = hard(spark, d)
    v = run_votes(records)
    s = subsets.annotation_subset(records, v.filter("run = 0"), v.filter("run = 1"), 900)
    return s.select("window_id", F.col("selection_reason").alias("reason"))


# ---- audits -------------------------------------------------------------------------------------


@check("answer_positions", "SELECT CAST(answer AS INT) AS position, count(*) AS n FROM hard_v3_answer GROUP BY 1")
def answer_positions(spark, d):
    return audit.answer_positions(hard(spark, d))


_ALL_V1 = "(SELECT window_id, string_agg(lower(text), chr(10)) AS t FROM hard_v1_items GROUP BY 1)"


@check(
    "shortcut_hits",
    " UNION ALL ".join(f"SELECT '{p}' AS phrase, CAST(count(*) AS BIGINT) AS records FROM {_ALL_V1} WHERE contains(t, '{p}')" for p in ph.SHORTCUT_PHRASES),
)
def shortcut_hits(spark, d):
    return audit.shortcut_hits(hard(spark, d, "v1"))


@check("changed_fact_counts", "SELECT unnest(string_split(fact, '+')) AS fact, count(*) AS n FROM hard_v3_items WHERE i > 0 GROUP BY 1")
def changed_fact_counts(spark, d):
    return audit.changed_fact_counts(hard(spark, d))


@check("subject_overlap", "SELECT DISTINCT a.subject_id FROM grid a JOIN grid b ON a.subject_id = b.subject_id AND a.split = 'train' AND b.split = 'test'")
def subject_overlap(spark, d):
    w = views.grid_windows(spark, d)
    return audit.subject_overlap(w.filter("split = 'train'"), w.filter("split = 'test'"))


@check(
    "audit_report",
    f"""SELECT 'wisdm' AS dataset_id, 'records' AS "check", 'all' AS item, count(*) AS n FROM ev_cards UNION ALL
    SELECT 'wisdm', 'answer_position', CAST(answer AS VARCHAR), count(*) FROM hard_v3_answer GROUP BY 3 UNION ALL
    SELECT 'wisdm', 'changed_fact', fact, count(*) FROM (SELECT unnest(string_split(fact, '+')) AS fact FROM hard_v3_items WHERE i > 0) GROUP BY 3 UNION ALL
    SELECT 'wisdm', 'windows', split, count(*) FROM ev_cards GROUP BY 3 UNION ALL SELECT 'wisdm', 'subject_overlap', 'subjects', 0
    UNION ALL {" UNION ALL ".join(f"SELECT 'wisdm', 'shortcut_phrase', '{p}', 0" for p in ph.SHORTCUT_PHRASES)}""",
)
def audit_report(spark, d):
    records = hard(spark, d)
    return audit.audit_report(records, records.select("window_id", "dataset_id", "split", "subject_id"))


