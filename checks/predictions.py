"""Scoring, combining, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import ctes as cx
from checks.captions import easy, hard, hnum, structured
from checks.ctes import hexnum, r6 as q6
from checks.registry import check, tight
from kinesift.functions import phrases as ph
from kinesift.functions import scores as sc
from kinesift.functions.arrays import once, total
from kinesift.operators import audit, combine, evaluate, metrics, reports
from kinesift.operators import benchmark as bm
from kinesift.plans import views
from kinesift.session import stored

# ---- hashed predictions over documents ----------------------------------------------------------


def votes(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset"))
    runs = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"))
    i = F.col("doc_id")
    return runs.select(
        "doc_id",
        "dataset",
        F.concat(F.lit("doc-"), i.cast("string")).alias("window_id"),
        "run",
        F.when(hnum(i, F.lit(":n:"), F.col("run")) % 17 != 0, hnum(i, F.lit(":"), F.col("run")) % 4).cast("int").alias("caption_prediction"),
        (hnum(i, F.lit(":a")) % 4).cast("int").alias("caption_answer_index"),
    )


def primaries(spark, d):
    return votes(spark, d).filter("run = 0").drop("run")


def scored(spark, d, with_map=True):
    """Alternate predictions with four scores; every third document counts in a rotated subset order."""
    docs = views.table(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset"))
    i = F.col("doc_id")
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: hnum(i, F.lit(":s:"), k) / F.lit(4294967296.0) * 6)
    rotated = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((k + i) % 4).cast("int"))
    rows = docs.select(
        "doc_id",
        "dataset",
        F.concat(F.lit("doc-"), i.cast("string")).alias("window_id"),
        values.alias("caption_scores"),
        (hnum(i, F.lit(":a")) % 4).cast("int").alias("caption_answer_index"),
        F.when((i % 3 == 0) & F.lit(with_map), rotated).alias("candidate_index_map"),
    )
    return rows.withColumn("caption_prediction", sc.first_argmax(F.col("caption_scores")))


def partners(spark, d, with_map=True):
    """Alternates of the documents that have labels: some primaries have none."""
    labelled = views.table(spark, d, "labels").select("doc_id")
    return scored(spark, d, with_map).join(labelled, "doc_id", "left_semi")


def binary(spark, d):
    rows = views.table(spark, d, "labels")
    return rows.select("doc_id", F.col("quality").alias("truth"), (hnum(F.col("doc_id"), F.lit(":p")) / F.lit(4294967296.0)).alias("score"))


RIGHT = "CAST(coalesce(pred, 0) = answer AS INT)"

# ---- scoring ------------------------------------------------------------------------------------


@check("verified_statements", "SELECT window_id, CAST(i AS INT) AS i, held = 1 AS held FROM v3_held")
def verified_statements(spark, d):
    _, rows = structured(spark, d)
    return rows.select("window_id", F.posexplode_outer("support_predictions").alias("i", "held"))


def _prf_sql(src: str) -> str:
    """tp, fp, fn, tn -> the four rejection measures."""
    return f"""SELECT {q6('(tp + tn) / greatest(1, tp + fp + fn + tn)')} AS cf_reject_accuracy, {q6('tp / greatest(1, tp + fp)')} AS cf_reject_precision,
    {q6('tp / greatest(1, tp + fn)')} AS cf_reject_recall, {q6('CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS cf_reject_f1, * EXCLUDE (tp, fp, fn, tn)
    FROM ({src})"""


_HELD_CELLS = """CAST(sum(CASE WHEN i = 0 AND {p} THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN i > 0 AND {p} THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN i = 0 AND NOT {p} THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN i > 0 AND NOT {p} THEN 1 ELSE 0 END) AS DOUBLE) AS tn"""


_HELD_PRF = _prf_sql(f"SELECT {_HELD_CELLS.format(p='held = 1')} FROM v3_held")


@check(
    "structured_summary",
    _prf_sql(
        f"""SELECT {_HELD_CELLS.format(p='held = 1')}, (SELECT {q6('avg(CAST(best = answer AS INT))')} FROM v3_rows) AS caption_selection_accuracy,
    (SELECT count(*) FROM v3_rows) AS n_eval_records, (SELECT {q6('avg(CAST(' + ' AND '.join(f'f_{f} IS NOT NULL' for f in ph.FIELDS) + ' AS INT))')} FROM v3_fields)
    AS evidence_parse_complete_rate FROM v3_held"""
    ),
)
def structured_summary(spark, d):
    _, rows = structured(spark, d)
    return tight(reports.grounding_summary(rows))


def _rule_sql(system: str) -> str:
    fields, penalty = sc.RULE_SYSTEMS[system]
    hits, against = ["0.0"], ["0"]
    for f in ph.FIELDS:
        if f in fields:
            rival = "(" + " OR ".join(f"contains(t, '{w}')" for w in sc.RIVAL_WORDS[f]) + ")"
            hits.append(f"CASE WHEN contains(t, {f}) THEN 1.0 WHEN {rival} THEN {-penalty} ELSE 0.0 END")
            against.append(f"CASE WHEN NOT contains(t, {f}) AND {rival} THEN 1 ELSE 0 END")
    parts = len(hits) - 1
    if "trend" in fields:
        parts += 1
        hits.append("least(1.0, (" + " + ".join(f"CAST(contains(t, {x}) AS INT)" for x in ("t0", "t1", "t2")) + ") / 3.0)")
    raw = f"greatest(0.0, least(1.0, ({' + '.join(hits)}) / {parts}))"
    value = f"CASE WHEN {' + '.join(against)} > 0 THEN least(0.35, {raw}) ELSE {raw} END" if penalty >= 0.75 else raw
    return (
        f"SELECT i.window_id, i.i, i.fact, CAST({value} AS DOUBLE) AS s FROM (SELECT window_id, i, fact, lower(text) AS t FROM easy_items) i "
        "JOIN ev_cards c ON c.window_id = i.window_id"
    )


# What a system answers: the card's own value of the facts it knows, the fixed word for the last question, else "unknown".
_ASKED = """SELECT window_id, 'dominant_axis' AS fact, dominant_axis AS answer FROM ev_cards UNION ALL SELECT window_id, 'periodicity', periodicity FROM ev_cards
    UNION ALL SELECT window_id, 'intensity', intensity FROM ev_cards UNION ALL SELECT window_id, 'task_understanding', 'counterfactual' FROM ev_cards"""


def _qa_sql(system: str) -> str:
    known = "" if system == "B2" else " ".join(f"WHEN q.fact = '{f}' THEN c.{f}" for f in ("dominant_axis", "periodicity", "intensity"))
    guess = f"CASE WHEN q.fact = 'task_understanding' THEN 'counterfactual' {known} ELSE 'unknown' END"
    return f"(SELECT {q6(f'avg(CAST(lower({guess}) = lower(q.answer) AS INT))')} FROM ({_ASKED}) q JOIN ev_cards c ON c.window_id = q.window_id)"


for _system in ("B1", "B2", "B3", "M1"):
    _qa = _qa_sql(_system)

    def _rule(spark, d, s=_system):
        return tight(reports.grounding_summary(evaluate.rule_rows(easy(spark, d), s)))

    check(
        f"rule_system_{_system.lower()}",
        _prf_sql(
            f"""SELECT {_HELD_CELLS.format(p='s >= 0.5')}, count(DISTINCT window_id) AS n_eval_records, CAST({_qa} AS DOUBLE) AS qa_accuracy,
        (SELECT {q6('avg(CAST(b.pos = a.answer AS INT))')} FROM (SELECT c.window_id, arg_min(pos, (-round(s, 12), pos)) AS pos FROM easy_choice c JOIN ({_rule_sql(_system)}) r
        ON r.window_id = c.window_id AND r.i = c.i GROUP BY 1) b JOIN easy_answer a ON a.window_id = b.window_id) AS caption_selection_accuracy
        FROM ({_rule_sql(_system)})"""
        ),
    )(_rule)


@check("rule_scores", f"SELECT window_id, CAST(i AS INT) AS i, {q6('s')} AS score FROM ({_rule_sql('M1')})")
def rule_scores(spark, d):
    rows = evaluate.rule_rows(easy(spark, d), "M1")
    return tight(rows.select("window_id", F.posexplode_outer("support_probabilities").alias("i", "score")))


@check(
    "embedding_cosines",
    f"""SELECT a.vec_id, k, {q6('list_dot_product(av, bv) / sqrt(list_dot_product(av, av)) / sqrt(list_dot_product(bv, bv))')} AS score FROM
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS av, unnest(range(1, 11)) AS k, (SELECT count(*) FROM embeddings) AS n FROM embeddings) a
    JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS bv FROM embeddings) b ON b.vec_id = (a.vec_id + k) % n""",
)
def embedding_cosines(spark, d):
    rows = evaluate.cosine_rows(vector_sets(spark, d))
    every = F.concat("caption_scores", F.array("positive_score"), "counterfactual_scores")
    opened = rows.select(F.col("window_id").cast("bigint").alias("vec_id"), F.posexplode_outer(every).alias("k", "score"))
    return tight(opened.select("vec_id", (F.col("k") + 1).cast("bigint").alias("k"), "score"))


def vector_sets(spark, d):
    """Each vector with its ten successors: four candidates, a positive, five counterfactuals."""
    e = views.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.count()
    asked = e.select(F.col("vec_id").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k")).withColumn("vec_id", (F.col("own") + F.col("k")) % n)
    found = asked.join(e, "vec_id").groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("vs"))
    return e.select(F.col("vec_id").alias("own"), F.col("v").alias("evidence_vector")).join(found, "own").select(
        F.col("own").cast("string").alias("window_id"), (F.col("own") % 4).cast("int").alias("answer_index"), "evidence_vector",
        F.slice("vs", 1, 4).alias("candidate_vectors"), F.col("vs")[4].alias("positive_vector"), F.slice("vs", 6, 5).alias("counterfactual_vectors"),
    )


_COS = """SELECT a.vec_id, k, list_dot_product(av, bv) / sqrt(list_dot_product(av, av)) / sqrt(list_dot_product(bv, bv)) AS s FROM
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS av, unnest(range(1, 11)) AS k, (SELECT count(*) FROM embeddings) AS n FROM embeddings) a
    JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS bv FROM embeddings) b ON b.vec_id = (a.vec_id + k) % n"""


@check(
    "cosine_rejection",
    _prf_sql(
        f"""SELECT CAST(sum(CASE WHEN k = 5 AND s >= 0.1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN k > 5 AND s >= 0.1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN k = 5 AND s < 0.1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN k > 5 AND s < 0.1 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM ({_COS}) WHERE k >= 5"""
    ),
)
def cosine_rejection(spark, d):
    m = metrics.rejection_metrics(evaluate.cosine_judgements(evaluate.cosine_rows(vector_sets(spark, d))), "truth", "score", 0.1)
    return tight(m.select(*[F.col(c).alias(f"cf_reject_{c}") for c in ("accuracy", "precision", "recall", "f1")]))


@check(
    "pairwise_rejection",
    f"""SELECT {q6('sum(CASE WHEN s < p - 0.02 THEN 1 ELSE 0 END + CASE WHEN k = 6 THEN 1 ELSE 0 END) / (count(*) * 6 / 5)')} AS cf_pairwise_reject_accuracy,
    {q6('avg(p - s)')} AS cf_pairwise_margin_mean, count(DISTINCT vec_id) AS n_eval_records FROM (SELECT *, max(CASE WHEN k = 5 THEN s END) OVER
    (PARTITION BY vec_id) AS p FROM ({_COS})) WHERE k > 5""",
)
def pairwise_rejection(spark, d):
    return tight(metrics.pairwise_rejection(evaluate.cosine_rows(vector_sets(spark, d)), 0.02))


@check(
    "cosine_selection",
    f"""SELECT {q6('avg(CAST(best = vec_id % 4 AS INT))')} AS caption_selection_accuracy, count(*) AS n_eval_records FROM
    (SELECT vec_id, arg_min(k - 1, (-s, k)) AS best FROM ({_COS}) WHERE k <= 4 GROUP BY 1)""",
)
def cosine_selection(spark, d):
    return tight(metrics.selection_accuracy(evaluate.cosine_rows(vector_sets(spark, d))))


# Field probabilities: hashed weights, at unit sum per field.
_WEIGHTS = " UNION ALL ".join(
    f"SELECT window_id, '{f}' AS field, '{w}' AS word, {k} AS k, {hexnum(f'''concat(window_id, ':{f}:', {k})''')} / 4294967296.0 + 0.001 AS u FROM ev_cards"
    for f, ws in ph.VOCABULARY.items()
    for k, w in enumerate(ws)
)
cx.cte("field_weights", _WEIGHTS)
cx.cte("field_probs", "SELECT window_id, field, word, k, u / sum(u) OVER (PARTITION BY window_id, field) AS p FROM field_weights")
cx.cte("v3_said_claims", f"SELECT window_id, i, {cx.statement_claims('lower(text)')} FROM hard_v3_items")
cx.cte(
    "v3_claim_long",
    " UNION ALL ".join(f"SELECT window_id, i, '{f}' AS field, c_{f} AS word FROM v3_said_claims WHERE c_{f} IS NOT NULL" for f in ph.FIELDS),
)
cx.cte(
    "v3_prob",
    """SELECT i.window_id, i.i, coalesce(avg(p.p), 0.0) AS s FROM hard_v3_items i LEFT JOIN v3_claim_long c ON c.window_id = i.window_id AND c.i = i.i
    LEFT JOIN field_probs p ON p.window_id = c.window_id AND p.field = c.field AND p.word = c.word GROUP BY 1, 2""",
)
cx.cte(
    "v3_prob_rows",
    """SELECT c.window_id, max(a.answer) AS answer, arg_min(c.pos, (-round(s, 12), c.pos)) AS guess, max(s) AS conf FROM hard_v3_choice c JOIN v3_prob p ON p.window_id = c.window_id
    AND p.i = c.i JOIN hard_v3_answer a ON a.window_id = c.window_id GROUP BY 1""",
)
cx.cte("field_guess", "SELECT window_id, field, arg_min(word, (-p, k)) AS word FROM field_probs GROUP BY 1, 2")


def with_probabilities(records):
    entries = []
    for f, ws in ph.VOCABULARY.items():
        u = F.transform(F.sequence(F.lit(0), F.lit(len(ws) - 1)), lambda k: hnum(F.col("window_id"), F.lit(f":{f}:"), k) / F.lit(4294967296.0) + 0.001)  # noqa: B023
        entries += [F.lit(f), u]
    weighed = records.withColumn("field_weights", F.create_map(*entries))
    return weighed.withColumn(
        "field_probabilities",
        F.transform_values("field_weights", lambda _, u: once(total(u), lambda s: F.transform(u, lambda x: x / s))),
    ).drop("field_weights")


@check("probability_scores", f"SELECT window_id, CAST(i AS INT) AS i, {q6('s')} AS score FROM v3_prob")
def probability_scores(spark, d):
    rows = evaluate.probability_rows(with_probabilities(hard(spark, d)))
    return tight(rows.select("window_id", F.posexplode_outer("support_probabilities").alias("i", "score")))


@check("field_predictions", "SELECT window_id, field, word FROM field_guess")
def field_predictions(spark, d):
    rows = evaluate.probability_rows(with_probabilities(hard(spark, d)))
    g = F.col("evidence_predictions")
    return rows.select("window_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), g[f].alias("word")) for f in ph.VOCABULARY])))


def _ece(src: str, truth: str, score: str) -> str:
    return f"""(SELECT sum(CASE WHEN b IS NULL THEN 0 ELSE n * abs(a - c) END) / sum(n) FROM (SELECT CASE WHEN {score} BETWEEN 0 AND 1 THEN
    least(9, list_count(list_filter([i * 0.1::DOUBLE FOR i IN range(1, 11)], lambda e: e <= {score}))) END AS b, count(*) AS n, avg({truth}) AS a, avg({score}) AS c
    FROM ({src}) GROUP BY 1))"""


def _rca(src: str, truth: str, score: str, key: str) -> str:
    return f"""(SELECT greatest(0, least(1, 1 - sum(CASE WHEN i > 1 THEN (1 - cum / i + 1 - (cum - r) / (i - 1)) / 2 ELSE 0 END) / count(*))) FROM
    (SELECT r, CAST(sum(r) OVER w AS DOUBLE) AS cum, row_number() OVER w AS i FROM (SELECT {key} AS k, greatest({score}, 1 - {score}) AS c,
    CAST(CAST({score} >= 0.5 AS INT) = {truth} AS INT) AS r FROM ({src})) WINDOW w AS (ORDER BY c DESC, k ROWS UNBOUNDED PRECEDING)))"""


def _confidence_sql(prefix: str, src: str, truth: str, score: str, key: str) -> list[str]:
    return [
        f"SELECT '{prefix}_brier' AS metric, {q6(f'(SELECT avg(({score} - {truth}) * ({score} - {truth})) FROM ({src}))')} AS value",
        f"SELECT '{prefix}_ece', {q6(_ece(src, truth, score))}",
        f"SELECT '{prefix}_risk_coverage_auc', {q6(_rca(src, truth, score, key))}",
    ]


_CAP = "SELECT window_id, conf, CAST(guess = answer AS INT) AS ok FROM v3_prob_rows"
_SUP = "SELECT concat(window_id, ':', printf('%06d', i)) AS k0, s, CAST(i = 0 AS INT) AS t FROM v3_prob"
_REJ = "SELECT concat(window_id, ':', printf('%06d', i)) AS k0, 1 - s AS s, 1 AS t FROM v3_prob WHERE i > 0"
_FIELD_ACC = (
    "SELECT 'evidence_field_accuracy' AS metric, "
    + q6("avg(CAST(g.word = CASE g.field " + " ".join(f"WHEN '{f}' THEN c.{f}" for f in ph.FIELDS) + " END AS INT))")
    + " AS value FROM field_guess g JOIN ev_cards c ON c.window_id = g.window_id"
)
_CAP_ACC = [
    f"SELECT 'caption_selection_accuracy' AS metric, {q6('avg(CAST(guess = answer AS INT))')} AS value FROM v3_prob_rows",
    "SELECT 'n_eval_records', CAST(count(*) AS DOUBLE) FROM v3_prob_rows",
]
_F1S = """SELECT avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) FROM (SELECT l, CAST(sum(CASE WHEN t = l AND g = l THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    sum(CASE WHEN t <> l AND g = l THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t = l AND g <> l THEN 1 ELSE 0 END) AS fn FROM ({src}),
    (SELECT DISTINCT unnest([t, g]) AS l FROM ({src})) GROUP BY 1)"""


@check(
    "probability_report",
    " UNION ALL ".join(
        [
            *_CAP_ACC,
            f"SELECT 'caption_macro_f1', {q6('(' + _F1S.format(src='SELECT answer AS t, guess AS g FROM v3_prob_rows') + ')')}",
            *_confidence_sql("caption", _CAP, "ok", "conf", "window_id"),
            *_confidence_sql("support", _SUP, "t", "s", "k0"),
            *_confidence_sql("cf_reject", _REJ, "t", "s", "k0"),
            _FIELD_ACC,
            *[
                f"SELECT 'cf_reject_{m}', {q6(e)} FROM (SELECT {_HELD_CELLS.format(p='s >= 0.2')} FROM v3_prob)"
                for m, e in (
                    ("accuracy", "(tp + tn) / (tp + fp + fn + tn)"),
                    ("precision", "tp / greatest(1, tp + fp)"),
                    ("recall", "tp / greatest(1, tp + fn)"),
                    ("f1", "CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"),
                )
            ],
        ]
    ),
)
def probability_report(spark, d):
    rows = evaluate.probability_rows(with_probabilities(hard(spark, d)))
    return tight(reports.probability_report(rows, 0.2))


@check("field_probability_report", " UNION ALL ".join([*_CAP_ACC, _FIELD_ACC, *_confidence_sql("caption", _CAP, "ok", "conf", "window_id")]))
def field_probability_report(spark, d):
    return tight(reports.field_probability_report(evaluate.probability_rows(with_probabilities(hard(spark, d)))))


@check(
    "field_match_scores",
    f"""SELECT window_id, CAST(i AS INT) AS i, {q6('CASE WHEN b > 0 THEN least(0.1, a / greatest(1, a + b)) ELSE a / greatest(1, a + b) END')} AS score FROM
    (SELECT s.window_id, i, CAST({" + ".join(f"CAST(coalesce(c_{f} = {f}, false) AS INT)" for f in ph.FIELDS)} AS DOUBLE) AS a,
    {" + ".join(f"CAST(coalesce(c_{f} <> {f}, false) AS INT)" for f in ph.FIELDS)} AS b FROM v3_said_claims s JOIN ev_cards c ON c.window_id = s.window_id)""",
)
def field_match_scores(spark, d):
    rows = evaluate.field_match_rows(hard(spark, d))
    return tight(rows.select("window_id", F.posexplode_outer("support_probabilities").alias("i", "score")))


@check(
    "best_f1_threshold",
    f"""SELECT {q6('t')} AS threshold, {q6('f')} AS f1 FROM (SELECT t, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM (SELECT t,
    CAST(sum(CASE WHEN truth = 1 AND score >= t THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN truth = 0 AND score >= t THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN truth = 1 AND score < t THEN 1 ELSE 0 END) AS fn FROM bin_rows, (SELECT DISTINCT t FROM (SELECT score AS t FROM bin_rows UNION ALL
    SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]))) GROUP BY 1)) ORDER BY f DESC, t LIMIT 1""",
)
def best_f1_threshold(spark, d):
    return tight(metrics.best_f1_threshold(binary(spark, d), "truth", "score"))


def _margins(records):
    """Yes/no scores per candidate from hashes."""
    n = records.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    return n.select(
        "window_id", "pos",
        F.when(F.col("pos") == 2, hnum(F.col("window_id"), F.lit(":y:"), F.col("pos")) / F.lit(4294967296.0)).alias("margin"),
        (hnum(F.col("window_id"), F.lit(":y:"), F.col("pos")) / F.lit(4294967296.0)).alias("positive_logprob"),
        F.lit(0.1).alias("negative_logprob"),
    )


_YES = f"SELECT window_id, pos, {hexnum('''concat(window_id, ':y:', pos)''')} / 4294967296.0 - CASE WHEN pos = 2 THEN 0 ELSE 0.1 END AS s FROM hard_v3_choice"


@check("margin_choices", f"SELECT window_id, CAST(arg_min(pos, (-s, pos)) AS INT) AS guess, {q6('max(s)')} AS best FROM ({_YES}) GROUP BY 1")
def margin_choices(spark, d):
    records = hard(spark, d)
    rows = evaluate.margin_rows(records, _margins(records))
    return tight(rows.select("window_id", F.col("caption_prediction").alias("guess"), F.array_max("caption_scores").alias("best")))


@check(
    "forced_choices",
    f"""SELECT window_id, CASE WHEN k = 0 THEN 'candidate count' WHEN k = 1 THEN 'not finite' END AS violation, CASE WHEN k > 1 THEN guess END AS guess FROM
    (SELECT window_id, {hexnum('''concat(window_id, ':k')''')} % 10 AS k, CAST(arg_min(pos, (-s, pos)) AS INT) AS guess FROM (SELECT window_id, pos,
    {hexnum('''concat(window_id, ':y:', pos)''')} / 4294967296.0 AS s FROM hard_v3_choice) GROUP BY 1)""",
)
def forced_choices(spark, d):
    records = hard(spark, d)
    w = F.col("window_id")
    k = hnum(w, F.lit(":k")) % 10
    p = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: hnum(w, F.lit(":y:"), i) / F.lit(4294967296.0))
    probs = F.when(k == 0, F.slice(p, 1, 3)).when(k == 1, F.transform(p, lambda x, i: F.when(i == 1, float("-inf")).otherwise(x))).otherwise(p)
    rows = evaluate.choice_rows(records, records.select("window_id", probs.alias("logprobs")), strict=False)
    return rows.select("window_id", "violation", F.col("caption_prediction").alias("guess"))


@check("user_model", f"SELECT window_id, CAST(length(evidence_text) AS DOUBLE) AS score, contains(evidence_text, 'loose') AS flag FROM (SELECT window_id, {cx.easy_text()} AS evidence_text FROM ev_cards)")
def user_model(spark, d):
    import pandas as pd

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"window_id": batch["window_id"], "score": batch["text"].str.len().astype(float), "flag": batch["text"].str.contains("loose")}
        )

    records = easy(spark, d).select("window_id", F.col("positive.text").alias("text"))
    return evaluate.apply_model(records, model, "window_id string, score double, flag boolean")


_SAID = f"SELECT window_id, answer, {hexnum('''concat(window_id, ':r')''')} AS h FROM hard_v3_answer"


@check(
    "answer_summary",
    _prf_sql(
        f"""SELECT {_HELD_CELLS.format(p='(h % 5 <> 0 AND rk % 2 = 0)')}, (SELECT {q6('avg(CAST(CASE WHEN h % 3 = 0 THEN 0 ELSE h % 4 END = answer AS INT))')} FROM ({_SAID}))
    AS caption_selection_accuracy, (SELECT count(*) FROM ({_SAID})) AS n_eval_records, (SELECT {q6('avg(CAST(h % 3 <> 0 AND h % 5 <> 0 AS INT))')} FROM ({_SAID})) AS parse_success_rate
    FROM (SELECT i.window_id, i, h, row_number() OVER (PARTITION BY i.window_id ORDER BY md5(concat('42:', i.window_id, ':support:', i))) - 1 AS rk
    FROM hard_v3_items i JOIN ({_SAID}) s ON s.window_id = i.window_id)"""
    ),
)
def answer_summary(spark, d):
    records = hard(spark, d)
    h = hnum(F.col("window_id"), F.lit(":r"))
    said = F.when(h % 3 == 0, "nothing fits").otherwise(F.concat(F.lit('{"answer_index": '), (h % 4).cast("string"), F.lit("}")))
    support = F.when(h % 5 == 0, "?").otherwise('{"supported": [true, false, true, false, true, false]}')
    answers = records.select("window_id", said.alias("caption_response"), support.alias("support_response"))
    return tight(reports.grounding_summary(evaluate.answer_rows(records, answers)))


_TOLD = hexnum("concat(c.window_id, ':told')") + " % 3"
_OTHER = "CASE burstiness WHEN 'bursty' THEN 'smooth' ELSE 'bursty' END"
_ANSWERED = f"""SELECT c.window_id, {", ".join(
    f"CASE {_TOLD} WHEN 0 THEN {f} WHEN 1 THEN {_OTHER if f == 'burstiness' else 'NULL' if f == 'intensity' else f} END AS f_{f}" for f in ph.FIELDS
)} FROM ev_cards c"""
_CLAIMED = " + ".join(f"CAST(c_{f} IS NOT NULL AS INT)" for f in ph.FIELDS)
_AGREED = " AND ".join(f"(c_{f} IS NULL OR coalesce(c_{f} = f_{f}, false))" for f in ph.FIELDS)


@check(
    "answered_statements",
    f"""SELECT c.window_id, CAST(i AS INT) AS i, (({_CLAIMED}) > 0 AND {_AGREED}) AS held FROM v3_claims c JOIN ({_ANSWERED}) f ON f.window_id = c.window_id""",
)
def answered_statements(spark, d):
    """Statements held against the fields of model answers: whole ones, ones with a wrong and a missing field, and none."""
    records = hard(spark, d)
    e, h = F.col("evidence"), hnum(F.col("window_id"), F.lit(":told")) % 3
    whole = F.to_json(F.struct(*[e[f].alias(f) for f in ph.FIELDS]))
    other = F.when(e["burstiness"] == "bursty", "smooth").otherwise("bursty")
    part = F.to_json(F.struct(*[(other if f == "burstiness" else e[f]).alias(f) for f in ph.FIELDS if f != "intensity"]))
    said = F.when(h == 0, F.concat(F.lit("Fields: "), whole)).when(h == 1, part).otherwise("no idea")
    rows = evaluate.structured_rows_from_answers(records, records.select("window_id", said.alias("response")))
    return rows.select("window_id", F.posexplode_outer("support_predictions").alias("i", "held"))


@check("forest_rows", "SELECT count(*) AS n_eval_records, true AS better_than_guessing FROM ev_cards WHERE split = 'test'")
def forest_rows(spark, d):
    """A random forest over statement vectors: choices of the test records right far more often than one in four."""
    records = stored(hard(spark, d), "forest")
    model = evaluate.fit_statement_classifier(bm.statements(records.filter("split = 'train'")), "random_forest")
    found = reports.grounding_summary(evaluate.classifier_rows(records.filter("split = 'test'"), model))
    return found.select("n_eval_records", (F.col("caption_selection_accuracy") > 0.5).alias("better_than_guessing"))


@check("classifier_rows")
def classifier_rows(spark, d):
    """Logistic regression over statement vectors; trained on the train split, applied to the test split."""
    records = hard(spark, d)
    model = evaluate.fit_statement_classifier(bm.statements(records.filter("split = 'train'")))
    rows = evaluate.classifier_rows(records.filter("split = 'test'"), model)
    return tight(reports.grounding_summary(rows))


# ---- combining ----------------------------------------------------------------------------------


@check(
    "mapped_predictions",
    """SELECT window_id, CAST(alt_mapped AS INT) AS lenient, CAST(alt_mapped AS INT) AS strict FROM whole_sides""",
)
def mapped_predictions(spark, d):
    s = scored(spark, d)
    p, m = F.col("caption_prediction"), F.col("candidate_index_map")
    return s.select("window_id", combine.mapped(p, m).alias("lenient"), combine.mapped(p, m, strict=True).alias("strict"))


@check(
    "short_maps",
    """SELECT window_id, CASE WHEN alt < 2 THEN 3 - alt ELSE alt END::INT AS lenient, CASE WHEN alt < 2 THEN 3 - alt END::INT AS strict, alt >= 2 AS bad FROM scored""",
)
def short_maps(spark, d):
    s = scored(spark, d).withColumn("candidate_index_map", F.array(F.lit(3), F.lit(2)))
    p, m = F.col("caption_prediction"), F.col("candidate_index_map")
    return s.select("window_id", combine.mapped(p, m).alias("lenient"), combine.mapped(p, m, strict=True).alias("strict"), combine.bad_map(p, m).alias("bad"))


def direct_rows(records):
    w = F.col("window_id")
    return records.filter(hnum(w, F.lit(":m")) % 13 != 0).select(
        "window_id", F.when(hnum(w, F.lit(":n")) % 7 != 0, hnum(w, F.lit(":d")) % 4).cast("int").alias("caption_prediction")
    )


HYBRID = """SELECT r.window_id, r.answer, n_held, CASE WHEN n_held = 1 THEN best WHEN d IS NOT NULL THEN d ELSE best END AS guess, d
    FROM v3_rows r LEFT JOIN direct x ON x.window_id = r.window_id"""


@check(
    "hybrid_rows",
    f"SELECT window_id, CAST(guess AS INT) AS guess, CASE WHEN n_held = 1 THEN 'structured' ELSE 'direct_fallback' END AS source FROM ({HYBRID})",
)
def hybrid_rows(spark, d):
    records, rows = structured(spark, d)
    h = combine.hybrid_rows(rows, direct_rows(records))
    return h.select("window_id", F.col("caption_prediction").alias("guess"), F.col("caption_source").alias("source"))


@check(
    "hybrid_summary",
    f"""SELECT {q6('avg(CAST(guess = answer AS INT))')} AS caption_selection_accuracy, count(*) AS n_eval_records, CAST(sum(CAST(n_held <> 1 AS INT)) AS BIGINT) AS caption_fallback_count,
    {q6('avg(CAST(n_held <> 1 AS INT))')} AS caption_fallback_rate, CAST(sum(CAST(n_held <> 1 AND d IS NULL AS INT)) AS BIGINT) AS missing_direct_count,
    {q6('sum(CAST(n_held <> 1 AND guess = answer AS INT)) / greatest(1, sum(CAST(n_held <> 1 AS INT)))')} AS caption_fallback_accuracy,
    {q6('1 - avg(CAST(n_held <> 1 AS INT))')} AS structured_decisive_rate, any_value(cf_reject_accuracy) AS cf_reject_accuracy, any_value(cf_reject_precision) AS cf_reject_precision,
    any_value(cf_reject_recall) AS cf_reject_recall, any_value(cf_reject_f1) AS cf_reject_f1 FROM ({HYBRID}), ({_HELD_PRF})""",
)
def hybrid_summary(spark, d):
    records, rows = structured(spark, d)
    return tight(combine.hybrid_summary(combine.hybrid_rows(rows, direct_rows(records))))


VOTED = """SELECT window_id, dataset, answer, arg_min(pred, (-k, first)) AS vote FROM (SELECT window_id, dataset, answer, pred, count(pred) AS k, min(run) AS first FROM votes
    WHERE pred IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
ALL_VOTED = f"SELECT p.window_id, p.dataset, p.answer, v.vote FROM primaries p LEFT JOIN ({VOTED}) v ON v.window_id = p.window_id"


@check("majority_votes", f"SELECT window_id, CAST(answer AS INT) AS answer, CAST(vote AS INT) AS vote FROM ({ALL_VOTED})")
def majority_votes(spark, d):
    v = combine.vote_rows(votes(spark, d).drop("dataset", "doc_id"))
    return v.select("window_id", F.col("caption_answer_index").alias("answer"), F.col("caption_prediction").alias("vote"))


@check(
    "vote_accuracy",
    f"""SELECT {q6('avg(CAST(CASE WHEN vote <= greatest(p.answer, coalesce(pred, 0)) THEN vote ELSE 0 END = p.answer AS INT))')} AS caption_selection_accuracy, count(*) AS n_eval_records
    FROM ({ALL_VOTED}) v JOIN primaries p ON p.window_id = v.window_id""",
)
def vote_accuracy(spark, d):
    return tight(metrics.selection_accuracy(combine.vote_rows(votes(spark, d).drop("dataset", "doc_id"))))


def gated_sql(t: float) -> str:
    take = f"coalesce(alt IS NOT NULL AND margin > {t}, false)"
    return f"SELECT window_id, dataset, answer, pred AS own, CASE WHEN {take} THEN alt_mapped ELSE pred END AS pred, {take} AS took, margin FROM sides"


@check(
    "gated_rows",
    f"SELECT window_id, CAST(pred AS INT) AS guess, CASE WHEN took THEN 'alternate' ELSE 'primary' END AS source, {q6('margin')} AS margin FROM ({gated_sql(2.0)})",
)
def gated_rows(spark, d):
    g = combine.gate_rows(primaries(spark, d), partners(spark, d), 2.0)
    return tight(
        g.select("window_id", F.col("caption_prediction").alias("guess"), F.col("caption_gate_source").alias("source"), F.col("caption_gate_alternate_margin").alias("margin"))
    )


@check(
    "gated_summary",
    f"""SELECT {q6(f'avg({RIGHT})')} AS caption_selection_accuracy, count(*) AS n_eval_records, CAST(sum(CAST(took AS INT)) AS BIGINT) AS caption_gate_alternate_count,
    {q6('avg(CAST(took AS INT))')} AS coverage FROM ({gated_sql(2.0)})""",
)
def gated_summary(spark, d):
    return tight(combine.gated_summary(combine.gate_rows(primaries(spark, d), partners(spark, d), 2.0)))


SWEEP = " UNION ALL ".join(
    f"""SELECT {t}::DOUBLE AS threshold, avg({RIGHT}) AS acc, avg({RIGHT}) - (SELECT avg({RIGHT}) FROM primaries) AS delta, CAST(sum(CAST(took AS INT)) AS BIGINT) AS taken,
    avg(CAST(took AS INT)) AS cover, count(*) AS n FROM ({gated_sql(t)})"""
    for t in combine.DEFAULT_THRESHOLDS
)


@check(
    "gate_sweep",
    f"""SELECT threshold, {q6('acc')} AS caption_selection_accuracy, {q6('delta')} AS delta_vs_primary, taken AS alternate_count, {q6('cover')} AS coverage,
    n AS n_eval_records FROM ({SWEEP})""",
)
def gate_sweep(spark, d):
    return tight(combine.gate_sweep(primaries(spark, d), partners(spark, d)))


@check("chosen_gate", f"SELECT threshold, {q6('acc')} AS accuracy, taken FROM ({SWEEP}) ORDER BY round(acc, 12) DESC, taken, threshold LIMIT 1")
def chosen_gate(spark, d):
    b = combine.choose_gate(combine.gate_sweep(primaries(spark, d), partners(spark, d)))
    return tight(b.select("threshold", F.col("caption_selection_accuracy").alias("accuracy"), F.col("alternate_count").alias("taken")))


BUCKET = "CAST('0x' || substr(sha256(window_id), 1, 12) AS BIGINT) % 5"


@check(
    "dev_split",
    f"SELECT window_id, CASE WHEN {BUCKET} IN (0, 2) THEN 'dev' ELSE 'eval' END AS side FROM sides WHERE alt IS NOT NULL",
)
def dev_split(spark, d):
    return combine.dev_split(primaries(spark, d), partners(spark, d), 5, [0, 2]).select("window_id", "side")


DEV = " UNION ALL ".join(
    f"""SELECT {t}::DOUBLE AS t, sum(CASE WHEN dev THEN {RIGHT} ELSE 0 END) AS dr, sum(CASE WHEN dev AND took THEN 1 ELSE 0 END) AS dt, sum(CASE WHEN dev THEN 1 ELSE 0 END) AS dn,
    sum(CASE WHEN NOT dev THEN {RIGHT} ELSE 0 END) AS er, sum(CASE WHEN NOT dev AND took THEN 1 ELSE 0 END) AS et, sum(CASE WHEN NOT dev THEN 1 ELSE 0 END) AS en
    FROM (SELECT *, {BUCKET} IN (0, 2) AS dev FROM ({gated_sql(t)}) WHERE margin IS NOT NULL)"""
    for t in combine.DEFAULT_THRESHOLDS
)


@check(
    "calibrated_gate",
    f"""SELECT t AS best_threshold, {q6('dr / dn')} AS dev_accuracy, {q6('dt / dn')} AS dev_coverage, CAST(dn AS BIGINT) AS n_dev, {q6('er / en')} AS eval_accuracy,
    CAST(et AS BIGINT) AS eval_alternate_count, {q6('et / en')} AS eval_coverage, CAST(en AS BIGINT) AS n_eval FROM ({DEV}) ORDER BY dr DESC, dt, t LIMIT 1""",
)
def calibrated_gate(spark, d):
    return tight(combine.calibrate_gate(primaries(spark, d), partners(spark, d), 5, [0, 2]))


_STEPS = [round(i * 0.05, 10) for i in range(21)]
_ROW_SCORES = """SELECT r.window_id, r.answer, best, n_held, d FROM v3_rows r LEFT JOIN direct x ON x.window_id = r.window_id"""
HYBRID_SWEEP = " UNION ALL ".join(
    f"""SELECT {t}::DOUBLE AS t, avg(CAST(CASE WHEN {'false' if t == 0 else 'n_held = 1'} THEN best WHEN d IS NOT NULL THEN d ELSE best END = answer AS INT)) AS acc,
    avg(CAST({'true' if t == 0 else 'n_held <> 1'} AS INT)) AS fb FROM ({_ROW_SCORES})"""
    for t in _STEPS
)


@check("hybrid_sweep", f"SELECT t AS threshold, {q6('acc')} AS caption_selection_accuracy, {q6('fb')} AS caption_fallback_rate FROM ({HYBRID_SWEEP})")
def hybrid_sweep(spark, d):
    records, rows = structured(spark, d)
    s = combine.hybrid_sweep(rows, direct_rows(records))
    return tight(s.select("threshold", "caption_selection_accuracy", "caption_fallback_rate"))


@check(
    "chosen_hybrid",
    f"""SELECT t AS threshold, {q6('acc')} AS accuracy, (SELECT min(t) FROM ({HYBRID_SWEEP}) WHERE round(acc, 12) = round(b.acc, 12)) AS plateau_low,
    (SELECT max(t) FROM ({HYBRID_SWEEP}) WHERE round(acc, 12) = round(b.acc, 12)) AS plateau_high FROM ({HYBRID_SWEEP}) b ORDER BY round(acc, 12) DESC, abs(t - 0.5), t LIMIT 1""",
)
def chosen_hybrid(spark, d):
    records, rows = structured(spark, d)
    b = combine.choose_hybrid(combine.hybrid_sweep(rows, direct_rows(records)))
    return tight(b.select("threshold", F.col("caption_selection_accuracy").alias("accuracy"), "plateau_low", "plateau_high"))


# ---- metrics ------------------------------------------------------------------------------------


@check("accuracy", f"SELECT {q6('avg(CAST(coalesce(pred = answer, false) AS INT))')} AS accuracy, count(*) AS n FROM primaries")
def accuracy(spark, d):
    return tight(metrics.accuracy(primaries(spark, d), "caption_answer_index", "caption_prediction"))


@check("selection_accuracy", f"SELECT dataset, {q6('avg(CAST(s.alt = p.answer AS INT))')} AS caption_selection_accuracy, count(*) AS n_eval_records FROM scored s JOIN primaries p ON p.window_id = s.window_id GROUP BY 1")
def selection_accuracy(spark, d):
    return tight(metrics.selection_accuracy(scored(spark, d), ["dataset"]))


_BIN_CELLS = """CAST(sum(CASE WHEN truth = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN truth = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN truth = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN truth = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn"""


@check(
    "rejection_metrics",
    f"""SELECT cf_reject_accuracy AS accuracy, cf_reject_precision AS "precision", cf_reject_recall AS recall, cf_reject_f1 AS f1 FROM
    ({_prf_sql(f'SELECT {_BIN_CELLS} FROM bin_rows')})""",
)
def rejection_metrics(spark, d):
    return tight(metrics.rejection_metrics(binary(spark, d), "truth", "score"))


@check(
    "macro_f1",
    f"SELECT {q6('(' + _F1S.format(src='SELECT answer AS t, coalesce(pred, 9) AS g FROM primaries') + ')')} AS macro_f1, CAST(5 AS BIGINT) AS labels",
)
def macro_f1(spark, d):
    rows = primaries(spark, d).withColumn("g", F.coalesce("caption_prediction", F.lit(9)))
    return tight(metrics.macro_f1(rows, "caption_answer_index", "g"))


@check("brier_score", f"SELECT {q6('avg((score - truth) * (score - truth))')} AS brier FROM bin_rows")
def brier_score(spark, d):
    return tight(metrics.brier(binary(spark, d), "truth", "score"))


@check("calibration_error", f"SELECT {q6(_ece('SELECT * FROM bin_rows', 'truth', 'score'))} AS ece")
def calibration_error(spark, d):
    return tight(metrics.expected_calibration_error(binary(spark, d), "truth", "score"))


@check("risk_coverage", f"SELECT {q6(_rca('SELECT * FROM bin_rows', 'truth', 'score', 'doc_id'))} AS risk_coverage_auc")
def risk_coverage(spark, d):
    return tight(metrics.risk_coverage(binary(spark, d), "truth", "score", "doc_id"))


@check("majority_label", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def majority_label(spark, d):
    return metrics.majority_label(views.table(spark, d, "events"), "event_type")


def _boot(rows: str, values: list[str]) -> str:
    """Per replicate the sums over outcomes weighed by Poisson counts: the first k whose cumulative share is over the uniform number."""
    label = "concat_ws(',', " + ", ".join(values) + ")"
    sums = ", ".join(f"CAST(sum(w * {v}) AS DOUBLE) AS {v}" for v in values)
    listed = ", ".join(values)
    return f"""SELECT b, CAST(sum(w) AS DOUBLE) AS n, {sums} FROM (SELECT o.*, d.b, (SELECT count(*) FROM shares s WHERE s.label = o.label AND s.c <= d.u) AS w
    FROM outcomes o JOIN draws d ON d.label = o.label) GROUP BY 1""", f"""outcomes AS (SELECT {label} AS label, {listed}, count(*) AS n FROM ({rows}) GROUP BY ALL),
    terms AS (SELECT label, k, exp(k * ln(n) - n - lgamma(k + 1.0)) AS p FROM (SELECT *, unnest(range(0, CAST(n + 12 * sqrt(n) + 40 AS BIGINT))) AS k FROM outcomes)),
    shares AS (SELECT label, sum(p) OVER (PARTITION BY label ORDER BY k) AS c FROM terms),
    draws AS (SELECT label, b, CAST('0x' || substr(md5(concat('42:', label, ':', b)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
    FROM (SELECT label, unnest(range(0, 200)) AS b FROM outcomes))"""


def _with_boot(rows: str, values: list[str], query: str) -> str:
    boot, before = _boot(rows, values)
    return f"SELECT * FROM (WITH {before}, boot AS ({boot}) {query})"


_SAMPLES = "SELECT window_id AS key, CAST(pred = answer AS INT) AS correct FROM primaries WHERE pred IS NOT NULL"


@check(
    "bootstrap_interval",
    _with_boot(
        _SAMPLES,
        ["correct"],
        f"""SELECT (SELECT {q6('avg(correct)')} FROM ({_SAMPLES})) AS point, {q6('quantile_cont(correct / n, 0.025)')} AS lower,
    {q6('quantile_cont(correct / n, 0.975)')} AS upper, (SELECT count(*) FROM ({_SAMPLES})) AS n FROM boot""",
    ),
)
def bootstrap_interval(spark, d):
    return tight(metrics.bootstrap_ci(metrics.caption_samples(primaries(spark, d)), "correct", n_bootstrap=200))


_LR = """SELECT CAST(p.pred = p.answer AS INT) AS l, CAST(s.alt = p.answer AS INT) AS r FROM primaries p JOIN scored s ON s.window_id = p.window_id
    WHERE p.pred IS NOT NULL"""


@check(
    "paired_bootstrap",
    _with_boot(
        _LR,
        ["l", "r"],
        f"""SELECT point, lower, upper, CASE WHEN point >= 0 THEN low ELSE high END AS p_value, n FROM (SELECT (SELECT {q6('avg(l - r)')} FROM ({_LR})) AS point,
    {q6('quantile_cont((l - r) / n, 0.025)')} AS lower, {q6('quantile_cont((l - r) / n, 0.975)')} AS upper, {q6('avg(CAST(l - r <= 0 AS INT))')} AS low,
    {q6('avg(CAST(l - r >= 0 AS INT))')} AS high, (SELECT count(*) FROM ({_LR})) AS n FROM boot)""",
    ),
)
def paired_bootstrap(spark, d):
    a = metrics.caption_samples(primaries(spark, d)).withColumnRenamed("correct", "l")
    b = metrics.caption_samples(scored(spark, d, with_map=False)).withColumnRenamed("correct", "r")
    return tight(metrics.paired_bootstrap(a.join(b, "key"), "l", "r", n_bootstrap=200))


PAIR_COUNTS = """SELECT CAST(sum(CAST(alt IS NOT NULL AS INT)) AS BIGINT) AS n_pairs, CAST(sum(CAST(alt IS NULL AS INT)) AS BIGINT) AS missing_challenger,
    CAST(sum(CASE WHEN alt IS NOT NULL AND p AND c THEN 1 ELSE 0 END) AS BIGINT) AS both_correct, CAST(sum(CASE WHEN alt IS NOT NULL AND NOT p AND NOT c THEN 1 ELSE 0 END) AS BIGINT) AS both_wrong,
    CAST(sum(CASE WHEN alt IS NOT NULL AND p AND NOT c THEN 1 ELSE 0 END) AS BIGINT) AS primary_only_correct, CAST(sum(CASE WHEN alt IS NOT NULL AND NOT p AND c THEN 1 ELSE 0 END) AS BIGINT)
    AS challenger_only_correct FROM (SELECT alt, coalesce(pred = answer, false) AS p, coalesce(alt = answer, false) AS c FROM sides)"""


@check(
    "paired_comparison",
    f"""SELECT *, {q6('(both_correct + primary_only_correct) / n_pairs')} AS primary_accuracy, {q6('(both_correct + challenger_only_correct) / n_pairs')} AS challenger_accuracy,
    {q6('(challenger_only_correct - primary_only_correct) / n_pairs')} AS delta, primary_only_correct + challenger_only_correct AS discordant_count FROM ({PAIR_COUNTS})""",
)
def paired_comparison(spark, d):
    c = metrics.paired_comparison(primaries(spark, d), partners(spark, d, with_map=False))
    return tight(c.drop("two_sided_p_value", "midp_value"))


_TAIL = """SELECT n, s, list_sum(list_transform(range(0, s + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2)))) AS tail,
    exp(lgamma(n + 1.0) - lgamma(s + 1.0) - lgamma(n - s + 1.0) - n * ln(2)) AS last FROM (SELECT primary_only_correct + challenger_only_correct AS n,
    least(primary_only_correct, challenger_only_correct) AS s FROM ({src}))"""


@check(
    "mcnemar",
    f"SELECT n AS discordant_count, {q6('least(1, 2 * tail)')} AS two_sided_p_value, {q6('least(1, 2 * (tail - last / 2))')} AS midp_value FROM ({_TAIL.format(src=PAIR_COUNTS)})",
)
def mcnemar(spark, d):
    c = metrics.paired_comparison(primaries(spark, d), partners(spark, d, with_map=False))
    return tight(c.select("discordant_count", "two_sided_p_value", "midp_value"))


def _fact_sql(choice: str) -> str:
    return f"coalesce((SELECT coalesce(c.fact, 'supported') FROM hard_v3_choice c WHERE c.window_id = r.window_id AND c.pos = {choice}), 'out_of_range')"


CHANGES = f"""SELECT r.window_id, CASE WHEN best <> r.answer AND guess = r.answer THEN 'corrected' WHEN best = r.answer AND guess <> r.answer THEN 'regressed'
    WHEN best = r.answer THEN 'unchanged_correct' ELSE 'unchanged_wrong' END AS kind, CASE WHEN best <> r.answer AND guess = r.answer THEN {_fact_sql('best')}
    WHEN best = r.answer AND guess <> r.answer THEN {_fact_sql('guess')} END AS wrong_fact FROM ({HYBRID}) h JOIN v3_rows r ON r.window_id = h.window_id"""


def _changes(spark, d):
    records, rows = structured(spark, d)
    # Both sides of the comparison read them.
    rows = stored(rows.select("window_id", "caption_answer_index", "caption_prediction", "caption_scores"), "choices")
    return reports.failure_changes(rows, combine.hybrid_rows(rows, direct_rows(records)), records)


@check("failure_taxonomy", f"SELECT kind, wrong_fact, count(*) AS n FROM ({CHANGES}) GROUP BY 1, 2")
def failure_taxonomy(spark, d):
    return reports.failure_taxonomy(_changes(spark, d))


@check(
    "failure_examples",
    f"SELECT window_id, kind, wrong_fact FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY window_id) AS rk FROM ({CHANGES}) WHERE kind IN ('corrected', 'regressed')) WHERE rk <= 8",
)
def failure_examples(spark, d):
    return reports.failure_examples(_changes(spark, d)).select("window_id", "kind", "wrong_fact")


@check(
    "per_fact_accuracy",
    f"""SELECT grouping, fact, count(*) AS n, {q6('avg(ok)')} AS accuracy FROM (SELECT 'overall' AS grouping, 'all' AS fact, CAST(best = answer AS INT) AS ok FROM v3_rows UNION ALL
    SELECT 'gold', {_fact_sql('r.answer')}, CAST(best = answer AS INT) FROM v3_rows r UNION ALL SELECT 'predicted_wrong', {_fact_sql('best')}, 0 FROM v3_rows r WHERE best <> answer)
    GROUP BY 1, 2""",
)
def per_fact_accuracy(spark, d):
    records, rows = structured(spark, d)
    return tight(reports.per_fact_accuracy(rows, records))


_EDGES = [(None, 0.0), (0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (5.0, 10.0), (10.0, None)]
_M = """SELECT margin AS m, CAST(alt_mapped = CASE WHEN doc_id % 3 = 0 THEN (answer + doc_id) % 4 ELSE answer END AS INT) AS ok FROM whole_sides"""


@check(
    "margin_buckets",
    " UNION ALL ".join(
        f"""SELECT '({'-inf' if lo is None else f'{lo:g}'}, {'inf)' if hi is None else f'{hi:g}]'}' AS bucket, count(*) AS count, {q6('coalesce(avg(ok), 0)')} AS alternate_accuracy
    FROM ({_M}) WHERE {'true' if lo is None else f'm > {lo}'} AND {'true' if hi is None else f'm <= {hi}'}"""
        for lo, hi in _EDGES
    ),
)
def margin_buckets(spark, d):
    return tight(reports.margin_buckets(scored(spark, d)).select("bucket", "count", "alternate_accuracy"))


@check(
    "field_rejection",
    f"""SELECT field, count(*) AS total, CAST(sum(ok) AS BIGINT) AS "right", {q6('avg(ok)')} AS recall FROM (SELECT '*positive' AS field, held AS ok FROM v3_held WHERE i = 0 UNION ALL
    SELECT '*counterfactual', 1 - held FROM v3_held WHERE i > 0 UNION ALL SELECT unnest(string_split(fact, '+')), 1 - held FROM v3_held WHERE i > 0) GROUP BY 1""",
)
def field_rejection(spark, d):
    return tight(reports.field_rejection(structured(spark, d)[1]))


@check(
    "support_summary",
    f"""SELECT {q6('(tp + tn) / (tp + fp + fn + tn)')} AS support_accuracy, {q6('tp / greatest(1, tp + fn)')} AS positive_recall, {q6('tn / greatest(1, tn + fp)')} AS negative_recall,
    {q6('(tp / greatest(1, tp + fn) + tn / greatest(1, tn + fp)) / 2')} AS balanced_accuracy, {q6('CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS support_f1,
    {q6('(fp + tn) / (tp + fp + fn + tn)')} AS all_negative_accuracy, CAST(tp + fp + fn + tn AS BIGINT) AS n_support_items FROM (SELECT {_HELD_CELLS.format(p='held = 1')} FROM v3_held)""",
)
def support_summary(spark, d):
    return tight(metrics.support_summary(structured(spark, d)[1]))


RUN_ACC = f"SELECT dataset, run, avg({RIGHT}) AS acc, count(*) AS n FROM votes GROUP BY 1, 2"


def run_metrics(spark, d):
    rows = votes(spark, d)
    ok = (F.coalesce("caption_prediction", F.lit(0)) == F.col("caption_answer_index")).cast("int")
    return rows.groupBy("dataset", "run").agg(F.avg(ok).alias("caption_selection_accuracy"), F.count(F.lit(1)).alias("n_eval_records"))


@check(
    "metric_family",
    f"SELECT dataset, count(*) AS count, {q6('avg(acc)')} AS caption_selection_accuracy_mean, {q6('stddev_samp(acc)')} AS caption_selection_accuracy_std FROM ({RUN_ACC}) GROUP BY 1",
)
def metric_family(spark, d):
    return tight(reports.metric_family(run_metrics(spark, d), "dataset", ["caption_selection_accuracy"]))


@check(
    "subset_accuracy",
    f"""SELECT 'run-' || run AS system, {q6('avg(CAST(coalesce(pred = answer, false) AS INT))')} AS full_accuracy,
    {q6('avg(CASE WHEN doc_id % 4 = 1 THEN CAST(coalesce(pred = answer, false) AS INT) END)')} AS balanced_accuracy, CAST(sum(CAST(doc_id % 4 = 1 AS INT)) AS BIGINT) AS balanced_n,
    count(*) AS full_n, {q6('avg(CASE WHEN doc_id % 4 = 1 THEN CAST(coalesce(pred = answer, false) AS INT) END) - avg(CAST(coalesce(pred = answer, false) AS INT))')} AS delta_balanced_minus_full
    FROM votes GROUP BY run""",
)
def subset_accuracy(spark, d):
    v = votes(spark, d).withColumn("system", F.concat(F.lit("run-"), F.col("run").cast("string")))
    return tight(reports.subset_accuracy(v, v.filter("doc_id % 4 = 1").select("window_id")))


_CONDITIONS = ["visible", "shuffled", "numeric-mask", "hidden", "trend-flip"]


def condition_metrics(spark, d):
    """Run r of the votes stands for condition r: kinds choice (own votes), gated and nogate."""
    v = votes(spark, d).drop("caption_scores")
    alt = partners(spark, d).drop("dataset", "doc_id", "caption_answer_index")
    name = F.element_at(F.array(*[F.lit(c) for c in _CONDITIONS]), F.col("run") + 1)
    parts = []
    for kind, margin in (("gated", 2.0), ("nogate", -1.0)):
        keyed = v.withColumn("condition", name)
        rows = combine.gate_rows(keyed, alt, margin)
        took = (F.col("caption_gate_source") == "alternate").cast("bigint")
        parts.append((kind, rows.withColumn("took", took)))
    parts.append(("choice", v.withColumn("condition", name).withColumn("took", F.lit(0).cast("bigint"))))
    out = None
    for kind, rows in parts:
        ok = (F.coalesce("caption_prediction", F.lit(0)) == F.col("caption_answer_index")).cast("int")
        m = rows.groupBy("dataset", "condition").agg(
            F.avg(ok).alias("caption_selection_accuracy"), F.count(F.lit(1)).alias("n_eval_records"), F.sum("took").alias("alternate_count")
        ).withColumn("kind", F.lit(kind)).withColumn("n_scoring_prompts", F.col("n_eval_records"))
        out = m if out is None else out.unionByName(m)
    return out


_COND = "CASE v.run " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CONDITIONS)) + " END"
_COND_ROWS = f"""SELECT v.dataset, {_COND} AS condition, v.answer, v.pred, CASE WHEN s.alt IS NOT NULL AND margin > 2 THEN s.alt_mapped ELSE v.pred END AS g,
    coalesce(s.alt IS NOT NULL AND margin > 2, false) AS took, coalesce(s.alt_mapped, v.pred) AS ng FROM votes v JOIN sides s ON s.window_id = v.window_id"""
_COND_TABLE = f"""SELECT dataset, condition, avg(CAST(coalesce(pred, 0) = answer AS INT)) AS ca, avg(CAST(coalesce(g, 0) = answer AS INT)) AS ga,
    avg(CAST(coalesce(ng, 0) = answer AS INT)) AS na, count(*) AS n, sum(CAST(took AS INT)) AS k FROM ({_COND_ROWS}) GROUP BY 1, 2"""


@check(
    "control_table",
    f"""SELECT t.dataset, t.condition, {q6('t.ca')} AS choice_accuracy, {q6('t.ga')} AS gated_accuracy, {q6('t.na')} AS nogate_accuracy, t.n AS n_eval_records,
    {q6('t.k / t.n')} AS gated_coverage, {q6('t.ca - v.ca')} AS choice_delta_vs_visible, t.condition <> 'visible' AND round(v.ca - t.ca, 9) < 0.03 AS choice_risk,
    t.condition <> 'visible' AND round(v.ga - t.ga, 9) < 0.03 AS gated_risk FROM ({_COND_TABLE}) t JOIN ({_COND_TABLE}) v ON v.dataset = t.dataset AND v.condition = 'visible'""",
)
def control_table(spark, d):
    return tight(reports.control_table(condition_metrics(spark, d)))


@check(
    "position_prior_table",
    f"""SELECT dataset, {q6('max(CASE WHEN run = 1 THEN acc END)')} AS position_prior_acc, {q6('max(CASE WHEN run = 0 THEN acc END)')} AS choice_acc,
    {q6('max(CASE WHEN run = 0 THEN acc END) - max(CASE WHEN run = 1 THEN acc END)')} AS choice_minus_position, max(n) AS n_eval_records,
    max(CASE WHEN run = 1 THEN acc END) >= 0.25 AS high_prior FROM ({RUN_ACC}) GROUP BY 1""",
)
def position_prior_table(spark, d):
    m = run_metrics(spark, d).filter("run < 2").withColumn("kind", F.when(F.col("run") == 1, "position_prior").otherwise("choice"))
    return tight(reports.position_prior_table(m, 0.25))


@check(
    "override_cost",
    f"""SELECT dataset, n AS n_eval_records, n AS full_choice_prompts, CAST(k AS BIGINT) AS effective_override_prompts, {q6('k / n')} AS gate_coverage FROM ({_COND_TABLE})
    WHERE condition = 'visible'""",
)
def override_cost(spark, d):
    return tight(reports.override_cost(condition_metrics(spark, d).filter("condition = 'visible'")))


_BY_SET = PAIR_COUNTS.replace("FROM (SELECT alt,", "FROM (SELECT dataset, alt,").replace("SELECT CAST(sum(CAST(alt IS NOT NULL", "SELECT dataset, CAST(sum(CAST(alt IS NOT NULL") + " GROUP BY dataset"


_TAIL_BY_SET = f"""SELECT n.*, list_sum(list_transform(range(0, s + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2)))) AS tail,
    exp(lgamma(n + 1.0) - lgamma(s + 1.0) - lgamma(n - s + 1.0) - n * ln(2)) AS last FROM (SELECT *, primary_only_correct + challenger_only_correct AS n,
    least(primary_only_correct, challenger_only_correct) AS s FROM ({_BY_SET})) n"""


@check(
    "system_table",
    f"""SELECT t.dataset, {q6('ca')} AS choice_accuracy, {q6('ga')} AS gated_accuracy, {q6('na')} AS nogate_accuracy, {q6('p.delta')} AS delta_vs_primary,
    {q6('least(1, 2 * (p.tail - p.last / 2))')} AS mcnemar_midp, CAST(k AS BIGINT) AS gate_alternate_count, t.n AS n_eval_records FROM ({_COND_TABLE}) t JOIN (SELECT t.*, (challenger_only_correct - primary_only_correct) / n_pairs AS delta
    FROM ({_TAIL_BY_SET}) t) p ON p.dataset = t.dataset WHERE condition = 'visible'""",
)
def system_table(spark, d):
    own, other = primaries(spark, d), partners(spark, d, with_map=False)
    paired = metrics.paired_comparison(own, other, by=["dataset"])
    t = reports.system_table(condition_metrics(spark, d).filter("condition = 'visible'"), paired)
    return tight(t)


@check("score_invariance", f"SELECT 'same' AS outcome, count(*) AS rows FROM v3_prob HAVING count(*) > 0")
def score_invariance(spark, d):
    """Probability scores before and after the cards are altered; changed rows would show as their own group."""
    read = ("window_id", "dataset_id", "evidence", "caption_selection", "positive", "counterfactuals", "field_probabilities")
    records = stored(with_probabilities(hard(spark, d)).select(*read), "weighed")
    altered = records.withColumn("evidence", F.col("evidence").withField("intensity", F.lit("high")).withField("dominant_axis", F.lit("uncertain")))

    def scores_of(r):
        rows = evaluate.probability_rows(r)
        return rows.select("window_id", F.posexplode_outer("support_probabilities").alias("pos", "score"))

    before = stored(scores_of(records), "scores")
    changed = audit.changed_rows(before, scores_of(altered)).select(F.col("side").alias("outcome"))
    same = before.select(F.lit("same").alias("outcome"))
    return same.unionByName(changed).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


