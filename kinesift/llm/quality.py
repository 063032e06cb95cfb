"""Quality rules as weak labelers: their votes, weighed by learnt reliability, decide which documents stay.

Column functions only: no Python runs on the executors. A document's measures stay on its row; the one
shuffle before the result counts vote patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.llm import weak
from kinesift.llm.text import stored, words_of

WINDOW = 8
LEAST_WORDS = 20
#: Chance of being good text from which a document stays. In doubt it does.
KEEP_AT = 0.3

RULES = ["v_length", "v_word_size", "v_symbols", "v_repeats", "v_shouting", "v_letters", "v_sentences", "v_variety", "v_lines"]
#: Chances of a vote "for" on good and on bad text before any data are seen. One rule is thought better than the others, so
#: that it is clear which class is the good one; how far each can be trusted is learnt, and a rule that good texts often
#: break is outvoted.
FIRST = {rule: (0.9, 0.5) for rule in RULES} | {"v_symbols": (0.99, 0.1)}
YES, NO, ANCHOR = (0.5, 0.9995), (0.0005, 0.995), 0.02
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _repeat_words(m: Column) -> Column:
    """Words covered by the windows at the sorted 1-based positions ``m``."""
    return F.aggregate(
        F.transform(m, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(m, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    ).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (a struct column ``row`` of its columns) with the base measures and those the rules look at.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting them finds the repeats in
    n log n, and only in texts that have some.
    """
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    words = docs.select("row", t.alias("_t"), words_of(t).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = words.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        _without(F.col("_t"), " \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.char_length("_t") - _without(F.col("_t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        (F.char_length("_t") - _without(F.col("_t"), "!?")).cast("long").alias("n_marks"),
        (F.char_length("_t") - _without(F.col("_t"), ".,;:!?")).cast("long").alias("n_stops"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    hashed = one.select(
        *[c for c in one.columns if c not in ("_lines", "_h")],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_h") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])
            ),
        ).alias("_g"),
    )
    kept = [c for c in hashed.columns if c != "_g"]
    ordered = hashed.select(
        *kept,
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("_s"),
    )
    twice = ordered.select(
        *kept,
        F.array_sort(
            F.transform(
                F.filter(
                    "_s",
                    lambda x, k: F.coalesce(F.get("_s", k - 1)["g"] == x["g"], F.lit(False))
                    | F.coalesce(F.get("_s", k + 1)["g"] == x["g"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ).alias("_m"),
    )
    return twice.select(*kept, F.coalesce(_repeat_words(F.col("_m")), F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def with_votes(rows: DataFrame) -> DataFrame:
    """One column per rule: 1 for keeping, -1 against, 0 where the rule has no opinion."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    letters = F.greatest(c("n_letters"), F.lit(1))
    size, stops, lines = c("word_chars") / n, c("n_stops") / n, n / F.greatest(c("n_lines"), F.lit(1))
    variety = c("n_distinct") / F.sqrt(n)
    return rows.withColumns(
        {
            "v_length": _vote((n >= 50) & (n <= 100_000), c("n_words") < LEAST_WORDS),
            "v_word_size": _vote((size >= 3) & (size <= 10), (size < 2) | (size > 20)),
            "v_symbols": _vote(c("n_symbols") <= 0.05 * n, c("n_symbols") > 0.1 * n),
            "v_repeats": _vote(
                (c("n_repeat_words") <= 0.1 * n) & (c("n_dup_lines") <= 0.1 * c("n_lines")),
                (c("n_repeat_words") > 0.3 * n)
                | (c("n_dup_lines") > 0.5 * c("n_lines"))
                | ((n >= LEAST_WORDS) & (c("n_distinct") < 2 * F.sqrt(n))),
            ),
            "v_shouting": _vote(
                (c("n_upper") <= 0.15 * letters) & (c("n_marks") <= 0.05 * n), (c("n_upper") > 0.4 * letters) | (c("n_marks") > 0.25 * n)
            ),
            "v_letters": _vote(c("n_letters") >= 0.9 * chars, c("n_letters") < 0.9 * chars),
            "v_sentences": _vote((stops >= 0.08) & (stops <= 0.3), (stops < 0.06) | (stops > 0.35)),
            "v_variety": _vote(variety >= 6, variety < 5),
            "v_lines": _vote((lines >= 8) & (lines <= 120), (lines < 6) | (lines > 160)),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, columns: list[str] | None = None, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Measures, votes, ``posterior`` (chance of being good text), ``base_failed`` and ``kept`` of every document.

    ``row`` holds ``columns`` of the input (all, if not given). ``kept`` is false where the base rules fail,
    else it tells whether the posterior reaches ``keep_at``. Null and empty texts have no word and fail; repeated
    rows are judged alike; an empty table gives an empty one. The measures are written once: the fit of the
    rules' reliabilities and the result both start from them.
    """
    wanted = columns or docs.columns
    rows = measured(docs.select(F.struct(*dict.fromkeys([*wanted, text])).alias("row")), text)
    if text not in wanted:
        rows = rows.withColumn("row", F.struct(*[F.col(f"row.{c}").alias(c) for c in wanted]))
    votes = stored(with_votes(rows), "quality-votes")
    model = weak.fit(weak.pattern_counts(votes, RULES), RULES, FIRST, YES, NO, anchor=ANCHOR)
    out = votes.withColumn("posterior", model.posterior()).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))


def keep_good(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that ``judged`` keeps, with their columns as they are."""
    return judged(docs, None, text, keep_at).filter("kept").select("row.*")
