"""One registered query per operator of this folder, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesift.llm import ann, chat, lines, mixing, periods, pieces, pii, quality, repair, simhash, suffixes, toxicity, urls
from kinesift.llm.text import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


ORACLES["op5_urls"] = urls.judged_sql()
# Any fixed order of words gives right prefixes; long words are rare enough here.
ORACLES["op10_line_dedup"] = r"""
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS no FROM doc),
words AS (
    SELECT doc_id, no, list_sort(list_transform(list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+')), lambda x: {'k': -length(x), 'x': x})) AS w
    FROM line
),
cut AS (SELECT * FROM words WHERE len(w) > 0),
sets AS (SELECT w, len(w) AS n, min((doc_id, no)) AS first FROM cut GROUP BY w),
numbered AS (SELECT row_number() OVER () AS id, * FROM sets),
entries AS (SELECT id, n, unnest(w[1:n - CAST(ceil(n * 4 / 5) AS INT) + 1]) AS word FROM numbered),
pairs AS (
    SELECT DISTINCT a.id AS a, b.id AS b FROM entries a JOIN entries b
    ON a.word = b.word AND a.id <> b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
),
gone AS (
    SELECT DISTINCT b.w FROM pairs p JOIN numbered a ON p.a = a.id JOIN numbered b ON p.b = b.id
    WHERE a.first < b.first AND 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)
),
marked AS (
    SELECT c.doc_id, c.no, (s.first < (c.doc_id, c.no) OR g.w IS NOT NULL) AS removed
    FROM cut c JOIN sets s ON c.w = s.w LEFT JOIN gone g ON c.w = g.w
)
SELECT d.doc_id, count(m.no) AS n_lines, count(*) FILTER (m.removed) AS n_removed,
       coalesce(string_agg(m.no::VARCHAR, ',' ORDER BY m.no) FILTER (m.removed), '') AS removed
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *quality.BASE, "base_failed", "kept", "posterior")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; what is known of a row travels in its key."""
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.sha2("text", 256).alias("digest")).alias("key"), "text")
    ids = pieces.encoded(docs, "key").select(F.struct("key.*", F.col("ids")).alias("key"), "ids")
    back = pieces.decoded(ids, "key")
    same = F.sha2("text", 256).eqNullSafe(F.col("key.digest"))
    return back.select("key.doc_id", F.size("key.ids").alias("n_ids"), "key.ids", same.alias("round_trip"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.repeated_lines(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("m"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("m") == F.col("mark")), "left")
    removed = F.coalesce(F.array_join("removed", ","), F.lit(""))
    return both.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("removed").isNotNull(), F.size("removed")), F.lit(0)).cast("long").alias("n_removed"),
        removed.alias("removed"),
    )


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("all")).alias("spans"),
    )


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, with a share of markers lost; roles are learnt outside the held-out fifth."""
    raw = stored(chat.raw_transcripts(chat.pieces(table(spark, sf_dir, "conversations"))), "transcripts")
    known = raw.filter(~F.coalesce(chat.held_out(F.col("key")), F.lit(True)))
    model = chat.fit(known.select(F.transform(F.split("text", "\n"), chat.observed).alias("seen"), "state"))
    rows = raw.select(F.struct("key", "piece", F.array_join("state", "").alias("true_states")).alias("key"), "text")
    found = chat.formatted(rows, model)
    held = F.coalesce(chat.held_out(F.col("key.key")), F.lit(True)).alias("held_out")
    return found.select(F.col("key.key").alias("conv_id"), "key.piece", held, "roles", "states", "key.true_states", "chat")


@query
def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule of the row's key, and what repairs them."""
    turns = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_rows(table(spark, sf_dir, "documents"))


@query
def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest_rows(table(spark, sf_dir, "documents"))
