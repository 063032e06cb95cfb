"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier learns from their votes.

Column functions only. Candidates are what the base patterns match, plus what further patterns match (a card or
phone number next to other digits, national phone numbers, obfuscated addresses). Regex, checksum,
gazetteer and context labelers vote on each; expectation-maximisation estimates how far each can be trusted; a
logistic classifier is trained on the resulting probabilities and decides which further spans to add. Spans that
the base rules accept always stay.

Both fits see counts of vote patterns only, a table bounded by the number of labelers and kinds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesift.llm import weak
from kinesift.llm.text import stored

KINDS = ["email", "ip", "card", "phone"]
#: Possessive runs and look-behinds keep long runs of one class linear; they change no match: within a run of the
#: first class, a start that fails is followed by starts that fail likewise, unless a match ended there.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: (kind, pattern).
MORE = [
    ("email", r"(?i)\b[a-z0-9_%+-]++(?:\.[a-z0-9_%+-]++)*+ ?[\[(]at[\])] ?[a-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[a-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
#: A text without any of these has no candidate.
ANY = r"[0-9@]|[\[(](?i:at)[\])]"
FORMS = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$",
    "card": r"^([0-9]{16}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(\([0-9]{2,4}\)|[0-9]{2,4})([ .-]?[0-9]{2,4}){2,3}$",
}
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl)$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
}
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach)[^A-Za-z]{0,3}(\w+\W+){0,2}$",
    "ip": r"(?i)(\bip\b|server|host|address|from|login)[^A-Za-z]{0,3}(\w+\W+){0,2}$",
    "card": r"(?i)(card|visa|master|credit|payment|karte|tarjeta|carte)[^A-Za-z]{0,3}(\w+\W+){0,2}$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|whatsapp|telefon)[^A-Za-z]{0,3}(\w+\W+){0,2}$",
}
AGAINST = r"(?i)(version|isbn|order|invoice|token|password|section|chapter|release|build|nr|no)[\s.:=#]{1,3}$"
LABELERS = ["v_form", "v_check", "v_gazetteer", "v_context", "v_edges"]
AROUND = 40
BLOCK = 128
ADD_AT = 0.5
#: Labelers here are wrong more often than quality rules, on either side.
YES, NO = (0.6, 0.9995), (0.0005, 0.55)
FIRST = (0.9, 0.3)
STEPS = 15


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def _matches(kind: Column, text: Column, patterns: dict[str, str]) -> Column:
    return _by_kind(kind, {k: text.rlike(p) for k, p in patterns.items()})


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _check(kind: Column, text: Column) -> Column:
    """The base rules' test of a match."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    n = F.length(_digits(text))
    card = n.between(16, 19) & F.call_function("luhn_check", _digits(text))
    return _by_kind(kind, {"email": F.lit(True), "ip": text.rlike(rf"^{part}(?:\.{part}){{3}}$"), "card": card, "phone": n.between(8, 15)})


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): per document its candidate spans (kind, base, start, end, s, before, after) in code points.

    What lies between the matches and the matches themselves have lengths whose running sums are the places. The sums
    are made in blocks, so that many matches cost no square.
    """
    patterns = [*((k, BASE[k]) for k in KINDS), *MORE]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.when(t.rlike(ANY), t).alias("t"))
    ids = range(len(patterns))
    rows = rows.select("key", "t", *[F.regexp_extract_all("t", F.lit(p), 0).alias(f"m{i}") for i, (_, p) in enumerate(patterns)])
    rows = rows.select("*", *[F.when(F.size(f"m{i}") > 0, F.split("t", p, -1)).alias(f"g{i}") for i, (_, p) in enumerate(patterns)])

    def steps(i: int) -> Column:
        before = lambda k: F.coalesce(F.char_length(F.get(f"m{i}", k - 1)), F.lit(0))
        return F.transform(f"m{i}", lambda m, k: F.char_length(F.get(f"g{i}", k)) + before(k))

    rows = rows.select("key", "t", *[f"m{i}" for i in ids], *[F.when(F.col(f"g{i}").isNotNull(), steps(i)).alias(f"d{i}") for i in ids])

    def running(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))

    def blocks(i: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(f"d{i}"), F.lit(BLOCK))
        return F.when(F.col(f"d{i}").isNotNull(), F.transform(starts, lambda b: running(F.slice(f"d{i}", b, BLOCK))))

    rows = rows.select("key", "t", *[f"m{i}" for i in ids], *[blocks(i).alias(f"b{i}") for i in ids])
    rows = rows.select("*", *[running(F.transform(f"b{i}", lambda b: F.element_at(b, -1))).alias(f"o{i}") for i in ids])

    def places(i: int) -> Column:
        return F.flatten(F.transform(f"b{i}", lambda b, k: F.transform(F.slice(b, 2, BLOCK), lambda x: x + F.get(f"o{i}", k))))

    rows = rows.select("key", "t", *[f"m{i}" for i in ids], *[places(i).alias(f"s{i}") for i in ids])

    def spans(i: int) -> Column:
        kind = F.lit(KINDS.index(patterns[i][0]))
        return F.transform(
            f"m{i}",
            lambda m, k: F.struct(
                kind.alias("kind"),
                (F.lit(i < len(KINDS)) & _check(kind, m)).alias("base"),
                F.get(f"s{i}", k).alias("start"),
                (F.get(f"s{i}", k) + F.char_length(m)).alias("end"),
                m.alias("s"),
            ),
        )

    rows = rows.select("key", "t", F.concat(*[F.coalesce(F.when(F.size(f"m{i}") > 0, spans(i)), F.array()) for i in ids]).alias("f"))
    around = F.transform(
        "f",
        lambda c: c.withField("before", F.substring("t", F.greatest(c["start"] - AROUND, F.lit(0)) + 1, F.least(c["start"], F.lit(AROUND)))).withField(
            "after", F.substring("t", c["end"] + 1, F.lit(3))
        ),
    )
    return rows.select("key", F.when(F.col("t").isNotNull(), around).alias("found"))


def _votes(c: Column) -> dict[str, Column]:
    kind, s = c["kind"], c["s"]
    glued = c["before"].rlike(r"[0-9A-Za-z]$") | c["before"].rlike(r"[0-9][ ().-]$") | c["after"].rlike(r"^([0-9A-Za-z@]|[ .-]?[0-9])")
    plain = _by_kind(kind, {"card": _digits(s)} | {k: s for k in KINDS if k != "card"})
    yes_no = lambda x: F.when(x, 1).otherwise(-1)
    return {
        "v_form": yes_no(_matches(kind, s, FORMS)),
        "v_check": yes_no(_check(kind, s)),
        "v_gazetteer": yes_no(_matches(kind, plain, GAZETTEER)),
        "v_context": F.when(_matches(kind, c["before"], CONTEXT), 1).when(c["before"].rlike(AGAINST), -1).otherwise(0),
        "v_edges": yes_no(~glued),
    }


def _features(kind: Column, base: Column, votes: dict[str, Column]) -> list[Column]:
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    return [F.lit(1.0), *[one(kind == k) for k in range(1, len(KINDS))], one(base), *[v.cast("double") for v in votes.values()]]


def train(patterns: DataFrame) -> list[float]:
    """Weights of the span classifier: logistic regression on the label model's probabilities, by Newton steps over
    the pattern counts. Without any candidate all weights are 0."""
    model = weak.fit(patterns, LABELERS, FIRST, YES, NO)
    soft = patterns.withColumn("y", model.posterior())
    x = _features(F.col("kind"), F.col("base"), {v: F.col(v) for v in LABELERS})
    w = np.zeros(len(x))
    for _ in range(STEPS):
        p = 1 / (1 + F.exp(-sum((float(a) * b for a, b in zip(w, x, strict=True)), F.lit(0.0))))
        slope = [F.sum(F.col("n") * (F.col("y") - p) * a) for a in x]
        curve = [F.sum(F.col("n") * p * (1 - p) * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
        got = [float(v or 0.0) for v in soft.agg(*slope, *curve).first()]
        h = np.zeros((len(x), len(x)))
        h[np.triu_indices(len(x))] = got[len(x) :]
        h = h + np.triu(h, 1).T + np.eye(len(x)) * 1.0
        move = np.linalg.solve(h, np.array(got[: len(x)]) - 1.0 * w)
        w = w + move
        if np.abs(move).max() < 1e-5:
            break
    return [float(v) for v in w]


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", add_at: float = ADD_AT) -> DataFrame:
    """(key, base, all): arrays of spans (kind number, start, end), each sorted; ``base`` by the base rules, ``all`` with
    those the classifier adds.

    No span is added that fails its kind's checksum or range. Added spans overlap no base span of their kind and no earlier (or, from the same start, longer) added one. Null
    texts are empty and have none; repeated rows repeat; an empty table gives an empty one.
    """
    found = stored(candidates(docs, key, text), "pii-candidates")
    each = found.select(F.explode("found").alias("c"))
    votes = each.select(F.col("c.kind").alias("kind"), F.col("c.base").alias("base"), *[v.alias(k) for k, v in _votes(F.col("c")).items()])
    weights = train(weak.pattern_counts(votes, LABELERS, "kind", "base"))

    def chance(c: Column) -> Column:
        x = _features(c["kind"], c["base"], _votes(c))
        return 1 / (1 + F.exp(-sum((a * b for a, b in zip(weights, x, strict=True)), F.lit(0.0))))

    place = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    sorted_places = lambda x: F.array_sort(F.array_distinct(F.transform(x, place)))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    rows = found.select(
        "key",
        F.coalesce(sorted_places(F.filter("found", lambda c: c["base"])), none).alias("base"),
        F.coalesce(sorted_places(F.filter("found", lambda c: ~c["base"] & _check(c["kind"], c["s"]) & (chance(c) >= add_at))), none).alias("extra"),
    )
    meet = lambda a, b: _all(a["kind"] == b["kind"], a["start"] < b["end"], b["start"] < a["end"])
    free = rows.withColumn("extra", F.filter("extra", lambda a: ~F.exists("base", lambda b: meet(a, b))))
    before = lambda b, a: (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["end"] > a["end"]))
    alone = free.withColumn("extra", F.filter("extra", lambda a: ~F.exists("extra", lambda b: meet(a, b) & before(b, a))))
    return alone.select(F.col("key").alias(key), "base", F.array_sort(F.concat("base", "extra")).alias("all"))


def listed(places: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(places, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def count(places: Column, kind: str) -> Column:
    return F.size(F.filter(places, lambda p: p["kind"] == KINDS.index(kind))).cast("long")
