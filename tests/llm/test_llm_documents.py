"""Document operators against plain versions, and their defined results on odd input."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinesift.llm import lines, mixing, pii, quality, simhash, toxicity, weak
from kinesift.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    ids = ids or range(len(texts))
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


ODD = [None, "", "  \n\t ", "one", "two words", "a b É", "x " * 30000, "same text here", "same text here"]


# --- SimHash ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks, bits=3):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(marks)), 2):
        if bin(marks[i] ^ marks[j]).count("1") <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(marks))]


def test_fingerprints_and_components_equal_all_pairs(spark):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(12):
        base = words(rng, 300).split()
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = "Changed"
            texts.append(" ".join(near))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).select("*", simhash.hexed(F.col("fp")).alias("h")).collect()}
    marks = [plain_fingerprint(t) for t in texts]
    assert [got[i].h for i in range(len(texts))] == [f"{m:016x}" for m in marks]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(marks)
    assert got[1].component_id == 0 and got[2].component_id == 0


def test_anchors_lose_no_link(spark):
    rng = random.Random(2)
    marks = [rng.getrandbits(64) for _ in range(60)]
    for m in list(marks[:40]):
        for n in (1, 2, 3, 4):
            marks.append(m ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [m - (1 << 64) if m >> 63 else m for m in set(marks)]
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long")).collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= 3}
    assert found == want and len(want) >= 120


def test_anchors_are_not_broadcast(spark, tmp_path):
    """Small fingerprints have many anchors: Spark sizes a side by the former."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/marks")
    plan = simhash.links(spark.read.parquet(f"{tmp_path}/marks"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {(r.node, r.root) for r in components(chain).collect()}
    assert got == {(i, 0) for i in range(201)}
    assert components(chain.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    clash = docs(spark, ["a b c d e", "a b c d e", None, "", "other words are here"]).withColumn("fp", F.lit("kept")).withColumn("component_id", F.lit(7))
    got = simhash.drop_near_duplicates(clash)
    assert got.columns == clash.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 4]
    twice = docs(spark, ["a b c", "a b c", "z y x"], ids=[4, 4, 9])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(twice).collect()) == [4, 9]
    assert simhash.drop_near_duplicates(clash.limit(0)).count() == 0


def test_simhash_with_null_keys(spark):
    got = simhash.near_duplicates(docs(spark, ["p q r", "p q r", "u v w"], ids=[None, 5, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.component_id is not None) == [(False, 5), (True, 5)]


def test_one_row_of_each_group_stays_whatever_the_keys(spark):
    one, two, three = "p q r s t u", "other words are here now", "and a third text of seven words"
    kept = lambda texts, ids: sorted(simhash.drop_near_duplicates(docs(spark, texts, ids=ids)).select("doc_id", "text").collect(), key=str)
    assert {r.text for r in kept([one, two, three, one], [None, None, None, None])} == {one, two, three}
    assert kept([one, two], [1, 1]) == [(1, two), (1, one)]
    # Key 2 heads its own group and is a mere copy in that of key 1.
    assert kept([one, one, two], [1, 2, 2]) == [(1, one), (2, two)]
    assert len(kept([one, two, one, two], [1, 1, 1, 1])) == 2


# --- quality ---------------------------------------------------------------------------------------------------


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


def test_quality_measures_equal_plain_ones(spark):
    rng = random.Random(3)
    block = words(rng, 11)
    texts = [*ODD, "a b c d e f g h " * 3, f"{words(rng, 30)} {block} x {block}", "l one\nl one\n\nl two\n \nl one", "q " * 9, "# | a*b 𝄞𝄞 é"]
    rows = quality.judged(docs(spark, texts)).select("row.doc_id", *quality.BASE, "base_failed", "kept").collect()
    for r in rows:
        n, chars, symbols, dup, rep = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), texts[r.doc_id][:40]
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)


def test_quality_keeps_prose_and_drops_faults(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["the", "river", "light", "stone", "walks", "under", "green", "cloud", "a", "of"]) + rng.choice("abcdefgh") for _ in range(120)) for _ in range(60)]
    symbols = [" ".join(x + "%%%" for x in p.split()) for p in prose[:4]]
    shouting = [" ".join(x.upper() + "!!" for x in p.split()) for p in prose[:4]]
    repeated = ["go " * 80, "on and " * 60]
    bad = symbols + shouting + repeated
    table = docs(spark, prose + bad).withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x"))
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(60))
    assert quality.keep_good(table.limit(0)).count() == 0


def plain_posteriors(votes):
    """Expectation-maximisation row by row, without patterns."""
    first = np.array([quality.FIRST[r] for r in quality.RULES])
    rates, prior, n = first.copy(), 0.5, len(votes)
    for step in range(weak.ROUNDS):
        odds = np.full(n, np.log(prior / (1 - prior)))
        for i, (yes, no) in enumerate(rates):
            odds += np.where(votes[:, i] == 1, np.log(yes / no), np.where(votes[:, i] == -1, np.log((1 - yes) / (1 - no)), 0.0))
        good = 1 / (1 + np.exp(-odds))
        moved = np.empty_like(rates)
        for i in range(len(rates)):
            for k, (w, bounds) in enumerate(((good, quality.YES), (1 - good, quality.NO))):
                held = quality.ANCHOR * n
                rate = (w[votes[:, i] == 1].sum() + held * first[i, k]) / (w[votes[:, i] != 0].sum() + held)
                moved[i, k] = min(max(rate, bounds[0]), bounds[1])
        new = min(max(good.mean(), 0.02), 0.98)
        change = max(abs(new - prior), np.abs(moved - rates).max())
        rates, prior = moved, new
        if change < weak.SETTLED:
            break
    odds = np.full(n, np.log(prior / (1 - prior)))
    for i, (yes, no) in enumerate(rates):
        odds += np.where(votes[:, i] == 1, np.log(yes / no), np.where(votes[:, i] == -1, np.log((1 - yes) / (1 - no)), 0.0))
    return 1 / (1 + np.exp(-odds)), rates


def test_quality_verdict_equals_plain_estimation(spark):
    """On the given documents: the same posteriors, rates inside their bounds, rules outvoted on some that stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judged(table, ["doc_id"]).orderBy("row.doc_id").collect()
    votes = np.array([[r[x] for x in quality.RULES] for r in rows])
    want, rates = plain_posteriors(votes)
    assert np.allclose([r.posterior for r in rows], want, atol=1e-6)
    assert sum(0.5 < yes < 0.9995 for yes, _ in rates) >= 6 and all(0.0005 < no < 0.995 for _, no in rates)
    against = [(r.kept, -1 in v.tolist()) for r, v in zip(rows, votes, strict=True) if not r.base_failed]
    assert sum(kept and no for kept, no in against) >= 3 and sum(not kept for kept, _ in against) >= 10
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(marks[r.row.doc_id], r.kept) for r in rows if r.row.doc_id in marks and not r.base_failed]
    assert np.mean([kept for q, kept in judged if q == 1]) > 0.99 and np.mean([kept for q, kept in judged if q == 0]) < 0.05


def test_label_model_recovers_reliabilities(spark):
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.8
    votes = {}
    for name, good, bad in (("a", 0.97, 0.2), ("b", 0.9, 0.3), ("c", 0.95, 0.5)):
        cast = rng.random(4000) < 0.9
        says = np.where(truth, rng.random(4000) < good, rng.random(4000) < bad)
        votes[name] = np.where(cast, np.where(says, 1, -1), 0)
    rows = spark.createDataFrame([tuple(map(int, r)) for r in zip(*votes.values())], "a int, b int, c int")
    m = weak.fit(weak.pattern_counts(rows, list("abc")), list("abc"), (0.9, 0.4), (0.6, 0.999), (0.01, 0.6), rounds=60)
    assert abs(m.prior - 0.8) < 0.1 and abs(m.rates["a"][1] - 0.2) < 0.15 and m.rates["a"][0] > 0.9
    assert weak.fit(weak.pattern_counts(rows.limit(0), list("abc")), list("abc")).prior == 0.5


# --- lines -----------------------------------------------------------------------------------------------------


def plain_repeats(texts):
    earlier, out = [], {}
    for i, t in enumerate(texts):
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(line.encode().split())
            if s:
                if any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                    gone.append(k)
                earlier.append(s)
        out[i] = gone
    return out


@pytest.mark.parametrize("salts", [16, 1])
def test_repeated_lines_equal_all_pairs(spark, monkeypatch, salts):
    monkeypatch.setattr(lines, "SALTS", salts)
    rng = random.Random(6)
    texts = list(ODD)
    stock = [words(rng, rng.randrange(1, 40), 90) for _ in range(60)]
    for _ in range(80):
        some = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(stock).split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(90)}"
            some.append(" ".join(w))
        texts.append(rng.choice(["\n", "\n\n", " \n"]).join(some))
    got = {r.doc: list(r.removed) for r in lines.repeated_lines(docs(spark, texts)).collect()}
    want = plain_repeats(texts)
    assert {i: g for i, g in want.items() if g} == {i: g for i, g in got.items() if g}
    assert sum(map(len, want.values())) > 40


@pytest.mark.parametrize("few", [0, 6])
def test_bands_of_length_lose_no_pair(spark, monkeypatch, few):
    """Every word, or every word of more than six lines, is met by bands of length."""
    monkeypatch.setattr(lines, "FEW", few)
    rng = random.Random(14)
    texts = []
    for n in (*range(1, 14), 16, 20, 25, 31, 40, 50):
        w = words(rng, n, 60).split()
        texts += [" ".join(w), " ".join(w[: -(-4 * n // 5)]), " ".join(w[: n // 2]), " ".join([*w, *[f"more{n}x{i}" for i in range(n // 4)]])]
    rng.shuffle(texts)
    got = {r.doc: list(r.removed) for r in lines.repeated_lines(docs(spark, texts)).collect()}
    want = plain_repeats(texts)
    assert {i: g for i, g in got.items() if g} == {i: g for i, g in want.items() if g} and sum(map(len, want.values())) > 20


def test_sets_of_other_lengths_do_not_meet(spark, monkeypatch):
    """One word in many lines: its sets meet by word and band, so far fewer pairs of rows than all are looked at."""
    monkeypatch.setattr(lines, "FEW", 0)
    rows = [(i, 4 + i, 0, 0, True, 0, [7]) for i in range(400)]
    sets = spark.createDataFrame(rows, "at long, n int, p0 long, p1 long, open boolean, rare int, prefix array<int>")
    pairs = lines._pairs(lines._entries(sets, "open"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [meet#" in plan and "Broadcast" not in plan
    entries = lines._entries(sets.withColumn("p0", F.lit(0)), "open").withColumn("pos", F.lit(0))
    close = {(r.b, r.a) for r in lines._pairs(entries).collect()}
    assert close == {(j, i) for i in range(400) for j in range(i + 1, 400) if 5 * (4 + i) >= 4 * (4 + j)}


def test_counts_of_very_frequent_words_differ(spark):
    """Words are ordered by rarity however many lines have them; counts of 12 bits are exact where words are rare."""
    texts = ["\n".join(f"a{k % 9000} " + ("b " if k % 3 else "") + "c" for k in range(i, 30000, 10)) for i in range(10)]
    counts = lines.word_counts(docs(spark, texts), "text")
    word = lines.LineReader().lines(pa.array(["b", "c"]))["word"]
    b, c = counts[lines._counter(word)].tolist()
    assert b < c < 4096
    assert lines._code(np.arange(2049)).tolist() == list(range(2049)) and (np.diff(lines._code(2 ** np.arange(11, 40)).astype(int)) > 0).all()


def test_words_of_pairs_are_read_once(spark, monkeypatch):
    """Texts are read for the neighbours and for the pairs, not again for the pairs that stay open; only texts that hold an asked set."""
    calls = {"words_of_sets": 0, "_verified": 0}
    for name in calls:

        def counted(*args, name=name, plain=getattr(lines, name)):
            calls[name] += 1
            return plain(*args)

        monkeypatch.setattr(lines, name, counted)
    rng = random.Random(12)
    texts = []
    for _ in range(120):
        w = [f"w{k}" for k in range(30)]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(30)] = f"x{rng.randrange(40)}"
        texts.append("\n".join([" ".join(w), "its own " + words(rng, 12, 5000)]))
    got = {r.doc: (r.n_lines, list(r.removed)) for r in lines.repeated_lines(docs(spark, texts)).collect()}
    assert got == {i: (2, g) for i, g in plain_repeats(texts).items()}
    assert calls == {"words_of_sets": 2, "_verified": 3}


def test_line_dedup_texts_and_columns(spark):
    texts = ["first line of it\nsecond line\n\nthird", "second line\nfresh words\n", "third", None, "", "fresh words"]
    table = docs(spark, texts).withColumn("removed", F.lit("x")).withColumn("doc", F.lit(3)).withColumn("row", F.lit(2.5))
    got = {r.doc_id: r for r in lines.drop_repeated_lines(table).collect()}
    assert {i: r.text for i, r in got.items()} == {0: texts[0], 1: "fresh words\n", 3: None, 4: ""}
    assert got[1].n_chars == 12 and got[1].removed == "x" and lines.drop_repeated_lines(table).columns == table.columns
    assert lines.drop_repeated_lines(table.limit(0)).count() == 0
    same = lines.drop_repeated_lines(docs(spark, ["a b", "a b", "c"], ids=[1, 1, None]))
    assert sorted((r.doc_id or 0, r.text) for r in same.collect()) == [(0, "c"), (1, "a b"), (1, "a b")]


# --- mixing ----------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if target[s] + weight[s] * share >= 3 * sizes[s]}
        for s in free - over if over else free:
            target[s] += weight[s] * share
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over
        left = total - sum(target.values())
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(400)] + [None, "", "z " * 4000]
    sources = [rng.choice(["big"] * 12 + ["b", "tiny", "Ä", None]) for _ in texts]
    rows = mixing.mixed(docs(spark, texts, sources)).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.times <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.times
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in rows) and len(rows) == len(texts)
    want = plain_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mixed(docs(spark, texts, sources).repartition(7)).collect()
    assert sorted((r.doc_id, r.times) for r in again) == sorted((r.doc_id, r.times) for r in rows)


def test_subset_program_is_optimal():
    rng = random.Random(8)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(2, 30), 4)))
        spare = np.array([rng.randrange(0, 4) for _ in lengths])
        budget = rng.randrange(0, 90)
        got = mixing.fit_subset(budget, lengths, spare)
        sums = {int(np.dot(c, lengths)) for c in itertools.product(*(range(s + 1) for s in spare))}
        assert (got <= spare).all() and int(got @ lengths) == max(s for s in sums if s <= budget)


def test_long_texts_come_near_the_target():
    def taken(target, lengths, counts):
        passes, extra = mixing.plan_lengths(target, np.array(lengths), np.array(counts))
        assert (extra >= 0).all() and (extra <= counts).all()
        return int(((passes * np.array(counts) + extra) * lengths).sum())

    assert taken(279_000, [100, 300_000], [100, 1]) == 300_000
    assert taken(650_000, [200_000, 300_000, 350_000], [1, 1, 1]) == 650_000
    assert abs(taken(70_000_000, [30_000_000, 40_000_001, 55_000_000, 7], [1, 1, 1, 9]) - 70_000_000) <= 7
    # Of equally frequent lengths, the longest are drawn as well as the shortest.
    lengths = np.arange(1, 4001)
    extra = mixing.plan_lengths(lengths.sum() / 2, lengths, np.ones(4000, np.int64))[1]
    assert 0.3 < extra[2000:].mean() < 0.7 and int(extra @ lengths) == lengths.sum() // 2


def test_drawn_documents(spark):
    table = docs(spark, ["a b c d", "e f", None, "g"], ["x", "y", "y", "x"]).withColumn("times", F.lit("t")).withColumn("row", F.lit(0))
    got = mixing.draw(table)
    times = {r.doc_id: r.times for r in mixing.mixed(table).collect()}
    count = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert got.columns == table.columns and count == {i: n for i, n in times.items() if n}
    assert mixing.draw(table.limit(0)).count() == 0
    twice = docs(spark, ["a b", "c d", "e"], ["x", "x", "y"], ids=[1, 1, 2])
    assert mixing.draw(twice).count() == sum(r.times for r in mixing.mixed(twice).collect())


# --- personal data ---------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


PRIVATE = [
    *ODD, "mail a.b@c.de, x@y and %d@e.f.g; a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1 1..2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (314) 555-6532 4111111111111111", "call +49 30 1234567890, 😀 +1 2", "v@" * 50 + "a.b", "7" * 5000, "+" * 50 + "1 " * 200, " ".join(f"u{i}@h{i}.org" for i in range(300)),
]


def test_base_spans_equal_plain_ones(spark):
    rng = random.Random(9)
    texts = PRIVATE + ["".join(rng.choice("ab@.+-% 0123456789()😀") for _ in range(200)) for _ in range(60)]
    rows = pii.spans(docs(spark, texts)).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("all")).alias("a"), pii.count(F.col("base"), "email").alias("n")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.b == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r.a.split(",")) | {""} and r.n == sum(x.startswith("email") for x in want)
    added = {r.doc_id: set(r.a.split(",")) - set(r.b.split(",")) for r in rows}
    glued = texts.index("+1 (314) 555-6532 4111111111111111")
    assert {"phone:0:17", "card:18:34"} & added[glued]
    assert pii.spans(docs(spark, texts).limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(10)
    texts, labels = [], []
    for i in range(600):
        t = words(rng, rng.randrange(20, 200), 150).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["vile", "awful"])
        texts.append(" ".join(t))
        labels.append((i, 1, int(bad)))
    table = docs(spark, [*texts, None, "", "x " * 20000], ids=[*range(600), 900, 901, None])
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (7000, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(table.withColumn("x", F.lit(1)).withColumn("toxic", F.lit(1)), marks).collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by.items() if i is not None)
    held = [i for i in range(600) if by[i].held_out]
    assert np.mean([by[i].predicted == labels[i][2] for i in held]) > 0.95
    assert by[900].score == by[901].score < 0.5


def plain_differences(texts, toxic):
    """The mean differences of all texts by a model of those with a label, in dictionaries."""
    n, pairs = {}, {}
    split = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    for w, y in zip(split, toxic, strict=True):
        if y is not None:
            for table, found in ((n, set(w)), (pairs, set(itertools.pairwise(w)))):
                for x in found:
                    table.setdefault(x, [0, 0])[y] += 1
    total = [sum(c[k] for c in n.values()) for k in (0, 1)]
    share = [t / sum(total) for t in total]

    def weight(c, e):
        left = [e[k] + np.sign(c[k] - e[k]) * max(abs(c[k] - e[k]) - 2 * max(c[k], e[k], 1) ** 0.5, 0) for k in (0, 1)]
        return np.log(left[1] / e[1]) - np.log(left[0] / e[0])

    single = {x: weight(c, [sum(c) * share[0], sum(c) * share[1]]) for x, c in n.items()}
    double = {}
    for (a, b), c in pairs.items():
        odds = (n[a][1] + share[1] / 2) * np.exp(single[b]) / (n[a][0] + share[0] / 2)
        double[a, b] = weight(c, [sum(c) / (1 + odds), sum(c) * odds / (1 + odds)])
    sums = [sum(single.get(x, 0) for x in set(w)) + sum(double.get(x, 0) for x in set(itertools.pairwise(w))) for w in split]
    return [x / (len(w) + 10) for x, w in zip(sums, split, strict=True)], sum(x != 0 for x in single.values()), sum(x != 0 for x in double.values())


@pytest.mark.parametrize("common", [1 << 16, 2, 0])
def test_toxicity_counts_every_expression(spark, monkeypatch, common):
    """Of a class of 200,000 words, one that ten texts hold is in the model, and so are bigrams; by the join as by the tasks' table."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = random.Random(11)
    texts, toxic = [], []
    for i in range(160):
        t = words(rng, 2500, 3000).split()
        bad = i % 2
        for said in (["Vile", "w1 w2"] if i % 16 == 1 else []) + (["w3 w4"] * 2 if bad else ["w4 w5"] if i % 3 == 0 else []):
            t.insert(rng.randrange(len(t)), said)
        texts.append(" ".join(t))
        toxic.append(bad)
    texts += ["vile w3 w4 w1 w2", "w3 w4 vile vile unseen", None, "", "vile w3 w4 w1 w2"]
    toxic += [None] * 5
    train = spark.createDataFrame([(t, y) for t, y in zip(texts, toxic, strict=True) if y is not None], "text string, toxic int")
    model = toxicity.fit(train)
    want, n_words, n_pairs = plain_differences(texts, toxic)
    assert model.count() == n_words + n_pairs and n_words > 1 and n_pairs > 1
    got = toxicity.differences(docs(spark, texts), model, "doc_id", "text").collect()
    assert len(got) == len(texts) and all(abs(r.x - want[r.key]) < 1e-5 for r in got)
    assert want[160] > 0.05


def test_toxicity_without_both_classes(spark):
    table = docs(spark, ["a b", "c"])
    only = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.scored(table, only).collect())
    assert toxicity.scored(table.limit(0), only).count() == 0
    assert {r.score for r in toxicity.scored(table, only.limit(0)).collect()} == {0.5}




def test_groups_of_alike_lines_grow_in_proportion(spark):
    """Of many variants of one long line, and of a common short line, nearly all are settled by a few neighbours: the full
    join sees pairs in proportion to the lines. Lines from a template that are not alike are told apart by parity."""

    def pairs(n):
        rng = random.Random(n)
        stock = [f"base{i}" for i in range(60)]
        lines_ = []
        for k in range(n):
            long = list(stock)
            for i in rng.sample(range(60), 2):
                long[i] = f"v{k}x{i}"
            lines_.append(" ".join(long))
            short = [f"s{i}" for i in range(10)]
            if k % 3:
                short[rng.randrange(10)] = f"u{k}"
            lines_.append(" ".join(short))
            mixed = [f"t{i}" for i in range(30)]
            for i in rng.sample(range(30), 8):
                mixed[i] = f"m{k}x{i}"
            lines_.append(" ".join(mixed))
        rng.shuffle(lines_)
        table = docs(spark, lines_)
        made = {}
        old = lines.stored

        def counted(df, name):
            out = old(df, name)
            made[name] = out.count()
            return out

        lines.stored = counted
        try:
            gone = {r.doc: r.removed for r in lines.repeated_lines(table).collect()}
        finally:
            lines.stored = old
        want = {i for i, bad in enumerate(plain_removed(lines_)) if bad}
        assert {i for i, r in gone.items() if r} == want
        return made["line-pairs"]

    small, large = pairs(150), pairs(600)
    assert large < 8 * max(small, 300)


def plain_removed(texts):
    sets = [frozenset(t.split()) for t in texts]
    return [any(9 * len(a & b) >= 4 * (len(a) + len(b)) for a in sets[:i]) for i, b in enumerate(sets)]
