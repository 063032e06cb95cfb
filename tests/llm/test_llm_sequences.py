"""Repeated strings, periodic runs and repaired conversations against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinesift.llm import periods, repair, suffixes

DOCS = "doc_id long, text string"


def digest(data):
    return hashlib.sha256(data).hexdigest()


# --- repeated byte strings -------------------------------------------------------------------------------------


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        lost = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                lost[i : i + length] = b"\1" * length
        kept = bytes(c for c, gone in zip(d, lost, strict=True) if not gone)
        spans = sum(lost[i] and not (i and lost[i - 1]) for i in range(len(lost)))
        out.append((len(d), sum(lost), spans, digest(kept)))
    return out


def prose(rng, n, stock="abcdefghij"):
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def repeated_texts(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (50, 60, 33, 200)]
    texts = [None, "", "short", prose(rng, 400), "é" * 300, "ab" * 400, "x" * 199, "x" * 200, "x" * 199]
    for i in range(25):
        t = prose(rng, rng.randrange(5, 120))
        for p in rng.sample(passages, rng.randrange(3)):
            cut = rng.randrange(len(p) // 3)
            t += p[cut : len(p) - rng.randrange(len(p) // 3)] + prose(rng, rng.randrange(30))
        texts.append(t)
    base = prose(rng, 150)
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = "Q"
        texts.append("".join(near))
    texts += [base, base, prose(rng, 100) * 3]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings_equal_all_positions(spark, seed):
    texts = repeated_texts(seed)
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(range(len(texts)), ids, texts, strict=True)), "n long, doc_id long, text string")
    clash = frame.withColumn("kept", F.lit(1)).withColumn("mark", F.lit("m")).withColumn("row", F.lit(0))
    got = {r.row.n: r for r in suffixes.without_repeats(clash).collect()}
    found = [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, digest(bytes(got[i].kept))) for i in range(len(texts))]
    assert found == plain_repeats(texts, suffixes.LENGTH)
    assert sum(n for _, n, _, _ in found) > 5000 and got[0].row.kept == 1


def test_common_ranks_are_spread_and_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    passage, edge = prose(rng, 120), prose(rng, 25)
    texts = [prose(rng, 20) + passage + prose(rng, 20) for _ in range(25)]
    texts += [prose(rng, 30) + edge + passage[i : 300 + i] + prose(rng, 10) for i in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    spread = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest_rows(frame).orderBy("doc_id").collect()]
    monkeypatch.setattr(suffixes, "SHARE", 10)
    plain = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest_rows(frame).orderBy("doc_id").collect()]
    assert spread == plain == plain_repeats(texts, suffixes.LENGTH)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(4)
    shared = prose(rng, 90)
    text = prose(rng, 700) + shared + prose(rng, 500) + shared
    lots = list(suffixes._lots([text.encode(), b"x" * 300], 200))
    assert len(lots) == 1
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    lots = list(suffixes._lots([text.encode()], 200))
    starts = [at + i for lot in lots for _, at, p in lot for i in range(len(p) - 199)]
    assert starts == list(range(len(text.encode()) - 199)) and len(lots) > 4


def test_no_documents_no_rows(spark):
    assert suffixes.digest_rows(spark.createDataFrame([], DOCS)).count() == 0


# --- periodic runs ---------------------------------------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_period_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = 1000 * best[1] // best[2] if best else None
    return (len(runs), *(best or (None,) * 3), milli, digest(listed.encode()), digest(kept.encode()))


def periodic_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "a", "a " * 6, "a " * 5, "ab cd " * 4, "ab cd " * 3, "x " * 3000]
    for _ in range(90):
        stock = rng.choice([2, 3, 30, 500])
        words = [f"w{rng.randrange(stock)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(4)):
            period = [f"w{rng.randrange(stock)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 40, 64, 70]))]
            m = int(len(period) * rng.uniform(2.5, 7))
            words += (period * 8)[:m] + [f"w{rng.randrange(stock)}" for _ in range(rng.randrange(30))]
        texts.append(" ".join(words))
    nested = ("a b " * 5 + "c ") * 6
    return [*texts, nested, nested * 4 + "d " * 9]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_all_lags(spark, seed):
    texts = periodic_texts(seed)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in periods.digest_rows(spark.createDataFrame(rows, DOCS)).collect()}
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for i, text in rows:
        assert tuple(got[i][c] for c in columns) == plain_period_row(i, text), i
    assert sum(r.n_runs for r in got.values()) > 60
    assert max(r.period or 0 for r in got.values()) > 64


def test_collapsed_texts_with_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b " * 4 + "c", 1), (None, None, 2)]
    got = periods.collapsed(spark.createDataFrame(rows, "doc_id long, text string, runs int")).orderBy("row.runs").collect()
    assert [(r.row.runs, r.collapsed, [tuple(x) for x in r.runs], r.best and tuple(r.best)) for r in got] == [
        (1, "a b c", [(0, 8, 2)], (0, 8, 2)),
        (2, "", [], None),
    ]
    assert periods.digest_rows(spark.createDataFrame([], DOCS)).count() == 0


# --- conversations ---------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        yield from [(c, t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(turns):
    """Cheapest, then least audit, by trying edits in order of (cost, audit)."""
    flaws = faults(turns)
    heap = [(0, "", 0, ())]
    done = set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)
        if i == len(turns) and GOOD.fullmatch(initials):
            return cost, audit, digest("\n".join(f"{r}:{t}" for r, t in out).encode())
        if not any(GOOD.fullmatch(initials + end) for end in ("", "a", "ua")):
            continue
        state = (i, initials[-1:])
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, (*out, (role, ""))))
        if i < len(turns):
            role, text = turns[i][2:]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out))
            if flaws[i] not in ("blank", "duplicate"):
                more = 5 * (flaws[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, (*out, (new, text))))
    raise AssertionError


def plain_report(turns):
    if not turns:
        return (0, 0, 0, 0, 0, 0, "", digest(b""))
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    numbers = {t for _, t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    flaws = faults(turns)
    initials = [r[2][:1] for r in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, sha = plain_repair(turns)
    return (gaps, *(flaws.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", None, "tool", ""])
            if t == 0 and rng.random() < 0.4:
                role = "system"
            text = rng.choice(["Yes.", "No", "A b!", f"t{t}.", f"t{t}?  ", f"t{t}", "", None, " \n"] + [f"Word {conv} {t}." for _ in range(9)])
            rows.append((conv, None if rng.random() < 0.05 else t, role, text))
    return rows


@pytest.mark.parametrize("chunk", [3, repair.ROWS])
def test_repairs_equal_the_cheapest_edits(spark, chunk):
    rows = conversations(5)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", chunk int, audit string").repartition(3)
    got = repair.report(repair.damaged(table), table, chunk).collect()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv_id: tuple(r[c] for c in columns) for r in got}
    by_conv = {c: [] for c, *_ in rows}
    for r in plain_damage(rows):
        by_conv[r[0]].append(r)
    want = {c: plain_report(turns) for c, turns in by_conv.items()}
    assert found == want and len(got) == len(want)
    assert {"D", "K", "R"} == set("".join(w[6] for w in want.values()))


def test_one_conversation_over_many_chunks(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Turn {t}" + rng.choice([".", ".", ""])) for t in range(400)]
    rows += [(2, t, "system", f"{t}.") for t in range(50)] + [(3, 0, "user", "Only.")]
    table = spark.createDataFrame(rows, TURNS)
    audits = [{r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in repair.report(table, table, n).collect()} for n in (7, 1000)]
    assert audits[0] == audits[1]
    for conv in (2, 3):
        want = plain_report([r for r in rows if r[0] == conv])
        assert audits[0][conv] == want[5:]
    assert len(audits[0][1][1]) >= 400
    assert repair.report(table.limit(0), table.limit(0)).count() == 0
    assert [tuple(r)[1:7] for r in repair.report(table.limit(0), table.filter("conv_id = 3")).collect()] == [(0,) * 6]


def test_fix_up_passes_end_where_runs_meet():
    """Keeping turns alone never makes two different vectors one; an end of a conversation does."""
    user, reply = 1 | repair.FIRST, 2 | repair.FIRST
    other = repair._plain(repair._before(reply, repair.END))
    assert other != repair.END
    plain = bytes([user, reply] * 4)
    assert repair._first_vector(plain, other) == (repair._first_vector(plain, other, repair.END) or repair._first_vector(plain, repair.END))
    ended = bytes([user, reply | repair.LAST] * 2)
    assert repair._first_vector(ended, other, repair.END) is None
    assert repair._first_vector(ended, other) == repair._first_vector(ended, repair.END)
