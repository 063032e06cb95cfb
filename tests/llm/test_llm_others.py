"""Pieces, neighbours, URLs, chats and the pipeline against plain versions, and on odd input."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinesift.llm import ann, chat, pieces, queries, urls
from tests.llm.test_llm_documents import DOCS, ODD, docs, words

SF = "/root/testdata/sf0.001"
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer file")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

TEXTS = [*ODD, "Hello  world\n\tx", " lead ", "▁x y▁", "日本 😀\x00z", " " * 77 + "hi" + " " * 40, "xxxxa boxxxx aaaaaa", "ünïcödé ﬁ Ａ <0x0A>"]


# --- SentencePiece ---------------------------------------------------------------------------------------------


@needs_model
def test_ids_equal_the_library_and_decode_exactly(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aabxx lle\n étion▁😀-- ") for _ in range(60)) for _ in range(300)]
    table = docs(spark, texts).withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.doc_id: r.ids for r in pieces.encoded(table).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
        elif pieces.MARK not in t:
            assert got[i] == model.encode(t), t
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(table)).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert pieces.encoded(table.limit(0)).count() == 0 and pieces.decoded(pieces.encoded(table.limit(0))).count() == 0


def best_split(word, scores, unknown):
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        ways = []
        for at in range(end):
            p = word[at:end]
            if p in scores or len(p) == 1:
                ways.append((best[at][0] + scores.get(p, unknown), [*best[at][1], p]))
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1]


def test_unigram_paths_have_the_best_score():
    rng = random.Random(2)
    for _ in range(40):
        names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(12)} | {"▁", "a"}
        scores = {p: -rng.random() * 10 for p in names}
        v = pieces.Vocabulary({p: i + 300 for i, p in enumerate(sorted(scores))}, scores, list(range(256)), merges=False)
        encoder = pieces.Encoder(v)
        text = "".join(rng.choice("abcd ") for _ in range(30))
        names_of = {i: p for p, i in v.ids.items()}
        got = [names_of.get(i) for i in pieces.encode_batch([text], encoder)[0].tolist()]
        want = [p for w in pieces.marked_words(text) for p in best_split(w, scores, v.unknown)[1]]
        total = lambda ps: sum(scores.get(p, v.unknown) for p in ps)
        assert abs(total([p or "d" for p in got]) - total(want)) < 1e-9


def test_forgotten_words_are_made_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    scores = {"▁": -9.0, "a": -9.0, "b": -9.0, "ab": -1.0, "▁ab": -2.0}
    encoder = pieces.Encoder(pieces.Vocabulary({p: i for i, p in enumerate(scores)}, scores, list(range(10, 266))))
    first = [x.tolist() for x in pieces.encode_batch(["ab ba aab", "b bb", "ab"], encoder)]
    assert [x.tolist() for x in pieces.encode_batch(["ab ba aab", "b bb", "ab"], encoder)] == first and first[2] == [4]


# --- neighbours ------------------------------------------------------------------------------------------------


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)) * rng.uniform(0.3, 3, (700, 1))
    x[40:300] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(800, None, 0), (820, [0.0] * 16, 0), (840, [float("nan")] * 16, 0), (860, [None] * 16, 0), (880, [1.0, 2.0], 0), (900, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows + odd + rows[20:23], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.nearest(table.withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        ids = [found[k][0] for k in range(1, 21)]
        assert q not in ids and len(set(ids)) == 20
        scores = [found[k][1] for k in range(1, 21)]
        assert np.allclose(scores, x[ids] @ x[q]) and all((a > b) or (a == b and i < j) for a, b, i, j in zip(scores, scores[1:], ids, ids[1:]))
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(700), -np.round(exact, 9)))[:20]) & set(ids))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(table.filter("vec_id < 3")).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 1), (0, 2)}


def test_a_long_vector_leaves_queries_their_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1e4
    x[11:31] *= 1e-3
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table).toPandas().groupby("query_id")["vec_id"].apply(list)
    assert sorted(got.index) == list(range(0, 4000, 20)) and all(len(set(v)) == 20 for v in got)
    exact = x[got.index] @ x.T
    exact[np.arange(len(got)), got.index] = -np.inf
    assert np.mean([len(set(e[:20]) & set(v)) / 20 for e, v in zip(np.argsort(-exact, 1), got)]) >= 0.95
    # Probes that find next to nothing: every query is still complete.
    few = ann.nearest(table.filter("vec_id < 400"), probes=1).groupBy("query_id").count().collect()
    assert len(few) == 20 and {r["count"] for r in few} == {20}


def test_share_of_neighbours_found_does_not_fall_with_size():
    rng = np.random.default_rng(6)
    n, asked = 200_000, 8
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    hashes = ann.Hashes(64, ann.directions_for(n))
    full = np.concatenate([x, np.zeros((n, 1))], 1)
    seen = np.zeros((asked, n), bool)
    for t in range(len(hashes.a)):
        keys = hashes.key(np.floor(hashes.cells(t, full)))
        seen |= np.stack([np.isin(keys, p) for p in hashes.probes(t, full[:asked])])
    near = np.argsort(-(x[:asked] @ x.T), 1)[:, 1:21]
    assert np.take_along_axis(seen, near, 1).mean() >= 0.95


def test_probe_sets_come_in_order_of_expected_distance():
    sets = ann.probe_sets(3, 18)
    assert sets[0] == () and len(set(sets)) == 18
    assert all(5 - p not in s for s in sets for p in s)


# --- URLs ------------------------------------------------------------------------------------------------------


def test_urls_equal_sql_and_every_rule_tried(spark):
    rng = random.Random(4)
    hosts = ["example.net", "a.b.example.net", "net", "xnet", "M.Example.COM", "blog.x.org", "ads.y.com", "www.q.com", "h:80", ""]
    tails = ["", "/", "/en/", "/de/x.html", "/fr/1.html", "/es/2", "?utm_source=feed", "/a?page=2&ref=x", "/en/a?utm_source=feed", "/login", "#top", "/tracker/é\n", "/ünï"]
    made = [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(tails)}{rng.choice(['', '#top', '?x=1'])}" for _ in range(300)]
    made += [None, "", "no scheme", "://", "a://b://c", "http://net", "x" * 100000, "http://" + "a." * 5000 + "net/"]
    table = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(table).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(made)))
    assert got == sorted(con.execute(urls.judged_sql()).fetchall())
    assert urls.judged(table.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rule = urls.PatternRule("block", "/ads/banner^")
    assert rule.tokens == ["ads", "banner"] and urls.PatternRule("block", "*foo*").tokens == []
    assert list(urls.filed([rule], {"ads": 5, "banner": 2})) == ["banner"]


# --- chats -----------------------------------------------------------------------------------------------------


def conversations(spark, n=120):
    rng = random.Random(5)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(2, 7)):
            role = "user" if t % 2 == 0 else "assistant"
            text = words(rng, 8) + rng.choice(["?", "?", "\n" + words(rng, 3)]) if role == "user" else "\n".join(words(rng, rng.randrange(20, 60)).capitalize() + "." for _ in range(rng.randrange(1, 4)))
            rows.append((c, t, role, text))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def best_path(m, seen):
    import itertools

    def total(path):
        return m.start[path[0]] + m.show[path[0], seen[0]] + sum(m.step[a, b] + m.show[b, o] for a, b, o in zip(path, path[1:], seen[1:]))

    return max(itertools.product(range(chat.STATES), repeat=len(seen)), key=total), total


def test_viterbi_is_optimal():
    rng = np.random.default_rng(6)
    m = chat.RoleModel(rng.normal(size=6), rng.normal(size=(6, 6)), rng.normal(size=(6, 9)))
    for n in (1, 2, 4):
        seen = rng.integers(0, 9, n)
        want, total = best_path(m, seen)
        assert abs(total(tuple(m.states(seen))) - total(want)) < 1e-12
    assert len(m.states(np.zeros(0, np.int64))) == 0


def test_roles_are_recovered(spark):
    raw = chat.raw_transcripts(chat.pieces(conversations(spark)))
    model = chat.fit(raw.filter("key % 5 > 0").select(F.transform(F.split("text", "\n"), chat.observed).alias("seen"), "state"))
    rows = raw.filter("key % 5 = 0").select(F.struct("key", F.array_join("state", "").alias("true")).alias("key"), "text")
    found = chat.formatted(rows, model).collect()
    pairs = [(a, b) for r in found for a, b in zip(r.states, r.key.true, strict=True)]
    assert np.mean([int(a) // 2 == int(b) // 2 for a, b in pairs]) > 0.9
    assert all(r.chat.count(chat.END) == len(r.roles.split(",")) for r in found)
    marked = spark.createDataFrame([(1, "User: hi there\nmore\nAssistant: Well.\nYes."), (2, None), (3, ""), (4, "line\n" * 3000)], "key long, text string").withColumn("roles", F.lit(0))
    got = {r.key: r for r in chat.formatted(marked, model).collect()}
    assert got[1].chat == "<|user|>\nhi there\nmore<|end|>\n<|assistant|>\nWell.\nYes.<|end|>\n"
    assert got[2].chat == got[3].chat == "" and len(got[4].states) == 3001
    assert chat.formatted(marked.limit(0), model).count() == 0


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 300, "assistant", None), (None, None, None, None), (2, 1, "tool", "x\ny")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("turns", F.lit(1))
    got = {(r.key, r.piece): r for r in chat.raw_transcripts(chat.pieces(table)).collect()}
    assert len(got) == 4 and got[1, 0].state == [2] and got[1, 1].state == [4] and got[2, 0].state == [2, 3]


# --- queries and pipeline --------------------------------------------------------------------------------------


def test_stages_on_odd_documents(spark, tmp_path):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["stone", "river", "walks", "under", "light"]) + rng.choice("abcdefghij") + rng.choice("abcdefghij") for _ in range(90)) for _ in range(12)]
    table = docs(spark, [*ODD, *good, good[0]]).withColumn("row", F.lit("x")).withColumn("size", F.lit(1)).withColumn("kept", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix", "encode"]
    for empty in (False, True):
        df = table.limit(0) if empty else table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{k}{empty}")
            done = stage(spark, df, "")
            if name != "encode":
                assert done.columns == table.columns
            done.write.parquet(out)
            df = spark.read.parquet(out)
            if not empty and name in ("quality_rules", "line_dedup", "near_dedup"):
                ids = sorted(r.doc_id for r in df.select("doc_id").collect())
                want = list(range(len(ODD), len(ODD) + 12))
                assert ids == (want + [len(ODD) + 12] if name == "quality_rules" else want)
        assert df.columns == ["doc_id", "source", "n_ids", "ids"] and (df.count() == 0) == empty


@needs_data
def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert DOCS.startswith("doc_id")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = entry.queries()[name](spark, SF)
        rel = con.execute(sql)
        at = [[c[0] for c in rel.description].index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name
