"""Readers and segmentation against a plain sequential loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesift.operators import segments as sg
from kinesift.sources import logs, tables


def sequential_runs(samples, max_gap):
    """(user, activity, ts) in file order -> list of runs, the loop a single process would use."""
    runs, current = [], []
    for s in samples:
        if current:
            p = current[-1]
            step = s[2] - p[2]
            if s[0] != p[0] or s[1] != p[1] or step < 0 or (max_gap is not None and step > max_gap):
                runs.append(current)
                current = []
        current.append(s)
    if current:
        runs.append(current)
    return runs


def windows_of(runs, size, stride):
    return [
        (r[0][0], r[0][1], tuple(x[2] for x in r[k : k + size])) for r in runs for k in range(0, len(r) - size + 1, stride)
    ]


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    rng = random.Random(5)
    lines, samples, t = [], [], 0
    while len(samples) < 3000:
        user = 7 if rng.random() < 0.5 else rng.randrange(1, 6)
        activity = rng.choice(["Walking", "Jogging Fast"])
        for _ in range(rng.randrange(1, 40)):
            t += rng.choice([1, 2, 30, -3]) if rng.random() < 0.1 else 1
            samples.append((str(user), activity.lower().replace(" ", "_"), t))
            lines.append(f" 0{user},{activity},{t},{t}.5,-1,2e0;")
            if rng.random() < 0.05:
                lines.append(rng.choice(["bad,line", "", "1,A,x,1,2,3;", "1,A,1,1,2;"]))
    path = tmp_path_factory.mktemp("log") / "raw.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path), samples


@pytest.mark.parametrize("max_gap,split_bytes", [(10, "8k"), (None, "8k"), (10, "10m")])
def test_log3_windows_equal_a_sequential_loop(spark, log, max_gap, split_bytes):
    path, samples = log
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = logs.read_log3(spark, path)
        assert rows.count() == len(samples)
        runs = logs.log3_runs(rows, max_gap)
        cut = sg.sliding_windows(
            runs.withColumn("v", F.col("ts_ns")), size=8, stride=4, keys=["seq_no"], values="v", carry=["subject_id", "activity"]
        )
        got = [(r["subject_id"], r["activity"], tuple(r["sensor"])) for r in cut.orderBy("seq_no", "win_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == windows_of(sequential_runs(samples, max_gap), 8, 4)


def test_log3_line(spark):
    lines = ["33,Jogging,49105962326000,-0.6946377,12.680544,0.5039537;", "bad,line", "", "1,Up Stairs,5,1,2,3"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = df.select(logs.parse_log3(F.col("value")).alias("p")).collect()
    assert got[0]["p"].asDict() == {
        "subject_id": "33", "activity": "jogging", "ts_ns": 49105962326000, "values": [-0.6946377, 12.680544, 0.5039537],
    }
    assert got[1]["p"] is None and got[2]["p"] is None and got[3]["p"]["activity"] == "up_stairs"


def test_rejected_lines_are_counted(spark, log):
    path, samples = log
    n = sum(1 for x in open(path) if x.strip()) - len(samples)
    assert logs.rejected_lines(logs.read_lines(spark, path), logs.parse_log3(F.col("value"))).first()["rejected"] == n


def test_log21(spark, tmp_path):
    def line(label, first=0.0):
        return "\t".join(str(first + i) for i in range(23)) + f"\t{label}"

    (tmp_path / "mHealth_subject7.log").write_text("\n".join([line(4), line(0), line(4), line(2), "1 2 3"]) + "\n")
    rows = logs.read_log21(spark, str(tmp_path))
    got = rows.orderBy("ord").collect()
    assert [(r["subject_id"], r["activity"], len(r["values"])) for r in got] == [("7", "walking", 21)] * 2 + [("7", "sitting_relaxing", 21)]
    assert got[0]["values"][3] == 5.0
    runs = logs.log21_runs(rows).orderBy("ord").collect()
    assert [(r["seq_no"], r["pos"]) for r in runs] == [(1, 0), (1, 1), (2, 0)]


def test_matrices_align_by_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = {}
    (tmp_path / "train" / "Inertial Signals").mkdir(parents=True)
    for stem in logs.MATRIX_FILES.values():
        data[stem] = rng.normal(size=(40, 5)).round(4)
        text = "\n".join("  ".join(str(v) for v in row) for row in data[stem])
        (tmp_path / "train" / "Inertial Signals" / f"{stem}_train.txt").write_text(text + "\n")
    (tmp_path / "train" / "y_train.txt").write_text("\n".join(str(i % 7) for i in range(40)) + "\n")
    (tmp_path / "train" / "subject_train.txt").write_text("\n".join(str(i // 10) for i in range(40)) + "\n")
    got = logs.read_matrices(spark, str(tmp_path), "train", max_windows=30).orderBy("window_id").collect()
    assert len(got) == 30 and got[1]["window_id"] == "ucihar_train_000001" and got[1]["label"] == "walking"
    assert got[0]["label"] == "0" and got[25]["subject_id"] == "2"
    want = np.stack([data[s] for s in logs.MATRIX_FILES.values()], axis=-1)
    for i, row in enumerate(got):
        assert np.allclose(np.array(row["sensor"]), want[i])


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").orderBy("a").collect() == [(1, "x"), (2, None)]


def test_csv_keeps_any_text(spark, tmp_path):
    rows = [(1, 'say "hi",\nthen go'), (2, "plain")]
    df = spark.createDataFrame(rows, "id int, text string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == rows


@pytest.mark.parametrize("split_bytes", ["37b", "200b", "10m"])
def test_csv_records_across_splits(spark, tmp_path, split_bytes):
    """One file in many splits: breaks, quotes and separators inside fields, records longer than a split."""
    rng = random.Random(5)
    stock = [None, " spaced ", "plain", 'a "b" c', "x,y", "one\ntwo", '"\n"', "\n\n", "long " * 60 + "\n" + "more " * 30, '""', "é\n"]
    rows = [(i, rng.choice(stock), i / 2, rng.choice(stock)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, text string, v double, more string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"))
    tables.write_csv(df.filter("id < 3").coalesce(1), str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = tables.read_csv(spark, [str(tmp_path / "c"), str(tmp_path / "d")], df.schema)
        got = sorted(map(tuple, read.collect()))
        if split_bytes == "37b":
            lines = spark.read.text(str(tmp_path / "c"))
            assert lines.rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 153 and [r for r in got if r[0] >= 3] == [r for r in rows if r[0] >= 3]
    assert [r for r in got if r[0] < 3] == sorted(rows[:3] * 2, key=lambda r: r[0])


def plain_runs(rows, max_gap):
    """seq_no and pos by one loop over (subject, activity, i, t)."""
    out, last, seq, pos = [], {}, {}, {}
    for s, a, i, t in sorted(rows, key=lambda r: r[2]):
        before = last.get(s)
        if before is None or before[0] != a or t < before[1] or t - before[1] > max_gap:
            seq[s], pos[s] = seq.get(s, 0) + 1, -1
        pos[s] += 1
        last[s] = (a, t)
        out.append((i, seq[s], pos[s]))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_partitions_do_not_change_runs(spark, parts):
    """A bursty subject holds most rows, nearly all of them in one moment, and spreads over the partitions all the same."""
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        hot = rng.random() < 0.7
        t = i if hot and not 200 < i < 1400 else 200_000 + i % 3 if hot else i * rng.choice([1, 1, 3])
        rows.append(("hot" if hot else f"s{rng.randrange(4)}", None if i % 400 < 20 else f"a{i // 40}", i, t))
    df = spark.createDataFrame(rows, "subject_id string, activity string, i long, t long").repartition(6)
    out = sg.segment_runs(df, order=["i"], time="t", max_gap=500, partitions=parts)
    assert sorted((r["i"], r["seq_no"], r["pos"]) for r in out.collect()) == plain_runs(rows, 500)
    by_range = df.repartitionByRange(parts, "subject_id", "i").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert by_range <= 3 * len(rows) / parts


def test_runs_take_one_shuffle_of_samples(spark, tmp_path):
    spark.range(4000).selectExpr("string(id % 3) subject_id", "id t").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    out = sg.segment_runs(df, order=["t"], activity=None, time="t", max_gap=10, partitions=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Shuffled once before the written copy; after it the corrections are broadcast.
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan and "BroadcastHashJoin" in plan
    assert out.filter("seq_no = 1 and pos >= 0").count() == 4000


def test_interleaved_subjects_break_with_dense_lines(spark):
    rows = [("a", 0), ("a", 1), ("b", 2), ("a", 3), ("a", 4)]
    df = spark.createDataFrame(rows, "subject_id string, line long")
    for parts in (1, 4):
        out = sg.segment_runs(df, order=["line"], activity=None, line_no="line", partitions=parts)
        assert sorted((r["line"], r["seq_no"], r["pos"]) for r in out.collect()) == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 2, 0), (4, 2, 1)]


@pytest.mark.parametrize("size,stride", [(1, 1), (5, 1), (8, 4), (8, 8), (3, 5), (4, 3)])
def test_windows_equal_slices_of_runs(spark, size, stride):
    """Runs below, at and far over a block; rows in any order; few samples are copied."""
    lengths = {1: 400, 2: size, 3: size - 1, 4: 9 * size + 1, 5: 8 * size * stride}
    rows = [("s", n, p, [float(n), float(p)], p * 10) for n, m in lengths.items() for p in range(m)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "subject_id string, seq_no int, pos long, values array<double>, t long").repartition(3)
    cut = sg.sliding_windows(df, size=size, stride=stride, first_of=["t"])
    got = sorted((r["seq_no"], r["win_no"], r["t"], tuple(map(tuple, r["sensor"]))) for r in cut.collect())
    want = []
    for n, m in lengths.items():
        for w, p in enumerate(range(0, m - size + 1, stride)):
            want.append((n, w, p * 10, tuple((float(n), float(q)) for q in range(p, p + size))))
    assert got == sorted(want)


def test_window_numbers_of_one_run_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sg, "OFFSET_WINDOWS", 16)
    rows = [("hot", 1, w, "train", 0) for w in range(300)] + [(f"s{i}", 1, w, "train" if i % 2 else "test", i + 1) for i in range(6) for w in range(i + 1)]
    df = spark.createDataFrame(rows, "subject_id string, seq_no int, win_no long, split string, at long")
    got = {(r["split"], r["window_no"]): (r["subject_id"], r["win_no"]) for r in sg.number_windows(df, keys=["subject_id", "seq_no"], start=["at"], dataset_id="d").collect()}
    want = {}
    for split in ("train", "test"):
        ordered = sorted((r for r in rows if r[3] == split), key=lambda r: (r[4], r[2]))
        want |= {(split, n): (r[0], r[2]) for n, r in enumerate(ordered)}
    assert got == want


@pytest.mark.parametrize("n,ratio,want", [(1, 0.2, 0), (2, 0.2, 1), (10, 0.25, 2), (10, 0.35, 4), (3, 1.0, 2)])
def test_subject_split_counts(spark, n, ratio, want):
    df = spark.createDataFrame([(str(i % n),) for i in range(50)], "subject_id string")
    sides = df.select("subject_id", sg.subject_split(df, test_ratio=ratio).alias("side")).distinct().collect()
    assert len(sides) == n and sum(r["side"] == "test" for r in sides) == want


def test_bad_window_arguments(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0)], "subject_id string, seq_no int, pos int, values double")
    with pytest.raises(ValueError):
        sg.sliding_windows(df, size=0)
    with pytest.raises(ValueError):
        sg.sliding_windows(df, stride=0)
