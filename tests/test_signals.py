"""Window statistics against NumPy, and cards with known answers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesift.functions.hashing import order_hash
from kinesift.operators import cards as cd
from kinesift.operators import centroids as cn
from kinesift.operators import segments as sg
from kinesift.operators import signals as si
from kinesift.operators.logistic import fit_logistic
from kinesift.operators.scan import cyclic_successor, exact_quantiles, prefix_scan

RATE = 20.0


def frame(spark, windows):
    rows = [(f"w{i}", "wisdm", "train", "x", str(i), np.asarray(w, float).tolist()) for i, w in enumerate(windows)]
    return spark.createDataFrame(
        rows, "window_id string, dataset_id string, split string, label string, subject_id string, sensor array<array<double>>"
    )


def sines(amplitudes, hz, n=80):
    t = np.arange(n) / RATE
    return np.stack([a * np.sin(2 * np.pi * hz * t) for a in amplitudes], axis=1)


def expected(w):
    c = w - w.mean(axis=0)
    s = c[:, int(np.argmax((c * c).sum(axis=0)))]
    amp = np.abs(np.fft.rfft(s))[1:]
    k = int(np.argmax(amp))
    corr = np.correlate(s, s, "full")[len(s) - 1 :] / (s @ s + 1e-8)
    low = max(2, len(s) // 20)
    high = max(low + 1, len(s) // 2)
    g = np.linalg.norm(w, axis=1)
    mid = g[1:-1]
    peaks = ((mid > g[:-2]) & (mid > g[2:]) & (mid > g.mean() + 0.75 * g.std())).sum()
    return np.sqrt((w * w).mean()), (k + 1) * RATE / len(s), amp[k] / (amp.sum() + 1e-8), corr[low:high].max(), peaks


def test_statistics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    windows = [rng.normal(size=(n, 3)) * [1, 2, 0.5] + 3 for n in (16, 16, 37, 128, 5)]
    got = si.window_statistics(frame(spark, windows), channels=3, sample_rate=RATE).orderBy("window_id").collect()
    for row, w in zip(got, windows):
        want = expected(w)
        have = [row[k] for k in ("rms_energy", "dominant_frequency_hz", "fft_dominant_ratio", "autocorr_peak", "peak_count")]
        assert np.allclose(have, want), (have, want)
        chunks = np.array_split(w[:, row["top_channel"]], 3)
        bound = 0.2 * (w[:, row["top_channel"]].std() + 1e-6)
        trend = ["stable" if len(c) < 2 or abs(c[-1] - c[0]) <= bound else "rise" if c[-1] > c[0] else "fall" for c in chunks]
        assert row["trend_segments"] == trend
        r = np.corrcoef(w, rowvar=False)
        best = max(((abs(r[i, j]), -i, -j) for i in range(3) for j in range(i + 1, 3)))
        assert np.isclose(row["pair"]["strength"], best[0]) and row["pair"]["i"] == -best[1] and row["pair"]["j"] == -best[2]


def test_still_window(spark):
    row = si.window_statistics(frame(spark, [np.full((16, 3), 5.3)]), channels=3).first()
    assert row["dominant_frequency_hz"] == 0.0 and row["autocorr_peak"] == 0.0 and row["peak_count"] == 0.0 and row["pair"] is None


def test_cards_from_sines(spark):
    train = [sines((a, 0.1, 0.05), f) for a, f in ((0.2, 0.5), (0.4, 0.75), (0.6, 1.0), (1.4, 1.5))]
    near = sines((1.0, 0.98, 0.0), 1.0)
    cards = cd.evidence_cards(frame(spark, [*train, near]), names=["acc_x", "acc_y", "acc_z"], sample_rate=RATE).orderBy("window_id").collect()
    strong, tie = cards[3], cards[4]
    assert (strong["intensity"], strong["periodicity"], strong["dominant_axis"]) == ("high", "strong", "acc_x")
    assert strong["dominant_frequency"] == "high" and strong["cross_channel_relation"] == "acc_x and acc_y move synchronously"
    assert tie["dominant_axis"] == "uncertain" and abs(tie["confidence"] - 0.85) < 1e-9


def test_bucket_edges(spark):
    b = cd.CardBounds({"rms_energy": (1.0, 1.0), "peak_count": (0, 0), "dominant_frequency": (0, 0)})
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,)], "v double")
    got = [r[0] for r in df.select(b.bucket("rms_energy", F.col("v"), ("low", "medium", "high"))).collect()]
    assert got == ["low", "low", "high"]


def test_unusable_windows(spark):
    df = frame(spark, [np.ones((8, 3)), np.ones((3, 3)), np.ones((8, 2))])
    good, bad = si.split_valid_windows(df, 3)
    assert [r["window_id"] for r in good.collect()] == ["w0"]
    assert {r["window_id"]: r["reason"] for r in bad.collect()} == {"w1": "too short", "w2": "channel count"}
    with pytest.raises(Exception, match="unusable sensor window"):
        si.require_valid_windows(df, 3).collect()


def test_centroids(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = frame(spark, [rng.normal(size=(16, 2)) + (k % 3) for k in range(30)]).withColumn(
        "label", (F.substring("window_id", 2, 9).cast("int") % 3).cast("string")
    )
    f = si.window_features(df, channels=2)
    x = np.array([r["features"] for r in f.orderBy(F.col("subject_id").cast("int")).collect()])
    y = np.arange(30) % 3
    m, s = x.mean(axis=0), x.std(axis=0)
    s[s < 1e-6] = 1
    z = (x - m) / s
    centers = np.stack([z[y == k].mean(axis=0) for k in range(3)])
    want = np.linalg.norm(z[:, None] - centers[None], axis=2).argmin(axis=1)
    got = cn.fit_centroids(f).predict(f).orderBy(F.col("subject_id").cast("int")).collect()
    assert [int(r["predicted"]) for r in got] == list(want)


def test_pad_crop_and_shape(spark):
    df = frame(spark, [np.ones((3, 2)), np.ones((6, 4))])
    assert sg.sensor_shape(df).first() == (6, 4)
    got = df.orderBy("window_id").select(sg.pad_or_crop(F.col("sensor"), 4, 3).alias("s")).collect()
    assert got[0]["s"] == [[1.0, 1.0, 0.0]] * 3 + [[0.0, 0.0, 0.0]] and got[1]["s"] == [[1.0] * 3] * 4


def test_quantiles_of_odd_values(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=997), rng.integers(0, 5, 997).astype(float)
    c = np.concatenate([[-np.inf, np.inf, -0.0, 0.0, 5e-324, -1e308], rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400), np.full(591, 1 / 3)])
    rows = [(float(x), float(y), float(z), None if i else 7.5) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.01, 0.33, 0.5, 0.67, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], probs)
    assert got["a"] == pytest.approx(np.quantile(a, probs).tolist(), rel=1e-15) and got["b"] == np.quantile(b, probs).tolist()
    ordered = np.sort(c)
    for p, v in zip(probs, got["c"]):
        low = int(p * 996)
        assert ordered[low] <= v <= ordered[min(low + 1, 996)]
    assert got["c"][0] == -np.inf and got["d"] == [7.5] * 6
    with pytest.raises(ValueError):
        exact_quantiles(df.select(F.lit(None).cast("double").alias("e")), ["e"], [0.5])


def test_quantiles_move_no_value(spark):
    """One pass moves a row per task and bin, not per value; neighbours in the last bit stay apart."""
    start = 1.0
    values = [start + i * 2.0**-52 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert exact_quantiles(df, ["v"], [0.25, 0.5]) == {"v": [pytest.approx(np.quantile(values, 0.25), abs=3e-16), pytest.approx(np.quantile(values, 0.5), abs=3e-16)]}


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_scan_is_the_same_in_any_partitioning(spark, parts):
    rows = [(i, i % 3, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(5)
    got = prefix_scan(df, ["-k", "id"], {"run": F.col("v")}, partitions=parts).orderBy("row_index").collect()
    total = 0
    for i, want in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += want[2]
        assert (got[i]["id"], got[i]["row_index"], got[i]["run"]) == (want[0], i, total)


def test_running_sums_of_doubles_do_not_depend_on_partitions(spark):
    """The same to the last bit for any split, close to the exact sum; infinities come through."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=600) * 10.0 ** rng.integers(-12, 12, 600)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double").repartition(5)
    runs = []
    for parts in (1, 7, 40):
        got = prefix_scan(df, ["id"], {"run": F.col("v")}, partitions=parts).orderBy("id").collect()
        runs.append([r["run"] for r in got])
    assert runs[0] == runs[1] == runs[2]
    exact = [math.fsum(values[: i + 1]) for i in range(600)]
    assert np.allclose(runs[0], exact, rtol=1e-15, atol=600 * 2.0**-86 * np.abs(values).max() * 2)
    odd = spark.createDataFrame([(0, 1.5), (1, None), (2, float("inf")), (3, 2.0)], "id int, v double")
    got = [r["run"] for r in prefix_scan(odd, ["id"], {"run": F.col("v")}, partitions=2).orderBy("id").collect()]
    assert got == [1.5, 1.5, math.inf, math.inf]


@pytest.mark.parametrize("parts", [1, 5])
def test_segments_of_a_scan(spark, parts):
    rows = [(k, i, i % 5) for k in ("a", "b", None) for i in range(60 if k else 7)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    got = prefix_scan(df, ["-i"], {"run": F.col("v")}, partitions=parts, within="k")
    for k in ("a", "b", None):
        own = sorted((r for r in got.collect() if r["k"] == k), key=lambda r: -r["i"])
        assert [r["row_index"] for r in own] == list(range(len(own)))
        assert [r["run"] for r in own] == np.cumsum([r["v"] for r in own]).tolist()


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_ring_of_keys(spark, n):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(n)], "key string, v int")
    got = {r["key"]: (r["next_key"], r["next_v"]) for r in cyclic_successor(df, "key", order_hash(7, F.col("key")), ["key", "v"]).collect()}
    order = sorted((hashlib.md5(f"7:k{i}".encode()).hexdigest(), i) for i in range(n))
    want = {f"k{i}": (f"k{order[(p + 1) % n][1]}", order[(p + 1) % n][1]) for p, (_, i) in enumerate(order)}
    assert got == want


def test_nearest_of_many_centers(spark, monkeypatch):
    """Ten thousand labels in several rounds: the nearest by plain distances, the first label on ties, nothing in the plan."""
    rng = np.random.default_rng(5)
    centers = np.round(rng.normal(size=(10_000, 5)) * rng.gamma(1.0, 2.0, (10_000, 1)), 1)
    labels = [f"c{i:05d}" for i in range(10_000)]
    model = cn.Centroids(cn.ZScore([0.5] * 5, [2.0] * 5), dict(zip(labels, centers.tolist())))
    points = np.concatenate([np.round(rng.normal(size=(300, 5)) * 4, 1), centers[:40] * 2.0 + 0.5])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id int, features array<double>").repartition(3)
    z = (points - 0.5) / 2.0
    d = np.zeros((len(z), 10_000))
    for j in range(5):
        d += (z[:, j : j + 1] - centers[:, j][None, :]) ** 2
    want = {i: labels[k] for i, k in enumerate(d.argmin(axis=1))} | {900: None, 901: None}
    for size in (cn.CENTER_BYTES, 8 * 5 * 3000):
        monkeypatch.setattr(cn, "CENTER_BYTES", size)
        out = model.predict(df)
        assert {r["id"]: r["predicted"] for r in out.collect()} == want
    assert "c00007" not in out._jdf.queryExecution().toString()


def test_logistic_weights_equal_plain_newton_steps(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    x[:, 3] = x[:, 0] > 0
    y = (x @ [1.0, -2.0, 0.5, 1.0] + rng.logistic(size=400) > 0.3).astype(float)
    w = np.where(y == 1, 1.5, 0.7)
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)], "features array<double>, label double, weight double").repartition(5)
    full, beta, ridge = np.column_stack([x, np.ones(400)]), np.zeros(5), np.diag([1.0] * 4 + [0.0])
    for n in (3, 25):
        got = fit_logistic(df, steps=n)
        beta = np.zeros(5)
        for _ in range(n):
            p = 1 / (1 + np.exp(-full @ beta))
            beta = beta + np.linalg.solve(full.T @ (full * (w * p * (1 - p))[:, None]) + ridge, full.T @ (w * (y - p)) - ridge @ beta)
        assert np.allclose([*got.weights, got.intercept], beta, atol=1e-9)
    p = 1 / (1 + np.exp(-full @ beta))
    told = df.select(got.probability(F.col("features")).alias("p"), "features").collect()
    assert np.allclose(sorted(r["p"] for r in told), sorted(p))
