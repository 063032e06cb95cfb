"""Logs, windows, signal statistics, cards, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ctes import case, r6 as q6
from checks.registry import check, r6, tight
from kinesift.functions.phrases import ACTIVITY_LABELS_6, ACTIVITY_LABELS_12
from kinesift.operators import cards as cd
from kinesift.operators import centroids as cn
from kinesift.operators import segments as sg
from kinesift.operators import signals as si
from kinesift.operators.scan import exact_quantiles, prefix_scan
from kinesift.plans import views
from kinesift.session import stage_path
from kinesift.sources import logs, tables

# ---- sources ------------------------------------------------------------------------------------

def _lines3(spark, d):
    e = views.table(spark, d, "events")
    good = F.concat(
        F.lit("\t 0"), F.col("user_id").cast("string"), F.lit(", "), F.upper("event_type"), F.lit(" Up,"),
        F.col("event_id").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit(","),
        (F.col("event_id") % 7).cast("string"), F.lit(".5 ,-"), (F.col("event_id") % 3).cast("string"), F.lit(";"),
    )
    broken = F.concat(F.col("user_id").cast("string"), F.lit(",A,x,1,2,3;"))
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 97 == 0, "bad,line").when(F.col("event_id") % 89 == 0, broken).otherwise(good).alias("value"),
    )


@check(
    "log3_parse",
    f"""SELECT CAST(user_id AS VARCHAR) AS subject_id, lower(event_type) || '_up' AS activity, event_id AS ts_ns,
    {q6('value')} AS x, {q6("event_id % 7 + 0.5")} AS y, {q6("-(event_id % 3)")} AS z
    FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0""",
)
def log3_parse(spark, d):
    p = _lines3(spark, d).select(logs.parse_log3(F.col("value")).alias("p")).filter("p is not null").select("p.*")
    v = F.col("values")
    return p.select("subject_id", "activity", "ts_ns", r6(v[0]).alias("x"), r6(v[1]).alias("y"), r6(v[2]).alias("z"))


@check(
    "log3_rejects",
    "SELECT CAST(sum(CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM events",
)
def log3_rejects(spark, d):
    lines = _lines3(spark, d).withColumn("src", F.lit("events"))
    return logs.rejected_lines(lines, logs.parse_log3(F.col("value"))).select("rejected")


def _lines21(spark, d):
    """Lines of 23 values and a label: 23 in a row from a place that follows the id, so all 64 take part."""
    e = views.table(spark, d, "embeddings")
    start = (F.col("vec_id") % 42 + 1).cast("int")
    numbers = F.transform(F.slice("embedding", start, F.lit(23)), lambda x: x.cast("double").cast("string"))
    label = F.when(F.col("vec_id") % 15 == 13, "NaN").when(F.col("vec_id") % 15 == 14, "99999999999").otherwise((F.col("vec_id") % 15).cast("string"))
    return e.select("vec_id", F.concat(F.lit("\t"), F.array_join(numbers, "\t"), F.lit("\t"), label, F.lit(" \t")).alias("value"))


_GOOD21 = "vec_id % 15 BETWEEN 1 AND 12"


@check(
    "log21_parse",
    f"""SELECT vec_id, {case('vec_id % 15', ACTIVITY_LABELS_12, 'NULL')} AS activity, CAST(i AS INT) AS i,
    {q6('CAST(embedding[vec_id % 42 + 1 + CASE WHEN i < 3 THEN i ELSE i + 2 END] AS DOUBLE)')} AS v
    FROM (SELECT *, unnest(range(0, 21)) AS i FROM embeddings WHERE {_GOOD21})""",
)
def log21_parse(spark, d):
    p = _lines21(spark, d).select("vec_id", logs.parse_log21(F.col("value")).alias("p")).filter("p is not null")
    return p.select("vec_id", "p.activity", F.posexplode("p.values").alias("i", "v")).withColumn("v", r6("v"))


_RUNS_OF = """SELECT {keep}, row_number() OVER (PARTITION BY {by}, seq_no ORDER BY {order}) - 1 AS pos, CAST(seq_no AS BIGINT) AS seq_no FROM
    (SELECT *, sum(CASE WHEN {same} THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS seq_no FROM
    (SELECT *, {lags} FROM ({rows})))"""


@check(
    "log3_file_runs",
    _RUNS_OF.format(
        keep="subject_id, activity, ts_ns, x",
        by="one",
        order="ts_ns",
        same="ls = subject_id AND la = activity AND ts_ns - lt <= 3",
        lags="lag(subject_id) OVER w AS ls, lag(activity) OVER w AS la, lag(ts_ns) OVER w AS lt",
        rows=f"""SELECT 1 AS one, CAST(user_id AS VARCHAR) AS subject_id, lower(event_type) || '_up' AS activity, event_id AS ts_ns, {q6('value')} AS x
    FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0""",
    ).replace("WHERE event_id % 97 <> 0 AND event_id % 89 <> 0)", "WHERE event_id % 97 <> 0 AND event_id % 89 <> 0) WINDOW w AS (ORDER BY ts_ns)"),
)
def log3_file_runs(spark, d):
    """The log as text files in line order, read from there: broken lines are left out, runs end with user, activity or time."""
    path = stage_path(spark, "log3")
    lines = _lines3(spark, d).repartitionByRange("event_id").sortWithinPartitions("event_id")
    lines.select("value").write.text(path)
    runs = logs.log3_runs(logs.read_log3(spark, path), max_gap=3)
    return runs.select("subject_id", "activity", "ts_ns", r6(F.col("values")[0]).alias("x"), "pos", "seq_no")


@check(
    "log21_file_runs",
    _RUNS_OF.format(
        keep="vec_id, activity",
        by="part",
        order="vec_id",
        same="la = activity",
        lags="lag(activity) OVER (PARTITION BY part ORDER BY vec_id) AS la",
        rows=f"SELECT vec_id, vec_id % 4 AS part, {case('vec_id // 9 % 15', ACTIVITY_LABELS_12, 'NULL')} AS activity FROM embeddings WHERE vec_id // 9 % 15 BETWEEN 1 AND 12",
    ),
)
def log21_file_runs(spark, d):
    """A file per recording, no times: runs end with the activity, lines without one are left out and end none."""
    path = stage_path(spark, "log21")
    e = views.table(spark, d, "embeddings")
    numbers = F.concat(F.array(F.col("vec_id").cast("string")), F.transform(F.slice("embedding", 1, 22), lambda x: x.cast("double").cast("string")))
    value = F.concat_ws("\t", F.array_join(numbers, "\t"), F.floor(F.col("vec_id") / 9) % 15)
    rows = e.select("vec_id", (F.col("vec_id") % 4).alias("part"), value.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "vec_id").select("part", "value").write.partitionBy("part").text(path)
    runs = logs.log21_runs(logs.read_log21(spark, path))
    return runs.select(F.col("values")[0].cast("bigint").alias("vec_id"), "activity", "pos", "seq_no")


@check(
    "matrices",
    f"""SELECT printf('ucihar_train_%06d', line_no) AS window_id, {case('label % 7', ACTIVITY_LABELS_6, "CAST(label % 7 AS VARCHAR)")} AS label,
    CAST(vec_id % 12 AS VARCHAR) AS subject_id, CAST(t AS INT) AS t, CAST(ch AS INT) AS ch, {q6('CAST(embedding[ch * 10 + t + 1] AS DOUBLE)')} AS v
    FROM (SELECT *, unnest(range(0, 10)) AS t FROM (SELECT *, unnest(range(0, 6)) AS ch FROM
    (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS line_no FROM embeddings)))""",
)
def matrices(spark, d):
    """One file set per channel, written and read as directories of parts, aligned by line."""
    base = stage_path(spark, "matrices")
    e = views.table(spark, d, "embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    for c, stem in enumerate(logs.MATRIX_FILES.values()):
        values = F.transform(F.slice("embedding", 10 * c + 1, 10), lambda x: x.cast("double").cast("string"))
        e.select(F.concat(F.lit("  "), F.array_join(values, "  ")).alias("value")).write.text(f"{base}/train/Inertial Signals/{stem}_train.txt")
    e.select((F.col("label") % 7).cast("string").alias("value")).write.text(f"{base}/train/y_train.txt")
    e.select((F.col("vec_id") % 12).cast("string").alias("value")).write.text(f"{base}/train/subject_train.txt")
    m = logs.read_matrices(spark, base, "train").select("window_id", "label", "subject_id", F.posexplode("sensor").alias("t", "row"))
    return m.select("window_id", "label", "subject_id", "t", F.posexplode("row").alias("ch", "v")).withColumn("v", r6("v"))


@check(
    "interleaved_runs",
    _RUNS_OF.format(
        keep="event_id, line",
        by="subject_id",
        order="line",
        same="line - ll = 1",
        lags="lag(line) OVER (PARTITION BY subject_id ORDER BY line) AS ll",
        rows="SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id, row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS line FROM events",
    ),
)
def interleaved_runs(spark, d):
    """Lines in an order of types: a run ends where another subject's line lies between."""
    e = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("subject_id"), "event_type", "ts", "event_id")
    numbered = prefix_scan(e, ["event_type", "ts", "event_id"], index="line")
    return sg.segment_runs(numbered, order=["line"], activity=None, line_no="line").select("event_id", "line", "seq_no", "pos")


@check(
    "line_numbers",
    "SELECT event_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS line_no FROM events",
)
def line_numbers(spark, d):
    """Lines written in event order, a file per thousand ids, come back with that order as line numbers of their file."""
    path = stage_path(spark, "lines")
    event = F.col("event_id").cast("bigint")
    rows = views.table(spark, d, "events").select(F.col("event_id").cast("string").alias("value"), F.floor(event / 1000).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", F.col("value").cast("bigint")).write.partitionBy("part").text(path)
    lines = logs.number_lines(logs.read_lines(spark, path))
    return lines.select(F.col("value").cast("bigint").alias("event_id"), "line_no")


@check("jsonl_roundtrip", f"SELECT doc_id, lang, n_chars, text, {q6('n_chars / 7.0')} AS share FROM documents")
def jsonl_roundtrip(spark, d):
    path = stage_path(spark, "jsonl")
    docs = views.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text", r6(F.col("n_chars") / 7.0).alias("share"))
    tables.write_jsonl(docs, path)
    return tables.read_jsonl(spark, path, docs.schema)


@check("csv_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def csv_roundtrip(spark, d):
    path = stage_path(spark, "csv")
    rows = views.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@check("window_table", "SELECT dataset_id, split, count(*) AS windows FROM grid GROUP BY 1, 2")
def window_table(spark, d):
    return tables.write_windows(views.grid_windows(spark, d), stage_path(spark, "windows"))


@check(
    "parameter_table",
    f"""SELECT 'rms_energy' AS measure, {q6('rl')} AS low, {q6('rh')} AS high FROM gr_q UNION ALL
    SELECT 'peak_count', {q6('pl')}, {q6('ph')} FROM gr_q UNION ALL SELECT 'dominant_frequency', {q6('hl')}, {q6('hh')} FROM gr_q""",
)
def parameter_table(spark, d):
    path = stage_path(spark, "bounds")
    tables.save_bounds(cd.fit_card_bounds(_grid_stats(spark, d).filter("split = 'train'")), spark, path)
    return tight(tables.load_bounds(spark, path).table(spark).select("measure", "low", "high"))


# ---- windows ------------------------------------------------------------------------------------


@check("run_segments", "SELECT event_id, seq_no, pos FROM runs")
def run_segments(spark, d):
    return views.runs(spark, d).select("event_id", "seq_no", "pos")


@check("activity_runs", "SELECT event_id, seq_no, pos FROM actruns")
def activity_runs(spark, d):
    return views.runs(spark, d, activity="activity").select("event_id", "seq_no", "pos")


@check("gapless_runs", "SELECT event_id, seq_no, pos FROM gapless")
def gapless_runs(spark, d):
    return views.runs(spark, d, activity="activity", max_gap=None).select("event_id", "seq_no", "pos")


@check(
    "sliding_windows",
    f"""SELECT subject_id, seq_no, win_no, CAST(p AS INT) AS p, {q6('c0')} AS c0, {q6('c1')} AS c1, {q6('c2')} AS c2 FROM win_rows""",
)
def sliding_windows(spark, d):
    """Every sample of every window."""
    w = sg.sliding_windows(views.runs(spark, d), size=8, stride=4)
    opened = w.select("subject_id", "seq_no", "win_no", F.posexplode("sensor").alias("p", "v"))
    return opened.select("subject_id", "seq_no", "win_no", "p", *[r6(F.col("v")[i]).alias(f"c{i}") for i in range(3)])


@check(
    "gapped_windows",
    """SELECT k.subject_id, k.seq_no, k.win_no, CAST(sum(event_id) AS BIGINT) AS ids FROM
    (SELECT subject_id, seq_no, unnest(range(0, (n - 3) // 5 + 1)) AS win_no FROM (SELECT subject_id, seq_no, count(*) AS n FROM runs GROUP BY ALL)
    WHERE n >= 3) k JOIN runs r ON r.subject_id = k.subject_id AND r.seq_no = k.seq_no AND r.pos BETWEEN 5 * k.win_no AND 5 * k.win_no + 2
    GROUP BY 1, 2, 3""",
)
def gapped_windows(spark, d):
    """A stride beyond the window size leaves samples out."""
    runs = views.runs(spark, d).withColumn("values", F.col("event_id"))
    w = sg.sliding_windows(runs, size=3, stride=5)
    return w.select("subject_id", "seq_no", "win_no", F.aggregate("sensor", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))


NUMBERED = """SELECT window_id AS old_id, split, row_number() OVER (PARTITION BY split ORDER BY s_us, s_ev, win_no) - 1 AS window_no FROM
    (SELECT *, min(us) OVER (PARTITION BY subject_id, seq_no) AS s_us, min(event_id) OVER (PARTITION BY subject_id, seq_no) AS s_ev FROM wins)"""


def _numbered(spark, d):
    w = views.event_windows(spark, d).withColumnRenamed("window_id", "old_id").drop("sensor")
    return sg.number_windows(w, keys=["subject_id", "seq_no"], start=["us", "event_id"], dataset_id="wisdm")


@check("window_numbers", f"SELECT old_id, window_no, concat('wisdm_', split, '_', printf('%06d', window_no)) AS window_id FROM ({NUMBERED})")
def window_numbers(spark, d):
    return _numbered(spark, d).select("old_id", "window_no", "window_id")


@check(
    "window_caps",
    f"SELECT old_id, split, window_no FROM ({NUMBERED}) WHERE (split = 'train' AND window_no < 200) OR (split = 'test' AND window_no < 50)",
)
def window_caps(spark, d):
    return sg.cap_windows(_numbered(spark, d), {"train": 200, "test": 50}).select("old_id", "split", "window_no")


@check("subject_split", "SELECT subject_id, split FROM splits")
def subject_split(spark, d):
    s = views.samples(spark, d)
    return s.select("subject_id", sg.subject_split(s).alias("split")).distinct()


@check(
    "pad_or_crop",
    f"""SELECT window_id, 20 AS length, 3 AS channels, {q6('sum(CASE WHEN ch < 3 THEN v ELSE 0 END)')} AS total, CAST(0 AS DOUBLE) AS tail
    FROM grid_long GROUP BY 1""",
)
def pad_or_crop(spark, d):
    w = views.grid_windows(spark, d).select("window_id", sg.pad_or_crop(F.col("sensor"), 20, 3).alias("s"))
    total = F.aggregate(F.flatten("s"), F.lit(0.0), lambda a, x: a + x)
    return w.select("window_id", F.size("s").alias("length"), F.size(F.col("s")[0]).alias("channels"), r6(total).alias("total"), F.col("s")[19][2].alias("tail"))


@check("sensor_shape", "SELECT CAST(max(p) + 1 AS INT) AS length, CAST(max(ch) + 1 AS INT) AS channels FROM grid_long")
def sensor_shape(spark, d):
    return sg.sensor_shape(views.grid_windows(spark, d))


@check(
    "prefix_scan",
    f"""SELECT event_id, row_number() OVER w - 1 AS row_index, {q6('sum(value) OVER w')} AS running FROM events
    WINDOW w AS (ORDER BY event_type, value DESC, event_id ROWS UNBOUNDED PRECEDING)""",
)
def scan(spark, d):
    e = views.table(spark, d, "events").select("event_id", "event_type", "value")
    return tight(prefix_scan(e, ["event_type", "-value", "event_id"], {"running": F.col("value")}).select("event_id", "row_index", "running"))


@check(
    "exact_quantiles",
    f"""SELECT 'value' AS metric, {q6('quantile_cont(value, 0.33)')} AS low, {q6('quantile_cont(value, 0.67)')} AS high FROM events
    UNION ALL SELECT 'l_extendedprice', {q6('quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.33)')},
    {q6('quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.67)')} FROM lineitem""",
)
def quantiles(spark, d):
    rows = []
    for table, column in (("events", "value"), ("lineitem", "l_extendedprice")):
        df = views.table(spark, d, table).select(F.col(column).cast("double").alias(column))
        rows.append((column, *exact_quantiles(df, [column], [0.33, 0.67])[column]))
    return tight(spark.createDataFrame(rows, "metric string, low double, high double"))


# ---- signal statistics --------------------------------------------------------------------------


def _grid_stats(spark, d):
    return si.window_statistics(views.grid_windows(spark, d), channels=4, sample_rate=50.0)


def _grid_cards(spark, d):
    return cd.evidence_cards(views.grid_windows(spark, d), names=views.GRID_CHANNELS)


@check("window_rms", f"SELECT window_id, {q6('sqrt(avg(v * v))')} AS rms FROM grid_long GROUP BY 1")
def window_rms(spark, d):
    return views.grid_windows(spark, d).select("window_id", r6(si.window_rms(F.col("sensor"))).alias("rms"))


@check("axis_energy", f"SELECT window_id, CAST(ch AS INT) AS channel, {q6('e')} AS energy FROM gr_ch")
def axis_energy(spark, d):
    return tight(_grid_stats(spark, d).select("window_id", F.posexplode_outer("axis_energy").alias("channel", "energy")))


@check("dominant_frequency", f"SELECT window_id, {q6('hz')} AS hz, {q6('ratio')} AS ratio FROM tn_spec")
def dominant_frequency(spark, d):
    s = si.window_statistics(views.tone_windows(spark, d), channels=1, sample_rate=50.0)
    return tight(s.select("window_id", F.col("dominant_frequency_hz").alias("hz"), F.col("fft_dominant_ratio").alias("ratio")))


@check("autocorr_peak", f"SELECT window_id, {q6('ac')} AS autocorr FROM gr_ac")
def autocorr_peak(spark, d):
    return tight(_grid_stats(spark, d).select("window_id", F.col("autocorr_peak").alias("autocorr")))


@check("peak_count", f"SELECT window_id, {q6('peaks')} AS peaks FROM tn_peak")
def peak_count(spark, d):
    s = si.window_statistics(views.tone_windows(spark, d), channels=1)
    return tight(s.select("window_id", F.col("peak_count").alias("peaks")))


@check("trend_segments", "SELECT window_id, concat_ws(',', t0, t1, t2) AS trend FROM gr_trend")
def trend_segments(spark, d):
    return _grid_stats(spark, d).select("window_id", F.array_join("trend_segments", ",").alias("trend"))


@check(
    "card_bounds",
    f"""SELECT {q6('rl')} AS rms_low, {q6('rh')} AS rms_high, {q6('pl')} AS peak_low, {q6('ph')} AS peak_high,
    {q6('hl')} AS hz_low, {q6('hh')} AS hz_high FROM gr_q""",
)
def card_bounds(spark, d):
    b = cd.fit_card_bounds(_grid_stats(spark, d).filter("split = 'train'")).bounds
    row = (*b["rms_energy"], *b["peak_count"], *b["dominant_frequency"])
    names = ["rms_low", "rms_high", "peak_low", "peak_high", "hz_low", "hz_high"]
    return tight(spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)))


for _field in ("intensity", "dominant_axis", "periodicity", "burstiness", "dominant_frequency"):

    def _card_field(spark, d, f=_field):
        return _grid_cards(spark, d).select("window_id", f)

    check(f"card_{_field}", f"SELECT window_id, {_field} FROM gr_cards")(_card_field)


@check("cross_channel_relation", "SELECT window_id, rel AS relation FROM gr_cards")
def cross_channel_relation(spark, d):
    return _grid_cards(spark, d).select("window_id", F.col("cross_channel_relation").alias("relation"))


@check("card_confidence", f"SELECT window_id, {q6('confidence')} AS confidence FROM gr_cards")
def card_confidence(spark, d):
    return tight(_grid_cards(spark, d).select("window_id", "confidence"))


@check(
    "evidence_cards",
    f"""SELECT window_id, split, label, subject_id, intensity, periodicity, dominant_axis, dominant_frequency, rel AS cross_channel_relation,
    burstiness, concat_ws(',', t0, t1, t2) AS trend, {q6('confidence')} AS confidence, {q6('rms')} AS rms_energy, {q6('ac')} AS autocorr_peak,
    {q6('ratio')} AS fft_dominant_ratio, {q6('hz')} AS dominant_frequency_hz, {q6('peaks')} AS peak_count FROM ev_cards""",
)
def evidence_cards(spark, d):
    c = views.cards(spark, d)
    return tight(
        c.select(
            "window_id", "split", "label", "subject_id", "intensity", "periodicity", "dominant_axis", "dominant_frequency",
            "cross_channel_relation", "burstiness", F.array_join("trend_segments", ",").alias("trend"), "confidence", "numeric.*",
        )
    )


@check(
    "evidence_counts",
    """SELECT split, intensity, periodicity, dominant_axis, dominant_frequency, burstiness, count(*) AS windows FROM ev_cards
    GROUP BY 1, 2, 3, 4, 5, 6""",
)
def evidence_counts(spark, d):
    keys = ["split", "intensity", "periodicity", "dominant_axis", "dominant_frequency", "burstiness"]
    return views.cards(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"))


@check(
    "unusable_windows",
    """SELECT window_id, CASE WHEN vec_id % 3 = 0 THEN 'too short' ELSE 'channel count' END AS reason FROM grid WHERE vec_id % 3 < 2""",
)
def unusable_windows(spark, d):
    cut = (
        F.when(F.col("vec_id") % 3 == 0, F.slice("sensor", 1, 3))
        .when(F.col("vec_id") % 3 == 1, F.transform("sensor", lambda r: F.slice(r, 1, 2)))
        .otherwise(F.col("sensor"))
    )
    _, bad = si.split_valid_windows(views.grid_windows(spark, d).withColumn("sensor", cut), 4)
    return bad.select("window_id", "reason")


@check("window_features", f"SELECT window_id, CAST(pos AS INT) AS pos, {q6('x')} AS x FROM gr_feat")
def window_features(spark, d):
    f = si.window_features(views.grid_windows(spark, d), channels=4)
    return tight(f.select("window_id", F.posexplode_outer("features").alias("pos", "x")))


@check(
    "feature_zscores",
    f"""SELECT window_id, CAST(place AS INT) AS pos, {q6('(x - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END')} AS z FROM (SELECT f.window_id, f.pos AS place, f.x,
    avg(f.x) FILTER (WHERE g.split = 'train') OVER (PARTITION BY f.pos) AS m, stddev_pop(f.x) FILTER (WHERE g.split = 'train') OVER (PARTITION BY f.pos) AS s
    FROM gr_feat f JOIN grid g ON g.window_id = f.window_id)""",
)
def feature_zscores(spark, d):
    f = si.window_features(views.grid_windows(spark, d), channels=4)
    z = cn.fit_zscore(f.filter("split = 'train'"))
    return tight(f.select("window_id", F.posexplode_outer(z.apply(F.col("features"))).alias("pos", "z")))


@check("sensor_scale", f"SELECT {q6('avg(v)')} AS mean, {q6('CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END')} AS std FROM grid_long")
def sensor_scale(spark, d):
    return tight(cn.sensor_scale(views.grid_windows(spark, d)))


@check("nearest_centroid", "SELECT window_id, label, predicted FROM gr_guess")
def nearest_centroid(spark, d):
    f = si.window_features(views.grid_windows(spark, d), channels=4)
    path = stage_path(spark, "centroids")
    tables.save_centroids(cn.fit_centroids(f.filter("split = 'train'")), spark, path)
    model = tables.load_centroids(spark, path)
    return model.predict(f.filter("split = 'test'")).select("window_id", "label", "predicted")
