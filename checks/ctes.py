"""Shared SQL blocks for the oracles: the given tables recomputed step by step in plain SQL."""

from __future__ import annotations

import re

from kinesift.functions import phrases as ph

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def needed(text: str) -> list[str]:
    """Blocks that a query uses, in definition order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in CTES:
            if name in words and name not in found:
                found.add(name)
                todo.append(CTES[name])
    return [n for n in CTES if n in found]


def full(select: str) -> str:
    names = needed(select)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {head}\n{select}" if names else select


def case(value: str, words: dict, otherwise: str) -> str:
    arms = " ".join(f"WHEN {value} = '{k}' THEN '{v}'" for k, v in words.items())
    return f"(CASE {arms} ELSE {otherwise} END)"


def hexnum(text: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


# ---- windows ------------------------------------------------------------------------------------

cte(
    "samples",
    """SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(event_id // 500 AS VARCHAR) AS activity,
    epoch_us(ts) AS us, event_id, value AS c0, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS c1,
    CAST(hour(ts) AS DOUBLE) AS c2 FROM events""",
)


def _runs(name: str, act: bool, gap: bool) -> None:
    rule = "lag(us) OVER w IS NULL OR us - lag(us) OVER w < 0"
    if gap:
        rule += " OR us - lag(us) OVER w > 86400000000"
    if act:
        rule += " OR activity <> lag(activity) OVER w"
    cte(
        name + "_b",
        f"SELECT *, CASE WHEN {rule} THEN 1 ELSE 0 END AS b FROM samples "
        "WINDOW w AS (PARTITION BY subject_id ORDER BY us, event_id)",
    )
    cte(
        name + "_s",
        f"SELECT *, CAST(sum(b) OVER (PARTITION BY subject_id ORDER BY us, event_id) AS BIGINT) AS seq_no FROM {name}_b",
    )
    cte(
        name,
        "SELECT *, row_number() OVER (PARTITION BY subject_id, seq_no ORDER BY us, event_id) - 1 AS pos "
        f"FROM {name}_s",
    )


_runs("runs", False, True)
_runs("actruns", True, True)
_runs("gapless", True, False)

cte(
    "subs",
    """SELECT subject_id, row_number() OVER (ORDER BY md5('42:' || subject_id)) AS rk, count(*) OVER () AS n
    FROM (SELECT DISTINCT subject_id FROM samples)""",
)
cte(
    "splits",
    """SELECT subject_id, CASE WHEN n > 1 AND rk <= greatest(1, least(n - 1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)))
    THEN 'test' ELSE 'train' END AS split FROM subs""",
)
cte(
    "win_keys",
    """SELECT subject_id, seq_no, unnest(range(0, (n - 8) // 4 + 1)) AS win_no FROM
    (SELECT subject_id, seq_no, count(*) AS n FROM runs GROUP BY ALL) WHERE n >= 8""",
)
cte(
    "win_rows",
    """SELECT concat_ws('-', 'wisdm', split, k.subject_id, k.seq_no, k.win_no) AS window_id, split, k.subject_id, k.seq_no,
    k.win_no, r.pos - 4 * k.win_no AS p, us, event_id, activity, c0, c1, c2
    FROM win_keys k JOIN runs r ON r.subject_id = k.subject_id AND r.seq_no = k.seq_no
    AND r.pos BETWEEN 4 * k.win_no AND 4 * k.win_no + 7 JOIN splits s ON s.subject_id = k.subject_id""",
)
cte(
    "wins",
    "SELECT window_id, split, subject_id, seq_no, win_no, us, event_id, activity AS label FROM win_rows WHERE p = 0",
)
cte(
    "ev_long",
    """SELECT window_id, p, 0 AS ch, c0 AS v FROM win_rows UNION ALL SELECT window_id, p, 1, c1 FROM win_rows
    UNION ALL SELECT window_id, p, 2, c2 FROM win_rows""",
)
cte(
    "grid_long",
    """SELECT printf('ucihar_%06d', vec_id) AS window_id, (i - 1) // 4 AS p, (i - 1) % 4 AS ch,
    CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
)
cte(
    "grid",
    """SELECT printf('ucihar_%06d', vec_id) AS window_id, 'ucihar' AS dataset_id,
    CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CAST(label AS VARCHAR) AS label,
    CAST(vec_id % 12 AS VARCHAR) AS subject_id, vec_id FROM embeddings""",
)
cte(
    "tone_long",
    """SELECT printf('tone_%06d', vec_id) AS window_id, i - 1 AS p, 0 AS ch, CAST(embedding[i] AS DOUBLE) AS v
    FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
)


def stat_ctes(x: str, long: str, rate: float, names: list[str]) -> None:
    """Signal statistics of a long table (window_id, p, ch, v) under the prefix ``x``."""
    cte(f"{x}_n", f"SELECT window_id, max(p) + 1 AS n FROM {long} GROUP BY 1")
    cte(
        f"{x}_ch",
        f"""SELECT window_id, ch, avg(v) AS m, sqrt(avg(v * v)) AS e, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi,
        sum(v * v) AS ss, count(*) AS k FROM {long} GROUP BY 1, 2""",
    )
    cte(
        f"{x}_c",
        f"SELECT l.window_id, l.p, l.ch, l.v - c.m AS z FROM {long} l JOIN {x}_ch c ON c.window_id = l.window_id AND c.ch = l.ch",
    )
    cte(
        f"{x}_top",
        f"""SELECT window_id, ch AS top, e AS e1, coalesce(lead(e) OVER (PARTITION BY window_id ORDER BY e DESC, ch) >= e * 0.9,
        false) AS contested, row_number() OVER (PARTITION BY window_id ORDER BY e DESC, ch) AS rk FROM {x}_ch""",
    )
    cte(f"{x}_ce", f"SELECT window_id, ch, sum(z * z) AS en FROM {x}_c GROUP BY 1, 2")
    cte(f"{x}_sch", f"SELECT window_id, arg_min(ch, (-en, ch)) AS ch, max(en) AS en FROM {x}_ce GROUP BY 1")
    cte(
        f"{x}_sig",
        f"SELECT c.window_id, c.p, c.z, n.n, s.en FROM {x}_c c JOIN {x}_sch s ON s.window_id = c.window_id AND s.ch = c.ch "
        f"JOIN {x}_n n ON n.window_id = c.window_id",
    )
    cte(
        f"{x}_dft",
        f"""SELECT window_id, k, n, sqrt(pow(sum(z * cos(2 * pi() * k * p / n)), 2) + pow(sum(z * sin(2 * pi() * k * p / n)), 2)) AS a
        FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM {x}_sig) GROUP BY 1, 2, 3""",
    )
    cte(f"{x}_amp", f"SELECT window_id, max(a) AS mx, sum(a) AS sm FROM {x}_dft GROUP BY 1")
    cte(
        f"{x}_spec",
        f"""SELECT d.window_id, CASE WHEN max(m.sm) > 1e-9 THEN min(k) * {rate} / max(n) ELSE 0.0 END AS hz,
        CASE WHEN max(m.sm) > 1e-9 THEN arg_min(a, k) / (max(m.sm) + 1e-8) ELSE 0.0 END AS ratio
        FROM {x}_dft d JOIN {x}_amp m ON m.window_id = d.window_id WHERE a >= mx * (1 - 1e-9) GROUP BY 1""",
    )
    cte(
        f"{x}_lag",
        f"""SELECT a.window_id, b.p - a.p AS lag, sum(a.z * b.z) / (max(a.en) + 1e-8) AS r, max(a.en) AS en FROM {x}_sig a
        JOIN {x}_sig b ON b.window_id = a.window_id AND b.p - a.p >= greatest(2, a.n // 20)
        AND b.p - a.p < greatest(greatest(2, a.n // 20) + 1, a.n // 2) GROUP BY 1, 2""",
    )
    cte(f"{x}_ac", f"SELECT window_id, CASE WHEN max(en) <= 1e-8 THEN 0.0 ELSE max(r) END AS ac FROM {x}_lag GROUP BY 1")
    cte(f"{x}_mag", f"SELECT window_id, p, sqrt(sum(v * v)) AS g FROM {long} GROUP BY 1, 2")
    cte(f"{x}_lim", f"SELECT window_id, avg(g) + 0.75 * stddev_pop(g) AS lim FROM {x}_mag GROUP BY 1")
    cte(
        f"{x}_nb",
        f"""SELECT window_id, g, lag(g) OVER (PARTITION BY window_id ORDER BY p) AS l,
        lead(g) OVER (PARTITION BY window_id ORDER BY p) AS r FROM {x}_mag""",
    )
    cte(
        f"{x}_peak",
        f"""SELECT b.window_id, CAST(sum(CASE WHEN g > l AND g > r AND g > lim THEN 1 ELSE 0 END) AS DOUBLE) AS peaks
        FROM {x}_nb b JOIN {x}_lim t ON t.window_id = b.window_id GROUP BY 1""",
    )
    cte(
        f"{x}_tb",
        f"""SELECT t.window_id, n, unnest([0, 1, 2]) AS part, top, c.sd FROM {x}_top t JOIN {x}_n n ON n.window_id = t.window_id
        JOIN {x}_ch c ON c.window_id = t.window_id AND c.ch = t.top WHERE rk = 1""",
    )
    cte(
        f"{x}_tc",
        f"SELECT *, part * (n // 3) + least(part, n % 3) AS s, n // 3 + CASE WHEN n % 3 > part THEN 1 ELSE 0 END AS len FROM {x}_tb",
    )
    cte(
        f"{x}_tw",
        f"""SELECT t.window_id, part, CASE WHEN len < 2 THEN 'stable' WHEN b.v - a.v > 0.2 * (sd + 1e-6) THEN 'rise'
        WHEN b.v - a.v < -0.2 * (sd + 1e-6) THEN 'fall' ELSE 'stable' END AS w FROM {x}_tc t
        JOIN {long} a ON a.window_id = t.window_id AND a.ch = top AND a.p = s
        JOIN {long} b ON b.window_id = t.window_id AND b.ch = top AND b.p = s + len - 1""",
    )
    cte(
        f"{x}_trend",
        f"""SELECT window_id, max(CASE WHEN part = 0 THEN w END) AS t0, max(CASE WHEN part = 1 THEN w END) AS t1,
        max(CASE WHEN part = 2 THEN w END) AS t2 FROM {x}_tw GROUP BY 1""",
    )
    cte(
        f"{x}_pair",
        f"""SELECT a.window_id, a.ch AS i, b.ch AS j, corr(a.v, b.v) AS r FROM {long} a JOIN {long} b
        ON b.window_id = a.window_id AND b.p = a.p AND b.ch > a.ch
        JOIN {x}_ch ca ON ca.window_id = a.window_id AND ca.ch = a.ch AND ca.sd > 1e-8
        JOIN {x}_ch cb ON cb.window_id = b.window_id AND cb.ch = b.ch AND cb.sd > 1e-8 GROUP BY 1, 2, 3""",
    )
    who = lambda c: case(c, {i: n for i, n in enumerate(names)}, "''")
    cte(
        f"{x}_rel",
        f"""SELECT window_id, CASE WHEN abs(r) >= 0.45 THEN concat({who('i')}, ' and ', {who('j')},
        CASE WHEN r > 0 THEN ' move synchronously' ELSE ' move oppositely' END) ELSE 'no clear relation' END AS rel, abs(r) AS strength
        FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(r) DESC, i, j) AS rk FROM {x}_pair) WHERE rk = 1""",
    )
    cte(
        f"{x}_stat",
        f"""SELECT n.window_id, sqrt(avg(c.e * c.e)) AS rms, max(ac) AS ac, max(ratio) AS ratio, max(hz) AS hz, max(peaks) AS peaks,
        max(t.top) AS top, bool_or(t.contested) AS contested, max(t0) AS t0, max(t1) AS t1, max(t2) AS t2,
        coalesce(max(rel), 'no clear relation') AS rel
        FROM {x}_n n JOIN {x}_ch c ON c.window_id = n.window_id JOIN {x}_top t ON t.window_id = n.window_id AND t.rk = 1
        JOIN {x}_ac a ON a.window_id = n.window_id JOIN {x}_spec s ON s.window_id = n.window_id
        JOIN {x}_peak p ON p.window_id = n.window_id JOIN {x}_trend w ON w.window_id = n.window_id
        LEFT JOIN {x}_rel r ON r.window_id = n.window_id GROUP BY 1""",
    )


def card_ctes(x: str, identity: str, names: list[str]) -> None:
    """Cards of the statistics ``{x}_stat``; ``identity`` gives window_id, dataset_id, split, label, subject_id."""
    cte(f"{x}_id", identity)
    cte(
        f"{x}_q",
        f"""SELECT quantile_cont(rms, 0.33) AS rl, quantile_cont(rms, 0.67) AS rh, quantile_cont(peaks, 0.33) AS pl,
        quantile_cont(peaks, 0.67) AS ph, quantile_cont(hz, 0.33) AS hl, quantile_cont(hz, 0.67) AS hh
        FROM {x}_stat JOIN {x}_id USING (window_id) WHERE split = 'train'""",
    )
    axis = case("top", {i: n for i, n in enumerate(names)}, "''")
    cte(
        f"{x}_w",
        f"""SELECT i.*, s.* EXCLUDE (window_id), hl, hh,
        CASE WHEN rms <= rl THEN 'low' WHEN rms >= rh THEN 'high' ELSE 'medium' END AS intensity,
        CASE WHEN greatest(ac, ratio) >= 0.55 THEN 'strong' WHEN greatest(ac, ratio) >= 0.25 THEN 'weak' ELSE 'none' END AS periodicity,
        CASE WHEN contested THEN 'uncertain' ELSE {axis} END AS dominant_axis,
        CASE WHEN peaks > ph THEN 'bursty' ELSE 'smooth' END AS burstiness
        FROM {x}_stat s JOIN {x}_id i USING (window_id), {x}_q""",
    )
    cte(
        f"{x}_f",
        f"""SELECT *, CASE WHEN hz <= 1e-8 OR periodicity = 'none' THEN 'uncertain' WHEN hz <= hl THEN 'low'
        WHEN hz >= hh THEN 'high' ELSE 'mid' END AS dominant_frequency FROM {x}_w""",
    )
    cte(
        f"{x}_cards",
        f"""SELECT *, greatest(0.1, 1.0 - 0.15 * (CAST(dominant_axis = 'uncertain' AS INT) + CAST(periodicity = 'none' AS INT)
        + CAST(dominant_frequency = 'uncertain' AS INT) + CAST(rel = 'no clear relation' AS INT)))::DOUBLE AS confidence FROM {x}_f""",
    )


EV_NAMES = ["acc_x", "acc_y", "acc_z"]
GRID_NAMES = ["acc_x", "acc_y", "acc_z", "gyro_x"]
stat_ctes("ev", "ev_long", 20.0, EV_NAMES)
card_ctes("ev", "SELECT window_id, 'wisdm' AS dataset_id, split, label, subject_id FROM wins", EV_NAMES)
stat_ctes("gr", "grid_long", 50.0, GRID_NAMES)
card_ctes("gr", "SELECT window_id, dataset_id, split, label, subject_id FROM grid", GRID_NAMES)
stat_ctes("tn", "tone_long", 50.0, ["tone"])

# ---- features and centroids -----------------------------------------------------------------------

cte(
    "gr_feat",
    """SELECT window_id, ch AS pos, m AS x FROM gr_ch UNION ALL SELECT window_id, 4 + ch, sd FROM gr_ch
    UNION ALL SELECT window_id, 8 + ch, lo FROM gr_ch UNION ALL SELECT window_id, 12 + ch, hi FROM gr_ch
    UNION ALL SELECT window_id, 16 + ch, e FROM gr_ch
    UNION ALL SELECT window_id, 20, avg(g) FROM gr_mag GROUP BY 1 UNION ALL SELECT window_id, 21, stddev_pop(g) FROM gr_mag GROUP BY 1
    UNION ALL SELECT window_id, 22, max(g) - min(g) FROM gr_mag GROUP BY 1""",
)
cte(
    "gr_scale",
    """SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS s
    FROM gr_feat JOIN grid USING (window_id) WHERE split = 'train' GROUP BY 1""",
)
cte(
    "gr_z",
    "SELECT window_id, pos, (x - m) / s AS z, split, label FROM gr_feat JOIN gr_scale USING (pos) JOIN grid USING (window_id)",
)
cte("gr_center", "SELECT label AS cl, pos, avg(z) AS c FROM gr_z WHERE split = 'train' GROUP BY 1, 2")
cte(
    "gr_guess",
    """SELECT window_id, label, arg_min(cl, (d, cl)) AS predicted FROM (SELECT window_id, label, cl, sum((z - c) * (z - c)) AS d
    FROM gr_z JOIN gr_center USING (pos) WHERE split = 'test' GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)

# ---- benchmark texts ------------------------------------------------------------------------------

EDITS = {
    "easy": {
        "intensity": case("intensity", ph.EASY_EDITS["intensity"][0], "'high'"),
        "periodicity": case("periodicity", ph.EASY_EDITS["periodicity"][0], "'strong'"),
        "dominant_axis": "(CASE WHEN dominant_axis = 'acc_x' THEN 'acc_y' ELSE 'acc_x' END)",
        "dominant_frequency": case("dominant_frequency", ph.EASY_EDITS["dominant_frequency"][0], "'mid'"),
        "burstiness": "(CASE WHEN burstiness = 'bursty' THEN 'smooth' ELSE 'bursty' END)",
    },
    "hard": {
        "intensity": case("intensity", ph.HARD_EDITS["intensity"][0], "'high'"),
        "periodicity": case("periodicity", ph.HARD_EDITS["periodicity"][0], "'strong'"),
        "dominant_axis": "(CASE WHEN dominant_axis = 'acc_x' THEN 'acc_y' ELSE 'acc_x' END)",
        "dominant_frequency": case("dominant_frequency", ph.HARD_EDITS["dominant_frequency"][0], "'mid'"),
        "burstiness": "(CASE WHEN burstiness = 'bursty' THEN 'smooth' ELSE 'bursty' END)",
    },
}
TREND = "concat_ws(', ', t0, t1, t2)"


def easy_text(**edit: str) -> str:
    f = {k: edit.get(k, k) for k in ph.FIELDS}
    return (
        f"concat('The motion intensity is ', {f['intensity']}, '. The signal shows ', {f['periodicity']}, "
        f"' periodicity. The dominant movement axis is ', {f['dominant_axis']}, '. The dominant frequency is ', "
        f"{f['dominant_frequency']}, '. The movement is ', {f['burstiness']}, '. ', "
        f"CASE WHEN rel = 'no clear relation' THEN '' ELSE concat(rel, '. ') END, 'The main trend pattern is ', {TREND}, '.')"
    )


def axis_words(a: str) -> str:
    return case(a, ph.AXIS_WORDS, f"replace({a}, '_', ' ')")


def v3_axis(a: str) -> str:
    return (
        f"(CASE WHEN {a} = 'uncertain' THEN 'energy is spread across channels without a clear leader' "
        f"ELSE concat('the largest per-axis energy is on the ', {axis_words(a)}) END)"
    )


def v3_text(**edit: str) -> str:
    f = {k: edit.get(k, k) for k in ph.FIELDS}
    return (
        f"concat('Overall, the motion shows ', {case(f['intensity'], ph.V3_INTENSITY, 'NULL')}, ', ', "
        f"{case(f['periodicity'], ph.V3_PERIODICITY, 'NULL')}, ', ', {v3_axis(f['dominant_axis'])}, ', ', "
        f"{case(f['dominant_frequency'], ph.V3_FREQUENCY, 'NULL')}, ', and ', {case(f['burstiness'], ph.V3_BURST, 'NULL')}, '.')"
    )


def band(v: str) -> str:
    return case(v, ph.BAND_HINTS, f"'{ph.OTHER_BAND}'")


def trend_words() -> str:
    return "concat_ws(', then ', " + ", ".join(case(t, ph.TREND_WORDS, t) for t in ("t0", "t1", "t2")) + ")"


V3_EVIDENCE = (
    "concat('RMS energy is ', printf('%.3f', rms), ', ', " + band("intensity") + ", '. The repeatability scores are autocorrelation ', "
    "printf('%.3f', ac), ' and FFT concentration ', printf('%.3f', ratio), ', ', " + band("periodicity") + ", '. Axis comparison: ', "
    + v3_axis("dominant_axis") + ", '. The dominant spectral peak is ', printf('%.3f', hz), ' Hz, ', " + band("dominant_frequency")
    + ", '. Peak count is ', printf('%.0f', peaks), ', with the profile ', " + band("burstiness")
    + ", ' for burstiness. Segment slopes move ', " + trend_words() + ", '.', CASE WHEN rel = 'no clear relation' THEN '' ELSE "
    "concat(' Pairwise channel check: ', rel, '.') END)"
)


def hard_words(field: str, value: str) -> str:
    table = {
        "intensity": ph.INTENSITY_PHRASES,
        "periodicity": ph.PERIODICITY_PHRASES,
        "dominant_frequency": ph.FREQUENCY_PHRASES,
        "burstiness": ph.BURST_PHRASES,
    }
    return axis_words(value) if field == "dominant_axis" else case(value, table[field], f"replace({value}, '_', ' ')")


_LEAD = (
    "(CASE WHEN dominant_axis = 'uncertain' THEN 'without a single clearly dominant channel' ELSE "
    "concat('strongest evidence from the ', " + axis_words("dominant_axis") + ") END)"
)
_W = {f: hard_words(f, f) for f in ph.FIELDS}
HARD_POSITIVE = {
    "v1": f"concat('A supported description is ', {_W['intensity']}, ' with ', {_W['periodicity']}, ', ', {_LEAD}, ', and ', {_W['dominant_frequency']}, '.')",
    "v2": f"concat('The movement has ', {_W['intensity']}, ' and ', {_W['periodicity']}, ', ', {_LEAD}, ', with ', {_W['dominant_frequency']}, '.')",
    "v3": v3_text(),
}
HARD_EVIDENCE = (
    f"concat('The window shows ', {_W['intensity']}, ' with ', {_W['periodicity']}, '. ', CASE WHEN dominant_axis = 'uncertain' THEN "
    f"'No single channel clearly dominates the activity' ELSE concat('The clearest activity is in the ', {_W['dominant_axis']}) END, "
    f"', and the temporal pattern suggests ', {_W['dominant_frequency']}, '. Across the window, ', {_W['burstiness']}, "
    f"'. The coarse segment shape is ', {trend_words()}, '.', CASE WHEN rel = 'no clear relation' THEN '' ELSE "
    "concat(' A channel relation is visible: ', rel, '.') END)"
)
_H = {f: hard_words(f, EDITS["hard"][f]) for f in ph.FIELDS}
HARD_WRONG = {
    "v1": {
        "intensity": f"concat('This description claims ', {_H['intensity']}, ', while keeping the same rhythm and main channel.')",
        "periodicity": f"concat('This description says the trace has ', {_H['periodicity']}, ' and otherwise matches the same amplitude and channel evidence.')",
        "dominant_axis": f"concat('This description shifts the strongest activity to the ', {_H['dominant_axis']}, ', while leaving the cadence and amplitude unchanged.')",
        "dominant_frequency": f"concat('This description keeps the same channel and amplitude but says the motion has ', {_H['dominant_frequency']}, '.')",
        "burstiness": f"concat('This description says ', {_H['burstiness']}, ', despite the rest of the evidence being unchanged.')",
    },
    "v2": {
        "intensity": f"concat('The movement has ', {_H['intensity']}, ' while following the same rhythm and main channel.')",
        "periodicity": f"concat('The trace shows ', {_H['periodicity']}, ' with otherwise similar amplitude and channel evidence.')",
        "dominant_axis": f"concat('The strongest activity comes from the ', {_H['dominant_axis']}, ', with the same cadence and amplitude.')",
        "dominant_frequency": f"concat('The motion keeps the same channel and amplitude while showing ', {_H['dominant_frequency']}, '.')",
        "burstiness": "'The trace contains short, spiky bursts while the other properties remain similar.'",
    },
}
V3_SPECS = [
    ["intensity", "dominant_frequency"],
    ["periodicity", "burstiness"],
    ["dominant_axis", "periodicity"],
    ["burstiness", "dominant_frequency"],
    ["intensity"],
]


def _items(name: str, positive: str, wrong: list[tuple[str, str]]) -> None:
    """Statements of a benchmark: i = 0 is the positive."""
    parts = [f"SELECT window_id, 0 AS i, {positive} AS text, NULL AS fact FROM ev_cards"]
    parts += [f"SELECT window_id, {k}, {text}, '{fact}' FROM ev_cards" for k, (fact, text) in enumerate(wrong, start=1)]
    cte(f"{name}_items", " UNION ALL ".join(parts))
    cte(
        f"{name}_choice",
        f"SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY md5(concat('42:', window_id, ':', i))) - 1 AS pos "
        f"FROM {name}_items WHERE i <= 3",
    )
    cte(f"{name}_answer", f"SELECT window_id, pos AS answer FROM {name}_choice WHERE i = 0")


_items("easy", easy_text(), [(f, easy_text(**{f: EDITS["easy"][f]})) for f in ph.FIELDS])
for _v in ("v1", "v2"):
    _items(f"hard_{_v}", HARD_POSITIVE[_v], [(f, HARD_WRONG[_v][f]) for f in ph.FIELDS])
_items("hard_v3", v3_text(), [("+".join(fs), v3_text(**{f: EDITS["hard"][f] for f in fs})) for fs in V3_SPECS])
cte("hard_v3_text", f"SELECT window_id, {V3_EVIDENCE} AS evidence_text FROM ev_cards")

# ---- fields from texts ----------------------------------------------------------------------------


def mention(lower: str, phrases: list[tuple[str, str]]) -> str:
    arms = " ".join(f"WHEN contains({lower}, '{p}') THEN '{v}'" for p, v in phrases)
    return f"(CASE {arms} END)"


def caption_claims(lower: str) -> str:
    named = [(p, a) for p, a in ph.axis_mentions() if a != "uncertain"]
    cols = {f: mention(lower, ph.CLAIM_PHRASES[f]) for f in ph.CLAIM_PHRASES}
    cols["dominant_axis"] = (
        f"(CASE WHEN contains({lower}, 'without a single clearly dominant channel') THEN 'uncertain' ELSE {mention(lower, named)} END)"
    )
    return ", ".join(f"{cols[f]} AS c_{f}" for f in ph.FIELDS)


def statement_claims(lower: str) -> str:
    def word(lead: str, vocab: list[str]) -> str:
        w = f"regexp_extract({lower}, '{lead}\\s+([a-z0-9_]+)', 1)"
        return f"CASE WHEN {w} IN ({', '.join(repr(v) for v in vocab)}) THEN {w} END"

    cols = {f: mention(lower, ph.STATEMENT_PHRASES[f]) for f in ph.STATEMENT_PHRASES}
    axes = ph.VOCABULARY["dominant_axis"]
    seen = mention(lower, [*ph.axis_mentions(), ("strongest activity on uncertain", "uncertain")])
    cols["dominant_axis"] = (
        f"coalesce({word('strongest activity on', axes)}, {word('dominant movement axis is', axes)}, {seen})"
    )
    cols["dominant_frequency"] = (
        f"coalesce({word('dominant frequency is', ph.VOCABULARY['dominant_frequency'])}, {cols['dominant_frequency']})"
    )
    return ", ".join(f"{cols[f]} AS c_{f}" for f in ph.FIELDS)


_SAY = {
    "intensity": "CASE WHEN contains(t, 'lower reference band') THEN 'low' WHEN contains(t, 'middle reference band') THEN 'medium' "
    "WHEN contains(t, 'upper reference band') AND contains(t, 'rms energy') THEN 'high' END",
    "periodicity": "CASE WHEN contains(t, 'below the repeatability reference') THEN 'none' WHEN contains(t, 'near the repeatability reference') "
    "THEN 'weak' WHEN contains(t, 'above the repeatability reference') THEN 'strong' END",
    "dominant_axis": "CASE WHEN contains(t, 'without a clear leader') OR contains(t, 'no single channel clearly dominates') THEN 'uncertain' ELSE "
    + mention("t", ph.axis_mentions())
    + " END",
    "dominant_frequency": "CASE WHEN contains(t, 'dominant spectral peak') THEN CASE WHEN contains(t, 'without a stable reference crossing') "
    "THEN 'uncertain' WHEN contains(t, 'above the upper reference band') THEN 'high' WHEN contains(t, 'middle reference band') THEN 'mid' "
    "WHEN contains(t, 'lower reference band') THEN 'low' END END",
    "burstiness": "CASE WHEN contains(t, 'spiky') OR contains(t, 'short spikes') THEN 'bursty' WHEN contains(t, 'even profile') THEN 'smooth' END",
}
cte(
    "v3_said",
    "SELECT window_id, " + ", ".join(f"{e} AS s_{f}" for f, e in _SAY.items())
    + ", CAST(regexp_extract(t, 'rms energy is\\s+([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS n_rms"
    + ", CAST(regexp_extract(t, 'autocorrelation\\s+([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS n_ac"
    + ", CAST(regexp_extract(t, 'fft concentration\\s+([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS n_ratio"
    + ", CAST(regexp_extract(t, 'dominant spectral peak is\\s+([-+]?\\d+(?:\\.\\d+)?)\\s*hz', 1) AS DOUBLE) AS n_hz"
    + ", CAST(regexp_extract(t, 'peak count is\\s+([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS n_peaks"
    + " FROM (SELECT window_id, lower(evidence_text) AS t FROM hard_v3_text)",
)
_MEANS = {
    "intensity": ("rms", ["low", "medium", "high"]),
    "periodicity": ("ac", ["none", "weak", "strong"]),
    "dominant_frequency": ("hz", ["low", "mid", "high"]),
    "burstiness": ("peaks", ["smooth", "bursty"]),
}
cte(
    "class_means",
    "SELECT "
    + ", ".join(f"avg(CASE WHEN {f} = '{w}' THEN {m} END) AS {f}_{w}" for f, (m, ws) in _MEANS.items() for w in ws)
    + " FROM ev_cards WHERE split = 'train'",
)


def _infer(f: str) -> str:
    m, ws = _MEANS[f]
    n = f"n_{m}"
    mid = [f"(({f}_{a} + {f}_{b}) / 2)" for a, b in zip(ws, ws[1:])]
    known = " AND ".join(f"{f}_{w} IS NOT NULL" for w in ws)
    if len(ws) == 2:
        return f"CASE WHEN {known} AND {n} IS NOT NULL THEN CASE WHEN {n} >= {mid[0]} THEN 'bursty' ELSE 'smooth' END END"
    return (
        f"CASE WHEN {known} AND {n} IS NOT NULL THEN CASE WHEN {n} < {mid[0]} THEN '{ws[0]}' WHEN {n} < {mid[1]} THEN '{ws[1]}' "
        f"ELSE '{ws[2]}' END END"
    )


cte(
    "v3_fields",
    "SELECT window_id, s_dominant_axis AS f_dominant_axis, "
    + ", ".join(f"coalesce(s_{f}, {_infer(f)}) AS f_{f}" for f in _MEANS)
    + " FROM v3_said, class_means",
)
cte("v3_claims", f"SELECT window_id, i, fact, {caption_claims('lower(text)')} FROM hard_v3_items")
_ANY = " + ".join(f"CAST(c_{f} IS NOT NULL AS INT)" for f in ph.FIELDS)
_ALL = " AND ".join(f"(c_{f} IS NULL OR coalesce(c_{f} = f_{f}, false))" for f in ph.FIELDS)
cte(
    "v3_held",
    f"SELECT c.window_id, i, fact, CAST(({_ANY}) > 0 AND {_ALL} AS INT) AS held, "
    + " + ".join(f"CAST(coalesce(c_{f} = f_{f}, false) AS INT)" for f in ph.FIELDS)
    + " AS agree, "
    + " + ".join(f"CAST(coalesce(c_{f} <> f_{f}, false) AS INT)" for f in ph.FIELDS)
    + " AS clash FROM v3_claims c JOIN v3_fields f ON f.window_id = c.window_id",
)
cte(
    "v3_rows",
    """SELECT c.window_id, max(a.answer) AS answer, list(h.held ORDER BY c.pos) AS scores, CAST(sum(h.held) AS INT) AS n_held,
    coalesce(min(CASE WHEN h.held = 1 THEN c.pos END), 0) AS best FROM hard_v3_choice c JOIN v3_held h ON h.window_id = c.window_id AND h.i = c.i
    JOIN hard_v3_answer a ON a.window_id = c.window_id GROUP BY 1""",
)

# ---- hashed predictions ----------------------------------------------------------------------------

cte(
    "votes",
    f"""SELECT concat('doc-', doc_id) AS window_id, lang AS dataset, r AS run,
    CASE WHEN {hexnum("concat(doc_id, ':n:', r)")} % 17 = 0 THEN NULL ELSE {hexnum("concat(doc_id, ':', r)")} % 4 END AS pred,
    {hexnum("concat(doc_id, ':a')")} % 4 AS answer, doc_id FROM (SELECT doc_id, lang, unnest([0, 1, 2, 3, 4]) AS r FROM documents)""",
)
cte(
    "score_rows",
    f"""SELECT doc_id, concat('doc-', doc_id) AS window_id, i, {hexnum("concat(doc_id, ':s:', i)")} / 4294967296.0 * 6 AS s
    FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS i FROM documents)""",
)
cte(
    "scored",
    """SELECT doc_id, window_id, arg_min(i, (-s, i)) AS alt, max(s) - max(CASE WHEN rk = 2 THEN s END) AS margin FROM
    (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY s DESC, i) AS rk FROM score_rows) GROUP BY 1, 2""",
)
cte("partners", "SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM labels)")
cte("primaries", "SELECT window_id, dataset, pred, answer, doc_id FROM votes WHERE run = 0")
cte(
    "sides",
    """SELECT p.*, s.alt, s.margin, CASE WHEN p.doc_id % 3 = 0 THEN (s.alt + p.doc_id) % 4 ELSE s.alt END AS alt_mapped
    FROM primaries p LEFT JOIN partners s ON s.window_id = p.window_id""",
)
cte(
    "whole_sides",
    """SELECT p.*, s.alt, s.margin, CASE WHEN p.doc_id % 3 = 0 THEN (s.alt + p.doc_id) % 4 ELSE s.alt END AS alt_mapped
    FROM primaries p JOIN scored s ON s.window_id = p.window_id""",
)
cte(
    "bin_rows",
    f"""SELECT doc_id, quality AS truth, {hexnum("concat(doc_id, ':p')")} / 4294967296.0 AS score FROM labels""",
)
cte(
    "direct",
    f"""SELECT window_id, CASE WHEN {hexnum("concat(window_id, ':n')")} % 7 = 0 THEN NULL ELSE {hexnum("concat(window_id, ':d')")} % 4 END AS d
    FROM hard_v3_answer WHERE {hexnum("concat(window_id, ':m')")} % 13 <> 0""",
)
