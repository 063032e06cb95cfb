"""Least edits that turn a conversation into ``(s?(ua)+)?``: Viterbi over chunks, made parallel by rank convergence.

All turns of all conversations form one sequence, cut into chunks of ``ROWS`` turns, so a conversation of any
length is worked on by many tasks. The least cost from a turn to the end of its conversation is a vector over the
four states of the pattern. Every chunk first runs backwards from a guessed vector. Then fix-up passes: a chunk takes
the vector that its successor found for their border and runs again, from its end, until the new vector differs
from the former one by a constant only - from there on all choices are the same and the old run stands. Passes go
on until no chunk's first vector changes; an end of a conversation inside a chunk ends the dependence at once.

Forwards, a chunk traces the least audit from each state it may be entered in; the maps from entered to left state
are composed over 1, 2, 4, ... chunks until each is constant, and the trace from the true state is the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesift.llm.text import stored
from kinesift.operators.scan import prefix_scan

#: Turns in a chunk.
ROWS = 4096

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

# What is known of a turn: its role's initial, and marks.
INITIALS = {"u": 1, "a": 2, "s": 3}
BLANK, TRUNCATED, FIRST, LAST = 4, 8, 16, 32

# States: nothing yet, after the system turn, after a user's, after an assistant's. Legal ends: 0 and 3.
ENTERS = {(0, 3): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: The state after an inserted or re-roled turn: only one of the two roles fits.
FILLED = (2, 2, 3, 2)
FILLER = ("user", "user", "assistant", "user")

Vector = tuple[int, ...]


def _with_inserts(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(c, INSERT + costs[FILLED[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


END: Vector = _with_inserts([0, 99, 99, 0])


def _plain(vector: Vector) -> Vector:
    """Vectors that differ by a constant are the same one."""
    return tuple(c - min(vector) for c in vector)


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what may be done to a turn, in order of the initial."""
    found = [("D", DELETE, state)]
    if code & BLANK or not code & FIRST:
        return found
    more = CUT if code & TRUNCATED else 0
    if (state, code & 3) in ENTERS:
        found.append(("K", KEEP + more, ENTERS[state, code & 3]))
    return [*found, ("R", REROLE + more, FILLED[state])]


# There are few plain vectors and codes: steps once taken are looked up.
_KNOWN: dict = {}


def _before(code: int, after: Vector) -> Vector:
    """Costs before a turn from the costs behind it, not made plain."""
    if (code, after) not in _KNOWN:
        _KNOWN[code, after] = _with_inserts([min(cost + after[to] for _, cost, to in _edits(code, s)) for s in range(4)])
    return _KNOWN[code, after]


def _done(code: int, after: Vector, state: int) -> tuple[str, int, int]:
    """(audit, cost, next state): inserts before a turn and its edit, the least of the cheapest."""
    if (code, after, state) not in _KNOWN:
        _KNOWN[code, after, state] = _least(code, after, state)
    return _KNOWN[code, after, state]


def _least(code: int, after: Vector, state: int) -> tuple[str, int, int]:
    costs, audit, total = _before(code, after), "", 0
    while True:
        for name, cost, to in [_edits(code, state)[0], ("I", INSERT, FILLED[state]), *_edits(code, state)[1:]]:
            if costs[state] == cost + (costs[to] if name == "I" else after[to]):
                audit, total = audit + name, total + cost
                break
        if name != "I":
            return audit, total, to
        state = to


def _closed(state: int) -> tuple[str, int]:
    """Inserts behind the last turn."""
    n = {0: 0, 3: 0, 2: 1, 1: 2}[state]
    return "I" * n, INSERT * n


def _vectors(codes: bytes, end: Vector) -> list[Vector]:
    """The plain vector behind every turn."""
    out, now = [], end
    for code in reversed(codes):
        now = END if code & LAST else now
        out.append(now)
        now = _plain(_before(code, now))
    return out[::-1]


def _first_vector(codes: bytes, end: Vector, former: Vector | None = None) -> Vector | None:
    """The vector before the first turn; None as soon as the run meets the one from ``former``."""
    now, old = end, former
    for code in reversed(codes):
        if code & LAST:
            now = END
            old = END if former else None
        if now == old:
            return None
        now = _plain(_before(code, now))
        old = _plain(_before(code, old)) if former else None
    return None if now == old else now


def _trace(codes: bytes, behind: list[Vector], state: int) -> Iterator[tuple[int, str, int, int]]:
    """(turn, audit, cost, state behind it) from the state in which the chunk is entered."""
    for i, code in enumerate(codes):
        audit, cost, state = _done(code, behind[i], state)
        if code & LAST:
            more, price = _closed(state)
            audit, cost, state = audit + more, cost + price, 0
        yield i, audit, cost, state


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a chunk's turns -> their codes, where conversations begin, and a first guess."""
    for batch in batches:
        codes, segments, starts = [], [], []
        for chunk, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.zeros(max(m["i"] for m in marks) + 1, np.uint8)
            np.bitwise_or.at(own, [m["i"] for m in marks], np.array([m["code"] for m in marks], np.uint8))
            codes.append(own.tobytes())
            heads = {0} | {i + 1 for i in np.flatnonzero(own & LAST).tolist() if i + 1 < len(own)}
            segments.append([s for s in sorted({(m["i"], m["conv"]) for m in marks if m["i"] in heads}, key=lambda s: s[0])])
            starts.append(list(_first_vector(codes[-1], END)))
        kind = batch.schema.field(1).type.value_type.field("conv").type
        segment = pa.list_(pa.struct([("i", pa.int32()), ("conv", kind)]))
        vector = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(codes, pa.binary()), pa.array([[{"i": i, "conv": c} for i, c in s] for s in segments], segment)]
            + [pa.array([list(END)] * len(codes), vector), pa.array(starts, vector), pa.array([True] * len(codes))],
            names=["chunk", "codes", "segments", "end", "start", "moved"],
        )


def _fix_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, codes, end, start, next): run again from the successor's vector where it is another one."""
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("codes", "end", "start", "next")), strict=True)
        ends, starts, moved = [], [], []
        for codes, end, start, border in rows:
            found = None
            if border and border != end:
                found = _first_vector(codes, tuple(border), tuple(end))
            ends.append(border or end)
            starts.append(list(found) if found else start)
            moved.append(found is not None)
        vector = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("chunk"), batch.column("codes"), batch.column("segments"), pa.array(ends, vector), pa.array(starts, vector), pa.array(moved)],
            names=["chunk", "codes", "segments", "end", "start", "moved"],
        )


def _maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every chunk the state it leaves behind for each state it is entered in."""
    for batch in batches:
        out = []
        for codes, end in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            behind = _vectors(codes, tuple(end))
            out.append([[s for *_, s in _trace(codes, behind, state)][-1] for state in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["chunk", "leaves"])


def _audits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, codes, segments, end, state, before) -> audit, cost and illegal pairs of every conversation's part."""
    legal = {(3, 1), (1, 2), (2, 1)}
    for batch in batches:
        out = []
        rows = zip(*(batch.column(n).to_pylist() for n in ("chunk", "codes", "segments", "end", "state", "before")), strict=True)
        for chunk, codes, segments, end, state, before in rows:
            heads = {s["i"]: s["conv"] for s in segments}
            last = None if before is None or before & LAST else before & 3
            for i, audit, cost, _ in _trace(codes, _vectors(codes, tuple(end)), state):
                if i in heads:
                    part = [chunk, heads[i], [], 0, 0]
                    out.append(part)
                part[2].append(audit)
                part[3] += cost
                part[4] += last is not None and (last, codes[i] & 3) not in legal
                last = None if codes[i] & LAST else codes[i] & 3
        if out:
            chunk, conv, audit, cost, illegal = zip(*out, strict=True)
            kind = batch.schema.field("segments").type.value_type.field("conv").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, kind), pa.array(chunk, pa.int64()), pa.array(["".join(a) for a in audit]), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64())],
                names=["conv", "chunk", "audit", "cost", "illegal"],
            )


def _settled(chunks: DataFrame) -> DataFrame:
    """Fix-up passes until every chunk ran from the vector of its successor."""
    while chunks.filter("moved").limit(1).count():
        border = chunks.filter("moved").select((F.col("chunk") - 1).alias("chunk"), F.col("start").alias("next"))
        given = chunks.drop("moved").join(border, "chunk", "left")
        chunks = stored(given.mapInArrow(_fix_up, chunks.schema), "repair-pass")
    return chunks


def _entered(chunks: DataFrame) -> DataFrame:
    """(chunk, state): the state in which the least audit enters every chunk."""
    leaves = chunks.select("chunk", "codes", "end").mapInArrow(_maps, "chunk long, leaves array<int>")
    back = leaves.select((F.col("chunk") + 1).alias("chunk"), F.col("leaves").alias("via"))
    first = F.array(*[F.lit(0)] * 4)
    maps = stored(chunks.select("chunk").join(back, "chunk", "left").select("chunk", F.coalesce("via", first).alias("via")), "repair-maps")
    step = 1
    while maps.filter(F.size(F.array_distinct("via")) > 1).limit(1).count():
        earlier = maps.select((F.col("chunk") + step).alias("chunk"), F.col("via").alias("first"))
        composed = F.when(F.col("first").isNull(), F.col("via")).otherwise(F.transform("first", lambda s: F.get("via", s)))
        maps = stored(maps.join(earlier, "chunk", "left").select("chunk", composed.alias("via")), "repair-maps")
        step *= 2
    return maps.select("chunk", F.get("via", F.lit(0)).alias("state"))


def _noted(turns: DataFrame) -> DataFrame:
    """Turns in the form that is worked on: nulls of role and text as one space, a digest for the text."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest")
    )


def audits(turns: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(parts, counts) of conversations ``turns`` (conv_id, turn, role, text).

    ``parts``: (conv, chunk, audit, cost, illegal) - the audit of a conversation is the concatenation of its parts in
    order of ``chunk``, cost and illegal pairs are sums. ``counts``: (conv, gaps, blank, duplicate, truncated).
    """
    noted = _noted(turns)
    initial = F.substring("role", 1, 1)
    sign = F.lit(0)
    for name, value in INITIALS.items():
        sign = F.when(initial == name, value).otherwise(sign)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = sign + F.when(blank, BLANK).otherwise(F.when(cut, TRUNCATED).otherwise(0))
    # Equal turns are alike in all that follows; the random column only lets them share tasks.
    slim = noted.select("conv", "turn", "role", "digest", code.alias("code"), F.rand(11).alias("salt"))
    order = prefix_scan(slim, ["conv", "turn", "role", "digest", "salt"], index="at").drop("salt")
    full = F.col("code").bitwiseAND(BLANK) == 0
    firsts = order.filter(full).groupBy("conv", "role", "digest").agg(F.min("at").alias("at"), F.max("code").alias("code"))
    per_conv = order.groupBy("conv").agg(
        F.max("at").alias("at"),
        F.max("turn").alias("high"),
        F.min("turn").alias("low"),
        F.count_distinct("turn").alias("turns"),
        F.count_if(~full).alias("blank"),
        F.count_if(full).alias("full"),
    )
    per_first = firsts.groupBy("conv").agg(F.count(F.lit(1)).alias("firsts"), F.count_if(F.col("code").bitwiseAND(TRUNCATED) > 0).alias("cut"))
    other = per_first.withColumnRenamed("conv", "_conv")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    firsts_n, cut_n = F.coalesce("firsts", F.lit(0)), F.coalesce("cut", F.lit(0))
    counts = per_conv.join(other, F.col("conv").eqNullSafe(F.col("_conv")), "left").select(
        "conv", gaps.alias("gaps"), "blank", (F.col("full") - firsts_n).alias("duplicate"), cut_n.alias("truncated")
    )
    marks = order.select("at", "conv", "code")
    marks = marks.unionByName(firsts.select("at", "conv", F.lit(FIRST).alias("code")))
    marks = marks.unionByName(per_conv.select("at", "conv", F.lit(LAST).alias("code")))
    item = F.struct((F.col("at") % rows).cast("int").alias("i"), F.col("code").cast("int").alias("code"), "conv")
    grouped = marks.groupBy(F.floor(F.col("at") / rows).alias("chunk")).agg(F.collect_list(item).alias("marks"))
    conv = turns.select("conv_id").schema[0].dataType.simpleString()
    made = f"chunk long, codes binary, segments array<struct<i: int, conv: {conv}>>, end array<int>, start array<int>, moved boolean"
    chunks = _settled(stored(grouped.mapInArrow(_assemble, made), "repair-chunks"))
    states = _entered(chunks).withColumnRenamed("chunk", "_chunk")
    behind = chunks.select((F.col("chunk") + 1).alias("_after"), F.conv(F.hex(F.substring("codes", -1, 1)), 16, 10).cast("int").alias("before"))
    ready = chunks.join(states, F.col("chunk") == F.col("_chunk")).join(behind, F.col("chunk") == F.col("_after"), "left")
    ready = ready.select("chunk", "codes", "segments", "end", "state", "before")
    parts = ready.mapInArrow(_audits, f"conv {conv}, chunk long, audit string, cost long, illegal long")
    return stored(parts, "repair-parts"), counts


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation first its audit, then its turns in order: the turns after the edits."""
    conv, audit, at, state, no, begun = None, "", 0, 0, 0, False
    kinds, out = [], []

    def emit(role, text):
        nonlocal no
        out.append((conv, no, role, text))
        no += 1

    def fill():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            emit(FILLER[state], "")
            at, state = at + 1, FILLED[state]

    def packed():
        columns = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["conv_id", "no", "role", "text"])

    for batch in batches:
        kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string()]
        for own, kind, piece, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "audit", "role", "text")), strict=True):
            if not begun or own != conv:
                fill()
                conv, audit, at, state, no, begun = own, "", 0, 0, 0, True
            if kind == 0:
                audit += piece
                continue
            fill()
            if audit[at] == "K":
                emit(role, text)
                state = ENTERS[state, INITIALS[role[0]]]
            elif audit[at] == "R":
                emit(FILLER[state], text)
                state = FILLED[state]
            at += 1
        yield packed()
    if begun:
        fill()
        yield packed()


def repaired(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv_id, no, role, text): the conversations after the edits of ``parts`` (from :func:`audits`).

    Turns come in order, all of a conversation in one task, which reads them as a stream.
    """
    noted = _noted(turns)
    none = F.lit(None)
    edits = parts.select("conv", F.lit(0).alias("kind"), "chunk", "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"), none.cast("string").alias("text"))
    rows = noted.select("conv", F.lit(1).alias("kind"), none.cast("long").alias("chunk"), none.cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text")
    together = edits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "chunk", "turn", "role", "digest")
    conv = turns.select("conv_id").schema[0].dataType.simpleString()
    return together.mapInArrow(_apply, f"conv_id {conv}, no long, role string, text string")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines of conversations that come one after another."""
    conv, state, kind = None, None, None
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for own, no, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if no == 0:
                if state:
                    out.append((conv, state.hexdigest()))
                conv, state = own, hashlib.sha256()
            state.update(f"{chr(10) if no else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out], pa.string())], names=["conv_id", "digest"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["conv_id", "digest"])


def report(turns: DataFrame, ids: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id): faults, least cost, audit and a digest of the repaired turns.

    Turns go by number (nulls first), then role and digest of the text; equal rows are interchangeable. Null roles
    and texts count as one space; a null conv_id is a conversation like any other. A conversation without turns
    has zeros, an empty audit and the digest of nothing. Extra columns are ignored; no rows give no rows. The digest
    depends on the order of all turns, so it is taken in one task per conversation, as a stream.
    """
    parts, counts = audits(turns, rows)
    conv = turns.select("conv_id").schema[0].dataType.simpleString()
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
    whole = parts.groupBy("conv").agg(
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal")
    )
    lines = repaired(turns, parts).mapInArrow(_digests, f"conv_id {conv}, digest string")
    out = ids.select("conv_id").distinct()
    for frame, name in ((counts, "conv"), (whole, "conv"), (lines, "conv_id")):
        right = frame.withColumnRenamed(name, "_conv")
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", empty).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """What the registered query repairs: a quarter of the turns dropped, emptied, stripped, repeated or re-roled."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.filter(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")

