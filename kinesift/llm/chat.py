"""Chat formatting: who speaks in a raw transcript is recovered by a hidden Markov model, then turns are rendered.

A transcript is a text of lines. Some lines start with a speaker marker, many don't. The states are the roles, each
as the first line of a turn or a further one; a line shows its marker, length, start and end. Start, transition and
emission chances are counted on labelled turns; Viterbi finds the likeliest states of a transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["system", "user", "assistant"]
#: States: role r as first line (2 r) or further line (2 r + 1) of a turn.
STATES = 2 * len(ROLES)
SPEAKERS = {
    "system": "system|system note|context|instructions?",
    "user": "user|human|customer|question|q",
    "assistant": "assistant|ai|bot|agent|answer|a",
}
OPEN, CLOSE = r"^[\s>*#\[<|(]{0,6}", r"[*\]>|)]{0,4}\s*[:\]>|]\s*"
MARKERS = {role: f"(?i){OPEN}(?:{names}){CLOSE}" for role, names in SPEAKERS.items()}
OTHER_MARKER = r"^[A-Z][\w .-]{0,30}:\s"
LENGTHS = [0, 20, 60, 120, 250, 600]
#: Values per feature: marker, length, start, end.
SIZES = (len(ROLES) + 2, len(LENGTHS) + 1, 4, 4)
#: Lines of a transcript that belong together; a longer conversation is cut into pieces of so many turns.
TURNS = 256
END = "<|end|>"


def observed(line: Column) -> Column:
    """The features of a line as one number."""
    marker = F.lit(len(ROLES))
    marker = F.when(line.rlike(OTHER_MARKER), len(ROLES) + 1).otherwise(marker)
    for i, role in reversed(list(enumerate(ROLES))):
        marker = F.when(line.rlike(MARKERS[role]), i).otherwise(marker)
    size = sum((F.when(F.char_length(line) > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    start = F.when(line.rlike(r"^\p{Lu}"), 0).when(line.rlike(r"^\p{Ll}"), 1).when(line.rlike(r"^\s*([-*#]|[0-9]+[.)])"), 2).otherwise(3)
    end = F.when(line.rlike(r"\?\s*$"), 0).when(line.rlike(r"[.!]\s*$"), 1).when(line.rlike(r"[:,;]\s*$"), 2).otherwise(3)
    return ((marker * SIZES[1] + size) * SIZES[2] + start) * SIZES[3] + end


@dataclass
class RoleModel:
    """Log chances: of the first state, from state to state, and of each observation in each state."""

    start: np.ndarray
    step: np.ndarray
    show: np.ndarray

    def states(self, seen: np.ndarray) -> np.ndarray:
        """The likeliest states (Viterbi); ties go to the lower state."""
        if not len(seen):
            return np.zeros(0, np.int64)
        show = self.show[:, seen]
        best = self.start + show[:, 0]
        came = np.zeros((len(seen), STATES), np.int8)
        for t in range(1, len(seen)):
            ways = best[:, None] + self.step
            came[t] = ways.argmax(0)
            best = ways[came[t], np.arange(STATES)] + show[:, t]
        out = np.empty(len(seen), np.int64)
        out[-1] = best.argmax()
        for t in range(len(seen) - 1, 0, -1):
            out[t - 1] = came[t, out[t]]
        return out


def _chances(counts: np.ndarray, weight: float | np.ndarray = 0.5) -> np.ndarray:
    full = counts + weight
    return np.log(full / full.sum(-1, keepdims=True))


def pieces(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, piece, turns): the turns of every conversation in order, cut into pieces of ``TURNS`` turn numbers. Rows
    that are equal in all four columns count once; equal turn numbers go by role and text."""
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    piece = F.floor(F.col(turn) / TURNS).alias("piece")
    return turns.groupBy(F.col(key).alias("key"), piece).agg(F.array_sort(F.collect_set(row)).alias("turns"))


def fit(labelled: DataFrame) -> RoleModel:
    """The model of labelled transcripts (``seen``: observations, ``state``: states, arrays of equal length). Only
    counts leave the table, as many as there are states times states or observations. No rows give even chances."""
    start, step = np.zeros(STATES), np.zeros((STATES, STATES))
    some = labelled.filter(F.size("state") > 0)
    for r in some.groupBy(F.get("state", F.lit(0)).alias("a")).count().collect():
        start[r["a"]] = r["count"]
    each = some.select(F.explode(F.arrays_zip("seen", "state", F.slice("state", 2, 2_000_000_000).alias("next"))).alias("x"))
    for r in each.filter("x.next is not null").groupBy("x.state", "x.next").count().collect():
        step[r["state"], r["next"]] = r["count"]
    show = np.zeros((STATES, int(np.prod(SIZES))))
    for r in each.groupBy("x.state", "x.seen").count().collect():
        show[r["state"], r["seen"]] = r["count"]
    # Features are taken as independent given the state, so rare combinations borrow from their parts.
    grid = show.reshape(STATES, *SIZES)
    joint = np.zeros_like(grid)
    for axis, size in enumerate(SIZES, 1):
        sums = grid.sum(tuple(a for a in range(1, 5) if a != axis))
        joint = joint + _chances(sums).reshape(STATES, *[size if a == axis else 1 for a in range(1, 5)])
    # A state that no label shows is no refuge for odd lines.
    known = show.sum(1) > 0
    into = np.where(known, 0.5, 1e-9) if known.any() else np.full(STATES, 0.5)
    return RoleModel(_chances(start, into), _chances(step, into), joint.reshape(STATES, -1))


def unmarked(line: str) -> str:
    """A turn's first line without its speaker marker."""
    for pattern in MARKERS.values():
        m = re.match(pattern, line)
        if m:
            return line[m.end() :]
    return line


def turns_of(text: str, states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn: a new one starts at a first line, and where the role changes."""
    out: list[tuple[str, list[str]]] = []
    last = -1
    for line, state in zip(text.split("\n"), states.tolist(), strict=True):
        role = ROLES[state // 2]
        if state % 2 == 0 or state // 2 != last:
            out.append((role, [unmarked(line)]))
        else:
            out[-1][1].append(line)
        last = state // 2
    return [(role, "\n".join(lines).strip()) for role, lines in out]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}{END}\n" for role, text in turns)


def formatted(transcripts: DataFrame, model: RoleModel, key: str = "key", text: str = "text") -> DataFrame:
    """(key, states, roles, chat) of every transcript: a state for each line, a role for each turn, the rendered turns.

    Null and empty transcripts have no turn and an empty chat. Repeated rows repeat; an empty table gives an empty one.
    """
    shape = transcripts.select(F.col(key).alias("key")).schema.add("states", "string").add("roles", "string").add("chat", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, roles, chats = [], [], []
            for raw, seen in zip(batch.column(1), batch.column(2), strict=True):
                raw = raw.as_py()
                path = model.states(seen.values.to_numpy()) if raw else np.zeros(0, np.int64)
                turns = turns_of(raw, path) if raw else []
                states.append("".join(map(str, path)))
                roles.append(",".join(role for role, _ in turns))
                chats.append(render(turns))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (states, roles, chats))], ["key", "states", "roles", "chat"])

    t = F.coalesce(F.col(text), F.lit(""))
    rows = transcripts.select(F.col(key).alias("key"), t.alias("text"), F.transform(F.split(t, "\n"), observed).alias("seen"))
    return rows.mapInArrow(run, shape).withColumnRenamed("key", key)


#: How speakers are marked in transcripts made of labelled turns: one style for a conversation.
STYLES = [("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[ai] "), ("Context: ", "Q: ", "A: "), ("**Instructions**: ", "**Customer**: ", "**Agent**: ")]
#: One turn in so many has lost its marker.
LOST = 4


def raw_transcripts(parts: DataFrame) -> DataFrame:
    """(key, piece, text, state): transcripts as they are found in the wild, from ``pieces``: one marker style for each, a
    share of turns unmarked (by a hash), and the true state of each line. Unknown roles are written as users."""
    style = F.pmod(F.xxhash64("key", "piece"), F.lit(len(STYLES)))
    marks = F.get(F.array(*[F.array(*map(F.lit, s)) for s in STYLES]), style)
    role = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), t["role"]), F.lit(0)), F.lit(2)).cast("int") - 1
    kept = lambda t: F.pmod(F.xxhash64("key", t["turn"]), F.lit(LOST)) != 0
    rows = parts.select("key", "piece", "turns", marks.alias("marks"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.when(kept(t), F.get("marks", role(t))).otherwise(""), t["text"])), "\n")
    state = F.flatten(
        F.transform("turns", lambda t: F.transform(F.split(t["text"], "\n"), lambda _, i: 2 * role(t) + F.when(i == 0, 0).otherwise(1)))
    )
    return rows.select("key", "piece", text.alias("text"), state.alias("state"))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0
