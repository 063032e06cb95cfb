"""SentencePiece encoding and decoding by Viterbi over words that share prefixes.

A text becomes marked words: blanks turn into the mark, one mark goes in front, and a word is a run of marks
with the characters after it (no piece of a model reaches over the end of a word). The distinct words of a
batch are sorted, which lines up a trie depth-first: each word keeps the forward states of the prefix it
shares with the word before and extends only the rest.

Forward states by kind of model:

* unigram: best sum of piece scores up to a position, with the last piece of the best path;
* BPE: a path is allowed only where every two neighbouring pieces are what merging gives for their joint text.
  Exactly one allowed path leads to each position, so the state is its last piece. The path over a whole word is
  the one that merging gives.

Characters without a piece become byte pieces. A mark that stands in the text itself becomes byte pieces
too, so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesift.llm.text import parts

MARK = "▁"
#: Stands for a mark of the text while words are cut; it can't be a character of a text.
_OWN = "\udc81"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker remembers, twice: beyond it the older half is forgotten, but for what was met again since. Also
#: the bound on remembered neighbour tests.
REMEMBERED = 250_000


@dataclass
class Vocabulary:
    """Pieces with ids and scores, byte pieces, and whether they are merged (BPE) or chosen by score (unigram)."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    merges: bool = True
    #: The pieces by their characters from the last to the first: by character the table of the next ones, and of the
    #: piece that ends there, if one does, its text and a table of the pieces in front of it that were tested already:
    #: whether merging leaves the two apart.
    endings: dict = field(init=False)
    #: The ids of pieces as bytes; characters without a piece are added when met.
    packed: dict[str, bytes] = field(init=False)
    #: Score of a character without a piece: below every piece.
    unknown: float = field(init=False)
    right_edge: dict[str, list] = field(init=False)
    left_edge: dict[str, list] = field(init=False)

    def __post_init__(self) -> None:
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self.right_edge, self.left_edge, made = _edges(self.scores) if self.merges else ({}, {}, self.scores)
        self.endings = {}
        for piece in made:
            node = self.endings
            for c in reversed(piece):
                hit = node.setdefault(c, [{}, None])
                node = hit[0]
            hit[1] = (piece, {})
        self.packed = {piece: array("i", [number]).tobytes() for piece, number in self.ids.items()}


def load(path: str = MODEL, merges: bool = True) -> Vocabulary:
    """The vocabulary of a SentencePiece model file. ``merges``: the model's kind, BPE or unigram."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = {model.id_to_piece(i): i for i in plain}
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary(ids, scores, byte_ids, merges)


def merged(text: str, scores: dict[str, float], steps: list[tuple[int, str]] | None = None) -> list[str]:
    """Pieces of ``text`` by merging: always the neighbours whose joint piece scores best, leftmost first.
    ``steps`` gets the merges in their order, each with its place."""
    parts: list[str | None] = list(text)
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    queue: list[tuple[float, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (s := scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (-s, i, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while queue:
        _, i, joint = heapq.heappop(queue)
        j = after[i]
        if parts[i] is None or j < 0 or parts[i] + parts[j] != joint:
            continue
        if steps is not None:
            steps.append((i, joint))
        parts[i], parts[j] = joint, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None]


def _edges(scores: dict[str, float]) -> tuple[dict[str, list], dict[str, list], list[str]]:
    """By piece, the parts that stand at its right (at its left) end while it is merged, smallest first, each
    with the score of the merge that takes it in; the piece itself stays, so its score is minus infinity.

    Pieces that merging doesn't make, or whose merges don't come in falling order of score, are left out. Third, the
    pieces that merging makes.
    """
    right: dict[str, list] = {}
    left: dict[str, list] = {}
    made: list[str] = []
    for piece, score in sorted(scores.items(), key=lambda x: len(x[0])):
        if len(piece) == 1:
            right[piece] = left[piece] = [(piece, -np.inf)]
            made.append(piece)
            continue
        steps: list[tuple[int, str]] = []
        if merged(piece, scores, steps) != [piece]:
            continue
        made.append(piece)
        marks = [scores[x] for _, x in steps]
        if any(later >= earlier for earlier, later in zip(marks, marks[1:])):
            continue
        ends = [x for i, x in steps if i + len(x) == len(piece)]
        starts = [x for i, x in steps if i == 0]
        right[piece] = _lives([piece[-1], *ends], scores)
        left[piece] = _lives([piece[0], *starts], scores)
    return right, left, made


def _lives(parts: list[str], scores: dict[str, float]) -> list[tuple[str, float]]:
    return [(x, scores[y]) for x, y in zip(parts, parts[1:])] + [(parts[-1], -np.inf)]


def _apart(ends: list, starts: list, scores: dict[str, float]) -> bool:
    """Whether no merge ever joins the two parts that face each other. Their joint piece would be made if it scores
    better than the merge that takes the left part in, and no worse than that of the right one (leftmost first)."""
    i = j = 0
    while True:
        (a, a_until), (b, b_until) = ends[i], starts[j]
        joint = scores.get(a + b)
        if joint is not None and joint > a_until and joint >= b_until:
            return False
        if a_until == b_until == -np.inf:
            return True
        if a_until >= b_until:
            i += 1
        else:
            j += 1


class Encoder:
    """Encodes words and remembers them and the neighbour tests. Kept in a broadcast value, it stays with a worker over tasks."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tested: list[dict[str, bool]] = []
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _neighbours(self, left: str, right: str, fits: dict[str, bool]) -> bool:
        """Whether merging the joint text of two pieces gives these two; ``fits`` remembers it for ``right``."""
        if len(self.tested) >= REMEMBERED:
            for table in self.tested:
                table.clear()
            self.tested.clear()
        ends, starts = self.v.right_edge.get(left), self.v.left_edge.get(right)
        if ends is None or starts is None:
            got = merged(left + right, self.v.scores) == [left, right]
        else:
            got = _apart(ends, starts, self.v.scores)
        fits[left] = got
        self.tested.append(fits)
        return got

    def _extend_merged(self, word: str, last: list[str]) -> None:
        """Append to ``last`` the last piece of the one allowed path to each further position of ``word``."""
        endings, neighbours = self.v.endings, self._neighbours
        for end in range(len(last), len(word) + 1):
            node, at, chosen = endings, end, word[end - 1]
            while at:
                at -= 1
                hit = node.get(word[at])
                if hit is None:
                    break
                node, found = hit
                if found is not None:
                    if not at:
                        chosen = found[0]
                        break
                    before = last[at]
                    fit = found[1].get(before)
                    if fit or (fit is None and neighbours(before, *found)):
                        chosen = found[0]
                        break
            last.append(chosen)

    def _extend_scored(self, word: str, last: list[str], best: list[float]) -> None:
        """Append the best score of each further position of ``word`` and the last piece that reaches it."""
        scores = self.v.scores
        for end in range(len(last), len(word) + 1):
            node, at = self.v.endings, end
            top, chosen = best[end - 1] + self.v.unknown, word[end - 1]
            while at:
                at -= 1
                hit = node.get(word[at])
                if hit is None:
                    break
                node, found = hit
                if found is not None and best[at] + scores[found[0]] > top:
                    top, chosen = best[at] + scores[found[0]], found[0]
            last.append(chosen)
            best.append(top)

    def _ids(self, last: list[str]) -> bytes:
        out: list[bytes] = []
        at, packed = len(last) - 1, self.v.packed
        while at > 0:
            piece = last[at]
            known = packed.get(piece)
            if known is None:
                raw = MARK if piece == _OWN else piece
                known = packed[piece] = array("i", [self.v.byte_ids[b] for b in raw.encode()]).tobytes()
            out.append(known)
            at -= len(piece)
        out.reverse()
        return b"".join(out)

    def learn(self, words: Collection[str]) -> None:
        """Encode the words that are new: in sorted order, forward states of shared prefixes are kept. A word without a
        mark stands for the same word with one."""
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                known = self.older.get(w)
                if known is None:
                    new.append(w)
                else:
                    self.words[w] = known
        marked = sorted((w if w.startswith(MARK) else MARK + w, w) for w in new)
        last, best, before = [""], [0.0], ""
        for word, name in marked:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            if self.v.merges:
                self._extend_merged(word, last)
            else:
                self._extend_scored(word, last, best)
            self.words[name] = self._ids(last)
            before = word


def marked_words(text: str) -> list[str]:
    """The marked words of a text, in order; none for an empty text."""
    if not text:
        return []
    pieces = (MARK + text.replace(MARK, _OWN).replace(" ", MARK)).split(MARK)
    if "" not in pieces[1:]:
        return [MARK + p for p in pieces[1:]]
    out, run = [], ""
    for p in pieces[1:]:
        run += MARK
        if p:
            out.append(run + p)
            run = ""
    if run:
        out.append(run)
    return out


def _words(text: str | None) -> list[str]:
    """The words of a text; where all its blanks are single, without their marks."""
    if not text:
        return []
    words = text.split(" ")
    return marked_words(text) if "" in words or MARK in text else words


def encode_batch(texts: list[str | None], encoder: Encoder) -> list[np.ndarray]:
    """Piece ids of each text; none for null."""
    cut = [_words(t) for t in texts]
    encoder.learn(set(chain.from_iterable(cut)))
    known = encoder.words
    return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, merges: bool = True) -> DataFrame:
    """(key, ids): piece ids of every text; null for a null text, empty for an empty one. Repeated rows repeat.

    Works row by row in batches of bounded bytes, without a shuffle. The vocabulary is read by the driver and
    is broadcast as plain tables: it has the size of the model file. A worker puts its encoder beside them and keeps it.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": vars(load(model, merges))})
    shape = docs.select(F.col(key).alias("key")).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "encoder" not in held:
            vocabulary = object.__new__(Vocabulary)
            vars(vocabulary).update(held["vocabulary"])
            held["encoder"] = Encoder(vocabulary)
        encoder = held["encoder"]
        for part in parts(batches, 1):
            texts = part.column(1).to_pylist()
            ids = encode_batch(texts, encoder)
            arrays = pa.array([None if t is None else i for t, i in zip(texts, ids, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), arrays], ["key", "ids"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, shape).withColumnRenamed("key", key)


def decoder(v: Vocabulary) -> dict[int, bytes]:
    """The bytes that each piece id stands for; marks are blanks."""
    return {i: p.replace(MARK, " ").encode() for p, i in v.ids.items()} | {i: bytes([b]) for b, i in enumerate(v.byte_ids)}


def decode(ids: Iterable[int], raw: dict[int, bytes]) -> str:
    """The text of piece ids; the blank of the mark in front goes."""
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text): the text of every row's piece ids; null for null."""
    shared = rows.sparkSession.sparkContext.broadcast(decoder(load(model, merges=False)))
    shape = rows.select(F.col(key).alias("key")).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [decode(x.values.to_pylist(), raw) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["key", "text"])

    plain = rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return plain.mapInArrow(run, shape).withColumnRenamed("key", key)
