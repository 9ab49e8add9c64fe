"""Encoding and decoding with a SentencePiece vocabulary, with exact N-best segmentations.

A text is a lattice: pieces of the vocabulary are arcs, bytes are arcs for characters without a piece.
Forward Viterbi scores are the exact best completion of any suffix, so a backward A* search over them
yields segmentations best first.  No piece runs across the start of a word or a line end, so the lattice
falls into chunks there: chunks are solved apart, and the N best of a text change at most the N - 1
chunks whose second choice costs least.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import pack, unpack

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
_SPACE = "▁"
# Chunks one worker remembers, and their characters: some 80 MB.
_CACHED = 400_000
_CACHED_CHARS = 8_000_000
# Characters of the texts that are worked on at once; an Arrow batch is done in such runs, as its chunks take many times its bytes.
_RUN_CHARS = 1 << 19
_NONE = -math.inf


class Solved:
    """Chunks that were solved: a place each, and ids, scores and what the second best costs by place in flat arrays."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.chars = 0
        self.ids, self.ends = array("i"), array("q", [0])
        self.score, self.cost = array("d"), array("d")

    def add(self, chunk: str, ids: tuple[int, ...], score: float, cost: float) -> None:
        self.place[chunk] = len(self.score)
        self.chars += len(chunk)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.score.append(score)
        self.cost.append(cost)

    def __getitem__(self, chunk: str) -> tuple[tuple[int, ...], float, float]:
        at = self.place[chunk]
        return tuple(self.ids[self.ends[at]:self.ends[at + 1]]), self.score[at], self.cost[at]


@dataclass
class Vocabulary:
    """Surface text of pieces with (id, score), the same as a tree read backwards, byte ids and the score of a byte.

    A node of the tree is (characters before, id or -1, score).
    """
    pieces: dict[str, tuple[int, float]]
    tree: dict
    bytes_: list[int]
    byte_score: float
    surface: dict[int, bytes]
    chunks: re.Pattern[str]
    solved: Solved = field(default_factory=Solved)
    options: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = field(default_factory=dict)
    flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {**self.__dict__, "solved": Solved(), "options": {}, "flat": None}

    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, the length of each and where it begins; a last place stands for unknown ids."""
        if self.flat is None:
            parts = [self.surface.get(i, b"") for i in range(max(self.surface, default=-1) + 2)]
            length = np.array([*map(len, parts)], np.int64)
            self.flat = (np.frombuffer(b"".join(parts), np.uint8), length, np.cumsum(length) - length)
        return self.flat


def vocabulary(pieces: list[tuple[str, int, float]], byte_ids: list[int], byte_score: float) -> Vocabulary:
    """From (surface, id, score) with spaces written as spaces, and the ids of the 256 bytes."""
    table = {text: (number, score) for text, number, score in pieces if text}
    surface = {number: text.encode() for text, number, _ in pieces}
    surface |= {number: bytes([value]) for value, number in enumerate(byte_ids)}
    tree: dict = {}
    for text in sorted(table, key=lambda t: t[::-1]):
        # Endings sort first, so a piece's node is made before any that needs it as a parent.
        below = tree
        for c in text[:0:-1]:
            below = below.setdefault(c, ({}, -1, 0.0))[0]
        below[text[0]] = ({}, *table[text])
    across = any("\n" in text or re.search("[^ ] ", text) for text in table)
    return Vocabulary(table, tree, byte_ids, byte_score, surface,
                      re.compile(r"[\s\S]+" if across else "\n| *[^ \n]+| +"))


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Pieces of a model file.  Merge ranks (a BPE model) become log frequencies by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [model.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
    if any(not model.is_byte(number) for number in byte_ids):
        raise ValueError("the vocabulary has no byte pieces")
    normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    raw = {i: model.get_score(i) for i in normal}
    ranked = all(score <= 0 and score == int(score) for score in raw.values())
    scores = {i: -math.log(2.0 - s) for i, s in raw.items()} if ranked else raw
    return vocabulary([(model.id_to_piece(i).replace(_SPACE, " "), i, scores[i]) for i in normal],
                      byte_ids, min(scores.values()) - 2.0)


def _arcs(v: Vocabulary, text: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
    """Arcs by end: (start, ids, score); a character's bytes are one arc, there only without a piece."""
    into: list[list[tuple[int, tuple[int, ...], float]]] = [[]]
    for end in range(1, len(text) + 1):
        arcs, below = [], v.tree
        for start in range(end - 1, -1, -1):
            if (node := below.get(text[start])) is None:
                break
            below, number, score = node
            if number >= 0:
                arcs.append((start, (number,), score))
        if text[end - 1] not in v.pieces:
            arcs.append((end - 1, *_as_bytes(v, text[end - 1])))
        into.append(arcs)
    return into


def _as_bytes(v: Vocabulary, character: str) -> tuple[tuple[int, ...], float]:
    raw = character.encode("utf-8", "surrogatepass")
    return tuple(v.bytes_[b] for b in raw), v.byte_score * len(raw)


def _forward(into) -> list[float]:
    """Best score of a segmentation of every prefix."""
    best = [0.0]
    for arcs in into[1:]:
        best.append(max(best[start] + score for start, _, score in arcs))
    return best


def solve(v: Vocabulary, chunks: list[str]) -> Iterator[tuple[tuple[int, ...], float, float]]:
    """Per chunk: best ids, their score, and what the second best costs (infinite if there is none).

    A forward Viterbi pass that keeps the two best scores of every prefix.  What a chunk shares with the
    beginning of the one before it is not worked out again, so sorted chunks cost little.
    """
    tree, pieces = v.tree, v.pieces
    best, second, origin, piece = [0.0], [_NONE], [0], [-1]
    before = ""
    for text in chunks:
        same = 0
        for a, b in zip(before, text):
            if a != b:
                break
            same += 1
        del best[same + 1:], second[same + 1:], origin[same + 1:], piece[same + 1:]
        before = text
        for last in range(same, len(text)):
            character = text[last]
            if character in pieces:
                top = rival = _NONE
                chosen, at = -1, 0
            else:
                spelt = _as_bytes(v, character)[1]
                top, rival, chosen, at = best[last] + spelt, second[last] + spelt, -1, last
            below = tree
            for start in range(last, -1, -1):
                if (node := below.get(text[start])) is None:
                    break
                below, number, score = node
                if number >= 0:
                    through = best[start] + score
                    if through > top:
                        other = second[start] + score
                        rival = other if other > top else top
                        top, chosen, at = through, number, start
                    elif through > rival:
                        rival = through
            best.append(top)
            second.append(rival)
            origin.append(at)
            piece.append(chosen)
        ids: list[int] = []
        end = len(text)
        while end:
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(reversed(_as_bytes(v, text[end - 1])[0]))
            end = origin[end]
        ids.reverse()
        yield tuple(ids), best[-1], best[-1] - second[-1]


def a_star(v: Vocabulary, text: str) -> Iterator[tuple[float, tuple[int, ...]]]:
    """Segmentations of a chunk, best first: backward search, forward Viterbi scores as heuristic."""
    into = _arcs(v, text)
    best = _forward(into)
    count = 0
    heap = [(-best[-1], 0, len(text), 0.0, None)]
    while heap:
        _, _, at, done, tail = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while tail:
                ids.extend(tail[0])
                tail = tail[1]
            yield done, tuple(ids)
            continue
        for start, ids, score in into[at]:
            count += 1
            heapq.heappush(heap, (-(best[start] + score + done), count, start, score + done, (ids, tail)))


def split(v: Vocabulary, texts: list[str]) -> list[list[str]]:
    """Chunks of each text; all chunks are solved afterwards."""
    found = [v.chunks.findall(" " + text) if text else [] for text in texts]
    every = set().union(*found)
    new = every.difference(v.solved.place)
    if len(v.solved.place) + len(new) > _CACHED or v.solved.chars + sum(map(len, new)) > _CACHED_CHARS:
        v.solved, new = Solved(), every
    new = sorted(new)
    for chunk, best in zip(new, solve(v, new)):
        v.solved.add(chunk, *best)
    return found


def _options(v: Vocabulary, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """What each of the n best segmentations of a chunk costs over the best, and its ids."""
    if (found := v.options.get((chunk, n))) is None:
        ways = list(itertools.islice(a_star(v, chunk), n))
        found = [(ways[0][0] - score, ids) for score, ids in ways]
        if len(v.options) >= _CACHED // 20:
            v.options.clear()
        v.options[chunk, n] = found
    return found


def _choices(v: Vocabulary, chunk_at, costs: np.ndarray, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
    """The n cheapest sets of changes to the best path, as (cost, other ids by place); ``chunk_at`` gives the chunk at a place."""
    # Where the n - 1 cheapest changes are.
    cheap = np.argsort(costs, kind="stable")[:n - 1] if len(costs) < 64 else np.sort(np.argpartition(costs, n - 1)[:n - 1])
    choices: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
    for place in cheap.tolist() if n > 1 else []:
        if costs[place] == math.inf:
            continue
        options = _options(v, chunk_at(place), n)
        # The first option is the best path itself, up to ties; it stands for "no change".
        step = [(cost + extra, {**picks, place: ids} if k else picks)
                for cost, picks in choices for k, (extra, ids) in enumerate(options)]
        choices = heapq.nsmallest(n, step, key=lambda c: c[0])
    return choices


def encode(v: Vocabulary, chunks: list[str], n: int = N_BEST) -> tuple[list[tuple[int, ...]], float, list[tuple[float, dict[int, tuple[int, ...]]]]]:
    """From solved chunks: best ids of each, their score, and the N best as (score, chunks with other ids)."""
    parts = [v.solved[c] for c in chunks]
    total = math.fsum([p[1] for p in parts])
    choices = _choices(v, chunks.__getitem__, np.array([p[2] for p in parts]), n)
    return [p[0] for p in parts], total, [(total - cost, picks) for cost, picks in choices]


@dataclass
class Encoded:
    """A batch of texts: ids end to end, where each text begins, and scores and digests of the N best of each."""
    ids: np.ndarray
    starts: np.ndarray
    scores: list[list[float]]
    digests: list[list[str]]


def encode_batch(v: Vocabulary, texts: list[str], n: int = N_BEST) -> Encoded:
    """As ``encode`` on every text, gathered in numpy from the flat arrays of solved chunks."""
    found = split(v, texts)
    # The arrays can't grow while these views are there.
    own, place = v.solved, v.solved.place
    score, cost, flat = np.frombuffer(own.score), np.frombuffer(own.cost), np.frombuffer(own.ids, np.int32)
    begin, length = np.frombuffer(own.ends, np.int64)[:-1], np.diff(np.frombuffer(own.ends, np.int64))
    out, sizes, scores, digests = [np.zeros(0, np.int32)], [0], [], []
    for chunks in found:
        at = np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))
        own_length = length[at]
        ends = np.cumsum(own_length)
        size = int(ends[-1]) if len(at) else 0
        ids = flat[np.repeat(begin[at] - (ends - own_length), own_length) + np.arange(size)]
        total = math.fsum(score[at].tolist())
        ways = _choices(v, chunks.__getitem__, cost[at], n)
        starts = np.concatenate([[0], ends])
        out.append(ids)
        sizes.append(size)
        scores.append([total - extra for extra, _ in ways])
        digests.append([_digest(ids, picks, starts) for _, picks in ways])
    return Encoded(np.concatenate(out), np.cumsum(sizes), scores, digests)


def runs(texts: list[str], chars: int = _RUN_CHARS) -> Iterator[list[str]]:
    """The texts in order, in runs that end once they have so many characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_checked(v: Vocabulary, texts: list[str], n: int = N_BEST) -> tuple[Encoded, list[bool]]:
    """``encode_batch`` run by run, and for each text whether its ids give it back."""
    out, sizes, scores, digests, same = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [], [], []
    for run in runs(texts):
        made = encode_batch(v, run, n)
        out.append(made.ids)
        sizes.append(np.diff(made.starts))
        scores += made.scores
        digests += made.digests
        same += [b == t.encode("utf-8", "surrogatepass") for t, b in zip(run, decode_batch(v, made.ids, made.starts))]
    return Encoded(np.concatenate(out), np.cumsum(np.concatenate(sizes)), scores, digests), same


def decode_batch(v: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """The bytes of each text from its ids; None where an id has no text."""
    data, length, begin = v.surfaces()
    known = np.where((ids < 0) | (ids >= len(length)), len(length) - 1, ids)
    own = length[known]
    ends = np.concatenate([[0], np.cumsum(own)])
    body = data[np.repeat(begin[known] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
    lost = np.concatenate([[0], np.cumsum(own == 0)])
    gone = lost[starts[1:]] > lost[starts[:-1]]
    at = ends[starts].tolist()
    # The first byte is the space that every text is given.
    return [None if bad else body[a + 1:b] for bad, a, b in zip(gone.tolist(), at, at[1:])]


def nbest(v: Vocabulary, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a text as (score, ids)."""
    parts, _, ways = encode(v, split(v, [text])[0], n)
    return [(score, [i for k, ids in enumerate(parts) for i in picks.get(k, ids)]) for score, picks in ways]


def decode(v: Vocabulary, ids) -> str:
    """The text of ids: exact for everything ``encode`` gives."""
    return b"".join(map(v.surface.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def segment(docs: DataFrame, text_column: str = "text", model: str = DEFAULT_MODEL, n: int = N_BEST) -> DataFrame:
    """``docs`` with ``ids`` (best segmentation), ``n_pieces``, ``nbest_scores``, ``nbest_digests`` and ``round_trip``.

    Digests are MD5 of each segmentation's ids as 32-bit integers, best first; texts with fewer
    segmentations have fewer.  ``round_trip`` says that decoding the ids gives the text.  A null text has
    null in all of them; an empty one has no ids and one segmentation.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    kind = "ids array<int>, n_pieces int, nbest_scores array<double>, nbest_digests array<string>, round_trip boolean"

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        v = shared.value
        rows = texts.to_pylist()
        made, same = encode_checked(v, [t or "" for t in rows], n)
        null = [t is None for t in rows]
        mask = pa.array(null, pa.bool_())
        ids = pa.ListArray.from_arrays(pa.array(made.starts, pa.int32()), pa.array(made.ids), mask=mask)
        sizes = pa.array(np.diff(made.starts).astype(np.int32), mask=np.array(null, bool))
        blank = lambda values: [None if gone else x for gone, x in zip(null, values)]
        return pa.StructArray.from_arrays(
            [ids, sizes, pa.array(blank(made.scores), pa.list_(pa.float64())), pa.array(blank(made.digests), pa.list_(pa.string())),
             pa.array(blank(same), pa.bool_())], ["ids", "n_pieces", "nbest_scores", "nbest_digests", "round_trip"])

    names = ["ids", "n_pieces", "nbest_scores", "nbest_digests", "round_trip"]
    made = pack(docs).withColumn("made", apply.asNondeterministic()(F.col("row")[text_column]))
    return unpack(made, docs.columns, **{c: F.col("made")[c] for c in names})


def unsegment(rows: DataFrame, ids_column: str = "ids", model: str = DEFAULT_MODEL, text_column: str = "text") -> DataFrame:
    """``rows`` with the text of their ids.  Null ids, and ids that the vocabulary lacks, give null; no ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf("string")
    def apply(ids: pa.Array) -> pa.Array:
        numbers = [None if row is None else row for row in ids.to_pylist()]
        starts = np.cumsum([0, *(0 if row is None else len(row) for row in numbers)])
        flat = np.array([-1 if i is None else i for row in numbers if row is not None for i in row], np.int64)
        back = decode_batch(shared.value, flat, starts)
        return pa.array([None if row is None or b is None else b.decode("utf-8", "replace") for row, b in zip(numbers, back)], pa.string())

    made = pack(rows).withColumn("made", apply(F.col("row")[ids_column]))
    return unpack(made, rows.columns, **{text_column: F.col("made")})


def _digest(own: np.ndarray, picks: dict[int, tuple[int, ...]], starts: np.ndarray) -> str:
    """MD5 of the ids with some chunks replaced."""
    digest, at = hashlib.md5(), 0
    for place in sorted(picks):
        digest.update(own[at:starts[place]].tobytes())
        digest.update(np.array(picks[place], np.int32).tobytes())
        at = int(starts[place + 1])
    digest.update(own[at:].tobytes())
    return digest.hexdigest()
