"""Language identification by cross-parsing.

A suffix automaton per language, built from a bounded sample of labelled text, gives the longest match
from any place.  A text is cut greedily into longest matches; phrases times the bits that point into a
language's sample, per character, estimate the cross entropy, and the smallest estimate wins.

Every letter of any sample is a symbol of its own.  Each language numbers the letters of its sample; what it
lacks ends a phrase there, whichever letter it is.  Scripts of many letters have their transitions as sorted
edges instead of a full table.

Texts are parsed in numpy, many pieces side by side: every text is cut into pieces of ``PIECE`` symbols
(the last one padded), which costs at most one phrase more per piece in every language alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import labelled_sample, pack, unpack

UNDETERMINED = "und"
# The documented bounds of the sample: rows of a language, characters of a row, symbols of all languages.
SAMPLE_ROWS = 64
SAMPLE_CHARS = 1_500
SAMPLE_SYMBOLS = 60_000
TOTAL_SYMBOLS = 1_000_000
MAX_LANGUAGES = 500
PIECE = 192
# Entries of a full transition table; larger ones are kept as edges.
_DENSE = 1 << 24
_GAP, _OTHER, _PAD = 0, 1, 2
_ROOT, _SINK = 0, 1


@dataclass
class Parser:
    """Languages, symbol of every code point, each language's number of every symbol, transitions, bits per phrase."""
    languages: list[str]
    symbols: np.ndarray
    numbers: list[np.ndarray]
    steps: list[Table | Edges]
    bits: np.ndarray


@dataclass
class Table:
    """All transitions in one flat array."""
    flat: np.ndarray
    width: int

    def reach(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.flat[state * np.int32(self.width) + column]


@dataclass
class Edges:
    """Sorted keys (state * width + symbol) with their targets, and the root's transitions; answers as ``Table`` does."""
    keys: np.ndarray
    targets: np.ndarray
    root: np.ndarray
    width: int

    def reach(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        wanted = state.astype(np.int64) * self.width + column
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        # The root and the sink differ in what they do without an edge: the root does not end a phrase.
        other = np.where(state == _ROOT, self.root[column], ~self.root[column])
        found = np.where(self.keys[at] == wanted, self.targets[at], other)
        return np.where(column == _PAD, state, found).astype(np.int32)


def _states(sequence: list[int]) -> list[dict[int, int]]:
    """Edges of every state of the suffix automaton; the first is the root."""
    nexts: list[dict[int, int]] = [{}]
    suffix, length = [-1], [0]
    last = 0
    for symbol in sequence:
        here = len(nexts)
        nexts.append({})
        suffix.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in nexts[at]:
            nexts[at][symbol] = here
            at = suffix[at]
        if at >= 0:
            target = nexts[at][symbol]
            if length[target] == length[at] + 1:
                suffix[here] = target
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[target]))
                suffix.append(suffix[target])
                length.append(length[at] + 1)
                while at >= 0 and nexts[at].get(symbol) == target:
                    nexts[at][symbol] = copy
                    at = suffix[at]
                suffix[target] = suffix[here] = copy
        last = here
    return nexts


def _moved(state: int) -> int:
    """State 0 stays the root; state 1 is a sink for symbols the sample lacks; the others move up by one."""
    return state + 1 if state else 0


def _root(nexts: list[dict[int, int]], width: int) -> np.ndarray:
    root = np.full(width, _SINK, np.int32)
    for symbol, state in nexts[0].items():
        root[symbol] = _moved(state)
    return root


def _edges(sequence: list[int], width: int) -> Edges:
    nexts = _states(sequence)
    made = sorted((_moved(n) * width + symbol, _moved(state)) for n, edges in enumerate(nexts) for symbol, state in edges.items())
    keys, targets = np.array(made or [(-1, 0)], np.int64).T
    return Edges(np.ascontiguousarray(keys), targets.astype(np.int32), _root(nexts, width), width)


def _automaton(sequence: list[int], width: int) -> np.ndarray:
    """Flat transitions of the suffix automaton; a negative entry ends the phrase and holds ~(next state)."""
    nexts = _states(sequence)
    root = _root(nexts, width)
    steps = np.tile(~root, (len(nexts) + 1, 1))
    steps[_ROOT] = root
    for number, edges in enumerate(nexts):
        for symbol, state in edges.items():
            steps[_moved(number), symbol] = _moved(state)
    steps[:, _PAD] = np.arange(len(steps))
    return steps.reshape(-1)


def build_parser(samples: dict[str, list[str]], symbols: int = SAMPLE_SYMBOLS) -> Parser:
    """A parser from sample texts per language."""
    folded = {name: ["".join(c.lower()[0] for c in t) for t in texts] for name, texts in samples.items()}
    letters = sorted({c for texts in folded.values() for t in texts for c in t if c.isalpha()})
    known = {c: i + _PAD + 1 for i, c in enumerate(letters)}
    every = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            every[code] = known.get(c.lower()[0], _OTHER)
    numbers, steps, bits, languages = [], [], [], sorted(samples)
    share = max(1, min(symbols, TOTAL_SYMBOLS // max(1, len(languages))))
    for name in languages:
        codes = np.array([every[ord(c)] for t in folded[name] for c in " " + t], np.int32)
        keep = (codes != _GAP) | np.r_[False, codes[:-1] != _GAP]
        sequence = codes[keep][:share]
        held = np.unique(sequence[sequence > _PAD])
        own = np.full(len(letters) + _PAD + 1, _OTHER, np.int32)
        own[[_GAP, _PAD]], own[held] = (_GAP, _PAD), np.arange(len(held)) + _PAD + 1
        width, coded = len(held) + _PAD + 1, own[sequence].tolist()
        # An automaton has at most twice as many states as symbols.
        dense = (2 * len(coded) + 2) * width <= _DENSE
        numbers.append(own)
        steps.append(Table(_automaton(coded, width), width) if dense else _edges(coded, width))
        bits.append(math.log2(len(coded) + 2))
    return Parser(languages, every, numbers, steps, np.array(bits))


def parse(parser: Parser, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    texts = [t or "" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = parser.symbols[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = codes != _GAP
    # A run of other characters is one gap; a text starts with a letter.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    codes, owner = codes[keep], owner[keep]
    lengths = np.bincount(owner, minlength=len(texts))
    pieces = -(-lengths // PIECE)
    first, start = np.cumsum(pieces) - pieces, np.cumsum(lengths) - lengths
    total = int(pieces.sum())
    grid = np.full(total * PIECE, _PAD, np.int32)
    grid[np.arange(len(codes)) + np.repeat(first * PIECE - start, lengths)] = codes
    grid = np.ascontiguousarray(grid.reshape(total, PIECE).T)
    phrases = np.empty((len(parser.languages), len(texts)))
    of = np.repeat(np.arange(len(texts)), pieces)
    for k, (own, steps) in enumerate(zip(parser.numbers, parser.steps)):
        state, count = np.zeros(total, np.int32), np.ones(total, np.int32)
        for column in grid:
            reached = steps.reach(state, own[column])
            ended = reached >> 31
            state = reached ^ ended
            count -= ended
        phrases[k] = np.bincount(of, weights=count, minlength=len(texts))
    cost = phrases * parser.bits[:, None] / np.maximum(lengths, 1)
    order = np.argsort(cost, axis=0, kind="stable")
    out = []
    for i, length in enumerate(lengths):
        if not length:
            out.append((UNDETERMINED, 0.0))
            continue
        best = order[0, i]
        rival = cost[order[1, i], i] if len(parser.languages) > 1 else cost[best, i] * 2
        out.append((parser.languages[best], float(rival / (rival + cost[best, i]))))
    return out


def sample(docs: DataFrame, id_column: str, text_column: str, label: str) -> dict[str, list[str]]:
    """Slices of at most SAMPLE_CHARS characters from about SAMPLE_ROWS rows of each label, chosen by hash."""
    text = F.col("row")[text_column]
    name = F.col("row")[id_column].cast("string")
    place = F.pmod(F.xxhash64(F.lit(3), name), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1)))
    rows = pack(docs).filter(F.col("row")[label].isNotNull() & text.rlike("\\p{L}")).select(
        F.col("row")[label].cast("string").alias("label"), name.alias("name"),
        text.substr((place + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("slice"))
    chosen = labelled_sample(rows, "label", F.col("name"), SAMPLE_ROWS, MAX_LANGUAGES).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(chosen, key=lambda r: (r["label"], r["name"] or "", r["slice"])):
        found.setdefault(row["label"], []).append(row["slice"])
    return found


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "lang") -> Parser:
    return build_parser(sample(docs, id_column, text_column, label))


def identify(docs: DataFrame, parser: Parser, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, above one half unless two languages tie).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was
    learned.  Ties go to the language first in the alphabet.
    """
    if not parser.languages:
        return unpack(pack(docs), docs.columns, lang_pred=F.lit(UNDETERMINED), score=F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def apply(texts: pa.Array) -> pa.Array:
        made = parse(shared.value, texts.to_pylist())
        return pa.array([{"lang": a, "score": b} for a, b in made], kind)

    found: Column = apply.asNondeterministic()(F.col("row")[text_column])
    return unpack(pack(docs).withColumn("found", found), docs.columns,
                  lang_pred=F.col("found.lang"), score=F.col("found.score"))
