"""Fill-in-the-middle rearrangement with SWAR marks over UTF-8.

A unit is a run of the letters A-Z and a-z, or any other single character.  The bytes of a whole batch of
texts are read as 64-bit words; arithmetic on whole words marks the last byte of every unit, a population
count per word and its running total find the word that holds the k-th mark, and the mark is then picked
inside that word.  No text is cut into a list of units.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import pack, unpack

# The three sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
REARRANGED, SUFFIX_FIRST = 90, 20  # per cent of texts, and of these with the suffix first

_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE = np.uint64(0x2020202020202020)
_FROM_A = np.uint64(0x1F1F1F1F1F1F1F1F)  # brings 0x61 to 0x80
_PAST_Z = np.uint64(0x0505050505050505)  # brings 0x7B to 0x80
_ONE, _SEVEN, _EIGHT, _TOP = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


class Marks:
    """Rank and select over one mark bit a byte (its highest), eight bytes to a word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.totals = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def before(self, place: np.ndarray) -> np.ndarray:
        """Marks in front of the byte ``place``."""
        word = place >> 3
        below = (_ONE << ((place & 7).astype(np.uint64) * _EIGHT)) - _ONE
        return self.totals[word] + np.bitwise_count(self.words[word] & below)

    def nth(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark, from 1."""
        word = np.searchsorted(self.totals, k, side="left") - 1
        left, rest = self.words[word], k - self.totals[word] - 1
        for step in range(7):
            left = np.where(rest > step, left & (left - _ONE), left)
        lowest = left & (~left + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the bytes that end a unit, and of those that begin a character, in texts laid end to end."""
    size = len(data)
    padded = np.zeros((size // 8 + 1) * 8, np.uint8)
    padded[:size] = data
    x = padded.view("<u8")
    seven = (x | _CASE) & _LOW7
    letter = (seven + _FROM_A) & ~(seven + _PAST_Z) & ~x & _HIGH
    inside = x & ~(x << _ONE) & _HIGH  # 10xxxxxx: not the first byte of a character

    def ahead(mark: np.ndarray) -> np.ndarray:
        moved = mark >> _EIGHT
        moved[:-1] |= mark[1:] << _TOP
        return moved

    ends, begins = _HIGH & ~ahead(inside) & ~(letter & ahead(letter)), _HIGH & ~inside
    bits = ends.view(np.uint8)
    bits[offsets[1:][np.diff(offsets) > 0] - 1] = 0x80  # a text's last byte ends its last unit
    bits[size:] = 0
    begins.view(np.uint8)[size:] = 0
    return Marks(ends), Marks(begins)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, and where each begins; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers per id: the first groups of the SHA-256 of ``seed:id`` (null: nothing after the colon)."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def rearrange(texts: pa.Array, ids: list, seed: int, rearranged: int, suffix_first: int) -> pa.StructArray:
    """n, form, prefix_chars, middle_chars and output of every text of a batch."""
    body, offsets = _bytes(texts)
    ends, begins = marks(body, offsets)
    h = draws(ids, seed)
    start, stop = offsets[:-1], offsets[1:]
    base = ends.before(start)
    n = ends.before(stop) - base
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)

    def place(units: np.ndarray) -> np.ndarray:
        return np.where(units > 0, ends.nth(np.maximum(base + units, 1)) + 1, start) if len(body) else start

    first, second = place(cuts[:, 0]), place(cuts[:, 1])
    characters = [begins.before(p) for p in (start, first, second)]
    raw, outputs, forms = body.tobytes(), [], []
    for a, b, c, d, share, kind in zip(*(x.tolist() for x in (start, first, second, stop, h[:, 2] % 100, h[:, 3] % 100))):
        text = raw[a:d]
        if a == d or share >= rearranged or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            forms.append("plain")
            outputs.append(text)
        elif kind < suffix_first:
            forms.append("spm")
            outputs.append(b"".join((SUFFIX, raw[c:d], PREFIX, raw[a:b], MIDDLE, raw[b:c])))
        else:
            forms.append("psm")
            outputs.append(b"".join((PREFIX, raw[a:b], SUFFIX, raw[c:d], MIDDLE, raw[b:c])))
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(forms, pa.string()),
         pa.array(characters[1] - characters[0], pa.int64(), mask=plain),
         pa.array(characters[2] - characters[1], pa.int64(), mask=plain),
         pa.array(outputs, pa.binary()).cast(pa.string())],
        ["n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
              rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``n`` (units, long), ``form``, ``prefix_chars``, ``middle_chars`` (long) and ``output``.

    ``form`` is psm or spm (which part stands first), or plain: a text that is empty, holds a sentinel, or
    is not among the ``rearranged`` per cent stays as it is, with null lengths.  A null text counts as empty.
    Each row decides by its id alone, so repeated rows stay alike; nothing is shuffled.
    """
    kind = "n long, form string, prefix_chars long, middle_chars long, output string"

    @F.arrow_udf(kind)
    def apply(texts: pa.Array, ids: pa.Array) -> pa.Array:
        return rearrange(texts, ids.to_pylist(), seed, rearranged, suffix_first)

    row = F.col("row")
    made = pack(docs).withColumn("made", apply.asNondeterministic()(row[text_column], row[id_column].cast("string")))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    return unpack(made, docs.columns, **{c: F.col("made")[c] for c in names})


def restore(rows: DataFrame, output_column: str = "output", form_column: str = "form") -> DataFrame:
    """``rows`` with ``restored``: the text, from its output and form alone.  Null output gives null."""
    parts = F.split(F.col("row")[output_column], "<[PSM]>", -1)
    form = F.col("row")[form_column]
    text = (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col("row")[output_column]))
    return unpack(pack(rows), rows.columns, restored=text)
