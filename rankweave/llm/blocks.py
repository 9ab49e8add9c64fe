"""Texts as numbers into block dictionaries.

A task cuts its texts into tokens and numbers them within blocks of bounded size: each block keeps its
distinct tokens once, and per text one array of places in that dictionary.  What is then shuffled by token
grows with the distinct tokens of a block, so a token that fills a third of all text is one entry a block.
Blocks are written once, in files bucketed by block: later steps join on the block without moving texts
again, and a task that is run anew reads the same blocks.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import zstandard

_pack = zstandard.ZstdCompressor(level=1).compress
_open = zstandard.ZstdDecompressor().decompress


def squeeze(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Non-negative numbers that fit ``kind``, their bytes in planes, compressed."""
    planes = np.ascontiguousarray(numbers, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return _pack(planes.tobytes())


def stretch(raw: bytes, kind: str = "<u4") -> np.ndarray:
    flat = np.frombuffer(_open(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_strings(parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return _pack(len(parts).to_bytes(4, "little") + lengths.tobytes() + b"".join(parts))


def stretch_strings(raw: bytes) -> list[bytes]:
    data = _open(raw)
    size = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * size + np.cumsum(np.frombuffer(data, "<u4", size, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in itertools.pairwise([4 + 4 * size, *ends])]


class Numbering:
    """Distinct tokens of one block in order of first sight, and the numbers of every text."""

    def __init__(self):
        self.number: defaultdict = defaultdict(itertools.count().__next__)
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list) -> None:
        self.texts.append(np.fromiter(map(self.number.__getitem__, tokens), np.uint32, len(tokens)))
        self.size += len(tokens)

    def by_count(self) -> tuple[list, list[np.ndarray], np.ndarray]:
        """Tokens by descending count, the texts in that numbering, and the counts."""
        counts = np.zeros(len(self.number), np.int64)
        for text in self.texts:
            counts += np.bincount(text, minlength=len(counts))[:len(counts)] if len(text) * 8 > len(counts) else 0
            if len(text) * 8 <= len(counts):
                np.add.at(counts, text, 1)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.uint32)
        rank[order] = np.arange(len(counts), dtype=np.uint32)
        tokens = list(self.number)
        return [tokens[i] for i in order.tolist()], [rank[text] for text in self.texts], counts[order]
