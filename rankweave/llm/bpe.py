"""Byte-level BPE encoding and decoding with a public rank file.

Encoding shuffles distinct words.  Pre-tokens are exploded with their positions, as numbers into the
dictionary of a block of texts; the dictionaries meet by word, every distinct word is encoded once, the
ids join back on the block, and each text is put together by position.  Decoding joins ids with the table
of token bytes, which has as many rows as the vocabulary file and therefore travels as a broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.blocks import Numbering, squeeze, squeeze_strings, stretch, stretch_strings
from rankweave.llm.common import pack
from rankweave.session import materialise_by

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
# Pre-tokens of a block, shares of words by hash, and words one task keeps before it forgets them.
BLOCK_TOKENS = 4_000_000
WORD_SHARES = 1_024
_KEPT_WORDS = 1_000_000
_TEXT, _ORDER = -1, -2  # values of ``share`` for rows that hold no words
_ROW_TOKENS = 1_000_000  # of one Arrow batch that is sent on


def load(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids."""
    with open(path or public_tokenizers.path(DEFAULT_RANKS), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of neighbours with the lowest rank, leftmost first, merges until none can."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    size = len(word)
    # Segments by their first byte: where each ends, and which one stands before it.
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    alive = [True] * size
    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        if not alive[left] or (middle := end[left]) >= stop or end[middle] != stop:
            continue
        end[left], alive[middle] = stop, False
        if stop < size:
            before[stop] = left
            if (rank := ranks.get(word[left:end[stop]])) is not None:
                heapq.heappush(heap, (rank, left, end[stop]))
        if (first := before[left]) >= 0 and (rank := ranks.get(word[first:stop])) is not None:
            heapq.heappush(heap, (rank, first, stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at:end[at]]])
        at = end[at]
    return ids


def _cut(kind: T.StructType, block_tokens: int, shares: int):
    """Blocks of a task's texts: one row a text (its numbers), one a share of the dictionary, one with the order."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("share", T.IntegerType()),
                           T.StructField("body", T.BinaryType()), T.StructField("row", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(public_tokenizers.PATTERN)
        part, ordinal = TaskContext.get().partitionId(), 0
        state, rows = Numbering(), []
        row_type = None

        def table(block, share, body, row) -> pa.RecordBatch:
            size = len(body)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * size, pa.int64()), pa.array(share, pa.int32()), pa.array(body, pa.binary()),
                 pa.nulls(size, row_type) if row is None else row], ["block", "share", "body", "row"])

        def flush() -> Iterator[pa.RecordBatch]:
            block = (part << 32) | ordinal
            tokens, texts, _ = state.by_count()
            words = [t.encode() for t in tokens]
            share = np.fromiter((crc32(w) % shares for w in words), np.int64, len(words))
            order = np.argsort(share, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            yield table(block, [_ORDER], [squeeze(place)], None)
            ends = np.searchsorted(share[order], np.arange(shares + 1)).tolist()
            full = [s for s in range(shares) if ends[s + 1] > ends[s]]
            inside = order.tolist()
            yield table(block, full, [squeeze_strings([words[i] for i in inside[ends[s]:ends[s + 1]]]) for s in full], None)
            at = 0
            for some in rows:
                bodies = [squeeze(t) for t in texts[at:at + len(some)]]
                at += len(some)
                yield table(block, [_TEXT] * len(some), bodies, some)

        for batch in batches:
            packed, texts = batch.column("row"), batch.column("text")
            row_type = packed.type
            begin = 0
            for i, text in enumerate(texts.to_pylist()):
                state.add(pattern.findall(text) if text else [])
                if state.size >= block_tokens:
                    rows.append(packed.slice(begin, i + 1 - begin))
                    yield from flush()
                    state, rows, ordinal, begin = Numbering(), [], ordinal + 1, i + 1
            if begin < len(packed):
                rows.append(packed.slice(begin))
        if rows:
            yield from flush()

    return run, schema


def _encode_shares(shared):
    """Ids of the words of every row; rows come ordered by share, so a word is met by one task and encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, at = shared.value, {}, None
        for batch in batches:
            bodies = []
            for share, raw in zip(batch.column("share").to_pylist(), batch.column("body").to_pylist()):
                if share != at or len(known) > _KEPT_WORDS:
                    known, at = {}, share
                found = []
                for word in stretch_strings(raw):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = encode_word(word, ranks)
                    found.append(ids)
                flat = [i for ids in found for i in ids]
                bodies.append(squeeze(np.array([len(found), *map(len, found), *flat], np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("share"), pa.array(bodies, pa.binary())],
                                             ["block", "share", "body"])

    return run


def _assemble(names: list[str]):
    """Texts of a block and the ids of its words: ids of each text by position."""
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        shares = np.array(words["share"].to_pylist(), np.int64)
        bodies = words["body"].to_pylist()
        counts, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for i in np.argsort(shares, kind="stable").tolist():
            numbers = stretch(bodies[i])
            size = int(numbers[0])
            counts.append(numbers[1:size + 1])
            flat.append(numbers[size + 1:])
        count, ids = np.concatenate(counts).astype(np.int64), np.concatenate(flat)
        begin = np.cumsum(count) - count
        kind = np.array(texts["share"].to_pylist(), np.int64)
        order = stretch(texts["body"][int(np.flatnonzero(kind == _ORDER)[0])].as_py()).astype(np.int64)
        own = texts.filter(pa.array(kind == _TEXT))
        out, sizes = [], []
        for raw in own["body"].to_pylist():
            place = order[stretch(raw)]
            length = count[place]
            total = int(length.sum())
            out.append(ids[np.repeat(begin[place] - (np.cumsum(length) - length), length) + np.arange(total)])
            sizes.append(total)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        values = pa.array(np.concatenate([np.zeros(0, np.uint32), *out]).astype(np.int32))
        row = own["row"].combine_chunks()
        columns = {c: row.field(c) for c in names}
        return pa.table([*columns.values(), pa.ListArray.from_arrays(offsets, values)], [*columns, "ids"])

    return run


def encode(docs: DataFrame, text_column: str = "text", path: str | None = None, block_tokens: int = BLOCK_TOKENS,
           shares: int = WORD_SHARES) -> DataFrame:
    """``docs`` without the text and with ``ids`` (array of int): those of the text, every pre-token apart.

    A null or empty text has no ids.  Every row stays, repeated rows and null ids too; a column ``ids`` of the
    input is replaced.  Texts are never cut: a text longer than a block is a block of its own.
    """
    names = [c for c in docs.columns if c not in (text_column, "ids")]
    # The position of a column stands for its name on the way, so that any name will do.
    packed = pack(docs, text=F.col("row")[text_column])
    kept = F.struct(F.lit(0).alias("c"), *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    rows = packed.select(kept, "text")
    run, schema = _cut(rows.schema["row"].dataType, block_tokens, shares)
    blocks = materialise_by(rows.mapInArrow(run, schema), "block")
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    words = blocks.filter("share >= 0").select("block", "share", "body").repartition("share").sortWithinPartitions("share")
    encoded = words.mapInArrow(_encode_shares(shared), "block long, share int, body binary")
    inner = [f"c{i}" for i in range(len(names))]
    kind = T.StructType([*[T.StructField(c, docs.schema[n].dataType) for c, n in zip(inner, names)],
                         T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = blocks.filter("share < 0").groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(inner), kind)
    return whole.toDF(*names, "ids")


def _lists(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all rows end to end, where each row begins, and which rows are null."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    # A null row may still span numbers; they are nobody's.
    lengths = np.where(null, 0, np.diff(offsets))
    numbers = ids.values.fill_null(-1).to_numpy()[offsets[0]:offsets[-1]]
    if (lengths != np.diff(offsets)).any():
        numbers = numbers[np.repeat(~null, np.diff(offsets))]
    return numbers, np.concatenate([[0], np.cumsum(lengths)]), null


def decode(rows: DataFrame, ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded`` (binary): the bytes of the ids.  Null ids, and rows with an id without a token, give null."""
    ranks = load(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    # Tokens are never empty, so a length of zero marks an id that has none; the last place stands for such ids.
    length = np.array([*map(len, tokens), 0], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), length, np.cumsum(length) - length))

    @F.arrow_udf("binary")
    def join(ids: pa.Array) -> pa.Array:
        data, length, begin = shared.value
        numbers, starts, null = _lists(ids)
        numbers = np.where((numbers < 0) | (numbers >= len(length)), len(length) - 1, numbers)
        own = length[numbers]
        ends = np.concatenate([[0], np.cumsum(own)])
        body = data[np.repeat(begin[numbers] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        lost = np.concatenate([[0], np.cumsum(own == 0)])
        null = null | (lost[starts[1:]] > lost[starts[:-1]])
        at = ends[starts].tolist()
        return pa.array([None if gone else body[a:b] for gone, a, b in zip(null.tolist(), at, at[1:])], pa.binary())

    return rows.withColumn("decoded", join(F.col(f"`{ids_column}`")))


def digest(ids: Column) -> Column:
    """SHA-256 of ids as little-endian 32-bit integers, in hexadecimal."""
    @F.arrow_udf("string")
    def apply(rows: pa.Array) -> pa.Array:
        numbers, starts, null = _lists(rows)
        raw, at = memoryview(numbers.astype("<u4").tobytes()), (starts * 4).tolist()
        return pa.array([None if gone else sha256(raw[a:b]).hexdigest() for gone, a, b in zip(null.tolist(), at, at[1:])], pa.string())

    return apply(ids)
