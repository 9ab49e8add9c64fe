"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the majority bit of the hashes of a text's word shingles.  Equal fingerprints are one
item.  The 64 bits are cut into three segments; of two fingerprints at most 4 bits apart, one segment
differs in at most one bit (at most none in the last), so each fingerprint looks up the small Hamming
ball of each of its segments in the table of all segments, and full distances are verified.  A bucket
yields a spanning forest of its verified links, never all pairs: components come out the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import identity, materialise, pack, unpack
from rankweave.llm.components import connect

SHINGLE = 4
DISTANCE = 4
SEGMENTS = (22, 21, 21)
SEED = 42
_PIECE = 1 << 16
_PAIRS = 1 << 12


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(
            starts[at:at + _PIECE].tolist(), ends[at:at + _PIECE].tolist())], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(starts))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """Fingerprint of each text, as a signed 64-bit integer."""
    @F.arrow_udf(T.LongType())
    def apply(texts: pa.Array) -> pa.Array:
        made = np.fromiter((fingerprint(t) for t in texts.to_pylist()), np.uint64, len(texts))
        return pa.array(made.view(np.int64))

    return apply.asNondeterministic()(text)


def _ball() -> list[tuple[int, int, int, int]]:
    """(segment, shift, mask of its bits, flipped bits) of every probe: radius DISTANCE // segments, and
    one less in segments beyond the remainder."""
    radius, rest = divmod(DISTANCE, len(SEGMENTS))
    if radius != 1:
        raise ValueError("this table of probes is for radius 1")
    probes, shift = [], 0
    for number, size in enumerate(SEGMENTS):
        mask = (1 << size) - 1
        flips = [0, *(1 << i for i in range(size))] if number <= rest else [0]
        probes += [(number, shift, mask, flip) for flip in flips]
        shift += size
    return probes


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within DISTANCE, by breadth-first search."""
    rest, left, right = members, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= DISTANCE
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), one))
                right.append(found)
                queue.extend(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (members[:0], members[:0])


def _bucket_links(buckets: np.ndarray, prints: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets, rows sorted by (bucket, probe): table rows first."""
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, len(buckets)])
    tables = np.add.reduceat((~probes).astype(np.int64), starts)
    useful = (tables > 0) & (sizes > 1)
    few = useful & (tables * sizes <= _PAIRS)
    left, right = [], []
    # Small buckets: every table row against every row, all buckets at once.
    base, t, n = starts[few], tables[few], sizes[few]
    pairs = t * n
    first = np.cumsum(pairs) - pairs
    local = np.arange(pairs.sum()) - np.repeat(first, pairs)
    origin, width = np.repeat(base, pairs), np.repeat(n, pairs)
    x, y = prints[origin + local // width], prints[origin + local % width]
    near = (x != y) & (np.bitwise_count(x ^ y) <= DISTANCE)
    left.append(x[near])
    right.append(y[near])
    for start, size in zip(starts[useful & ~few], sizes[useful & ~few]):
        a, b = _forest(np.unique(prints[start:start + size]))
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive sorted; the last bucket of a batch waits for its other rows."""
    held: list[tuple[np.ndarray, ...]] = []

    def made(parts):
        a, b = _bucket_links(*[np.concatenate(c) for c in zip(*parts)])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    for batch in batches:
        bucket, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        rows = bucket, prints.view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        if not len(bucket):
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut:
            yield made([*held, tuple(c[:cut] for c in rows)])
            held = []
        elif held and held[-1][0][-1] != bucket[-1]:
            yield made(held)
            held = []
        held.append(tuple(c[cut:] for c in rows))
    if held:
        yield made(held)


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all those within DISTANCE bits."""
    fp = F.col(column)
    segments = {(number, shift, mask) for number, shift, mask, _ in _ball()}

    def bucket(number, shift, mask, flip=0):
        key = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(flip))
        return key.bitwiseOR(F.lit(number << 32)).cast("long")

    rows = [F.struct(bucket(*s).alias("bucket"), F.lit(False).alias("probe")) for s in sorted(segments)]
    rows += [F.struct(bucket(*p).alias("bucket"), F.lit(True).alias("probe")) for p in _ball() if p[3]]
    spread = prints.select(fp.alias("fp"), F.explode(F.array(*rows)).alias("r")).select("r.bucket", "fp", "r.probe")
    return spread.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInArrow(_links, "u long, v long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, best) from rows (fp, best): the smallest ``best`` reachable from each distinct fingerprint."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("best").alias("best")))
    roots = connect(links(distinct.select("fp")), "u", "v").withColumnRenamed("node", "fp")
    rooted = materialise(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best"))
    smallest = materialise(rooted.groupBy("root").agg(F.min("best").alias("best")))
    return materialise(rooted.select("fp", "root").join(smallest, "root").select("fp", "best"))


def fingerprinted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, _a, _b, fp) of every row, written once."""
    text, name = F.col("row")[text_column], F.col("row")[id_column]
    return materialise(pack(docs).select(name.alias("id"), *identity(name, text), fingerprints(text).alias("fp")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Null ids are
    ignored as component ids; a component of null ids alone has a null one.  Repeated rows each come out.
    """
    prints = fingerprinted(docs, id_column, text_column)
    found = classes(prints.select("fp", F.col("id").alias("best")))
    return prints.join(found, "fp").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component (any one of equal rows); null ids last."""
    prints = fingerprinted(docs, id_column, text_column)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "_a", "_b")
    found = classes(prints.select("fp", best.alias("best")))
    stay = found.select("best._a", "best._b").distinct()
    base = pack(docs).select("row", *identity(F.col("row")[id_column], F.col("row")[text_column]))
    kept = base.join(stay.hint("shuffle_hash"), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    return unpack(kept, docs.columns)
