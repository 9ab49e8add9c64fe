"""Document fingerprints by MinHash: signatures in numpy, bands joined in Spark, Jaccard verified.

A signature holds, for each of ``PERMUTATIONS`` universal hash functions, the smallest value over the
text's word shingles; two signatures agree in as large a share of places as their shingle sets overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import discard, materialise, pack
from rankweave.llm.components import connect

PERMUTATIONS = 64
BANDS = 16
SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_IDS = 2_000_000
# Counters of a shingle set, and members of a band's bucket in one chunk.
_CELLS = 128
_CHUNK = 2_048
_BLOCK = 2_048
# Forests of pairs a bucket gives in the first round, and the factor from round to round.
_FORESTS = 4
# Parts a band's rows are dealt in when they meet what is known of the band, so that no bucket is one task.
_PARTS = 64
# Bytes of text hashed at a time.
_BYTES = 1 << 20
_EMPTY = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)
# Words are hashed by sums of a number per byte (A-Z as a-z, none for white space) times a number per place in the word.
_LETTERS = _random.integers(1, 1 << 63, 256, np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS[_SPACE] = 0
_NEAR = _random.integers(0, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _random.integers(0, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
_FAR[0] = 1
_GAP = re.compile(rb"[\x09-\x0D ]")


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where they start; pieces of about ``_BYTES``, cut at white space, bound the memory."""
    hashes, places, at = [], [], 0
    while at < len(data):
        gap = _GAP.search(data, at + _BYTES)
        end = gap.start() if gap else len(data)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_SPACE.take(raw)
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if inside[0]:
            starts = np.r_[0, starts]
        if len(starts):
            place = np.arange(len(raw), dtype=np.int32)
            place[starts[0]:] -= np.repeat(starts.astype(np.int32), np.diff(starts, append=len(raw)))
            weights = _NEAR.take(place & 0xFFFF)
            if len(raw) > 1 << 16:
                weights *= _FAR.take(place >> 16)
            weights *= _LETTERS.take(raw)
            hashes.append(np.add.reduceat(weights, starts))
            places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    made = np.concatenate(hashes)
    made = (made ^ (made >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return made ^ (made >> np.uint64(32)), np.concatenate(places)


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words."""
    n = len(hashes) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i:i + n]) * _PLACES[i % len(_PLACES)]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingles_of(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Per text, 64-bit hashes of its runs of ``width`` words (A-Z lowered); fewer words make one run, none make none."""
    data = [(text or "").encode("utf-8", "replace") for text in texts]
    hashes, starts = _words(b" ".join(data))
    cuts = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data])).tolist()
    runs = _runs(hashes, width) if len(hashes) >= width else hashes[:0]
    return [runs[a:b - width + 1] if b - a >= width else _runs(hashes[a:b], b - a) if b > a else hashes[:0]
            for a, b in pairwise([0, *cuts])]


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """``shingles_of`` one text."""
    return shingles_of([text], width)[0]


def _in_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``_BYTES`` characters together, or one longer text."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= _BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def signature(runs: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function; all ones for a text without words."""
    best = _EMPTY.copy()
    small = (runs >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), _BLOCK):
        np.minimum(best, (small[at:at + _BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0), out=best)
    return best


def text_of(made: np.ndarray) -> str:
    return made.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing places of two signatures."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many code points of the next text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, zstd of the text as UTF-8)."""
    made = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [made.compress((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "z"])


def _deal(bounds: np.ndarray):
    """Rows (id, z, class_id) to the range of ids they fall in; a range's first id also goes to the range before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            place = np.searchsorted(bounds, keys, "right") - 1
            # Texts only: a class is needed in its own range alone.
            first = np.flatnonzero((keys == bounds[place]) & batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            for rows, p, halo in ((batch, place, False), (batch.take(pa.array(first)), (place[first] - 1) % len(bounds), True)):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), halo)), *rows.columns], ["p", "halo", "id", "z", "class_id"])
    return run


_RESULT = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("class_id", pa.int64())])


def _followed(held: tuple | None, rows: list[tuple], out: list[tuple]) -> tuple | None:
    """Adds to ``out`` the results of texts whose next one is in ``rows`` (p, halo, id, text, class_id), ``held`` being the
    row before them with its signature; returns the last row, unless it only follows a range."""
    if not rows:
        return held
    marks = [signature(runs) for runs in shingles_of([row[3] for row in rows])]
    chain = [*([held] if held else []), *[(*row, mark) for row, mark in zip(rows, marks)]]
    pairs = [(one, after) for one, after in pairwise(chain) if one[0] == after[0] and not one[1]]
    changed = [edited(one[3], after[3]) for one, after in pairs]
    for (one, after), text, runs in zip(pairs, changed, shingles_of(changed)):
        mark, other = one[5], signature(runs)
        out.append((one[2], len(one[3]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), text_of(mark),
                    text_of(other), likeness(mark, other), likeness(mark, after[5]), one[4]))
    return None if chain[-1][1] else chain[-1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text against the one after it in its range, as they arrive in order; its class comes before it."""
    plain = zstandard.ZstdDecompressor()
    held, last_class = None, (None, None)
    for batch in batches:
        out = []
        rows, size = [], 0
        for p, halo, name, z, class_id in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if z is None:
                last_class = (name, class_id)
                continue
            rows.append((p, halo, name, plain.decompress(z).decode(), last_class[1] if last_class[0] == name else name))
            size += len(rows[-1][3])
            if size >= _BYTES:
                held = _followed(held, rows, out)
                rows, size = [], 0
        held = _followed(held, rows, out)
        yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, row)) for row in out], _RESULT)


def compare_with_next(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row, in order of id: fingerprint, that of the edited text (see ``edited``), likenesses, ``class_id``.

    ``classes`` has (id, class_id) for rows in a class of several; others are their own.  The next of the
    last row is the first.  A null text counts as empty, a null id comes first and has no class, rows of
    one id follow each other in a fixed order.  An empty table gives no rows.

    Ranges of ids are cut by Spark's range partitioning; their first ids (two per shuffle partition)
    reach the driver.  Compressed texts are then shuffled once, each range to one task, with the first row of the
    next range behind it.
    """
    row = F.col("row")
    base = pack(docs).select(row[id_column].cast("long").alias("id"), row[text_column].alias("text"))
    low = F.coalesce("id", F.lit(-(1 << 63)))
    # Texts are far larger than ids: as many ranges as for a large shuffle, not as few as ids alone would fill.
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(base.select(low.alias("id")).repartitionByRange(ranges, "id").select("id", F.spark_partition_id().alias("p")))
    lows = [r["low"] for r in cut.groupBy("p").agg(F.min("id").alias("low")).collect()]
    kind = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, class_id long")
    if not lows:
        return docs.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_column)
    texts = base.mapInArrow(_compressed, "id long, z binary").withColumn("class_id", F.lit(None).cast("long"))
    marks = classes.select("id", F.lit(None).cast("binary").alias("z"), "class_id")
    spread = texts.unionByName(marks).mapInArrow(
        _deal(np.array(sorted(set(lows)), np.int64)), "p long, halo boolean, id long, z binary, class_id long")
    placed = spread.repartition("p").sortWithinPartitions("p", "halo", F.asc_nulls_first("id"), F.asc_nulls_first("z"))
    return placed.mapInArrow(_compare, kind).withColumnRenamed("id", id_column)


def counters(runs: np.ndarray) -> bytes:
    """Distinct shingles per cell, at most 255; what two texts differ by in all cells bounds their difference from below."""
    cells = np.bincount((runs & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _possible(apart: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` shingles that differ in ``apart`` or more can reach THRESHOLD; the slack is for rounding only."""
    return apart * (1 + THRESHOLD) <= total * (1 - THRESHOLD) + 1e-6


def sketched(text: Column) -> Column:
    """Struct of a text: ``set_a``, ``set_b`` (128-bit hash of its shingle set), ``bands`` (one 64-bit key per band),
    ``size`` and ``cells`` (see ``counters``) of the set."""
    @F.arrow_udf("set_a long, set_b long, bands array<long>, size long, cells binary")
    def apply(texts: pa.Array) -> pa.Array:
        rows = []
        for runs in (np.unique(r) for group in _in_groups(texts.to_pylist()) for r in shingles_of(group)):
            made = signature(runs).reshape(BANDS, -1)
            a, b = np.frombuffer(xxhash.xxh128_digest(runs.tobytes()), np.int64)
            keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(made)]
            rows.append({"set_a": int(a), "set_b": int(b), "bands": np.array(keys, np.uint64).view(np.int64).tolist(),
                         "size": len(runs), "cells": counters(runs)})
        return pa.array(rows, pa.struct([("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())),
                                         ("size", pa.int64()), ("cells", pa.binary())]))
    return apply.asNondeterministic()(text)


def _matrix(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, _CELLS).astype(np.int16)


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, total, cu, cv) to the pairs (u, v) whose counters leave THRESHOLD possible."""
    for batch in batches:
        apart = np.abs(_matrix(batch.column(3)) - _matrix(batch.column(4))).sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array(_possible(apart, batch.column(2).to_numpy())))


def _spanning(names: np.ndarray, classes: np.ndarray, sizes: np.ndarray, cells: np.ndarray, barred: list, times: int) -> list[tuple[int, int]]:
    """Places (x, y) of pairs across classes that may be links: ``times`` forests, each of which connects all that such
    pairs connect.  ``barred`` has, per member, names it was compared with in vain."""
    place = {name: i for i, name in enumerate(names.tolist())}
    closed: list[list[int]] = [[] for _ in place]
    for i, others in enumerate(barred):
        for j in (place[o] for o in others or () if o in place):
            closed[i].append(j)
            closed[j].append(i)
    _, own, n = np.unique(classes, return_inverse=True, return_counts=True)
    # Of two classes one is not the largest: its members look at all others.
    order = np.flatnonzero(own != n.argmax())
    made: list[tuple[int, int]] = []
    for _ in range(times):
        group, before = own.copy(), len(made)
        for x in order.tolist():
            far = group != group[x]
            far[closed[x]] = False
            at = np.flatnonzero(far)
            near = at[_possible(np.abs(cells[at] - cells[x]).sum(axis=1), sizes[at] + sizes[x])]
            if len(near):
                joined, first = np.unique(group[near], return_index=True)
                for y in near[first].tolist():
                    made.append((x, y))
                    closed[x].append(y)
                    closed[y].append(x)
                group[np.isin(group, joined)] = group[x]
        if len(made) == before:
            break
    return made


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one key (first column) at a time, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for a, b in pairwise([*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)] if len(keys) else []):
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _across(times: int):
    """Rows (key, rep, class_id, size, cells, barred) to pairs (u, v, cu, cv) of reps and their classes, see ``_spanning``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            names, classes, sizes = (rows.column(i).to_numpy() for i in (1, 2, 3))
            made = _spanning(names, classes, sizes, _matrix(rows.column(4)), rows.column(5).to_pylist(), times)
            x, y = np.array(made, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names[x], names[y], classes[x], classes[y])], ["u", "v", "cu", "cv"])
    return run


def _candidates(members: DataFrame, marks: DataFrame, failed: DataFrame, times: int) -> DataFrame:
    """(u, v, cu, cv) across the classes of every bucket of ``members`` (band, rep, class_id, n rows of the bucket).

    A bucket of more than _CHUNK members is cut into chunks by hash, and every two chunks meet in a task of their own.
    """
    barred = failed.groupBy(F.col("v").alias("rep")).agg(F.collect_set("u").alias("barred"))
    chunks, own = F.ceil(F.col("n") / _CHUNK), F.pmod(F.xxhash64("rep"), F.col("chunks"))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_except(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), F.array("own")))
    spread = members.join(marks, "rep").join(barred, "rep", "left").withColumn("chunks", chunks).withColumn("own", own).withColumn(
        "other", F.explode(others)).select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
                                           "rep", "class_id", "size", "cells", "barred")
    # A fixed number of partitions: rows are few bytes and much work, so AQE would merge too many.
    dealt = spread.repartition(2 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_across(times), "u long, v long, cu long, cv long").dropDuplicates(["u", "v"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, cu, cv, zu, zv) to (u, v, cu, cv, same): whether the shingle sets have a Jaccard similarity of THRESHOLD or more."""
    plain = zstandard.ZstdDecompressor()
    known: dict[int, np.ndarray] = {}

    def runs(name, z):
        if name not in known:
            if len(known) > 64:
                known.clear()
            known[name] = np.unique(shingles(plain.decompress(z).decode()))
        return known[name]

    for batch in batches:
        same = []
        for u, v, zu, zv in zip(*[batch.column(i).to_pylist() for i in (0, 1, 4, 5)]):
            x, y = runs(u, zu), runs(v, zv)
            both = len(np.intersect1d(x, y, assume_unique=True))
            same.append(both >= THRESHOLD * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same, pa.bool_())], ["u", "v", "cu", "cv", "same"])


def _tested(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written pairs (u, v, cu, cv) with ``same``, from the texts of ``base`` (id, text)."""
    wanted = materialise(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    # Ids of checked size filter the texts where they are read; more of them meet the texts in a join.
    few = wanted.count() <= BROADCAST_IDS
    texts = base.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").mapInArrow(_compressed, "id long, z binary")
    single = materialise(texts.dropDuplicates(["id"]))
    left = pairs.join(single.select(F.col("id").alias("u"), F.col("z").alias("zu")), "u")
    both = left.join(single.select(F.col("id").alias("v"), F.col("z").alias("zv")), "v").select("u", "v", "cu", "cv", "zu", "zv")
    tested = materialise(both.mapInArrow(_verified, "u long, v long, cu long, cv long, same boolean"))
    # Texts are the largest of all written tables, and of no more use.
    discard(wanted, single)
    return tested


def _moved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``class_id`` replaced by its root (node, root), if it has one."""
    return rows.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn(
        "class_id", F.coalesce("root", "class_id")).drop("root")


def _of_bands(rows: DataFrame, column: str) -> DataFrame:
    """Written (band, part, n, low, high) of ``rows`` (band, part, ...): number of the band's rows, its smallest and
    largest ``column``, for every part that has rows."""
    parts = rows.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
    parts = materialise(parts)
    bands = parts.groupBy("band").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return materialise(parts.select("band", "part").join(bands, "band").select("band", "part", "n", "low", "high"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, class_id) of rows in a class of several: links of Jaccard similarity 0.8 or more on five-word shingles.

    Texts of one shingle set are one item, named by its smallest id.  Items that share a signature band
    meet in the band's bucket; classes are those of all pairs of every bucket.  First each item is compared
    with the bucket's smallest one.  Then, in rounds with written tables, every bucket that still holds several
    classes gives the pairs across them that counters of the shingle sets cannot rule out, as forests: four in
    the first round, four times as many in each later one, without pairs that failed.  The rounds end when no
    bucket has such a pair.  Null ids take no part; texts without words are one item.  If an id has several
    texts, one of them stands for it in a comparison.
    """
    row = F.col("row")
    base = pack(docs).select(row[id_column].cast("long").alias("id"), row[text_column].alias("text")).filter("id IS NOT NULL")
    made = materialise(base.withColumn("s", sketched(F.col("text"))).select("id", "s.*"))
    items = materialise(made.groupBy("set_a", "set_b").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", "size", "cells")]))
    # An id with several texts stands for one item of them here too.
    marks = items.groupBy("rep").agg(F.first(F.struct("size", "cells")).alias("m")).select("rep", "m.*")
    part = F.pmod(F.xxhash64("rep"), F.lit(_PARTS)).cast("int").alias("part")
    buckets = items.select("rep", F.explode("bands").alias("band"), part).distinct()
    least = _of_bands(buckets, "rep").filter("n > 1").withColumnRenamed("low", "u")
    starred = materialise(buckets.join(least, ["band", "part"]).filter("rep > u").select("band", "part", "u", F.col("rep").alias("v"), "n"))
    left = starred.select("u", "v").distinct().join(marks.select(F.col("rep").alias("u"), F.col("size").alias("su"), F.col("cells").alias("zu")), "u")
    both = left.join(marks.select(F.col("rep").alias("v"), F.col("size").alias("sv"), F.col("cells").alias("zv")), "v")
    pairs = materialise(both.select("u", "v", (F.col("su") + F.col("sv")).alias("total"), "zu", "zv").mapInArrow(_hopeful, "u long, v long"))
    tested = _tested(base, pairs.withColumns({"cu": F.col("u"), "cv": F.col("v")}))
    rooted = items.select("set_a", "set_b", F.col("rep").alias("class_id"))
    # The smallest item has been compared with all others of its bucket.
    members = starred.filter("n > 2").select("band", "part", F.col("v").alias("rep"), F.col("v").alias("class_id"))
    failed, times = tested.filter("NOT same").select("u", "v"), _FORESTS
    while True:
        roots = connect(tested.filter("same"), "cu", "cv")
        rooted, members = materialise(_moved(rooted, roots)), materialise(_moved(members, roots).select("band", "part", "rep", "class_id"))
        mixed = _of_bands(members, "class_id").filter("low < high").select("band", "part", "n")
        members = materialise(members.join(mixed, ["band", "part"]))
        pairs = materialise(_candidates(members, marks, failed, times))
        if pairs.isEmpty():
            break
        tested, times = _tested(base, pairs), times * _FORESTS
        failed = failed.unionByName(tested.filter("NOT same").select("u", "v"))
    members = made.select("id", "set_a", "set_b").join(rooted, ["set_a", "set_b"]).groupBy("id").agg(F.min("class_id").alias("class_id"))
    # A class's smallest id needs no row: it is its own class.
    classes = materialise(members.filter("id <> class_id"))
    # What led to the classes is of no more use once they are written.
    discard(made, items, least, starred, rooted)
    return classes
