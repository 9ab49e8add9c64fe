"""Mixing sources to target weights with Pfair scheduling.

Each source is cut into blocks.  A source that has q of ``parts`` slots owes its k-th block in the window
from floor((k-1) parts/q) to ceil(k parts/q); earliest deadline first over these windows keeps every
source within one block of its weight at any time.  The schedule repeats every ``parts`` slots, so one
period is scheduled (a table of ``parts`` rows) and any block's slot follows by arithmetic, in parallel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.common import pack, unpack

BLOCK_ROWS = 16
PARTS = 10_000
MAX_SOURCES = 5_000
# Weights follow size to this power unless given: large sources yield a little to small ones.
SMOOTHING = 0.85
# Rows of all sources in one numbering bucket, and buckets under one running total.
_BUCKET_ROWS = 128
_RUN = 1_024


def _sorted(sources) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def shares(weights: Mapping[str | None, float], parts: int = PARTS) -> dict[str | None, int]:
    """Slots per period by largest remainders; every source with a weight above zero gets one at least."""
    wanted = {s: w for s, w in weights.items() if w > 0}
    if len(wanted) > parts:
        raise ValueError(f"{len(wanted)} sources need at least as many parts, not {parts}")
    total, order = sum(wanted.values()), _sorted(wanted)
    quota = {s: max(1, math.floor(wanted[s] / total * parts)) for s in order}
    while order and (gap := parts - sum(quota.values())):
        step = 1 if gap > 0 else -1
        free = [s for s in order if quota[s] + step >= 1]
        free.sort(key=lambda s: -step * (wanted[s] / total * parts - quota[s]))
        for s in free[:abs(gap)]:
            quota[s] += step
    return quota


def period(quota: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, k from 0, slot, release, deadline) of every block of one period, earliest deadline first."""
    parts, order = sum(quota.values()), _sorted(quota)
    waiting = [(0, i, 0) for i in range(len(order))]
    ready: list[tuple[int, int, int, int]] = []
    made = []
    for slot in range(parts):
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * parts // quota[order[i]]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        made.append((order[i], k, slot, release, deadline))
        if k + 1 < quota[order[i]]:
            heapq.heappush(waiting, ((k + 1) * parts // quota[order[i]], i, k + 1))
    return made


def source_sizes(docs: DataFrame, source: str) -> dict[str | None, int]:
    """Rows per source; a table of at most MAX_SOURCES rows reaches the driver, more are refused."""
    counts = pack(docs, source=F.col("row")[source].cast("string")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; merge small ones first")
    return {r["source"]: r["n"] for r in rows}


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """``place`` (from 0) of each row within its source ``s``, in an order given by hash.

    Rows are dealt into hash buckets whatever their source, counted, and numbered inside their bucket
    from its running total, so a large source is spread over all tasks.  Running totals go over runs of
    buckets first.
    """
    runs = max(1, -(-total // (_BUCKET_ROWS * _RUN)))
    dealt = rows.withColumns({"run": F.pmod("_a", F.lit(runs)), "bucket": F.pmod("_b", F.lit(_RUN))})
    counts = dealt.groupBy("s", "run", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    coarse = counts.groupBy("s", "run").agg(F.sum("n").alias("n")).withColumn("c", F.coalesce(F.sum("n").over(earlier(["s"], "run")), F.lit(0)))
    fine = counts.withColumn("f", F.coalesce(F.sum("n").over(earlier(["s", "run"], "bucket")), F.lit(0)))
    starts = fine.drop("n").join(coarse.drop("n"), ["s", "run"]).select("s", "run", "bucket", (F.col("c") + F.col("f")).alias("start"))
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy("s", "run", "bucket").orderBy("_a", "_b")))
    return inside.join(starts, ["s", "run", "bucket"]).withColumn("place", F.col("start") + F.col("at") - 1).drop(
        "run", "bucket", "start", "at", "_a", "_b")


def _timed(docs, weights, id_column, source, block_rows, parts) -> DataFrame:
    sizes = source_sizes(docs, source)
    if weights is None:
        weights = {s: n ** SMOOTHING for s, n in sizes.items()}
    quota = shares({s: w for s, w in weights.items() if s in sizes}, parts)
    order = _sorted(quota)
    blocks = {s: -(-sizes[s] // block_rows) for s in order}
    windows = [(order.index(s), k, slot, release, deadline) for s, k, slot, release, deadline in period(quota)]
    slot_of = {(s, k): slot for s, k, slot, _, _ in windows}
    # The mixture ends when the source that needs longest has been read whole.
    end = max(((b - 1) // quota[s] * parts + slot_of[i, (b - 1) % quota[s]] + 1
               for i, s in enumerate(order) for b in [blocks[s]]), default=0)
    spark = docs.sparkSession
    # MAX_SOURCES and PARTS bound these two tables, whatever the data.
    plan = F.broadcast(spark.createDataFrame(
        [(i, s, blocks[s], quota[s]) for i, s in enumerate(order)], "s int, _name string, blocks long, quota long"))
    turns = F.broadcast(spark.createDataFrame(windows, "s int, turn long, at_slot long, at_release long, at_deadline long"))
    others = [F.col("row")[c] for c in docs.columns if c != id_column]
    rows = pack(docs, _source=F.col("row")[source].cast("string"), _a=F.xxhash64(F.col("row")[id_column]),
                _b=F.xxhash64(F.lit(1), F.col("row")[id_column], *others))
    known = rows.join(plan, F.col("_source").eqNullSafe(F.col("_name"))).drop("_source", "_name")
    placed = _numbered(known, sum(sizes[s] for s in order)).withColumn("block", F.expr(f"place div {block_rows}"))
    # At most one epoch more than fit whole.
    last = F.expr(f"({end} div {parts} + 1) * quota div blocks + 1")
    read = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    read = read.withColumn("k", F.col("epoch") * F.col("blocks") + F.col("block"))
    read = read.withColumns({"turn": F.expr("k % quota"), "base": F.expr(f"k div quota * {parts}")}).join(turns, ["s", "turn"])
    return read.select("row", "epoch", "block", *[
        (F.col("base") + F.col(f"at_{c}")).alias(c) for c in ("slot", "release", "deadline")]).filter(F.col("slot") < end)


def schedule(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_column: str = "doc_id",
    source: str = "source", block_rows: int = BLOCK_ROWS, parts: int = PARTS,
) -> DataFrame:
    """``docs`` in the mixture: adds ``epoch``, ``block``, ``slot``, ``release``, ``deadline`` (long).

    The mixture runs until every source has been read whole once; a source that ends earlier starts
    again (epoch 1, 2, ...), so no row is lost and weights hold to the end.  With ``weights`` (source to
    weight) sources not named, or of weight zero, take no part; else weights are size ** SMOOTHING.
    A null source is a source.  Equal rows count apart.  An empty table gives no rows.
    """
    timed = _timed(docs, weights, id_column, source, block_rows, parts)
    return unpack(timed, docs.columns, **{c: F.col(c) for c in ("epoch", "block", "slot", "release", "deadline")})


def mixture(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_column: str = "doc_id",
    source: str = "source", block_rows: int = BLOCK_ROWS, parts: int = PARTS,
) -> DataFrame:
    """The rows that ``schedule`` reads, a row once per epoch, with the columns of ``docs`` alone."""
    return unpack(_timed(docs, weights, id_column, source, block_rows, parts), docs.columns)
