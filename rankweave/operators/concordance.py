"""Order concordance of lists of any length, by counting inversions.

A list that fits one task is counted there, by merging sorted halves in numpy, so that every row moves once.
Longer lists are spread: items of a list are put in the order of the first value; every pair out of order in the second is an inversion.
Two places first differ at one binary digit: of the items that share all higher digits, an earlier one with a 1
and a later one with a 0 are out of order.  So each item contributes one row per digit, and a running count per
(list, digit, higher digits) finds all inversions: n log n rows, no pairs, and groups that are huge are cut into
ordered pieces like any other running count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.scale import hot_limit, meet, midranked, running

_LEAF = 32
_COUNTS = ("n", "inversions", "tied_x", "tied_y", "tied_both")


def _tied_pairs(rows: DataFrame, keys: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """Pairs of a list that agree in ``values``."""
    counts = rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_t"))
    return counts.groupBy(*keys).agg(F.sum((F.col("_t") * (F.col("_t") - 1) / 2).cast("long")).alias(name))


def inversions(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per list: ``n`` items and ``inversions``, the pairs with a smaller ``x`` and a larger ``y``."""
    keys = list(keys)
    placed = midranked(rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), keys, F.col("_y"), "_place")
    # Twice the average rank is a whole number, and equal for ties.
    digits = placed.select(*keys, "_x", (2 * F.col("_place")).cast("long").alias("_place"))
    sizes = digits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_place").alias("_most"))
    spread = meet(digits, sizes, keys).withColumn("_digit", F.explode(F.sequence(F.lit(0), F.length(F.bin("_most")) - 1)))
    shifted = spread.select(*keys, "_x", "_place", "_digit", F.expr("shiftright(_place, _digit)").alias("_s"))
    rows_of = shifted.select(*keys, "_x", "_place", "_digit", F.expr("shiftright(_s, 1)").alias("_above"), F.pmod("_s", F.lit(2)).alias("_bit"))
    # Items with equal x stand in ascending order of y, so none of their pairs is out of order; equal rows are one.
    merged = rows_of.groupBy(*keys, "_digit", "_above", "_x", "_place", "_bit").agg(F.count(F.lit(1)).alias("_c"))
    counted = running(merged, [*keys, "_digit", "_above"], [F.col("_x"), F.col("_place")], {"_ones": ("sum", F.col("_bit") * F.col("_c"))})
    found = counted.groupBy(*keys).agg(F.sum(F.when(F.col("_bit") == 0, F.col("_ones") * F.col("_c")).otherwise(0)).alias("inversions"))
    return meet(sizes.select(*keys, "n"), found, keys)


def count_inversions(values: np.ndarray) -> int:
    """Pairs of whole numbers from 0 of which the earlier is the larger."""
    n = len(values)
    if n < 2:
        return 0
    # Blocks of equal width; what fills up the last one is larger than all and comes last, so never out of order.
    top = int(values.max()) + 1
    width = min(_LEAF, 1 << (n - 1).bit_length())
    blocks = np.full(-(-n // width) * width, top, np.int64)
    blocks[:n] = values
    later = np.triu(np.ones((width, width), bool), 1)
    found = 0
    for part in np.array_split(blocks.reshape(-1, width), max(1, n // 65_536)):
        found += int(np.count_nonzero((part[:, :, None] > part[:, None, :]) & later))
    step = top + 1
    while width < n:
        number = np.arange(len(blocks)) // width
        # Sorted within each block; the halves of a pair of blocks meet under one number.
        ordered = np.sort(number * step + blocks) - number * step
        pair = number // 2 * step
        left, right = (number % 2 == 0), (number % 2 == 1)
        keys = (pair + ordered)[left]
        upto = np.searchsorted(keys, (pair + ordered)[right], "right")
        ends = np.searchsorted(keys, (pair + step)[right], "left")
        found += int((ends - upto).sum())
        blocks, width = ordered, 2 * width
    return found


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers from 0 in the order of the values; equal for ties."""
    return np.unique(column.to_numpy(), return_inverse=True)[1].reshape(-1)


def _tied(codes: np.ndarray) -> int:
    counts = np.unique(codes, return_counts=True)[1].astype(np.int64)
    return int((counts * (counts - 1) // 2).sum())


def _counted_whole(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Counts of lists that fit one task each."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in _COUNTS])

    def count(table: pa.Table) -> pa.Table:
        a, b = _codes(table.column("_x")), _codes(table.column("_y"))
        size = int(b.max()) + 1
        # Items with equal x stand in ascending order of y, so none of their pairs is out of order.
        both = np.sort(a * size + b)
        counts = (len(a), count_inversions(both % size), _tied(a), _tied(b), _tied(both))
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, **{c: pa.array([v], pa.int64()) for c, v in zip(_COUNTS, counts)}})

    return rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy(*keys).applyInArrow(count, schema)


def _counted_spread(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Counts of lists of any length."""
    joined = inversions(rows, keys, x, y)
    for values, name in (((x,), "tied_x"), ((y,), "tied_y"), ((x, y), "tied_both")):
        joined = meet(joined, _tied_pairs(rows, keys, values, name), keys)
    return joined.select(*keys, *_COUNTS)


def order_concordance(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Kendall concordance with tie corrections per list: n, inversions, tied_x, tied_y, tied_both, kendall.

    Rows with a null in ``x`` or ``y`` do not count.  Lists of one item, and lists that are all ties in one of the
    two, have no concordance (null).  Lists have no length limit.
    """
    keys = list(keys)
    rows = rows.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    limit = hot_limit(rows, keys) if keys else 0
    if limit is None:
        joined = _counted_whole(rows, keys, x, y)
    elif not keys:
        joined = _counted_spread(rows, keys, x, y)
    else:
        huge = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
        joined = _counted_whole(meet(rows, huge, keys, "left_anti"), keys, x, y).unionByName(
            _counted_spread(meet(rows, huge, keys, "left_semi"), keys, x, y))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    free: list[Column] = [(pairs - F.col(c)).cast("double") for c in ("tied_x", "tied_y")]
    score = pairs - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - 2 * F.col("inversions")
    return joined.withColumn("kendall", F.try_divide(score.cast("double"), F.sqrt(free[0]) * F.sqrt(free[1])))
