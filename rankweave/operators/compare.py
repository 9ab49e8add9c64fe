"""Comparison of two tables by a digest tree.

Keys fall into ranges by hash, ranges of ranges form a tree.  A pass over each table makes one digest per range
(a count and two sums of 64-bit row hashes, independent of row order), which map-side aggregation leaves at one
row per range and task.  Only ranges whose digests differ are descended into, and only rows of the last ranges
are joined: what is shuffled grows with the difference, not with the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import materialise

FANOUT = 1_024
LEVELS = 3
# Rows of differing ranges of either table that are joined without another level.
JOIN_ROWS = 1_000_000


def _whole(*columns: str) -> list[Column]:
    """Columns with their null flags, so that a null is not skipped by the hash."""
    return [part for c in columns for part in (F.col(c).isNull(), F.col(c))]


def row_words(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row."""
    return [F.xxhash64(*_whole(*columns)), F.xxhash64(F.lit(1), *_whole(*columns))]


def _digests(table: DataFrame, columns: Sequence[str], level: int, fanout: int) -> DataFrame:
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    high, low = row_words(columns)
    return table.groupBy(_range(level, fanout).alias("range")).agg(F.count(F.lit(1)).alias("n"), wide(high).alias("high"), wide(low).alias("low"))


def _range(level: int, fanout: int) -> Column:
    """Number of the range of a row at a level; a range of the next level lies inside one of this."""
    return F.pmod(F.col("_key"), F.lit(fanout ** level))


def differing_ranges(left: DataFrame, right: DataFrame, columns: Sequence[str], level: int, fanout: int) -> DataFrame:
    """Ranges whose digests differ: range, rows on each side."""
    a, b = (_digests(t, columns, level, fanout) for t in (left, right))
    joined = a.withColumnsRenamed({"n": "n_left", "high": "h1", "low": "l1"}).join(
        b.withColumnsRenamed({"n": "n_right", "high": "h2", "low": "l2"}), "range", "full_outer")
    same = F.col("n_left").eqNullSafe(F.col("n_right")) & F.col("h1").eqNullSafe(F.col("h2")) & F.col("l1").eqNullSafe(F.col("l2"))
    return joined.filter(~same).select("range", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def suspects(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
    fanout: int = FANOUT, levels: int = LEVELS, join_rows: int = JOIN_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that lie in differing ranges; all others are equal as bags.

    ``columns`` are compared and include the keys.  Every level multiplies the ranges by ``fanout``; it is taken only
    while the differing ranges hold more than ``join_rows`` rows.
    """
    columns = [*keys, *[c for c in columns if c not in keys]]
    a, b = (t.select(*columns, F.xxhash64(F.lit(2), *_whole(*keys)).alias("_key")) for t in (left, right))
    for level in range(1, levels + 1):
        found = materialise(differing_ranges(a, b, columns, level, fanout))
        size = found.agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("n_left") + F.col("n_right")).alias("rows")).first()
        # The list of differing ranges of one level may be broadcast while it is short, whatever the tables' size.
        chosen = F.broadcast(found.select("range")) if size["ranges"] <= fanout * fanout else found.select("range")
        a, b = (t.withColumn("range", _range(level, fanout)).join(chosen, "range", "left_semi").drop("range") for t in (a, b))
        if (size["rows"] or 0) <= join_rows:
            break
    return a.drop("_key"), b.drop("_key")


def row_differences(left: DataFrame, right: DataFrame, columns: Sequence[str], keys: Sequence[str] | None = None, **tree) -> DataFrame:
    """Rows that one table has more often than the other: the columns, ``n_left`` and ``n_right`` copies."""
    a, b = suspects(left, right, keys or columns, columns, **tree)
    tagged = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    counted = tagged.groupBy(*columns).agg(F.count_if(F.col("_side") == 0).alias("n_left"), F.count_if(F.col("_side") == 1).alias("n_right"))
    return counted.filter("n_left <> n_right")


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], **tree) -> DataFrame:
    """Keys whose rows differ: the keys, ``change`` (missing, extra or changed) and the ``columns`` that changed.

    Keys are unique in each table; a repeated key is an error.  Nulls equal nulls, in keys too.
    """
    keys, columns = list(keys), [c for c in columns if c not in keys]
    a, b = suspects(left, right, keys, columns, **tree)
    side = lambda t, n: t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*columns) if columns else F.struct(F.lit(1))).alias(n))
    a, b = side(a, "_a"), side(b, "_b")
    for name, other in (("_a", a), ("_b", b)):
        once = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.raise_error(F.lit("a key occurs twice")).cast(other.schema[name].dataType))
        a, b = (other.withColumn(name, once).drop("_n"), b) if name == "_a" else (a, other.withColumn(name, once).drop("_n"))
    renamed = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    both = a.join(renamed, condition, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in columns])) if columns else F.array().cast("array<string>")
    change = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.size(changed) > 0, "changed")
    named = both.select(*[F.when(F.col("_a").isNull(), F.col(f"_right_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
                        change.alias("change"), F.when(change == "changed", changed).otherwise(F.array().cast("array<string>")).alias("columns"))
    return named.filter("change IS NOT NULL")
