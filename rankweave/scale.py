"""Ordered computations per group that stay exact when one group is huge.

A plain window sends every row of a group to one task.  The functions here use it
only after checking that no group is too large.  Beyond that, a huge group is cut
into ordered pieces at boundaries taken from its own rows (chosen by hash, hence the
same on every evaluation and after every retry); the pieces are processed apart and
joined by their totals.  What these passes read is written once, so that nothing before it is worked out again for
every pass, and so that Spark knows which of the small tables it can broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.session import materialise

HOT_ROWS_CONF = "spark.rankweave.hotGroupRows"
SMALL_BYTES_CONF = "spark.rankweave.smallInputBytes"
DEFAULT_HOT_ROWS = 1_000_000
DEFAULT_SMALL_BYTES = 16 * 1024 * 1024
# Cut points and piece totals are broadcast up to this many pieces; beyond it they are joined, and AQE
# splits the large side.  A piece has the same size either way.
BROADCAST_PIECES = 4096
_OVERSAMPLE = 8
# Logical nodes whose output can be any number of times their input: no size estimate sees through them.
_FAN_OUT = re.compile(r"\b(Generate|Expand|MapIn\w+|FlatMap\w+|PythonUDTF|ScriptTransform\w*)\b")
# Logical nodes that make working rows out again cost more than reading them from a file.  Turning columns into rows
# (Expand) is not one: the rows it makes are several times what it reads.
_WORK = re.compile(r"\b(Aggregate|Join|Window|Sort|Distinct|Generate|MapIn\w+|FlatMap\w+|\w*Python\w*|ScriptTransform\w*)\b")


def _conf(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``; None where it is not available."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except AttributeError:
        return None


def is_small(df: DataFrame) -> bool:
    """True when the whole input is small enough for any grouping of it.

    Only where Catalyst's estimate bounds the input: a plan that multiplies rows never counts as small.
    """
    size = estimated_bytes(df)
    if size is None or size > _conf(df, SMALL_BYTES_CONF, DEFAULT_SMALL_BYTES):
        return False
    return not _FAN_OUT.search(df._jdf.queryExecution().optimizedPlan().toString())


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls meet nulls; the columns of ``left`` keep their names."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def _few(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` and False, or its rows written once and True, where the input is large and more than a reading of tables.

    The count of its groups and all that comes after then read those rows, instead of each working them out.
    """
    if is_small(df) or not _WORK.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df, False
    return materialise(df), True


def hot_limit(df: DataFrame, keys: Sequence[str], written: bool = False) -> int | None:
    """Row limit above which a group must be cut, or None if no group exceeds it.

    One pruned scan with map-side counting; skipped when the input is small anyway.  Rows that were ``written``
    are always counted: files can be far smaller than their rows.
    """
    limit = _conf(df, HOT_ROWS_CONF, DEFAULT_HOT_ROWS)
    if not written and is_small(df):
        return None
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest")).first()
    return limit if (row["largest"] or 0) > limit else None


def _hot_cuts(df: DataFrame, keys: list[str], order: Column, limit: int) -> tuple[DataFrame, bool]:
    """Ascending cut points per huge group, about one per ``limit`` rows, and whether they are few."""
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit).select(*keys)
    )
    step = max(1, limit // _OVERSAMPLE)
    sample = df.withColumn("_o", order).filter(F.pmod(F.xxhash64("_o", *keys), F.lit(step)) == 0)
    pieces = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).agg(
        F.sum(F.ceil(F.col("_n") / limit)).alias("p")).first()["p"] or 0
    few = pieces <= BROADCAST_PIECES
    return (
        meet(sample, _few(hot, few), keys, "left_semi")
        .groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_s"))
        .select(*keys, F.filter("_s", lambda x, i: i % _OVERSAMPLE == 0).alias("_cuts"))
    ), few


def _piece(cuts: Column, row: Column) -> Column:
    """Number of cuts below ``row`` by binary search; 0 for a group without cuts."""
    def narrow(state, _):
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(cuts, middle) < row
        open_ = state["lo"] < state["hi"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, narrow, lambda s: s["lo"])
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


_FOLD = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
_JOIN = {
    "count": lambda carry, here: F.coalesce(carry, F.lit(0)) + here,
    "sum": lambda carry, here: F.coalesce(carry + here, carry, here),
    "max": lambda carry, here: F.greatest(carry, here),
    "min": lambda carry, here: F.least(carry, here),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    outputs: dict[str, tuple[str, Column]],
    size: str | None = None,
    checked: bool = False,
) -> DataFrame:
    """Running aggregates over rows of a group in ascending ``order``.

    ``outputs`` maps a new column to ``(how, value)`` with how in count/sum/max/min;
    ``count`` of a literal is the row number.  ``size`` names an optional column for the
    group's row count.  ``order`` must be total within a group.  ``checked`` says that the caller knows
    every group to be small.
    """
    keys = list(keys)
    source = df
    if not keys:
        keys, source = ["_all"], df.withColumn("_all", F.lit(0))
    aggregate = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
    source, written = (source, False) if checked else settled(source)
    limit = None if checked else hot_limit(source, keys, written)

    if limit is None:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {
            name: (F.row_number().over(whole.orderBy(*order)).cast("long")
                   if how == "count" else aggregate[how](value).over(upto))
            for name, (how, value) in outputs.items()
        }
        if size:
            columns[size] = F.count(F.lit(1)).over(whole)
        return source.withColumns(columns).drop("_all")

    source = source if written else materialise(source)
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    cuts, few = _hot_cuts(source, keys, row, limit)
    tagged = meet(source.withColumn("_o", row), _few(cuts, few), keys, "left")
    tagged = tagged.withColumn("_piece", _piece(F.col("_cuts"), F.col("_o"))).drop("_cuts")

    totals = (
        meet(source.withColumn("_o", row), _few(cuts, few), keys)
        .withColumn("_piece", _piece(F.col("_cuts"), F.col("_o")))
        .groupBy(*keys, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"),
             *[aggregate[how](value).alias(f"_t_{name}") for name, (how, value) in outputs.items()])
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_piece",
        F.sum("_n").over(group).alias("_size"),
        *[_FOLD[how](f"_t_{name}").over(earlier).alias(f"_c_{name}")
          for name, (how, _) in outputs.items()],
    )
    tagged = meet(tagged, _few(carried, few), [*keys, "_piece"], "left")
    piece = Window.partitionBy(*keys, "_piece")
    inside = piece.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {
        name: _JOIN[how](F.col(f"_c_{name}"), aggregate[how](value).over(inside))
        for name, (how, value) in outputs.items()
    }
    if size:
        columns[size] = F.coalesce(F.col("_size"), F.count(F.lit(1)).over(piece))
    carry = ["_o", "_piece", "_size", "_all"] + [f"_c_{name}" for name in outputs]
    return tagged.withColumns(columns).drop(*carry)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery.

    The value is computed once and used as a constant: no join takes place.  Without a row
    the columns are null.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", packed).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("_row")[c].alias(c) for c in one_row.columns])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    size: str | None = None,
    checked: bool = False,
) -> DataFrame:
    """Exact 1-based row number within each group, and optionally the group size."""
    return running(df, keys, order, {rank: ("count", F.lit(1))}, size, checked)


def midranked(
    df: DataFrame, keys: Sequence[str], value: Column, name: str, size: str | None = None
) -> DataFrame:
    """Ascending average rank of ``value`` within its group (ties share the mean)."""
    keys = list(keys)
    source, written = settled(df.withColumn("_v", value))
    if hot_limit(source.withColumn("_all", F.lit(0)), keys or ["_all"], written) is None:
        whole = Window.partitionBy(*(keys or [F.lit(0)]))
        ties = Window.partitionBy(*(keys or [F.lit(0)]), "_v")
        columns = {name: F.rank().over(whole.orderBy("_v"))
                   + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)}
        if size:
            columns[size] = F.count(F.lit(1)).over(whole)
        return source.withColumns(columns).drop("_v")
    source = source if written else materialise(source)
    counts = materialise(source.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_t")))
    cumulated = running(counts, keys, [F.col("_v")], {"_upto": ("sum", F.col("_t"))})
    ranks = materialise(cumulated.select(
        *keys, "_v", (F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / F.lit(2.0)).alias(name)))
    out = meet(source, ranks, [*keys, "_v"])
    if size:
        sizes = source.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
        out = meet(out, sizes, keys) if keys else with_row(out, sizes)
    return out.drop("_v")


# Ranks that the mergeable sketch of ``quantiles`` may be off by, as one part of so many of the group's rows.
SKETCH_ACCURACY = 10_000


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], name: str, accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as an array column.

    The built-in percentile holds a group's distinct values in one task, so it is used only for groups of checked
    size.  Larger ones take two passes and no sort of all values: a mergeable sketch, whose ranks are off by at most
    n / accuracy, brackets each quantile from below and above; the second pass counts what lies below a bracket and
    ranks only the values inside it.  Beside huge groups there are small ones, in which a bracket is narrower than the
    step to the next value; all values of a group of up to 4 x accuracy rows lie in its brackets.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    present, written = settled(present)
    check = present if keys else present.withColumn("_all", F.lit(0))
    if hot_limit(check, keys or ["_all"], written) is None:
        points = F.array(*[F.lit(float(p)) for p in probabilities])
        return present.groupBy(*keys).agg(F.percentile("_v", points).alias(name))
    # What is not written here only reads tables, which each pass does again.
    margin = 4.0 / accuracy
    ends = [e for p in probabilities for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = present.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_q"),
        F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count(F.lit(1)).alias("_n"))
    brackets = []
    for i, p in enumerate(probabilities):
        few = F.col("_n") <= 4 * accuracy
        low = F.col("_least") if p - margin <= margin else F.when(few, F.col("_least")).otherwise(F.col("_q")[2 * i])
        high = F.col("_most") if p + margin >= 1 - margin else F.when(few, F.col("_most")).otherwise(F.col("_q")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")))
    framed = materialise(sketch.select(*keys, "_n", F.array(*brackets).alias("_b")))
    rows = meet(present, framed, keys) if keys else with_row(present, framed)
    # One row per bracket; a value below it is only counted, one above it is nothing.
    placed = rows.select(*keys, "_n", "_v", F.explode("_b").alias("_b")).filter(F.col("_v") <= F.col("_b.high")).select(
        *keys, "_n", F.col("_b.i").alias("_i"), F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v"))
    counts = materialise(placed.groupBy(*keys, "_n", "_i", "_v").agg(F.count(F.lit(1)).alias("_t")))
    # Nulls stand for all that is below, and sort first.
    upto = running(counts, [*keys, "_i"], [F.col("_v").isNotNull(), F.col("_v")], {"_upto": ("sum", F.col("_t"))})
    chance = F.array(*[F.lit(float(p)) for p in probabilities])[F.col("_i")]
    spot = upto.withColumn("_spot", chance * (F.col("_n") - 1))

    def at(position: Column) -> Column:
        covers = (F.col("_upto") - F.col("_t") < position) & (position <= F.col("_upto")) & F.col("_v").isNotNull()
        return F.max(F.when(covers, F.col("_v")))

    low, high = at(F.floor("_spot") + 1), at(F.ceil("_spot") + 1)
    picked = spot.groupBy(*keys, "_i").agg((low + (high - low) * F.max(F.col("_spot") - F.floor("_spot"))).alias("_x"))
    checked = F.when(F.col("_x").isNotNull(), F.col("_x")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    return picked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", checked.alias("x")))), lambda s: s["x"]).alias(name))


def following(
    df: DataFrame, keys: Sequence[str], rank: str, outputs: dict[str, str], block: int = 100_000
) -> DataFrame:
    """Values of the next row of a group, given contiguous 1-based ranks.

    A group is split into rank blocks; the first row of a block is repeated as the last
    neighbour of the block before, so no task sees more than one block.
    """
    number = F.floor((F.col(rank) - 1) / block)
    first = (F.col(rank) > 1) & ((F.col(rank) - 1) % block == 0)
    copies = F.when(first, F.array(number, number - 1)).otherwise(F.array(number))
    spread = df.withColumn("_own", number).withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*keys, "_block").orderBy(rank)
    columns = {name: F.lead(column).over(window) for name, column in outputs.items()}
    return spread.withColumns(columns).filter(F.col("_own") == F.col("_block")).drop("_own", "_block")
