"""Paired resampling inference on cluster totals.

Everything starts from one row per cluster (sums of effects and a count), so the work is
draws times clusters, whatever the number of rows behind them.  Randomness is a pure
function of seed and counters (see ``rng``).

Bootstrap picks of a draw are uniform over clusters with replacement.  Clusters lie in blocks of
``BLOCK``; each draw first counts how many of its picks fall into each block, and every block then
makes its own picks.  Signs and permuted places come from the same kernels: one task holds a block of
rows and a chunk of draws, works in numpy, and emits one row per draw.  No table of draws by rows is
ever made, and one random stream serves every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankweave.rng import absorb_array, mix, with_random
from rankweave.scale import ranked, running, with_row
from rankweave.session import materialise

BLOCK = 65_536
_CHUNK = 1_000
# Rows of a task, and bits of the most buckets, of a permutation.  A draw has as many rows of bucket counts as rows in the
# buckets that a boundary cuts; both are about n / 256, however many rows there are.
PERMUTED_BLOCK = 262_144
_BUCKET_BITS = 10
LOW, HIGH = 0.025, 0.975
FLIP_TOLERANCE = 1e-15


def key_number(column: Column | str, kind: str) -> Column:
    """An integer counter for a cluster key: itself, or 60 bits of a hash of other types."""
    value = F.col(column) if isinstance(column, str) else column
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("long")
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def effect_totals(
    effects: DataFrame, values: Sequence[str], seeds: Sequence[int],
    cluster: str = "cluster_key", by: Sequence[str] = (), per_seed: bool = False,
) -> DataFrame:
    """Cluster totals of per-(query, seed) effects, written once for the draws to use.

    ``s_<value>`` is the sum over queries of the seed mean and ``n`` the number of queries;
    with ``per_seed`` there is also one column per value and seed.
    """
    count = len(seeds)
    columns = [(F.sum(v) / count).alias(f"s_{v}") for v in values]
    if per_seed:
        columns += [F.sum(F.when(F.col("seed") == s, F.col(v))).alias(f"s_{v}_{s}")
                    for v in values for s in seeds]
    totals = effects.groupBy(*by, F.col(cluster).alias("cluster")).agg(
        (F.count(F.lit(1)) / count).alias("n"), *columns)
    return materialise(totals)


def indexed(clusters: DataFrame, key: str, strata: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based index of each cluster within its stratum, and the stratum's size."""
    placed = ranked(clusters, list(strata), [F.col(key)], "idx", "size")
    return placed.withColumn("idx", F.col("idx") - 1)


def picks(clusters: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, idx, size): the cluster index chosen by every slot of every draw, as a table to be joined."""
    placed = indexed(clusters, key).select(F.col("idx").alias("_slot"), "size")
    slots = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = with_random(slots, "_r", seed, F.lit(0), F.col("draw"), F.col("_slot"))
    return drawn.select("draw", F.coalesce(F.col("_r") % F.col("size"), F.lit(0)).alias("idx"), "size")  # not null, as in ``rng``


def pick_counts(clusters: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, slots, distinct_clusters) of ``picks``, without a row per slot and draw.

    A task marks the picks of its slots as bits, for every draw; marks meet by draw and 32,768 clusters.
    """
    spark, size = clusters.sparkSession, clusters.count()
    start, bits = mix(seed), 32_768

    def mark(batches):
        here = [b.column(0).to_numpy() for b in batches]
        slots = np.concatenate(here) if here else np.empty(0, np.int64)
        for draw in range(draws) if len(slots) else ():
            picked = absorb_array(absorb_array(absorb_array(np.int64(start), 0), draw), slots) % size
            own = np.unique(picked)
            bucket = own // bits
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            marks = []
            for part in np.split(own % bits, cuts[1:]):
                flags = np.zeros(bits, np.uint8)
                flags[part] = 1
                marks.append(np.packbits(flags).tobytes())
            slots_of = np.r_[len(slots), np.zeros(len(cuts) - 1, int)]
            yield pa.RecordBatch.from_pydict({
                "draw": pa.array(np.full(len(cuts), draw, np.int32)), "bucket": pa.array(bucket[cuts]),
                "slots": pa.array(slots_of, pa.int64()), "marks": pa.array(marks, pa.binary())})

    marked = spark.range(0, size, 1, max(1, -(-size // PERMUTED_BLOCK))).mapInArrow(mark, "draw int, bucket long, slots long, marks binary")
    merged = marked.groupBy("draw", "bucket").agg(F.sum("slots").alias("slots"), F.bitmap_or_agg("marks").alias("marks"))
    return merged.groupBy("draw").agg(F.sum("slots").alias("slots"), F.sum(F.bitmap_count("marks")).alias("distinct_clusters"))


def _chunked(placed: DataFrame, draws: int) -> DataFrame:
    """A copy of each row per chunk of draws."""
    return placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((draws - 1) // _CHUNK).cast("long"))))


def _chunk(chunk: int, draws: int) -> np.ndarray:
    return np.arange(chunk * _CHUNK, min(draws, (chunk + 1) * _CHUNK), dtype=np.int64)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name in names]


def _keyed(rows: pd.DataFrame, keys: Sequence[str], columns: dict) -> pd.DataFrame:
    """A result of one group with the group's keys in front."""
    return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(next(iter(columns.values()))) for k in keys}, **columns})


def resampled_sums(
    totals: DataFrame, values: Sequence[str], draws: int, seed: int,
    strata: Sequence[str] = (), key: str = "cluster", block: int = BLOCK,
) -> DataFrame:
    """Per draw (and stratum): sums of ``values`` over clusters drawn with replacement.

    ``totals`` should be stored already (see ``effect_totals``).  The result has one row per
    draw and is written too, because several summaries read it.  ``block`` is part of the random
    stream, like the seed; the size of the data is not.
    """
    strata, values = list(strata), list(values)
    placed = indexed(totals.select(*strata, key, *values), key, strata)
    placed = materialise(placed.withColumn("block", F.floor(F.col("idx") / block)))
    group, start = [*strata, "block", "chunk"], mix(seed)
    own = [*_fields(totals, strata)]
    counted = T.StructType([*own, *[T.StructField(c, T.LongType()) for c in ("to", "chunk", "draw", "k")]])

    def count_picks(rows: pd.DataFrame) -> pd.DataFrame:
        """How many picks of this block's slots fall into each block."""
        size, chunk = int(rows["size"].iloc[0]), int(rows["chunk"].iloc[0])
        here, blocks = _chunk(chunk, draws), -(-size // block)
        if blocks == 1:
            return _keyed(rows, strata, {"to": np.zeros(len(here), int), "chunk": chunk, "draw": here, "k": size})
        slots, found = rows["idx"].to_numpy("int64"), []
        for draw in here:
            picked = absorb_array(absorb_array(absorb_array(np.int64(start), 0), draw), slots) % size
            to, k = np.unique(picked // block, return_counts=True)
            found.append(pd.DataFrame({"to": to, "draw": draw, "k": k}))
        found = pd.concat(found, ignore_index=True)
        return _keyed(rows, strata, {"to": found["to"], "chunk": chunk, "draw": found["draw"], "k": found["k"]})

    slots = _chunked(placed.select(*strata, "idx", "size", "block"), draws)
    wanted = slots.groupBy(*group).applyInPandas(count_picks, counted).groupBy(
        *strata, F.col("to").alias("block"), "chunk", "draw").agg(F.sum("k").alias("k"))
    summed = T.StructType([*own, T.StructField("draw", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in values]])

    def one_block(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame(columns=[f.name for f in summed.fields])
        rows = rows.sort_values("idx")
        matrix, size = rows[values].to_numpy("float64"), len(rows)
        state = absorb_array(np.int64(start), int(rows["block"].iloc[0]) + 1)
        out = np.empty((len(wanted), len(values)))
        for i, (draw, count) in enumerate(zip(wanted["draw"], wanted["k"])):
            local = absorb_array(absorb_array(state, int(draw)), np.arange(count)) % size
            out[i] = np.bincount(local, minlength=size) @ matrix
        return _keyed(rows, strata, {"draw": wanted["draw"].to_numpy("int32"), **dict(zip(values, out.T))})

    parts = _chunked(placed, draws).groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(one_block, summed)
    return materialise(parts.groupBy(*strata, "draw").agg(*[F.sum(v).alias(v) for v in values]))


def seed_weights(draws: DataFrame, name: str, seeds: Sequence[int], seed: int) -> DataFrame:
    """Add ``<name>_<seed>``: how often each seed is drawn, len(seeds) picks per draw."""
    chosen = []
    for slot in range(len(seeds)):
        column = f"_{name}_{slot}"
        draws = with_random(draws, column, seed, F.lit(slot), F.col("draw"))
        chosen.append(F.col(column) % len(seeds))
    counts = {}
    for place, label in enumerate(seeds):
        total = F.lit(0)
        for pick in chosen:
            total = total + (pick == place).cast("int")
        counts[f"{name}_{label}"] = total
    return draws.withColumns(counts).drop(*[f"_{name}_{slot}" for slot in range(len(seeds))])


def weighted_mean(value: str, weights: str, seeds: Sequence[int], count: str = "n") -> Column:
    """Mean over drawn clusters and drawn seeds, from per-seed sums of one draw."""
    total: Column = F.lit(0.0)
    for s in seeds:
        total = total + F.col(f"{value}_{s}") * F.col(f"{weights}_{s}")
    return total / (F.col(count) * len(seeds))


def interval(draws: DataFrame, estimate: str, by: Sequence[str] = (), levels: Sequence[float] = (LOW, HIGH)) -> DataFrame:
    """Percentile interval of an estimate over its draws (a fixed, chosen number of rows)."""
    points = F.percentile(estimate, F.array(*[F.lit(float(p)) for p in levels]))
    return draws.groupBy(*by).agg(points.alias("_p")).select(
        *by, F.col("_p")[0].alias("low"), F.col("_p")[len(levels) - 1].alias("high"),
        *([F.col("_p")[1].alias("low90"), F.col("_p")[2].alias("high90")] if len(levels) == 4 else []))


def cluster_bootstrap(
    totals: DataFrame, values: Sequence[str], draws: int, seed: int,
    levels: Sequence[float] = (LOW, HIGH), block: int = BLOCK,
) -> DataFrame:
    """Cluster bootstrap: one row per value with its effect and percentile interval."""
    sums = resampled_sums(totals, [*[f"s_{v}" for v in values], "n"], draws, seed, block=block)
    long = sums.select("draw", *[(F.col(f"s_{v}") / F.col("n")).alias(v) for v in values]).unpivot(
        ["draw"], list(values), "metric", "estimate")
    effect = totals.agg(*[(F.sum(f"s_{v}") / F.sum("n")).alias(v) for v in values]).unpivot(
        [], list(values), "metric", "effect")
    return effect.join(interval(long, "estimate", ["metric"], levels), "metric")


def crossed_bootstrap(totals: DataFrame, values: Sequence[str], seeds: Sequence[int], draws: int, seed: int) -> DataFrame:
    """Clusters and seeds resampled independently in every draw."""
    columns = [f"s_{v}_{s}" for v in values for s in seeds]
    sums = resampled_sums(totals, [*columns, "n"], draws, seed)
    sums = seed_weights(sums, "w", seeds, seed + 1)
    long = sums.select("draw", *[weighted_mean(f"s_{v}", "w", seeds).alias(v) for v in values]).unpivot(
        ["draw"], list(values), "metric", "estimate")
    effect = totals.agg(*[(F.sum(f"s_{v}") / F.sum("n")).alias(v) for v in values]).unpivot(
        [], list(values), "metric", "effect")
    return effect.join(interval(long, "estimate", ["metric"]), "metric")


def sign_flip(totals: DataFrame, values: Sequence[str], draws: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided sign-flip p-value per value: random signs of non-zero cluster totals."""
    by = list(by)
    kinds = dict(totals.dtypes)
    long = totals.unpivot([*by, "cluster", "n"], [f"s_{v}" for v in values], "metric", "total").withColumn(
        "metric", F.substring("metric", 3, 1000))
    group = [*by, "metric"]
    observed = long.groupBy(*group).agg(
        F.sum("n").alias("_n"), F.abs(F.sum("total") / F.sum("n")).alias("_observed"),
        F.count_if(F.col("total") != 0).alias("_nonzero"))
    blocks = F.pmod(F.xxhash64("_key"), F.lit(max(1, -(-totals.count() // BLOCK))))
    moving = long.filter(F.col("total") != 0).select(*group, key_number("cluster", kinds["cluster"]).alias("_key"), "total")
    start = mix(seed)
    kind = T.StructType([*_fields(moving, group), T.StructField("draw", T.LongType()), T.StructField("_sum", T.DoubleType())])

    def flip(rows: pd.DataFrame) -> pd.DataFrame:
        keys, values = rows["_key"].to_numpy("int64"), rows["total"].to_numpy("float64")
        here = _chunk(int(rows["chunk"].iloc[0]), draws)
        made = [float(np.where(absorb_array(absorb_array(np.int64(start), d), keys) % 2 == 0, -values, values).sum()) for d in here]
        return _keyed(rows, group, {"draw": here, "_sum": made})

    parts = _chunked(moving.withColumn("block", blocks), draws).groupBy(*group, "block", "chunk").applyInPandas(flip, kind)
    sums = parts.groupBy(*group, "draw").agg(F.sum("_sum").alias("_sum"))
    # At most (tests x draws) rows meet one row per test here.
    extreme = sums.join(observed, group).groupBy(*group).agg(F.count_if(
        F.abs(F.col("_sum") / F.col("_n")) >= F.col("_observed") - FLIP_TOLERANCE).alias("_extreme"))
    return observed.join(extreme, group, "left").select(*group, F.when(
        F.col("_nonzero") == 0, 1.0).otherwise((F.col("_extreme") + 1) / F.lit(draws + 1)).alias("p_value"))


def permuted_sums(
    rows: DataFrame, key: str, value: str, sizes: Sequence[tuple[str, int]], draws: int, seed: int,
    block: int = PERMUTED_BLOCK,
) -> DataFrame:
    """Per draw and label: sum of values when labels are dealt out in random order.

    ``sizes`` lists labels with their counts.  Each draw orders rows by a random number; the
    first block of places gets the first label, and so on.  A first pass counts and sums rows per
    draw and bucket of random numbers; only rows of the few buckets that a label boundary cuts are
    looked at again and sorted.
    """
    total, ends, upto = sum(n for _, n in sizes), [], 0
    for label, n in sizes:
        upto += n
        ends.append((label, upto))
    # About 256 rows a bucket, until there are as many buckets as a task should count per draw.
    bits, start = min(_BUCKET_BITS, max(1, math.ceil(math.log2(max(2, total) / 256)))), mix(seed)
    dealt = rows.select(F.col(key).cast("long").alias("_id"), F.col(value).cast("double").alias("_value")).withColumn(
        "block", F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-total // block)))))
    group = ["block", "chunk"]

    def label_of(place: Column) -> Column:
        out = None
        for label, end in ends:
            out = F.when(place <= end, label) if out is None else out.when(place <= end, label)
        return out

    def drawn(draw, ids):
        return absorb_array(absorb_array(np.int64(start), draw), ids)

    def count_buckets(part: pd.DataFrame) -> pd.DataFrame:
        ids, values, found = part["_id"].to_numpy("int64"), part["_value"].to_numpy("float64"), []
        for draw in _chunk(int(part["chunk"].iloc[0]), draws):
            bucket = drawn(draw, ids) >> (32 - bits)
            count, summed = np.bincount(bucket), np.bincount(bucket, weights=values)
            own = np.flatnonzero(count)
            found.append(pd.DataFrame({"draw": draw, "_bucket": own, "_c": count[own], "_s": summed[own]}))
        return pd.concat(found, ignore_index=True)

    chunked = _chunked(dealt, draws)
    buckets = chunked.groupBy(*group).applyInPandas(count_buckets, "draw long, _bucket long, _c long, _s double").groupBy(
        "draw", "_bucket").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
    window = Window.partitionBy("draw").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialise(buckets.withColumn("_end", F.sum("_c").over(window)).withColumn("_start", F.col("_end") - F.col("_c")))
    cut = F.lit(False)
    for _, end in ends[:-1]:
        cut = cut | ((F.col("_start") < end) & (F.lit(end) < F.col("_end")))
    whole = placed.filter(~cut).select("draw", label_of(F.col("_end")).alias("label"), F.col("_s").alias("_v"), F.col("_c").alias("_k"))
    # One bucket per draw and inner boundary at most.
    edges = placed.filter(cut).select("draw", "_bucket", "_start").withColumn("chunk", F.floor(F.col("draw") / _CHUNK))

    def rows_of_cuts(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"draw": pd.Series(dtype="int64"), "_bucket": pd.Series(dtype="int64"), "_start": pd.Series(dtype="int64"),
                               "_u": pd.Series(dtype="int64"), "_id": pd.Series(dtype="int64"), "_value": pd.Series(dtype="float64")})]
        ids, values = part["_id"].to_numpy("int64"), part["_value"].to_numpy("float64")
        for draw, own in wanted.groupby("draw"):
            u = drawn(int(draw), ids)
            for bucket, begin in zip(own["_bucket"], own["_start"]):
                here = (u >> (32 - bits)) == bucket
                found.append(pd.DataFrame({"draw": draw, "_bucket": bucket, "_start": begin, "_u": u[here], "_id": ids[here], "_value": values[here]}))
        return pd.concat(found, ignore_index=True)

    spread = edges.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-total // block)) - 1).cast("long"))))
    inside = chunked.groupBy(*group).cogroup(spread.groupBy(*group)).applyInPandas(
        rows_of_cuts, "draw long, _bucket long, _start long, _u long, _id long, _value double")
    spot = F.col("_start") + F.row_number().over(Window.partitionBy("draw", "_bucket").orderBy("_u", "_id"))
    split = inside.select("draw", label_of(spot).alias("label"), F.col("_value").alias("_v"), F.lit(1).cast("long").alias("_k"))
    return whole.unionByName(split).groupBy("draw", "label").agg(F.sum("_v").alias("total"), F.sum("_k").alias("n"))


def between_group(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over labels of n (mean - grand mean)^2 from label sums (total, n)."""
    # sum n_g m_g^2 - N m^2, with few labels per group.
    grand = F.sum("total") * F.sum("total") / F.sum("n")
    return sums.groupBy(*by).agg((F.sum(F.col("total") * F.col("total") / F.col("n")) - grand).alias("statistic"))


def upper_tail(draws: DataFrame, observed: float, count: int, two_sided: bool = False) -> DataFrame:
    """(extreme + 1) / (draws + 1) against an observed statistic."""
    value, limit = F.col("statistic"), observed
    if two_sided:
        value, limit = F.abs(value), abs(observed)
    slack = FLIP_TOLERANCE + 1e-12 * abs(observed)
    return draws.agg(((F.count_if(value >= limit - slack) + 1) / F.lit(count + 1)).alias("p_value"))


def label_sizes(rows: DataFrame, label: str) -> list[tuple[str, int]]:
    """Counts of all labels, in label order: the test statistic itself needs them all at once."""
    found = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()
    return [(r[0], r["n"]) for r in found]


def omnibus_permutation(rows: DataFrame, key: str, value: str, label: str, draws: int, seed: int, block: int = PERMUTED_BLOCK) -> DataFrame:
    """Permutation test of equal label means, upper tail of the between-group statistic."""
    rows = materialise(rows.select(key, value, label))
    sums = rows.groupBy(label).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    observed = between_group(sums).first()["statistic"]
    shuffled = permuted_sums(rows, key, value, label_sizes(rows, label), draws, seed, block)
    return upper_tail(between_group(shuffled, ["draw"]), observed, draws).select(
        F.lit(observed).alias("statistic"), "p_value")


def mean_contrast(rows: DataFrame, value: str, label: str, left: Sequence, right: Sequence) -> DataFrame:
    """Mean of the left labels minus the pooled mean of the right ones; empty is an error."""
    is_left, is_right = F.col(label).isin(*left), F.col(label).isin(*right)
    out = rows.agg(F.avg(F.when(is_left, F.col(value))).alias("l"), F.avg(F.when(is_right, F.col(value))).alias("r"))
    difference = F.col("l") - F.col("r")
    return out.select(F.when(difference.isNotNull(), difference).otherwise(
        F.raise_error(F.lit("empty contrast group")).cast("double")).alias("contrast"))


def contrast_permutation(rows: DataFrame, key: str, value: str, label: str, left, right, draws: int, seed: int, block: int = PERMUTED_BLOCK) -> DataFrame:
    """Two-sided permutation test of a mean contrast."""
    kept = materialise(rows.filter(F.col(label).isin(*left, *right)).select(key, value, label))
    observed = mean_contrast(kept, value, label, left, right).first()["contrast"]
    n_left = kept.filter(F.col(label).isin(*left)).count()
    sizes = [("left", n_left), ("right", kept.count() - n_left)]
    shuffled = permuted_sums(kept, key, value, sizes, draws, seed, block)
    mean = F.col("total") / F.col("n")
    statistic = shuffled.groupBy("draw").agg(
        (F.max(F.when(F.col("label") == "left", mean)) - F.max(F.when(F.col("label") == "right", mean))).alias("statistic"))
    return upper_tail(statistic, observed, draws, True).select(F.lit(observed).alias("contrast"), "p_value")


def three_way_bootstrap(
    rows: DataFrame, value: str, seeds: Sequence[int], replicates: Sequence[int], draws: int, seed: int,
) -> DataFrame:
    """Clusters, seeds and replicates resampled independently in every draw.

    ``rows`` has (cluster_key, seed, replicate, value); seeds and replicates are few.
    """
    cells = [(s, r) for s in seeds for r in replicates]
    totals = materialise(rows.groupBy(F.col("cluster_key").alias("cluster")).agg(
        (F.count(F.lit(1)) / len(cells)).alias("n"),
        *[F.sum(F.when((F.col("seed") == s) & (F.col("replicate") == r), F.col(value))).alias(f"v_{s}_{r}") for s, r in cells]))
    columns = [f"v_{s}_{r}" for s, r in cells]
    sums = resampled_sums(totals, [*columns, "n"], draws, seed)
    sums = seed_weights(seed_weights(sums, "w", seeds, seed + 1), "u", replicates, seed + 2)
    total: Column = F.lit(0.0)
    effect: Column = F.lit(0.0)
    for s, r in cells:
        total = total + F.col(f"v_{s}_{r}") * F.col(f"w_{s}") * F.col(f"u_{r}")
        effect = effect + F.sum(f"v_{s}_{r}")
    estimates = sums.withColumn("estimate", total / (F.col("n") * len(cells)))
    point = totals.agg((effect / (F.sum("n") * len(cells))).alias("effect"))
    return with_row(point, interval(estimates, "estimate"))


def _paired_draws(joint: DataFrame, metrics: Sequence[str], seeds: Sequence[int], draws: int, seed: int,
                  weight_seeds: tuple[int, int], by: Sequence[str] = ()):
    """Totals and per-draw sums of old and new effects with separate seed weights.

    Groups with the same clusters get the same cluster draws.
    """
    values = [f"{side}_{m}" for side in ("new", "old", "loss") for m in metrics]
    totals = effect_totals(joint, values, seeds, by=by, per_seed=True)
    columns = [f"s_{side}_{m}_{s}" for side in ("new", "old") for m in metrics for s in seeds]
    sums = resampled_sums(totals, ["n", *[f"s_loss_{m}" for m in metrics], *columns], draws, seed, by)
    sums = seed_weights(seed_weights(sums, "a", seeds, weight_seeds[0]), "b", seeds, weight_seeds[1])
    return totals, sums


def transfer_summary(
    joint: DataFrame, metrics: Sequence[str], seeds: Sequence[int], draws: int, seed: int,
    weight_seeds: tuple[int, int], by: Sequence[str] = ("pool",),
) -> DataFrame:
    """Old and new effect, their difference, and its cluster and crossed intervals, per group and metric.

    Both pools share the cluster draw; each has its own seed draw.
    """
    totals, sums = _paired_draws(joint, metrics, seeds, draws, seed, weight_seeds, by)
    keys = [*by, "metric"]

    def estimates(m: str) -> Column:
        new, old = weighted_mean(f"s_new_{m}", "b", seeds), weighted_mean(f"s_old_{m}", "a", seeds)
        return F.struct(F.lit(m).alias("metric"), (F.col(f"s_loss_{m}") / F.col("n")).alias("plain"), (new - old).alias("crossed"))

    drawn = sums.select(*by, F.explode(F.array(*[estimates(m) for m in metrics])).alias("e")).select(*by, "e.*")
    ends = F.array(F.lit(LOW), F.lit(HIGH))
    intervals = drawn.groupBy(*keys).agg(F.percentile("plain", ends).alias("p"), F.percentile("crossed", ends).alias("c")).select(
        *keys, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), F.col("c")[0].alias("crossed_low"), F.col("c")[1].alias("crossed_high"))
    sides = (("old", "old_effect"), ("new", "new_effect"), ("loss", "loss"))
    point = totals.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[F.struct(
        F.lit(m).alias("metric"), *[(F.sum(f"s_{side}_{m}") / F.sum("n")).alias(name) for side, name in sides]) for m in metrics]).alias("e"))
    point = point.select(*by, "n", F.explode("e").alias("e")).select(*by, "n", "e.*")
    return point.join(intervals, keys)


def pool_difference(joint: DataFrame, metric: str, seeds: Sequence[int], draws: int, seed: int, weight_seeds: tuple[int, int]) -> DataFrame:
    """Intervals of two pools and of their difference from shared cluster draws."""
    _, sums = _paired_draws(joint, [metric], seeds, draws, seed, weight_seeds)
    new, old = weighted_mean(f"s_new_{metric}", "b", seeds), weighted_mean(f"s_old_{metric}", "a", seeds)
    terms = sums.select("draw", old.alias("old"), new.alias("new"), (new - old).alias("difference"))
    return interval(terms.unpivot(["draw"], ["old", "new", "difference"], "term", "estimate"), "estimate", ["term"])


def stratified_bootstrap(
    effects: DataFrame, value: str, stratum: str, seeds: Sequence[int], draws: int, seed: int, contrast: tuple[int, int],
) -> DataFrame:
    """Effect interval per stratum and of one contrast; strata share the seed draw.

    An empty stratum has no row, so its contrast is null.
    """
    totals = effect_totals(effects, [value], seeds, by=[stratum], per_seed=True)
    sums = resampled_sums(totals, ["n", *[f"s_{value}_{s}" for s in seeds]], draws, seed, [stratum])
    sums = seed_weights(sums, "w", seeds, seed + 1)
    each = sums.select("draw", stratum, weighted_mean(f"s_{value}", "w", seeds).alias("estimate"))
    high, low = contrast
    both = each.groupBy("draw").agg(
        (F.max(F.when(F.col(stratum) == high, F.col("estimate"))) - F.max(F.when(F.col(stratum) == low, F.col("estimate")))).alias("estimate"))
    strata = interval(each, "estimate", [stratum]).withColumn("term", F.col(stratum).cast("string")).drop(stratum)
    return strata.unionByName(interval(both, "estimate").withColumn("term", F.lit("contrast")))


def contrast_bootstrap(rows: DataFrame, value: str, label: str, left: Sequence, right: Sequence, draws: int, seed: int) -> DataFrame:
    """Interval of a difference of means, both sides resampled by cluster independently."""
    side = F.when(F.col(label).isin(*left), "left").when(F.col(label).isin(*right), "right")
    totals = materialise(rows.withColumn("side", side).filter(F.col("side").isNotNull()).groupBy(
        "side", F.col("cluster_key").alias("cluster")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s_value")))
    sums = resampled_sums(totals, ["n", "s_value"], draws, seed, ["side"])
    mean = F.col("s_value") / F.col("n")
    both = sums.groupBy("draw").agg((F.max(F.when(F.col("side") == "left", mean)) - F.max(F.when(F.col("side") == "right", mean))).alias("e"))
    return interval(both, "e")


def significance(totals: DataFrame, values: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Effect, cluster interval and sign-flip p-value per value."""
    return cluster_bootstrap(totals, values, draws, seed).join(sign_flip(totals, values, draws, seed + 1), "metric")


@F.pandas_udf(T.DoubleType())
def exact_mcnemar(promoted: pd.Series, lost: pd.Series) -> pd.Series:
    """Two-sided exact binomial p-value of discordant counts at one half; 1 when none."""
    return pd.Series([min(1.0, 2.0 * binomial_half_tail(int(b + c), int(min(b, c)))) if b + c else 1.0
                      for b, c in zip(promoted, lost)])


def binomial_half_tail(n: int, k: int) -> float:
    """P(X <= k) for X ~ Binomial(n, 1/2), k <= n/2, by a continued fraction.

    Its cost does not grow with n, unlike a sum of terms.
    """
    a, b, x = float(n - k), float(k + 1), 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log(1.0 - x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        value = d
        for m in range(1, 100_000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + step * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + step / c
                c = c if abs(c) > tiny else tiny
                value *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return value

    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of a z score; null stays null."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v and v is not None else None)


EXACT_SIGNED_RANK = 50


@lru_cache(maxsize=EXACT_SIGNED_RANK + 1)
def signed_rank_tails(n: int) -> np.ndarray:
    """Probability that the ranks 1 to n with random signs have a positive sum of at most 0, 1, 2, ...

    Counts of rank subsets by their sum, one rank after the other; they are whole numbers below 2**53.
    """
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:len(ways) - rank]
    return np.cumsum(ways) / 2.0 ** n


@F.pandas_udf(T.DoubleType())
def exact_signed_rank(n: pd.Series, statistic: pd.Series) -> pd.Series:
    """Two-sided exact p-value of the smaller rank sum of up to 50 differences without zeros and ties."""
    return pd.Series([min(1.0, 2.0 * float(signed_rank_tails(int(k))[int(w)])) for k, w in zip(n, statistic)])


def wilcoxon_pratt(rows: DataFrame, value: str, by: Sequence[str] = (), exact_up_to: int = EXACT_SIGNED_RANK) -> DataFrame:
    """Signed-rank test with zeros kept in the ranking: n, statistic, z, exact and p_value per group.

    Groups of at most ``exact_up_to`` differences (50 is the most) without a zero and without ties have the exact
    null distribution; all others the normal approximation with tie correction.  Null differences are left out.
    """
    if exact_up_to > EXACT_SIGNED_RANK:
        raise ValueError(f"the exact distribution goes up to {EXACT_SIGNED_RANK} differences")
    by = list(by)
    d, t = F.col("_d"), F.col("_t").cast("double")
    # Differences of one size share a rank, so rows are counted by size before any is ordered.
    counts = rows.select(*by, F.col(value).alias("_d")).filter("_d IS NOT NULL").groupBy(*by, F.abs("_d").alias("_size")).agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(d > 0).alias("_plus"), F.count_if(d < 0).alias("_minus"), F.count_if(d == 0).alias("_zero"))
    placed = running(counts, by, [F.col("_size")], {"_upto": ("sum", F.col("_t"))})
    rank = F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / F.lit(2.0)
    joined = placed.groupBy(*by).agg(
        F.sum("_t").alias("n"), F.sum("_zero").cast("double").alias("zeros"),
        F.coalesce(F.sum(F.when(F.col("_plus") > 0, rank * F.col("_plus"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("_minus") > 0, rank * F.col("_minus"))), F.lit(0.0)).alias("w_minus"),
        F.sum(F.when(F.col("_zero") == 0, t * (t * t - 1))).alias("_ties"))
    if not by:
        joined = joined.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("zeros", F.coalesce("zeros", F.lit(0.0)))
    n, z, tied = F.col("n").cast("double"), F.col("zeros"), F.coalesce("_ties", F.lit(0.0))
    mean = (n * (n + 1) - z * (z + 1)) / 4
    variance = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - 0.5 * tied) / 24
    exact = (F.col("n") <= exact_up_to) & (z == 0) & (tied == 0)
    tested = joined.select(*by, "n", F.least("w_plus", "w_minus").alias("statistic"), mean.alias("_mean"), variance.alias("_variance"), exact.alias("exact"))
    tested = tested.withColumn("z", F.try_divide(F.col("statistic") - F.col("_mean"), F.sqrt("_variance")))
    # A row without an exact test asks for the distribution of no differences, which costs nothing.
    p_exact = exact_signed_rank(F.when(F.col("exact"), F.col("n")).otherwise(0), F.when(F.col("exact"), F.col("statistic")).otherwise(0.0))
    return tested.select(*by, "n", "statistic", "z", "exact", F.when(F.col("exact"), p_exact).otherwise(
        F.coalesce(two_sided_normal("z"), F.lit(1.0))).alias("p_value"))
