"""Feature tables: named views, schema mapping, vectors, list descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.rng import with_random
from rankweave.scale import ranked

QUERY, CAND = "query_id", "cand_key"

# Column order of the feature table and of its named views.
COLUMNS = ("prior", "set_similarity", "vector_set_similarity", "centroid_distance", "cosine_shift",
           "n_tokens", "size_ratio", "source_a", "source_b")
ARMS = {
    "baseline": ("prior", "set_similarity", "n_tokens", "size_ratio", "source_a", "source_b"),
    "augmented": COLUMNS,
}
VARIANTS = {
    "prior": ("prior",),
    "structure": ("set_similarity", "n_tokens", "size_ratio"),
    "vectors": ("vector_set_similarity", "centroid_distance", "cosine_shift"),
    "prior_structure": ("prior", "set_similarity", "n_tokens", "size_ratio"),
    "prior_vectors": ("prior", "vector_set_similarity", "centroid_distance", "cosine_shift"),
    "all": ("prior", "set_similarity", "n_tokens", "size_ratio", "vector_set_similarity",
            "centroid_distance", "cosine_shift"),
}
SMALL_NORM = 1e-10


def arm_view(features: DataFrame, arm: str) -> DataFrame:
    """Key columns and the ordered feature columns of one arm."""
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm!r}")
    return features.select(QUERY, CAND, *ARMS[arm])


def variant_view(features: DataFrame, variant: str) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    return features.select(QUERY, CAND, *VARIANTS[variant])


def add_flags(features: DataFrame, a: float, b: float) -> DataFrame:
    """Seven feature columns to nine, with constant source flags."""
    if "source_a" in features.columns:
        raise ValueError("source flags are already there")
    return features.withColumns({"source_a": F.lit(a), "source_b": F.lit(b)})


def drop_flags(features: DataFrame, a: float = 1.0) -> DataFrame:
    """Nine feature columns to seven; a row with another flag is an error."""
    checked = F.when(F.col("source_a") == a, F.col("prior")).otherwise(
        F.raise_error(F.lit("unexpected source flag")).cast("double"))
    return features.withColumn("prior", checked).drop("source_a", "source_b")


def overlapping_strata(rows: DataFrame, leaf: str) -> DataFrame:
    """Repeat each row for every stratum it belongs to: all, 0-4 and its leaf."""
    names = F.when(F.col(leaf) == ">=5", F.array(F.lit("all"), F.col(leaf))).otherwise(
        F.array(F.lit("all"), F.lit("0-4"), F.col(leaf)))
    return rows.withColumn("stratum", F.explode(names))


def rekey_features(lists: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Look features up by key; absent ones are flagged."""
    found = table.select(*keys, *columns, F.lit(True).alias("_found"))
    return lists.join(found, list(keys), "left").withColumn("missing", F.col("_found").isNull()).drop("_found")


def list_array(lists: DataFrame, columns: Sequence[str], by: Sequence[str] = (QUERY,)) -> DataFrame:
    """One row per capped list with its items in rank order (bounded by the cap)."""
    items = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return lists.groupBy(*by).agg(items.alias("items"))


def pair_fold(items: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``value`` over the unordered pairs of a short array."""
    def later(x: Column, i: Column) -> Column:
        rest = F.slice(items, i + 2, F.size(items))
        return F.aggregate(rest, F.lit(0.0), lambda acc, y: acc + value(x, y))

    return F.aggregate(F.transform(items, later), F.lit(0.0), lambda acc, v: acc + v)


def pair_count(items: Column) -> Column:
    size = F.size(items)
    return (size * (size - 1) / 2).cast("long")


def mean_pair_distance(lists: DataFrame, column: str) -> DataFrame:
    """Mean absolute difference over unordered pairs of a capped list, where pairs exist."""
    packed = list_array(lists, [column]).filter(F.size("items") > 1)
    total = pair_fold(F.col("items"), lambda x, y: F.abs(x[column] - y[column]))
    return packed.select(QUERY, pair_count(F.col("items")).alias("n_pairs"),
                         (total / pair_count(F.col("items"))).alias("mean_distance"))


def combine_vectors(owners: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """Vectors of all fragments of an owner; one zero vector when there is none."""
    wanted = owners.select(key, F.explode("fragments").alias("fragment"))
    joined = wanted.join(vectors, "fragment", "left")
    found = joined.filter(F.col("vec").isNotNull()).select(key, "fragment", "pos", "vec", F.lit(True).alias("found"))
    empty = owners.select(key).join(found.select(key), key, "left_anti").select(
        key, F.lit(None).cast("long").alias("fragment"), F.lit(0).alias("pos"),
        F.array_repeat(F.lit(0.0).cast("float"), width).alias("vec"), F.lit(False).alias("found"))
    return found.unionByName(empty)


def shift_from_anchor(rows: DataFrame, keys: Sequence[str], pool: str, anchor: str, columns: dict[str, str]) -> DataFrame:
    """Value minus the anchor pool's value for the same key; null where either is."""
    base = rows.filter(F.col(pool) == anchor).select(*keys, *[F.col(c).alias(f"_{n}") for n, c in columns.items()])
    return rows.filter(F.col(pool) != anchor).join(base, list(keys)).select(
        pool, *keys, *[(F.col(c) - F.col(f"_{n}")).alias(n) for n, c in columns.items()])


def centroids(vectors: DataFrame, owner: str, width: int) -> DataFrame:
    """Mean vector per owner, as one aggregate per dimension: no set is ever collected."""
    sums = [F.avg(F.get("vec", F.lit(i)).cast("double")) for i in range(width)]
    return vectors.groupBy(owner).agg(F.array(*sums).alias("centroid"), F.count(F.lit(1)).alias("n_vectors"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def centroid_features(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distance of two centroids, and the cosine of the left one with their difference.

    The cosine is 0 where a norm is tiny.
    """
    a, b = F.col(left), F.col(right)
    change = F.zip_with(a, b, lambda x, y: x - y)
    out = pairs.withColumn("_d", change)
    size, moved = norm(a), norm(F.col("_d"))
    cosine = F.when((size <= SMALL_NORM) | (moved <= SMALL_NORM), 0.0).otherwise(
        F.try_divide(dot(a, F.col("_d")), size * moved))
    return out.withColumns({"centroid_distance": moved, "cosine_shift": cosine}).drop("_d")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_best(left: pd.Series, right: pd.Series) -> pd.Series:
    """Largest dot product of every left vector within one bounded right block."""
    return pd.Series([
        (np.stack([np.asarray(v, dtype="float64") for v in a])
         @ np.stack([np.asarray(v, dtype="float64") for v in b]).T).max(axis=1)
        for a, b in zip(left, right)])


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length one; a tiny vector becomes zero."""
    size = norm(F.col("vec"))
    scaled = F.transform("vec", lambda x: F.when(F.col("_n") <= SMALL_NORM, 0.0).otherwise(
        F.try_divide(x.cast("double"), F.col("_n"))))
    return vectors.withColumn("_n", size).withColumn("vec", scaled).drop("_n")


def best_matches(pairs: DataFrame, vectors: DataFrame, block: int = 512) -> DataFrame:
    """For each (left, right) pair of owners: best cosine of every left vector in the right set.

    Both sets are packed into blocks of bounded size by position; a block pair is one matrix
    product, and the maximum over right blocks is an ordinary aggregate.  ``vectors`` has
    (owner, pos, vec) with unit vectors and positions from 0.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "vec")))
    blocks = (
        vectors.withColumn("_block", F.floor(F.col("pos") / block))
        .groupBy("owner", "_block").agg(items.alias("_items"))
    )
    vecs = F.transform("_items", lambda x: x["vec"])
    left = blocks.select(F.col("owner").alias("left"), vecs.alias("_l"),
                         F.transform("_items", lambda x: x["pos"]).alias("_pos"))
    right = blocks.select(F.col("owner").alias("right"), vecs.alias("_r"))
    scored = pairs.join(left, "left").join(right, "right").withColumn("_best", _block_best("_l", "_r"))
    flat = scored.select("left", "right", F.explode(F.arrays_zip("_pos", "_best")).alias("z"))
    return flat.groupBy("left", "right", F.col("z._pos").alias("pos")).agg(F.max("z._best").alias("best"))


def set_similarity(pairs: DataFrame, vectors: DataFrame, block: int = 512) -> DataFrame:
    """Symmetric set similarity: mean best cosine in both directions; 0 for an empty set."""
    def one_way(a: str, b: str, name: str) -> DataFrame:
        turned = pairs.select(F.col(a).alias("left"), F.col(b).alias("right"))
        best = best_matches(turned, vectors, block).groupBy("left", "right").agg(F.avg("best").alias(name))
        return best.select(F.col("left").alias(a), F.col("right").alias(b), name)

    forward, backward = one_way("left", "right", "_f"), one_way("right", "left", "_b")
    return (
        pairs.join(forward, ["left", "right"], "left").join(backward, ["left", "right"], "left")
        .select("left", "right", F.coalesce((F.col("_f") + F.col("_b")) / 2, F.lit(0.0)).alias("similarity"))
    )


def permuted_columns(rows: DataFrame, key: str, columns: Sequence[str], by: Sequence[str], seed: int) -> DataFrame:
    """Permute each column independently over the rows of a group (a negative control)."""
    out = ranked(rows, by, [F.col(key)], "_place")
    for offset, column in enumerate(columns):
        drawn = with_random(rows.select(*by, key, column), "_u", seed + offset, key)
        moved = ranked(drawn, by, [F.col("_u"), F.col(key)], "_place").select(*by, "_place", F.col(column).alias("_new"))
        out = out.join(moved, [*by, "_place"]).withColumn(column, F.col("_new")).drop("_new")
    return out.drop("_place")


def encode_tokens(
    distinct: DataFrame, column: str, encode: Callable[[list[str]], list[np.ndarray | None]]
) -> DataFrame:
    """Run a user's batch encoder over distinct tokens: rows (key, pos, vec).

    ``encode`` maps a list of tokens to one matrix per token (None = failed, null vector).
    """
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("vec", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            keys = batch[column].tolist()
            for key, matrix in zip(keys, encode(keys)):
                if matrix is None:
                    rows.append((key, 0, None))
                else:
                    rows += [(key, i, np.asarray(v, dtype="float32").tolist()) for i, v in enumerate(matrix)]
            yield pd.DataFrame(rows, columns=["key", "pos", "vec"])

    return distinct.select(column).distinct().mapInPandas(run, schema)


def assemble(parts: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Fill missing vector features with zero; any other non-finite value is an error."""
    columns = {}
    for name in COLUMNS:
        value = F.col(name).cast("double")
        if name in arrays:
            value = F.coalesce(value, F.lit(0.0))
        bad = value.isNull() | F.isnan(value)
        columns[name] = F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(value)
    return parts.withColumns(columns)
