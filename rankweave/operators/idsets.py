"""Sets of whole-number ids as bucketed bitmaps.

A set is a table (bucket, bits): one bitmap of 32,768 places per bucket that has any id.  Sets are built once, with
map-side aggregation; union, intersection and difference then work bucket by bucket on bitmaps, so what is shuffled
is a bit per place and not a row per id.  Ids that lie far apart make one bitmap each: number them densely first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 32_768


def bitmaps(ids: DataFrame, column: str) -> DataFrame:
    """The set of a column's ids; nulls and repeats do not count."""
    value = F.col(column).cast("long")
    return ids.filter(value.isNotNull()).groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))


def tagged_bitmaps(sets: dict[str, DataFrame], column: str) -> DataFrame:
    """Several sets in one table (bucket, name, bits), in one aggregation."""
    value = F.col(column).cast("long")
    rows = reduce(DataFrame.unionByName, [ids.select(value.alias("_id"), F.lit(name).alias("name")) for name, ids in sets.items()])
    return rows.filter("_id IS NOT NULL").groupBy(F.bitmap_bucket_number("_id").alias("bucket"), "name").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def intersection(tagged: DataFrame, count: int) -> DataFrame:
    """Ids that all ``count`` sets of a tagged table hold."""
    return tagged.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_sets")).filter(
        F.col("_sets") == count).select("bucket", "bits").filter(F.bitmap_count("bits") > 0)


def union(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def beside(tagged: DataFrame, names: list[str]) -> DataFrame:
    """One row a bucket: a bitmap column per set (null where it has none of the bucket)."""
    return tagged.groupBy("bucket").agg(*[F.first(F.when(F.col("name") == n, F.col("bits")), ignorenulls=True).alias(n) for n in names])


def size(bits: Column | str) -> Column:
    """Ids in a set: sum of the bitmaps' counts, 0 without any."""
    return F.coalesce(F.sum(F.bitmap_count(bits)), F.lit(0))


def set_sizes(tagged: DataFrame, left: str, right: str) -> DataFrame:
    """One row: ids on the left, on the right, on both sides, only left, only right."""
    per = tagged.filter(F.col("name").isin(left, right)).groupBy("bucket").agg(
        F.coalesce(F.sum(F.when(F.col("name") == left, F.bitmap_count("bits"))), F.lit(0)).alias("l"),
        F.coalesce(F.sum(F.when(F.col("name") == right, F.bitmap_count("bits"))), F.lit(0)).alias("r"),
        F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(0).alias("both"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("l").alias("n_left"), total("r").alias("n_right"), total("both").alias("n_both"),
                   (total("l") - total("both")).alias("only_left"), (total("r") - total("both")).alias("only_right"))


def bitmap_bytes(bits: Column) -> Column:
    """The 4,096 bytes of a bitmap as an array of numbers."""
    places = F.sequence(F.lit(1), F.lit(PLACES // 8))
    return F.transform(places, lambda i: F.conv(F.hex(F.substring(bits, i, F.lit(1))), 16, 10).cast("int"))


def members(bitmap_table: DataFrame, column: str) -> DataFrame:
    """The ids of a set, one row each."""
    bytes_ = bitmap_table.select("bucket", F.posexplode(bitmap_bytes(F.col("bits"))).alias("_byte", "_flags")).filter("_flags <> 0")
    bits = bytes_.select("bucket", "_byte", "_flags", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit")).filter("(shiftright(_flags, _bit) & 1) = 1")
    # Bucket 1 begins at id 1; buckets up to 0 run backwards from 0.
    place = F.col("_byte") * 8 + F.col("_bit")
    first = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * PLACES + 1 + place).otherwise(F.col("bucket") * PLACES - place)
    return bits.select(first.cast("long").alias(column))
