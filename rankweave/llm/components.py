"""Connected components of a link table, with a written table after every round.

Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest node
it sees, then its smaller neighbours to that node.  Links never grow in number, chains halve, and all
work is partial aggregates and joins that AQE can split; nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import materialise


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connect(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of a link that is not a self link; root is the smallest node reachable."""
    larger = materialise(links.filter(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    before = _state(larger)
    while True:
        # Larger neighbours go to the smallest neighbour (or the node itself).
        both = larger.unionByName(larger.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.filter("v > u").join(materialise(least), "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Smaller neighbours, and the node itself, go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(materialise(least), "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        larger = materialise(moved.select("e.*").filter("u != v").distinct())
        after = _state(larger)
        if after == before:
            break
        before = after
    roots = larger.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(larger.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
