"""Tables laid out for lookups by key: ranges of sorted keys in small row groups with Bloom filters.

A lookup of a few keys is a filter that Parquet answers from statistics and filters: it reads the row groups that
hold the keys, however large the table is.  A lookup of many keys is a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import shared_dir

ROW_GROUP_BYTES = 1 << 20
FILTERED_KEYS = 1_000


def write_keyed(df: DataFrame, key: str, path: str | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Write ``df`` sorted by ``key`` over ranges of it; returns the folder (a fresh shared one by default)."""
    path = path or shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ranged.write.mode("errorifexists").option("parquet.block.size", row_group_bytes).option(
        f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.page.row.count.limit", 2_000).parquet(path)
    return path


def lookup_keys(table: DataFrame, key: str, wanted: DataFrame, filtered: int = FILTERED_KEYS) -> DataFrame:
    """Rows of ``table`` whose key is in the first column of ``wanted``; nulls match nothing.

    Up to ``filtered`` distinct keys become a pushed-down filter; more are a join, with the same rows.
    """
    keys = wanted.select(F.col(wanted.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct()
    few = [row[0] for row in keys.limit(filtered + 1).collect()]
    if len(few) <= filtered:
        return table.filter(F.col(key).isin(few)) if few else table.limit(0)
    return table.join(keys, key, "left_semi").select(*table.columns)


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scanned_rows(df: DataFrame) -> int:
    """Rows that the file scans of an executed query handed on, from Spark's own metrics; runs the query."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numOutputRows").value()) for i in range(leaves.size())
               if leaves.apply(i).metrics().contains("numOutputRows"))
