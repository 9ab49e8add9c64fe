"""Session settings the library relies on, and where shared intermediates go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Tables that lie together by one key of a join are joined where they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# Bytes of input files per partition: what a task holds stays the same however large the tables are.
PARTITION_BYTES = 8 * 1024 * 1024
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def deal(spark: SparkSession, input_bytes: int) -> int:
    """Let shuffles start from as many partitions as the input asks for, never from fewer than the cluster's own number.

    Spark puts small ones together again.  Returns the number.
    """
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // PARTITION_BYTES))
    spark.conf.set(_INITIAL, str(count))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    return count


def partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts from."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_INITIAL, None) or 0))


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; partition counts stay the cluster's own."""
    for key, value in _RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    A machine-local folder is used only by a local session that names none, as in tests; on a cluster
    the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rankweave-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage; the files survive the loss of any executor.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, column: str, sort: str | None = None, gather: bool = False) -> DataFrame:
    """Write ``df`` in the shared folder, in files bucketed by ``column``, and read it back.

    Joins, groups and windows on ``column`` then need no exchange of these rows.  There are as many buckets
    as partitions that a shuffle starts from (``deal``).  Every task writes one file per bucket it has rows of; with ``gather`` rows are
    dealt by bucket first, so that each bucket is one file.  With ``sort`` bucket files are ordered by that column.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    name = f"rankweave_{path.rpartition('-')[2]}"
    buckets = partitions(spark)
    writer = (df.repartition(buckets, column) if gather else df).write.format("parquet").bucketBy(buckets, column)
    (writer.sortBy(sort) if sort else writer).option("path", path).saveAsTable(name)
    return spark.table(name)
