"""Incremental candidate ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.pools import dedupe
from rankweave.sources.commit import write_once

LINE_SCHEMA = "query_id LONG, cand_key LONG, prior DOUBLE, line_no LONG, status STRING"


def line_status(lines: DataFrame) -> DataFrame:
    """Typed status of each incoming line; only 'ok' lines become candidates."""
    status = (
        F.when(F.col("query_id").isNull() | F.col("cand_key").isNull(), "empty")
        .when(F.col("prior").isNull() | F.isnan("prior"), "invalid_prior")
        .when(F.col("prior") < 0, "policy_error").otherwise("ok")
    )
    return lines.withColumn("status", status)


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, files_per_batch: int = 4) -> None:
    """Append all new files of ``source`` to the parquet table ``target`` and stop.

    The checkpoint remembers finished files, so a restart goes on where it stopped; the
    file sink commits each batch once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        line_status(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingested_pool(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """Deduplicated pool of everything ingested; independent of arrival order."""
    lines = spark.read.schema(f"{schema}, status STRING").parquet(target)
    return dedupe(lines.filter(F.col("status") == "ok"))


def status_counts(spark: SparkSession, target: str, schema: str) -> DataFrame:
    lines = spark.read.schema(f"{schema}, status STRING").parquet(target)
    return lines.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def running_winners(lines: DataFrame) -> DataFrame:
    """Best line per (query, candidate), with the first position and a count."""
    best = F.max(F.struct("prior", (-F.col("line_no")).alias("_neg")))
    return lines.groupBy("query_id", "cand_key").agg(
        best.alias("_b"), F.min("line_no").alias("first_seen"), F.count(F.lit(1)).alias("copies")
    ).select("query_id", "cand_key", F.col("_b.prior").alias("prior"), "first_seen", "copies")


def _folders(spark: SparkSession, target: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix>=<number>`` below the target, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(n.removeprefix(f"{prefix}=")) for n in names if n.startswith(f"{prefix}=") and n.removeprefix(f"{prefix}=").isdigit())


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    """Size of all files below the folders."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(folder) for folder in folders]
    return sum(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() for path in paths)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def compact_winners(spark: SparkSession, target: str) -> None:
    """Merge the newest base with the changes after it into a base of their last number, and drop what it replaces.

    The new base appears by one rename, before anything is removed, so a reader or a restart at any point finds
    either the old base with all changes or the new one.
    """
    versions = _folders(spark, target, "version")
    if not versions or versions[-1] in _folders(spark, target, "base"):
        return
    write_once(latest_winners(spark, target, numbered=True), f"{target}/base={versions[-1]}")
    for number in _folders(spark, target, "base"):
        if number < versions[-1]:
            _remove(spark, f"{target}/base={number}")
    for number in versions:
        _remove(spark, f"{target}/version={number}")


def run_winners(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, files_per_batch: int = 4,
                compact_every: int = 8) -> None:
    """Keep a table of running winners up to date: the winners of each batch, merged once ``compact_every`` batches or
    more are as large as what was merged before.

    The table is the state: best prior, first position and count of two sets of lines are worked out from those of
    each, so no executor holds keys between batches.  Each batch is written under its number, so a repeated batch
    overwrites itself, and readers put the rows of a key together.  Storage stays within two rows per key and the
    winners of ``compact_every`` batches, and all merges together write a fixed multiple of what the batches wrote.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def save(batch: DataFrame, number: int) -> None:
        bases = _folders(spark, target, "base")
        if number in bases:
            return  # a batch that was merged before its commit was recorded
        running_winners(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/version={number}")
        versions = _folders(spark, target, "version")
        if len(versions) >= compact_every and _bytes(spark, [f"{target}/version={n}" for n in versions]) >= _bytes(
                spark, [f"{target}/base={n}" for n in bases]):
            compact_winners(spark, target)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


_WINNERS = "query_id LONG, cand_key LONG, prior DOUBLE, first_seen LONG, copies LONG, batch LONG"


def latest_winners(spark: SparkSession, target: str, numbered: bool = False) -> DataFrame:
    """Winners of every key over the newest base and the batches after it; ``numbered`` keeps the last batch of the key."""
    base = _folders(spark, target, "base")[-1:]
    paths = [f"{target}/base={n}" for n in base] + [f"{target}/version={n}" for n in _folders(spark, target, "version") if not base or n > base[0]]
    rows = spark.read.schema(_WINNERS).parquet(*paths) if paths else spark.createDataFrame([], _WINNERS)
    return rows.groupBy("query_id", "cand_key").agg(
        F.max("prior").alias("prior"), F.min("first_seen").alias("first_seen"), F.sum("copies").alias("copies"),
        *([F.max("batch").alias("batch")] if numbered else []))
