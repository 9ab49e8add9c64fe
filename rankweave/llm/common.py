"""Pieces the training-data operators share.

Conventions: an operator keeps every input column; a column it produces replaces an input column
of the same name.  Work columns live beside one struct that holds the input row, so input columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import materialise, tune

# Bytes of one Arrow batch: very long texts then travel in small batches.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for the operators: the library's own, and Arrow batches bounded in bytes."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pack(df: DataFrame, **work: Column) -> DataFrame:
    """One struct column ``row`` with the whole input row, and work columns computed from it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select(
        "row", *[column.alias(name) for name, column in work.items()])


def unpack(df: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """The columns ``names`` of ``row``; columns of ``made`` replace or follow them."""
    kept = [made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in names]
    return df.select(*kept, *[column.alias(c) for c, column in made.items() if c not in names])


def discard(*written: DataFrame) -> None:
    """Remove the files of ``materialise``d tables.  Only for tables that everything made from them has been written since."""
    for df in written:
        spark = df.sparkSession
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identity(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of a row's id and text: equal rows share them, copies under other ids do not."""
    return [F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit(1), *columns).alias("_b")]


def labelled_sample(rows: DataFrame, label: str, unit: Column, rows_per_label: int, labels: int) -> DataFrame:
    """About ``rows_per_label`` rows of each label: those whose hashed ``unit`` lies in the share that gives
    that many.  Counts of the labels, at most ``labels`` of them, reach the driver; more are refused.

    No group is gathered anywhere: each row decides for itself, and the result is bounded by
    ``labels * rows_per_label`` up to the binomial spread.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(labels + 1).collect()
    if len(counts) > labels:
        raise ValueError(f"more than {labels} labels")
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(label) == F.lit(row[0]), F.lit(min(1.0, rows_per_label / row["n"]))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(7), unit), F.lit(1 << 40)) / float(1 << 40)
    return rows.filter(place < share)


__all__ = ["BATCH_BYTES", "discard", "identity", "labelled_sample", "materialise", "pack", "prepare", "table", "unpack"]
