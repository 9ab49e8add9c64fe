"""A sink that writes once: all of a table or nothing, and never over something else.

Rows go through Spark's writer into a staging folder beside the target, whose task commits make partial files of
failed or repeated tasks invisible.  The driver then checks the row count that the written files hold, adds a
manifest and renames the folder to its final name, which one process can do once.  On any failure the staging
folder is removed and the target does not exist.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.compare import row_words

MANIFEST = "_MANIFEST.json"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _file_system(spark, path)
    return bool(files.exists(hadoop))


def content(df: DataFrame) -> dict:
    """Rows and two sums of row hashes, which do not depend on order or partitioning."""
    high, low = row_words(df.columns)
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), wide(high).alias("high"), wide(low).alias("low")).first()
    return {"rows": row["rows"], "digest": f"{row['high'] or 0}:{row['low'] or 0}"}


def write_once(df: DataFrame, target: str, kind: str = "parquet", **options) -> dict:
    """Write ``df`` to the folder ``target``, which must not exist; return its manifest.

    The manifest has the rows and the digest of what can be read back.  A target that exists, also one that another
    writer makes in the meantime, is an error and stays as it is.
    """
    spark = df.sparkSession
    files, final = _file_system(spark, target)
    if files.exists(final):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    _, staged = _file_system(spark, staging)
    try:
        df.write.format(kind).options(**options).mode("errorifexists").save(staging)
        stored = spark.read.format(kind).options(**options).schema(df.schema).load(staging)
        manifest = content(stored) | {"columns": df.columns, "format": kind}
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(staged, MANIFEST), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # A rename onto a folder that exists would move into it, so that is looked at once more.
        if files.exists(final) or not files.rename(staged, final):
            raise FileExistsError(target)
    except BaseException:
        files.delete(staged, True)
        raise
    return manifest


def read_once(spark: SparkSession, target: str, schema, **options) -> DataFrame:
    """The rows of a folder that ``write_once`` made; a folder without a manifest, or whose rows changed, is an error."""
    files, hadoop = _file_system(spark, target)
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(hadoop, MANIFEST))
    manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    stored = spark.read.format(manifest["format"]).options(**options).schema(schema).load(target)
    found = content(stored)
    if found != {k: manifest[k] for k in found}:
        raise ValueError(f"{target} does not hold what its manifest says")
    return stored
