"""Readers and writers of rank rows, prediction files and nested result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.scores import rank_hit, reciprocal_rank
from rankweave.scale import following, ranked, with_row

NESTED_METRICS = "map<string,map<string,map<string,map<string,double>>>>"


def write_records(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write as json, csv or parquet; an existing target is an error."""
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)


def read_predictions(spark: SparkSession, path: str, schema: str, pattern: str = r"seed_(\d+)") -> DataFrame:
    """Prediction files of all seeds in one scan; the seed comes from the file path.

    A header without the columns of ``schema``, a path without a seed and an id that a seed has twice
    are errors.
    """
    seed = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int")
    known = F.when(seed.isNotNull(), seed).otherwise(F.raise_error(F.lit("no seed in the file path")).cast("int"))
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    return unique(rows.select("*", known.alias("seed")), ["seed", rows.columns[0]])


def unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows unchanged; a combination of ``keys`` that occurs twice is an error."""
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_most"))
    first = F.col(f"`{keys[0]}`")
    return with_row(rows, most).withColumn(keys[0], F.when(F.coalesce("_most", F.lit(1)) == 1, first).otherwise(
        F.raise_error(F.lit(f"not unique: {', '.join(keys)}")).cast(dict(rows.dtypes)[keys[0]]))).drop("_most")


def unpivot_ranks(wide: DataFrame, ids: DataFrame, id_columns: Sequence[str] = ("query_id",)) -> DataFrame:
    """Columns like ``baseline_42`` to (arm, seed, rank) rows, for the requested ids."""
    columns = [c for c in wide.columns if c.rsplit("_", 1)[-1].isdigit()]
    kept = wide.join(ids, "query_id", "left_semi")
    long = kept.unpivot(list(id_columns), columns, "cell", "rank")
    return long.select(
        *id_columns, F.regexp_extract("cell", r"^(.*)_(\d+)$", 1).alias("arm"),
        F.regexp_extract("cell", r"^(.*)_(\d+)$", 2).cast("int").alias("seed"), "rank")


def prediction_rows(lists: DataFrame, ranks: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Flat prediction rows: hits, reciprocal rank, first candidate and the list as JSON.

    ``lists`` is cut to a fixed length, so collecting one list per row is bounded.
    """
    packed = lists.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cand_key"))).alias("items"))
    keys = F.transform("items", lambda x: x["cand_key"].cast("string"))
    return ranks.join(packed, "query_id").select(
        "query_id", "rank", *[rank_hit(F.col("rank"), k).cast("int").alias(f"hit_{k}") for k in ks],
        reciprocal_rank(F.col("rank")).alias("rr"), F.get(keys, F.lit(0)).alias("top1"),
        F.to_json(keys).alias("candidates_json"))


def write_shards(df: DataFrame, path: str, key: str, rows_per_shard: int) -> None:
    """Write contiguous key ranges as shards; each file holds part of one shard only."""
    sharded = df.withColumn("shard", F.floor(F.col(key) / rows_per_shard))
    sharded.repartitionByRange("shard", key).write.mode("errorifexists").partitionBy("shard").parquet(path)


def shard_ranges(df: DataFrame, key: str) -> DataFrame:
    """Range, size and continuity of every shard."""
    ranges = df.groupBy("shard").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"),
        F.count_distinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_rows"))
    placed = following(ranked(ranges, [], [F.col("shard")], "position"), [], "position",
                       {"next_first": "first_key"})
    return placed.select(
        "shard", "first_key", "last_key", "n_keys", "n_rows",
        F.coalesce(F.col("next_first") == F.col("last_key") + 1, F.lit(True)).alias("contiguous"))


def nested_metrics(records: DataFrame, column: str) -> DataFrame:
    """Rows (arm, seed, scope, metric, value) from nested JSON metric records."""
    out = records.select(F.explode(F.from_json(column, NESTED_METRICS)).alias("arm", "a"))
    out = out.select("arm", F.explode("a").alias("seed", "b"))
    out = out.select("arm", F.col("seed").cast("int").alias("seed"), F.explode("b").alias("scope", "c"))
    return out.select("arm", "seed", "scope", F.explode("c").alias("metric", "value"))


def tidy_effects(sources: Sequence[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Stack differently named result tables as (source, effect, low, high).

    A row whose interval does not hold its effect is an error.
    """
    out = None
    for table, names in sources:
        part = table.select(*[F.col(old).alias(new) for new, old in names.items()])
        out = part if out is None else out.unionByName(part)
    inside = (F.col("low") <= F.col("effect")) & (F.col("effect") <= F.col("high"))
    return out.withColumn("effect", F.when(inside, F.col("effect")).otherwise(
        F.raise_error(F.lit("effect outside its interval")).cast("double")))


def grid_cells(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """Gain of every (replicate, seed) cell over the shared baseline of its seed."""
    return cells.join(baseline, ["seed", "query_id"]).withColumn(
        "value", F.col("cell_value") - F.col("base_value"))
