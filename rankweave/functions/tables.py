"""Table functions: features of a candidate list as a function that SQL can call on any table.

The function itself asks for its input by query and in list order, and says which columns it returns, from the
input's own columns.  An extractor is a class with ``columns`` and ``row(items, place)``; registering another one
makes another function.  Every row of such a function passes through Python alone; the packed form takes a list as one row
and whole batches of them in Arrow, with the same extractors.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class ListShape:
    """Prior of a candidate beside its list: gap to the first and to the one before, share, and the list's entropy."""
    columns = ("gap_to_first", "gap_to_previous", "share", "entropy")

    def start(self, priors: list[float]) -> None:
        self.total = math.fsum(priors)
        shares = [p / self.total for p in priors if p > 0] if self.total > 0 else []
        self.entropy = -math.fsum(s * math.log(s) for s in shares) / math.log(len(priors)) if len(priors) > 1 and shares else None

    def row(self, priors: list[float], place: int) -> tuple:
        return (priors[0] - priors[place], priors[place - 1] - priors[place] if place else None,
                priors[place] / self.total if self.total > 0 else None, self.entropy)


def list_features(extractor: type = ListShape):
    """A table function over (query_id, cand_key, rank, prior) for one extractor."""
    class Features:
        def __init__(self):
            self.items: list[tuple] = []

        @staticmethod
        def analyze(lists: AnalyzeArgument) -> AnalyzeResult:
            if not lists.isTable:
                raise ValueError("the argument is a table")
            kinds = {f.name: f.dataType for f in lists.dataType.fields}
            if missing := {"query_id", "cand_key", "rank", "prior"} - set(kinds):
                raise ValueError(f"the table lacks {sorted(missing)}")
            schema = StructType([StructField("query_id", kinds["query_id"]), StructField("cand_key", kinds["cand_key"]),
                                 StructField("rank", LongType()), *[StructField(c, DoubleType()) for c in extractor.columns]])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("rank")])

        def eval(self, row):
            self.items.append((row["query_id"], row["cand_key"], row["rank"], row["prior"]))

        def terminate(self):
            if self.items:
                priors = [float(p) if p is not None else 0.0 for *_, p in self.items]
                own = extractor()
                own.start(priors)
                for place, (query, cand, rank, _) in enumerate(self.items):
                    yield (query, cand, int(rank), *own.row(priors, place))

    return F.udtf(Features)


def register(spark: SparkSession, name: str = "list_features", extractor: type = ListShape) -> None:
    """``SELECT * FROM name(TABLE(lists))`` from then on."""
    spark.udtf.register(name, list_features(extractor))


def packed(lists: DataFrame) -> DataFrame:
    """One row per list with its items in list order; for lists that are capped."""
    items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "cand_key", F.col("prior").cast("double").alias("prior"))))
    return lists.groupBy("query_id").agg(items.alias("items"))


def packed_features(lists: DataFrame, extractor: type = ListShape):
    """The table function over ``packed`` rows of tables like ``lists``: Arrow functions state their columns beforehand."""
    kinds = {f.name: f.dataType for f in lists.schema.fields}
    names = ["query_id", "cand_key", "rank", *extractor.columns]
    schema = StructType([StructField("query_id", kinds["query_id"]), StructField("cand_key", kinds["cand_key"]),
                         StructField("rank", LongType()), *[StructField(c, DoubleType()) for c in extractor.columns]])

    class Features:
        def eval(self, batch: pa.RecordBatch):
            column = batch.column("items")
            items = column.flatten()
            values = pc.fill_null(items.field("prior"), 0.0).to_pylist()
            rows, at = [], 0
            for size in pc.list_value_length(column).to_pylist():
                priors = values[at:at + size]
                at += size
                own = extractor()
                own.start(priors)
                rows += [own.row(priors, place) for place in range(size)]
            made = [pa.array(c, pa.float64()) for c in zip(*rows)] or [pa.array([], pa.float64())] * len(extractor.columns)
            query = batch.column("query_id").take(pc.list_parent_indices(column))
            yield pa.RecordBatch.from_arrays([query, items.field("cand_key"), items.field("rank"), *made], names)

    return F.arrow_udtf(Features, returnType=schema)


def register_packed(spark: SparkSession, lists: DataFrame, name: str = "packed_list_features", extractor: type = ListShape) -> None:
    """``SELECT * FROM name(TABLE(packed lists))`` from then on."""
    spark.udtf.register(name, packed_features(lists, extractor))
