"""Scoring of lists: prior transforms, user scorers and extractors, first-item changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.scores import log_prior, normalised_midrank
from rankweave.scale import midranked


def transformed_priors(lists: DataFrame) -> DataFrame:
    """Add ``log`` and ``rank_score`` versions of the prior of capped lists."""
    placed = midranked(lists, ["query_id"], F.col("prior"), "_m")
    return placed.withColumns({
        "log": log_prior(F.col("prior")), "rank_score": normalised_midrank(F.col("_m"), F.col("n"))}).drop("_m")


def top_item_deltas(scored: DataFrame, seeds: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Mean over seeds of a column at the augmented first item minus the baseline one."""
    def first(score: str, column: str):
        return F.max_by(column, F.struct(score, -F.col("rank")))

    def mean(column: str):
        total = F.lit(0.0)
        for s in seeds:
            total = total + (first(f"augmented_{s}", column) - first(f"baseline_{s}", column))
        return (total / len(seeds)).alias(f"d_{column}")

    return scored.groupBy("query_id").agg(*[mean(c) for c in columns])


def score_batches(lists: DataFrame, columns: Sequence[str], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a user's vectorised scorer to feature matrices in Arrow batches."""
    @F.pandas_udf(T.DoubleType())
    def run(*series: pd.Series) -> pd.Series:
        matrix = np.column_stack([s.to_numpy("float64") for s in series])
        return pd.Series(np.asarray(score(matrix), dtype="float64"))

    return lists.withColumn("score", run(*[F.col(c).cast("double") for c in columns]))


def extract_per_list(lists: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's Python extractor on batches of whole capped lists.

    Lists are co-located and sorted; a list cut by an Arrow batch boundary is carried over,
    so the extractor sees many complete lists per call and memory stays at one batch.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in batches:
            if carried is not None:
                batch = pd.concat([carried, batch], ignore_index=True)
            if batch.empty:
                continue
            unfinished = batch["query_id"] == batch["query_id"].iloc[-1]
            carried, ready = batch[unfinished], batch[~unfinished]
            if len(ready):
                yield extract(ready)
        if carried is not None and len(carried):
            yield extract(carried)

    placed = lists.repartition("query_id").sortWithinPartitions("query_id", "rank")
    return placed.mapInPandas(run, schema)
