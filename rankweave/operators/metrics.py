"""Ranks under a score, ranking metrics and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.scores import rank_hit, reciprocal_rank
from rankweave.scale import with_row

KS = (1, 3, 5, 10, 20, 50)


def truth_ranks(marked: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Rank of the answer under each score column, for lists of capped length.

    ``marked`` has (query_id, rank, n, is_truth) and the scores.  Order is score
    descending; ties keep the stored order.  0 where the answer is not in the list.
    All columns share one exchange, and no list is sorted again.
    """
    # The answer's row goes to all rows of its list as one value, not a window per score.
    fields = ", ".join(f"`{c}`" for c in (*scores, "rank"))
    answer = f"max(CASE WHEN is_truth THEN struct({fields}) END) OVER (PARTITION BY query_id) AS _t"
    ahead = [f"count_if(`{s}` > _t.`{s}` OR (`{s}` = _t.`{s}` AND rank <= _t.rank)) AS `{s}`" for s in scores]
    return (
        marked.selectExpr("query_id", "rank", "n", *[f"`{s}`" for s in scores], answer)
        .groupBy("query_id")
        .agg(F.max("n").alias("list_len"), F.coalesce(F.max("_t.rank"), F.lit(0)).alias("prior_rank"),
             *[F.expr(e) for e in ahead])
    )


def reranked(lists: DataFrame, score: str, k: int | None = None) -> DataFrame:
    """New order of capped lists by score descending; ties keep the stored order."""
    window = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("rank"))
    out = lists.withColumn("new_rank", F.row_number().over(window))
    if k is not None:
        out = out.filter(F.col("new_rank") <= k)
    return out.withColumn("new_rank", F.col("new_rank").cast("long"))


def reranked_reversed_ties(lists: DataFrame, score: str, k: int) -> DataFrame:
    """The other tie rule: equal scores appear in reversed stored order."""
    window = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("rank").desc())
    out = lists.withColumn("new_rank", F.row_number().over(window)).filter(F.col("new_rank") <= k)
    return out.withColumn("new_rank", F.col("new_rank").cast("long"))


def metric_columns(rank: Column, ks: Sequence[int] = KS, denominator: Column | None = None):
    """hit@k and MRR aggregates; with ``denominator`` the sums are divided by it."""
    def share(value: Column) -> Column:
        return F.avg(value) if denominator is None else F.sum(value) / denominator

    return [share(rank_hit(rank, k)).alias(f"top{k}") for k in ks] + [
        share(reciprocal_rank(rank)).alias("mrr")]


def ranking_metrics(ranks: DataFrame, by: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """Within-pool metrics: averages over the rows given."""
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *metric_columns(F.col("rank"), ks))


def end_to_end_metrics(
    ranks: DataFrame, by: Sequence[str], n_queries: DataFrame, ks: Sequence[int] = KS
) -> DataFrame:
    """Metrics with every query in the denominator; ``n_queries`` is a one-row table."""
    total = n_queries.select(F.col(n_queries.columns[0]).alias("_total"))
    joined = with_row(ranks, total)
    return joined.groupBy(*by).agg(
        F.max("_total").alias("n"),
        *metric_columns(F.col("rank"), ks, F.max("_total")))


def seed_summary(per_seed: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds (0 for one seed), one row per metric."""
    long = per_seed.unpivot([*by, "seed"], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def rank_shift(paired: DataFrame, by: Sequence[str], before: str, after: str) -> DataFrame:
    """Improved, unchanged and degraded counts with their mean size."""
    gain = F.col(before) - F.col(after)
    return paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gain > 0).alias("improved"),
        F.count_if(gain == 0).alias("unchanged"), F.count_if(gain < 0).alias("degraded"),
        F.coalesce(F.avg(F.when(gain > 0, gain)), F.lit(0.0)).alias("mean_gain"),
        F.coalesce(F.avg(F.when(gain < 0, -gain)), F.lit(0.0)).alias("mean_loss"),
        F.count_if((F.col(before) > 1) & (F.col(after) == 1)).alias("promoted_top1"),
        F.count_if((F.col(before) == 1) & (F.col(after) > 1)).alias("lost_top1"),
        F.avg(gain).alias("mean_delta"))


def net_flips(paired: DataFrame, by: Sequence[str], before: str, after: str) -> DataFrame:
    """Top-1 promotions, losses, unchanged and their balance."""
    promoted = F.count_if((F.col(before) != 1) & (F.col(after) == 1))
    lost = F.count_if((F.col(before) == 1) & (F.col(after) != 1))
    return paired.groupBy(*by).agg(
        promoted.alias("promoted"), lost.alias("lost"),
        (F.count(F.lit(1)) - promoted - lost).alias("unchanged"), (promoted - lost).alias("net"))


def sign_counts(values: DataFrame, by: Sequence[str], value: str, zero: float = 0.0) -> DataFrame:
    """Positive, zero and negative counts of a column."""
    v = F.col(value)
    return values.groupBy(*by).agg(
        F.count_if(v > zero).alias("positive"), F.count_if(F.abs(v) <= zero).alias("zero"),
        F.count_if(v < -zero).alias("negative"))


def headroom(rows: DataFrame, baseline: str, effect: str) -> Column:
    """Share of the remaining room captured; null when there is no room."""
    room = F.lit(1.0) - F.col(baseline)
    return F.when(room == 0, F.lit(None)).otherwise(F.col(effect) / room)
