"""Candidate pools: deduplicate, order, cap, merge, extend and compare lists.

Tables are flat.  Raw lines carry (query_id, cand_key, prior, line_no); an ordered list
carries (query_id, cand_key, prior, rank, n).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.scores import normalised_rank
from rankweave.operators import idsets
from rankweave.scale import following, ranked

QUERY = "query_id"
CAND = "cand_key"


def dedupe(lines: DataFrame, extras: Sequence[str] = (), by: Sequence[str] = (QUERY,)) -> DataFrame:
    """One row per candidate identity of a query.

    The highest prior wins and, on equal priors, the first line; the position of the
    identity's first line is kept for ordering.
    """
    winner = F.max(F.struct("prior", (-F.col("line_no")).alias("_neg"), *extras))
    return (
        lines.groupBy(*by, CAND)
        .agg(winner.alias("_w"), F.min("line_no").alias("first_seen"),
             F.count(F.lit(1)).alias("copies"))
        .select(*by, CAND, F.col("_w.prior").alias("prior"), "first_seen", "copies",
                (-F.col("_w._neg")).alias("winner_line"), *[F.col(f"_w.{c}").alias(c) for c in extras])
    )


def list_order() -> list[Column]:
    """Stable list order: prior descending (null last), then first seen, then identity."""
    return [F.col("prior").isNull(), -F.col("prior"), F.col("first_seen"), F.col(CAND)]


def full_list(pool: DataFrame, by: Sequence[str] = (QUERY,), checked: bool = False) -> DataFrame:
    """Rank whole lists, whatever their length; ``checked`` where all are known to be short."""
    return ranked(pool, by, list_order(), "rank", "n", checked)


def top_list(
    pool: DataFrame, k: int, by: Sequence[str] = (QUERY,), order: Sequence[Column] | None = None
) -> DataFrame:
    """The first k of every list.  Spark limits each group before the exchange."""
    window = Window.partitionBy(*by)
    place = F.row_number().over(window.orderBy(*(order or list_order())))
    kept = pool.withColumn("rank", place).filter(F.col("rank") <= k)
    return kept.withColumns({"rank": F.col("rank").cast("long"),
                             "n": F.count(F.lit(1)).over(window)})


def cap_prefix(ordered: DataFrame, k: int) -> DataFrame:
    """First k rows of a stored order, without sorting again."""
    return ordered.filter(F.col("rank") <= k).withColumn("n", F.least(F.col("n"), F.lit(k)))


def cap_then_dedupe(lines: DataFrame, k: int) -> DataFrame:
    """Cut raw lines at k first, so duplicates use up places."""
    order = [-F.col("prior"), F.col("line_no"), F.col(CAND)]
    return full_list(dedupe(top_list(lines, k, order=order).drop("rank", "n")))


def dedupe_then_cap(lines: DataFrame, k: int) -> DataFrame:
    """Remove duplicates first and then cut at k."""
    return top_list(dedupe(lines), k)


def truth_position(queries: DataFrame, ordered: DataFrame) -> DataFrame:
    """Rank of each query's recorded answer in its list, 0 when it is not there."""
    place = ordered.select(QUERY, F.col(CAND).alias("truth_key"), "rank")
    return (
        queries.join(place, [QUERY, "truth_key"], "left")
        .withColumn("rank", F.coalesce("rank", F.lit(0)))
    )


def truth_position_by_count(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """As ``truth_position``, with ``n``, from an unordered pool and without a sort.

    The rank of the answer is one more than the number of candidates ahead of it, an
    aggregate that splits over any number of tasks even for one enormous list.
    """
    wanted = queries.select(QUERY, F.col("truth_key").alias(CAND))
    found = pool.join(wanted, [QUERY, CAND]).select(
        QUERY, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(list_order())]).alias("_truth"))
    here = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(list_order())])
    counted = (
        pool.join(found, QUERY, "left").groupBy(QUERY)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(here <= F.col("_truth")).alias("rank"))
    )
    return (
        queries.join(counted, QUERY, "left")
        .withColumns({"has_pool": F.col("n").isNotNull(), "n": F.coalesce("n", F.lit(0)),
                      "rank": F.coalesce("rank", F.lit(0))})
    )


def coverage(located: DataFrame, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Coverage per split and over all, from queries with (split, cluster_key, rank, n)."""
    shares = [F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)).alias(f"coverage_at_{k}")
              for k in ks]
    covered = F.avg(F.when(F.col("rank") > 0, 1.0).otherwise(0.0))
    return (
        located.rollup("split")
        .agg(F.grouping("split").alias("_all"), F.count(F.lit(1)).alias("n_queries"),
             F.count_distinct("cluster_key").alias("n_clusters"),
             F.count_if(~F.col("has_pool")).alias("missing_pool"),
             covered.alias("coverage"), (1 - covered).alias("not_in_pool_rate"),
             F.avg("n").alias("mean_list_length"), *shares)
        .withColumn("split", F.when(F.col("_all") == 1, "all").otherwise(F.col("split")))
        .drop("_all")
    )


def contribution(queries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Which source holds the answer: a_only, b_only, both or neither, by split and overall."""
    def flag(pool: DataFrame, name: str) -> DataFrame:
        return pool.select(QUERY, F.col(CAND).alias("truth_key")).distinct().withColumn(name, F.lit(True))

    joined = (
        queries.join(flag(a, "_a"), [QUERY, "truth_key"], "left")
        .join(flag(b, "_b"), [QUERY, "truth_key"], "left")
    )
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    kind = (F.when(in_a & in_b, "both").when(in_a, "a_only").when(in_b, "b_only")
            .otherwise("neither"))
    return (
        joined.withColumn("source", kind).groupBy("source", "split").count()
        .rollup("source", "split").agg(F.sum("count").alias("n_queries"),
                                       F.grouping_id().alias("_g"))
        .filter(F.col("_g") < 3)
        .select("source", F.when(F.col("_g") == 1, "all").otherwise(F.col("split")).alias("split"),
                "n_queries")
    )


def merge_sources(a: DataFrame, b: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """Union of two ordered lists on identity.

    The prior is the larger of the two rank-normalised priors; source flags and each
    source's rank and score stay; other columns come from ``a`` where it has the row.
    """
    def side(lists: DataFrame, tag: str) -> DataFrame:
        return lists.select(
            QUERY, CAND, normalised_rank(F.col("rank"), F.col("n")).alias(f"norm_{tag}"),
            F.col("rank").alias(f"rank_{tag}"), F.col("prior").alias(f"prior_{tag}"),
            *[F.col(c).alias(f"{c}_{tag}") for c in extras])

    joined = side(a, "a").join(side(b, "b"), [QUERY, CAND], "full_outer")
    merged = joined.select(
        QUERY, CAND, F.greatest("norm_a", "norm_b").alias("prior"),
        F.col("rank_a").isNotNull().cast("int").alias("source_a"),
        F.col("rank_b").isNotNull().cast("int").alias("source_b"),
        "rank_a", "rank_b", "prior_a", "prior_b",
        *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in extras])
    # The merged order is prior, then identity; no first-seen line exists here.
    return merged.withColumn("first_seen", F.lit(0).cast("long"))


def overlap_by_query(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared, combined and Jaccard counts of two pools per query.

    From hash aggregates alone: no side is sorted.  Repeated lines count once, so raw lines do as well as pools.
    """
    rows = a.select(QUERY, CAND, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(QUERY, CAND, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = rows.groupBy(QUERY, CAND).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    # Null keys meet nothing.
    both = F.when(F.col(QUERY).isNotNull() & F.col(CAND).isNotNull(), F.col("_a") * F.col("_b")).otherwise(0)
    return (
        per.groupBy(QUERY)
        .agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(both).alias("shared"),
             F.sum(F.col("_a") + F.col("_b") - both).alias("combined"))
        .withColumn("jaccard", F.col("shared") / F.col("combined"))
    )


def anchored_extension(anchor: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Keep the anchor's order untouched and append new identities of ``other`` up to k."""
    fresh = other.join(anchor.select(QUERY, CAND), [QUERY, CAND], "left_anti")
    parts = (
        anchor.select(QUERY, CAND, "prior", "rank", F.lit(0).alias("part"))
        .unionByName(fresh.select(QUERY, CAND, "prior", "rank", F.lit(1).alias("part")))
        .withColumnRenamed("rank", "source_rank")
    )
    extended = top_list(parts, k, order=[F.col("part"), F.col("source_rank")])
    return extended.withColumn("source", F.when(F.col("part") == 0, "anchor").otherwise("extension"))


def anchor_violations(anchor: DataFrame, larger: DataFrame) -> DataFrame:
    """Anchor candidates that the larger list lacks; must be empty."""
    return anchor.select(QUERY, CAND, "rank").join(larger.select(QUERY, CAND), [QUERY, CAND], "left_anti")


def extension_diagnostics(extended: DataFrame) -> DataFrame:
    """Per query: extensions, boundary inversion flag, extensions above the anchor floor."""
    is_anchor = F.col("part") == 0
    summary = extended.groupBy(QUERY).agg(
        F.count_if(is_anchor).alias("n_anchor"), F.count_if(~is_anchor).alias("n_extension"),
        F.min(F.when(is_anchor, F.col("prior"))).alias("floor"),
        F.max_by("prior", F.when(is_anchor, F.col("rank"))).alias("last_anchor_prior"),
        F.min_by("prior", F.when(~is_anchor, F.col("rank"))).alias("first_extension_prior"),
    )
    above = (
        extended.filter(~is_anchor).join(summary.select(QUERY, "floor"), QUERY)
        .groupBy(QUERY).agg(F.count_if(F.col("prior") > F.col("floor")).alias("above_floor"))
    )
    return summary.join(above, QUERY, "left").select(
        QUERY, "n_anchor", "n_extension",
        F.coalesce(F.col("first_extension_prior") > F.col("last_anchor_prior"), F.lit(False))
        .alias("boundary_inversion"),
        F.coalesce("above_floor", F.lit(0)).alias("above_floor"))


def leakage_free(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Training rows whose key occurs in no other split."""
    return train.join(held_out.select(key).distinct(), key, "left_anti")


def common_ids(pools: dict[str, DataFrame], key: str = QUERY) -> DataFrame:
    """Whole-number ids present in every pool, by bitmaps combined bucket by bucket."""
    return idsets.members(idsets.intersection(idsets.tagged_bitmaps(pools, key), len(pools)), key)


def list_agreement(reference: DataFrame, current: DataFrame) -> DataFrame:
    """'same_order', 'same_set' or 'different' per query that both tables hold."""
    a = reference.select(QUERY, CAND, F.col("rank").alias("rank_a"))
    b = current.select(QUERY, CAND, F.col("rank").alias("rank_b"))
    both = a.join(b, [QUERY, CAND], "full_outer").groupBy(QUERY).agg(
        F.count("rank_a").alias("n_a"), F.count("rank_b").alias("n_b"),
        F.count_if(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()).alias("shared"),
        F.count_if(F.col("rank_a") == F.col("rank_b")).alias("same_place"))
    same_set = (F.col("shared") == F.col("n_a")) & (F.col("shared") == F.col("n_b"))
    return both.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)).select(
        QUERY, F.when(same_set & (F.col("same_place") == F.col("n_a")), "same_order")
        .when(same_set, "same_set").otherwise("different").alias("agreement"))


def crosswalk(source: DataFrame, other: DataFrame, identity: str) -> DataFrame:
    """Match status of each source row (identity, split) in another data set.

    missing / ambiguous_mapped / ambiguous_current / unique_same_split / unique_cross_split.
    """
    theirs = other.groupBy(identity).agg(
        F.count(F.lit(1)).alias("n_other"), F.min("split").alias("other_split"))
    ours = source.groupBy(identity).agg(F.count(F.lit(1)).alias("n_source"))
    joined = source.join(ours, identity).join(theirs, identity, "left")
    status = (
        F.when(F.col("n_other").isNull(), "missing").when(F.col("n_other") > 1, "ambiguous_mapped")
        .when(F.col("n_source") > 1, "ambiguous_current")
        .when(F.col("split") == F.col("other_split"), "unique_same_split")
        .otherwise("unique_cross_split")
    )
    return joined.withColumn("status", status)


def adjacent_inversions(aligned: DataFrame, value: str) -> DataFrame:
    """Places where the next value in the stored order is larger."""
    paired = following(aligned, [QUERY], "rank", {"next_value": value})
    return paired.filter(F.col(value) < F.col("next_value"))


def first_occurrences(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first line of each key."""
    columns = [c for c in lines.columns if c not in keys]
    first = F.min(F.struct("line_no", *[c for c in columns if c != "line_no"])).alias("_f")
    return lines.groupBy(*keys).agg(first).select(*keys, "_f.*")
