"""Training pairs, query-level splits, grids and model fits."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.rng import with_random
from rankweave.scale import ranked, with_row
from rankweave.session import materialise

QUERY, CAND = "query_id", "cand_key"


def _random_order(rows: DataFrame, seed: int, index: str) -> DataFrame:
    """Negatives of each query in seeded random order: 0-based index and count."""
    drawn = with_random(rows, "_u", seed, QUERY, CAND)
    placed = ranked(drawn, [QUERY], [F.col("_u"), F.col(CAND)], index, "_count")
    return placed.withColumn(index, F.col(index) - 1).drop("_u")


def _match(positives: DataFrame, negatives: DataFrame, seed: int, k: int, features: Sequence[str]) -> DataFrame:
    """Join each positive with k consecutive places of the negatives' random order.

    The start is random per positive, so each set of partners is a uniform sample without
    replacement, and the join key (query, place) never forms all pairs of a list.
    """
    placed = _random_order(negatives, seed, "_place")
    counts = placed.groupBy(QUERY).agg(F.max("_count").alias("_count"))
    starts = with_random(positives.join(counts, QUERY), "_start", seed + 1, QUERY, CAND)
    slots = starts.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_count")).cast("int") - 1)))
    slots = slots.select(
        QUERY, F.col(CAND).alias("pos_key"), *[F.col(c).alias(f"pos_{c}") for c in features],
        F.coalesce((F.col("_start") + F.col("_j")) % F.col("_count"), F.lit(0)).alias("_place"))
    partners = placed.select(QUERY, "_place", F.col(CAND).alias("neg_key"),
                             *[F.col(c).alias(f"neg_{c}") for c in features])
    return slots.join(partners, [QUERY, "_place"]).drop("_place")


def training_pairs(
    labelled: DataFrame, seed: int, k: int = 5, features: Sequence[str] = (), mining: str = "random"
) -> DataFrame:
    """Every positive with up to k negatives of its query.

    ``labelled`` has (query_id, cand_key, rank, is_match).  With mining='mixed', k // 2
    partners are the negatives of highest prior and the rest are random others.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    positives = labelled.filter("is_match")
    negatives = labelled.filter(~F.col("is_match"))
    if mining == "random":
        return _match(positives, negatives, seed, k, features)
    if mining != "mixed":
        raise ValueError(f"unknown mining mode {mining!r}")
    hard_count = k // 2
    by_prior = ranked(negatives, [QUERY], [F.col("rank")], "_hard")
    hard = by_prior.filter(F.col("_hard") <= hard_count)
    wanted = positives.select(
        QUERY, F.col(CAND).alias("pos_key"), *[F.col(c).alias(f"pos_{c}") for c in features],
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(hard_count, 1)).cast("long"))).alias("_hard"))
    hard_pairs = wanted.join(
        hard.select(QUERY, "_hard", F.col(CAND).alias("neg_key"),
                    *[F.col(c).alias(f"neg_{c}") for c in features]), [QUERY, "_hard"]).drop("_hard")
    rest = by_prior.filter(F.col("_hard") > hard_count).drop("_hard")
    return hard_pairs.unionByName(_match(positives, rest, seed, k - hard_count, features))


def pair_audit(labelled: DataFrame) -> DataFrame:
    """Queries usable for pairs, and those skipped for want of positives or negatives."""
    per = labelled.groupBy(QUERY).agg(
        F.count_if("is_match").alias("pos"), F.count_if(~F.col("is_match")).alias("neg"))
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("pos") == 0).alias("without_positive"),
        F.count_if((F.col("pos") > 0) & (F.col("neg") == 0)).alias("without_negative"),
        F.count_if((F.col("pos") > 0) & (F.col("neg") > 0)).alias("usable"))


def query_split(labelled: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Assign whole queries to train or eval; only queries with both kinds of candidate."""
    eligible = labelled.groupBy(QUERY).agg(
        F.count_if("is_match").alias("pos"), F.count_if(~F.col("is_match")).alias("neg")
    ).filter((F.col("pos") > 0) & (F.col("neg") > 0))
    drawn = with_random(eligible.select(QUERY), "_u", seed, QUERY)
    placed = ranked(drawn, [], [F.col("_u"), F.col(QUERY)], "_place", "_total")
    return placed.select(QUERY, F.when(F.col("_place") <= F.floor(F.lit(ratio) * F.col("_total")), "train")
                         .otherwise("eval").alias("part"))


def expand_positives(labelled: DataFrame) -> DataFrame:
    """One row per positive with all negatives of its capped list, positive first."""
    negatives = labelled.filter(~F.col("is_match")).groupBy(QUERY).agg(
        F.array_sort(F.collect_list(F.struct("rank", CAND))).alias("_neg"))
    positives = labelled.filter("is_match").select(QUERY, F.col(CAND).alias("pos_key"))
    return positives.join(negatives, QUERY).select(
        QUERY, "pos_key",
        F.concat(F.array("pos_key"), F.transform("_neg", lambda x: x[CAND])).alias("items"))


def adapter_audit(expanded: DataFrame) -> DataFrame:
    """Rows, distinct queries, extra rows of multi-positive queries and the longest list."""
    return expanded.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(QUERY).alias("n_queries"),
        (F.count(F.lit(1)) - F.count_distinct(QUERY)).alias("extra_rows"),
        F.max(F.size("items")).alias("longest"))


def grid(spark: SparkSession, axes: dict[str, Sequence]) -> DataFrame:
    """All parameter combinations in nested order, numbered from 0."""
    rows = [(i, *values) for i, values in enumerate(itertools.product(*axes.values()))]
    return spark.createDataFrame(rows, ["config", *axes])


def fit_pairwise_ranker(pairs: DataFrame, features: Sequence[str], reg: float = 0.0, iterations: int = 50) -> dict[str, float]:
    """Linear pairwise ranker: logistic regression on feature differences, both directions.

    Minimises the mean of log(1 + exp(score(neg) - score(pos))); returns the weights.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # The fit passes over its rows several times before it holds them.
    deltas = materialise(pairs.select(*[(F.col(f"pos_{c}") - F.col(f"neg_{c}")).alias(c) for c in features]))
    both = deltas.withColumn("label", F.lit(1.0)).unionByName(
        deltas.select(*[(-F.col(c)).alias(c) for c in features]).withColumn("label", F.lit(0.0)))
    data = VectorAssembler(inputCols=list(features), outputCol="_features").transform(both)
    model = LogisticRegression(featuresCol="_features", labelCol="label", fitIntercept=False,
                               standardization=False, regParam=reg, maxIter=iterations).fit(data)
    return dict(zip(features, (float(w) for w in model.coefficients)))


def fit_logit(frame: DataFrame, label: str, numeric: Sequence[str], category: str) -> DataFrame:
    """Binomial GLM on standardised predictors and class dummies: terms and odds ratios.

    Constant predictors are left out; the first class level is the reference.
    """
    from pyspark.ml.regression import GeneralizedLinearRegression
    from pyspark.ml.feature import VectorAssembler

    moments = frame.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric],
                        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    used = [c for c in numeric if (moments[f"s_{c}"] or 0.0) > 0]
    levels = [r[0] for r in frame.select(category).distinct().orderBy(category).limit(101).collect()]
    if len(levels) > 100:
        raise ValueError("too many class levels for dummy coding")
    prepared = frame.select(
        F.col(label).cast("double").alias("label"),
        *[((F.col(c) - moments[f"m_{c}"]) / moments[f"s_{c}"]).alias(c) for c in used],
        *[(F.col(category) == level).cast("double").alias(f"class_{i}") for i, level in enumerate(levels) if i])
    terms = [*used, *[f"class_{i}" for i in range(1, len(levels))]]
    data = VectorAssembler(inputCols=terms, outputCol="_features").transform(prepared)
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_features", labelCol="label").fit(data)
    names = [*used, *[f"{category}={level}" for level in levels[1:]]]
    rows = [("intercept", float(model.intercept))] + list(zip(names, (float(v) for v in model.coefficients)))
    return frame.sparkSession.createDataFrame(rows, "term STRING, coefficient DOUBLE").withColumn(
        "odds_ratio", F.exp("coefficient"))


def convergence_choice(trials: DataFrame, config_order: Sequence[str] = ("config",)) -> DataFrame:
    """Best configuration by mean validation score; ties within 1e-12 go to the lowest index."""
    best = trials.agg(F.max("mean").alias("_best"))
    near = with_row(trials, best).filter(F.col("_best") - F.col("mean") <= 1e-12)
    return near.agg(F.min(F.struct(*config_order, "mean")).alias("s")).select("s.*")
