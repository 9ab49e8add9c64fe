"""Pair construction, splitting and fitting (M01-M08)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import scores as S
from rankweave.functions.scores import normalised_rank
from rankweave.operators import metrics as M
from rankweave.operators import pairs as X
from rankweave.operators import pools as P
from rankweave.operators import ranker as RK
from rankweave.plans import views as V
from rankweave.plans.registry import Tables, cte, query
from rankweave.rng import random_sql
from rankweave.session import materialise, materialise_by

SEED, K = 42, 5


def labelled_lists(t: Tables, pool: str = "historical") -> DataFrame:
    """Capped lists with split, cluster, a prior score and the match flag."""
    q = V.queries(t).select("query_id", "cluster_key", "split", "truth_key")
    lists = V.lists(t, pool).withColumn("norm", normalised_rank(F.col("rank"), F.col("n")))
    return lists.join(q, "query_id").withColumn("is_match", F.col("cand_key") == F.col("truth_key")).drop("truth_key")


def labelled_once(t: Tables) -> DataFrame:
    """The same written once, together by query: what pairs, counts and ranks them needs no exchange."""
    return materialise_by(labelled_lists(t), "query_id", gather=True)


def multi_labelled(t: Tables) -> DataFrame:
    """Capped lists in which every candidate with a high discount counts as a match."""
    return V.lists(t, "historical").withColumn("is_match", F.col("feat") >= 0.08)


def train_pairs(t: Tables) -> DataFrame:
    train = labelled_lists(t).filter(F.col("split") == "train")
    return X.training_pairs(train, SEED, K, ["norm", "feat"])


cte("labelled", """
SELECT t.*, 1.0::DOUBLE - (rank - 1) / greatest(n - 1, 1) AS norm, q.cluster_key, q.split, t.cand_key = q.truth_key AS is_match
FROM top_historical t JOIN qs q USING (query_id)""")
cte("multi_labelled", "SELECT *, feat >= 0.08 AS is_match FROM top_historical")


def _pairs_sql(source: str, name: str, negatives: str = "NOT is_match", k: int = K) -> None:
    cte(f"{name}_neg", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY u, cand_key) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS cnt
FROM (SELECT *, {random_sql("u", SEED, "query_id", "cand_key")} FROM {source} WHERE {negatives})""")
    cte(name, f"""
SELECT p.query_id, p.cand_key AS pos_key, n.cand_key AS neg_key FROM (
  SELECT l.query_id, l.cand_key, {random_sql("start", SEED + 1, "l.query_id", "l.cand_key")}, c.cnt, unnest(range(0, least({k}, c.cnt))) AS j
  FROM {source} l JOIN (SELECT query_id, max(cnt) AS cnt FROM {name}_neg GROUP BY query_id) c ON c.query_id = l.query_id WHERE is_match) p
JOIN {name}_neg n ON n.query_id = p.query_id AND n.place = (p.start + p.j) % p.cnt""")


cte("labelled_train", "SELECT * FROM labelled WHERE split = 'train'")
_pairs_sql("labelled_train", "train_pairs")
_pairs_sql("multi_labelled", "multi_pairs")
cte("multi_ranked", """
SELECT *, CASE WHEN is_match THEN NULL ELSE row_number() OVER (PARTITION BY query_id, is_match ORDER BY rank) END AS hard FROM multi_labelled""")
_pairs_sql("multi_ranked", "rest_pairs", "NOT is_match AND hard > 2", 3)


@query("m01_training_pairs", "SELECT * FROM train_pairs")
def m01(t: Tables):
    """The recorded answer with up to five random negatives of its list."""
    return train_pairs(t).select("query_id", "pos_key", "neg_key")


@query("m01_multi_positive_pairs", "SELECT * FROM multi_pairs")
def m01_multi(t: Tables):
    """Several positives per list, each with up to five negatives."""
    return X.training_pairs(multi_labelled(t), SEED, K)


@query("m01_pair_audit", """
SELECT count(*) AS n_queries, count(*) FILTER (WHERE pos = 0) AS without_positive,
  count(*) FILTER (WHERE pos > 0 AND neg = 0) AS without_negative, count(*) FILTER (WHERE pos > 0 AND neg > 0) AS usable
FROM (SELECT query_id, count(*) FILTER (WHERE is_match) AS pos, count(*) FILTER (WHERE NOT is_match) AS neg FROM labelled_train GROUP BY query_id)""")
def m01_audit(t: Tables):
    """Training queries used and skipped."""
    return X.pair_audit(labelled_lists(t).filter(F.col("split") == "train"))


@query("m02_hard_negatives", """
SELECT p.query_id, p.cand_key AS pos_key, n.cand_key AS neg_key FROM multi_ranked p JOIN multi_ranked n ON p.query_id = n.query_id
  WHERE p.is_match AND n.hard <= 2 UNION ALL SELECT * FROM rest_pairs""")
def m02(t: Tables):
    """Two negatives of highest prior and three random others per positive."""
    return X.training_pairs(multi_labelled(t), SEED, K, mining="mixed")


@query("m03_query_split", f"""
SELECT part, count(*) AS n, CAST(sum(query_id) AS BIGINT) AS id_sum FROM (
  SELECT query_id, CASE WHEN row_number() OVER (ORDER BY u, query_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'eval' END AS part
  FROM (SELECT query_id, {random_sql("u", 7, "query_id")} FROM labelled GROUP BY query_id
    HAVING bool_or(is_match) AND bool_or(NOT is_match))) GROUP BY part""")
def m03(t: Tables):
    """Whole queries to train or eval, four to one."""
    return X.query_split(labelled_lists(t), 0.8, 7).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("id_sum"))


@query("m04_positive_rows", """
SELECT p.query_id, p.cand_key AS pos_key, list_concat([p.cand_key], n.items) AS items FROM multi_labelled p
JOIN (SELECT query_id, list(cand_key ORDER BY rank) AS items FROM multi_labelled WHERE NOT is_match GROUP BY query_id) n
  ON n.query_id = p.query_id WHERE p.is_match""")
def m04(t: Tables):
    """One row per positive with all negatives of its list."""
    return X.expand_positives(multi_labelled(t))


@query("m05_payload_audit", """
WITH held AS (SELECT DISTINCT cluster_key FROM qs WHERE split <> 'train'),
l AS (SELECT query_id, bool_or(is_match) AS pos, bool_or(NOT is_match) AS neg FROM labelled GROUP BY query_id),
c AS (SELECT q.split, q.query_id, q.cluster_key, h.cluster_key IS NOT NULL AND q.split = 'train' AS leaked, coalesce(pos, false) AS pos,
  coalesce(neg, false) AS neg FROM qs q LEFT JOIN l USING (query_id) LEFT JOIN held h ON h.cluster_key = q.cluster_key)
SELECT split, count(*) AS n_queries, count(*) FILTER (WHERE leaked) AS excluded, count(*) FILTER (WHERE NOT leaked AND NOT pos) AS uncovered,
  count(*) FILTER (WHERE NOT leaked AND pos AND NOT neg) AS without_negative, count(*) FILTER (WHERE NOT leaked AND pos AND neg) AS usable FROM c GROUP BY split""")
def m05(t: Tables):
    """Training and evaluation queries kept, and why the others are not."""
    q = V.queries(t).select("query_id", "cluster_key", "split")
    train = P.leakage_free(q.filter(F.col("split") == "train"), q.filter(F.col("split") != "train"), "cluster_key")
    state = labelled_lists(t).groupBy("query_id").agg(
        F.bool_or("is_match").alias("pos"), F.bool_or(~F.col("is_match")).alias("neg"))
    kept = train.select("query_id", F.lit(False).alias("leaked"))
    leaked = F.coalesce("leaked", F.col("split") == "train")
    pos, neg = F.coalesce("pos", F.lit(False)), F.coalesce("neg", F.lit(False))
    return q.join(kept, "query_id", "left").join(state, "query_id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(leaked).alias("excluded"),
        F.count_if(~leaked & ~pos).alias("uncovered"), F.count_if(~leaked & pos & ~neg).alias("without_negative"),
        F.count_if(~leaked & pos & neg).alias("usable"))


@query("m06_fitted_ranker")
def m06(t: Tables):
    """Fit the linear pairwise ranker on train and report validation metrics."""
    lists = labelled_once(t)
    pairs = X.training_pairs(lists.filter(F.col("split") == "train"), SEED, K, ["norm", "feat"])
    weights = X.fit_pairwise_ranker(pairs, ["norm", "feat"], reg=0.01)
    scored = lists.filter(F.col("split") == "valid").withColumn("score", S.linear_score(weights))
    placed = M.truth_ranks(scored.withColumnRenamed("is_match", "is_truth"), ["score"])
    rows = placed.filter(F.col("prior_rank") > 0).withColumnRenamed("score", "rank")
    out = M.ranking_metrics(rows, [], (1, 3, 5))
    return V.rounded(out.withColumns({f"weight_{k}": F.lit(v) for k, v in weights.items()}), 4)


RANKER_FEATURES = ("norm", "feat")


@query("m06_layered_ranker")
def m06_layered(t: Tables):
    """Fit a ranker with two hidden layers on train, stop early on validation lists, report every epoch."""
    lists = labelled_once(t)
    data = RK.prepare_pairs(X.training_pairs(lists.filter(F.col("split") == "train"), SEED, K, RANKER_FEATURES), RANKER_FEATURES)
    valid = lists.filter(F.col("split") == "valid").withColumnRenamed("is_match", "is_truth")
    fit = RK.fit_layered(data, RK.prepare_lists(valid, RANKER_FEATURES, data), (8, 4), seed=SEED, learning_rate=0.05, max_epochs=12, patience=5)
    rows = [(epoch, round(loss, 6), round(mrr, 6), chosen, epoch == fit.best_epoch) for epoch, loss, mrr, chosen in fit.history]
    return t.spark.createDataFrame(rows, "epoch INT, train_loss DOUBLE, validation_mrr DOUBLE, improved BOOLEAN, selected BOOLEAN")


@query("m06_validation_choice", """
SELECT config, round(mean, 6) AS mean FROM (SELECT w AS config, avg(CASE WHEN tr IS NULL THEN 0 ELSE 1.0::DOUBLE / place END) AS mean FROM (
  SELECT w, a.query_id, max(CASE WHEN a.is_match THEN 1 END) AS tr, count(*) FILTER (WHERE sc > t_sc OR (sc = t_sc AND rank <= t_rank)) AS place
  FROM (SELECT *, norm + w * 2.0::DOUBLE * feat AS sc, max(CASE WHEN is_match THEN norm + w * 2.0::DOUBLE * feat END) OVER (PARTITION BY query_id, w) AS t_sc,
    max(CASE WHEN is_match THEN rank END) OVER (PARTITION BY query_id, w) AS t_rank
    FROM labelled, (SELECT unnest([0, 1, 2, 3, 4]) AS w) WHERE split = 'valid') a GROUP BY w, a.query_id) WHERE tr IS NOT NULL GROUP BY w)
ORDER BY mean DESC, config LIMIT 1""")
def m06_choice(t: Tables):
    """Choose a feature weight by validation MRR, ties to the lowest index."""
    valid = labelled_lists(t).filter(F.col("split") == "valid").withColumnRenamed("is_match", "is_truth")
    for w in range(5):
        valid = valid.withColumn(f"w_{w}", F.col("norm") + F.lit(w) * F.lit(2.0) * F.col("feat"))
    placed = M.truth_ranks(valid, [f"w_{w}" for w in range(5)]).filter(F.col("prior_rank") > 0)
    means = placed.agg(*[F.avg(S.reciprocal_rank(F.col(f"w_{w}"))).alias(f"w_{w}") for w in range(5)])
    trials = means.unpivot([], [f"w_{w}" for w in range(5)], "name", "mean").withColumn(
        "config", F.substring("name", 3, 1).cast("int"))
    return V.rounded(X.convergence_choice(trials.select("config", "mean")))


@query("m07_grid_trials", """
WITH a AS (SELECT row_number() OVER (ORDER BY w, r) - 1 AS config, w AS width, r AS rate FROM (SELECT unnest([1, 2, 3]) AS w), (SELECT unnest([0.1::DOUBLE, 0.5, 2.0]) AS r)),
s AS (SELECT config, l.query_id, l.is_match, l.rank, norm + (width * rate) * feat AS sc FROM labelled l, a WHERE split = 'valid'),
p AS (SELECT *, max(CASE WHEN is_match THEN sc END) OVER w AS t_sc, max(CASE WHEN is_match THEN rank END) OVER w AS t_rank FROM s WINDOW w AS (PARTITION BY query_id, config)),
q AS (SELECT config, query_id, max(CASE WHEN is_match THEN 1 END) AS tr, count(*) FILTER (WHERE sc > t_sc OR (sc = t_sc AND rank <= t_rank)) AS place FROM p GROUP BY config, query_id)
SELECT config, width, rate, round(avg(1.0::DOUBLE / place), 6) AS mean FROM q JOIN a USING (config) WHERE tr IS NOT NULL GROUP BY config, width, rate""")
def m07(t: Tables):
    """Enumerate a parameter grid in nested order and score the validation lists with every cell."""
    axes = {"width": [1, 2, 3], "rate": [0.1, 0.5, 2.0]}
    cells = list(itertools.product(*axes.values()))
    valid = labelled_lists(t).filter(F.col("split") == "valid").withColumnRenamed("is_match", "is_truth").withColumns(
        {f"c_{i}": F.col("norm") + F.lit(width * rate) * F.col("feat") for i, (width, rate) in enumerate(cells)})
    names = [f"c_{i}" for i in range(len(cells))]
    placed = M.truth_ranks(valid, names).filter(F.col("prior_rank") > 0)
    means = placed.agg(*[F.avg(S.reciprocal_rank(F.col(c))).alias(c) for c in names]).unpivot([], names, "name", "mean")
    means = means.select(F.substring("name", 3, 9).cast("long").alias("config"), "mean")
    configs = X.grid(t.spark, axes).select("config", F.col("width").cast("int").alias("width"), "rate")
    return V.rounded(configs.join(means, "config"))


@query("m08_logit_terms")
def m08(t: Tables):
    """Odds ratios of an improvement by list properties and class."""
    rows = V.effects(t).groupBy("query_id", "class", "list_len", "prior_rank").agg(F.avg("d_mrr").alias("d"))
    frame = materialise(rows.withColumn("improved", F.col("d") > 0))
    return V.rounded(X.fit_logit(frame, "improved", ["list_len", "prior_rank"], "class"), 4)
