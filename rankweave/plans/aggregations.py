"""Aggregations: coverage, metrics, summaries and diagnostics (G01-G36)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import scores as S
from rankweave.operators import audits as A
from rankweave.operators import diagnostics as D
from rankweave.operators import metrics as M
from rankweave.operators import pairs as X
from rankweave.operators import pools as P
from rankweave.operators import resample as RS
from rankweave.plans import views as V
from rankweave.plans.joins import covered_ids
from rankweave.plans.pairs import labelled_lists, train_pairs
from rankweave.plans.registry import Tables, cte, query
from rankweave.rng import SPAN, random_sql, with_random
from rankweave.scale import quantiles, with_row
from rankweave.session import materialise

def rows_():
    return F.count(F.lit(1))


@query("g01_coverage", """
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS n_queries,
  count(DISTINCT cluster_key) AS n_clusters, count(*) FILTER (WHERE p.n IS NULL) AS missing_pool,
  round(avg(CASE WHEN r.rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage,
  round(1 - avg(CASE WHEN r.rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS not_in_pool_rate,
  round(avg(coalesce(p.n, 0)), 6) AS mean_list_length,
  round(avg(CASE WHEN r.rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage_at_1,
  round(avg(CASE WHEN r.rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS coverage_at_5,
  round(avg(CASE WHEN r.rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS coverage_at_10,
  round(avg(CASE WHEN r.rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS coverage_at_20
FROM qs LEFT JOIN pool_historical r ON r.query_id = qs.query_id AND r.cand_key = qs.truth_key
LEFT JOIN (SELECT query_id, max(n) AS n FROM pool_historical GROUP BY query_id) p ON p.query_id = qs.query_id
GROUP BY GROUPING SETS ((), (split))""")
def g01(t: Tables):
    """Coverage of one pool per split and over all."""
    return V.rounded(P.coverage(P.truth_position_by_count(V.queries(t), V.pool(t, "historical"))))


@query("g02_source_contribution", """
SELECT source, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS n_queries FROM (
  SELECT split, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both' WHEN a.rank IS NOT NULL THEN 'a_only'
    WHEN b.rank IS NOT NULL THEN 'b_only' ELSE 'neither' END AS source FROM qs LEFT JOIN pool_alpha a ON a.query_id = qs.query_id AND a.cand_key = truth_key
  LEFT JOIN pool_beta b ON b.query_id = qs.query_id AND b.cand_key = truth_key) GROUP BY GROUPING SETS ((source), (source, split))""")
def g02(t: Tables):
    """Which source holds the recorded answer."""
    return P.contribution(V.queries(t), V.pool(t, "alpha"), V.pool(t, "beta")).withColumn(
        "n_queries", F.col("n_queries").cast("long"))


_METRICS = ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 6) AS top{k}" for k in M.KS)


@query("g03_within_pool_metrics", f"""
SELECT pool, arm, seed, count(*) AS n, {_METRICS}, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr
FROM (SELECT * FROM ranks_historical UNION ALL SELECT * FROM ranks_beta) WHERE prior_rank > 0 GROUP BY pool, arm, seed""")
def g03(t: Tables):
    """Hit rates and MRR over covered queries."""
    rows = V.ranks(t, ("historical", "beta")).filter(F.col("prior_rank") > 0)
    return V.rounded(M.ranking_metrics(rows, ["pool", "arm", "seed"]))


@query("g03_end_to_end_metrics", """
SELECT arm, seed, max(total) AS n, round(sum(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) / max(total), 6) AS top1,
  round(sum(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END) / max(total), 6) AS top5,
  round(sum(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) / max(total), 6) AS mrr
FROM ranks_historical, (SELECT count(*) AS total FROM plain_qs) GROUP BY arm, seed""")
def g03_end(t: Tables):
    """The same with every query in the denominator."""
    total = V.plain_queries(t).agg(rows_().alias("total"))
    return V.rounded(M.end_to_end_metrics(V.ranks(t), ["arm", "seed"], total, (1, 5)))


@query("g04_seed_summary", """
SELECT arm, metric, count(*) AS n_seeds, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(avg(v) * max(c), 6) AS end_to_end FROM (
  SELECT arm, seed, unnest(['top1', 'top3', 'mrr']) AS metric, unnest([avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), avg(1.0::DOUBLE / rank)]) AS v
  FROM ranks_historical WHERE prior_rank > 0 GROUP BY arm, seed), (SELECT (SELECT count(*) FROM wide_historical WHERE prior_rank > 0) / (SELECT count(*) FROM plain_qs) AS c)
GROUP BY arm, metric""")
def g04(t: Tables):
    """Mean and deviation over seeds; end-to-end is scaled by coverage."""
    rows = V.ranks(t).filter(F.col("prior_rank") > 0)
    per_seed = M.ranking_metrics(rows, ["arm", "seed"], (1, 3))
    total = V.plain_queries(t).agg(rows_().alias("_total"))
    fraction = with_row(per_seed.agg(F.max("n").alias("_n")), total).select((F.col("_n") / F.col("_total")).alias("_c"))
    summary = M.seed_summary(per_seed, ["arm"], ["top1", "top3", "mrr"])
    return V.rounded(with_row(summary, fraction).withColumn("end_to_end", F.col("mean") * F.col("_c")).drop("_c"))


@query("g04_paired_summary", """
SELECT metric, round(avg(d), 6) AS mean_delta, round(coalesce(stddev_samp(d), 0), 6) AS sd_delta, count(*) AS n_seeds FROM (
  SELECT seed, unnest(['top1', 'mrr']) AS metric, unnest([avg(d_top1), avg(d_mrr)]) AS d FROM effects_historical GROUP BY seed) GROUP BY metric""")
def g04_paired(t: Tables):
    """Paired difference per seed, summarised."""
    per_seed = V.effects(t).groupBy("seed").agg(F.avg("d_top1").alias("top1"), F.avg("d_mrr").alias("mrr"))
    out = M.seed_summary(per_seed, [], ["top1", "mrr"])
    return V.rounded(out.select("metric", F.col("mean").alias("mean_delta"), F.col("sd").alias("sd_delta"), "n_seeds"))


@query("g05_pool_overlap", """
WITH j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, count(a.rank) AS na, count(b.rank) AS nb,
    count(*) FILTER (WHERE a.rank IS NOT NULL AND b.rank IS NOT NULL) AS s, count(*) AS u
  FROM pool_alpha a FULL OUTER JOIN pool_beta b ON a.query_id = b.query_id AND a.cand_key = b.cand_key GROUP BY ALL)
SELECT count(*) AS n_queries, round(avg(coalesce(s / u, 1)), 6) AS mean_jaccard, round(quantile_cont(coalesce(s / u, 1), 0.5), 6) AS median_jaccard,
  CAST(sum(s) AS BIGINT) AS shared, round(sum(s) / sum(u), 6) AS global_jaccard, count(*) FILTER (WHERE coalesce(nb, 0) = 0) AS without_b, max(u) AS longest
FROM plain_qs LEFT JOIN j USING (query_id)""")
def g05(t: Tables):
    """Overlap of two pools; two empty lists count as equal."""
    per = V.plain_queries(t).select("query_id").join(
        P.overlap_by_query(V.raw_lines(t, "alpha"), V.raw_lines(t, "beta")), "query_id", "left")
    per = materialise(per.withColumn("jaccard", F.coalesce("jaccard", F.lit(1.0))))
    counts = per.agg(
        rows_().alias("n_queries"), F.avg("jaccard").alias("mean_jaccard"), F.sum("shared").alias("shared"),
        (F.sum("shared") / F.sum("combined")).alias("global_jaccard"),
        F.count_if(F.coalesce("n_b", F.lit(0)) == 0).alias("without_b"), F.max("combined").alias("longest"))
    median = quantiles(per, [], "jaccard", [0.5], "_q").select(F.col("_q")[0].alias("median_jaccard"))
    return V.rounded(with_row(counts, median))


@query("g06_winner_dedup", """
SELECT query_id, cand_key, prior, first_seen, winner_line, copies FROM dedup_beta""")
def g06(t: Tables):
    """One winner per identity, with the first position kept."""
    return P.dedupe(V.raw_lines(t, "beta"), ["feat"]).drop("feat")


@query("g07_rank_shift", """
SELECT seed, count(*) AS n, count(*) FILTER (WHERE g > 0) AS improved, count(*) FILTER (WHERE g = 0) AS unchanged, count(*) FILTER (WHERE g < 0) AS degraded,
  round(coalesce(avg(g) FILTER (WHERE g > 0), 0), 6) AS mean_gain, round(coalesce(avg(-g) FILTER (WHERE g < 0), 0), 6) AS mean_loss,
  count(*) FILTER (WHERE base_rank > 1 AND aug_rank = 1) AS promoted_top1, count(*) FILTER (WHERE base_rank = 1 AND aug_rank > 1) AS lost_top1, round(avg(g), 6) AS mean_delta
FROM (SELECT *, base_rank - aug_rank AS g FROM effects_historical) GROUP BY seed""")
def g07(t: Tables):
    """Improved, unchanged and degraded ranks per seed."""
    return V.rounded(M.rank_shift(V.effects(t), ["seed"], "base_rank", "aug_rank"))


@query("g08_net_flips", """
SELECT seed, count(*) FILTER (WHERE base_rank <> 1 AND aug_rank = 1) AS promoted, count(*) FILTER (WHERE base_rank = 1 AND aug_rank <> 1) AS lost,
  count(*) FILTER (WHERE (base_rank = 1) = (aug_rank = 1)) AS unchanged,
  count(*) FILTER (WHERE base_rank <> 1 AND aug_rank = 1) - count(*) FILTER (WHERE base_rank = 1 AND aug_rank <> 1) AS net FROM effects_historical GROUP BY seed""")
def g08(t: Tables):
    """Top-1 flips and their balance per seed."""
    return M.net_flips(V.effects(t), ["seed"], "base_rank", "aug_rank")


@query("g09_class_results", """
SELECT class, count(*) AS n_seeds, max(n) AS n, round(avg(b), 6) AS baseline, round(avg(a), 6) AS augmented, round(avg(a - b), 6) AS delta, round(coalesce(stddev_samp(a - b), 0), 6) AS sd_delta
FROM (SELECT class, seed, count(*) AS n, avg(1.0::DOUBLE / base_rank) AS b, avg(1.0::DOUBLE / aug_rank) AS a FROM effects_historical GROUP BY class, seed) GROUP BY class""")
def g09(t: Tables):
    """Seed means per class, then mean and deviation over seeds."""
    per = V.effects(t).groupBy("class", "seed").agg(
        rows_().alias("n"), F.avg(S.reciprocal_rank(F.col("base_rank"))).alias("b"), F.avg(S.reciprocal_rank(F.col("aug_rank"))).alias("a"))
    return V.rounded(per.groupBy("class").agg(
        rows_().alias("n_seeds"), F.max("n").alias("n"), F.avg("b").alias("baseline"), F.avg("a").alias("augmented"),
        F.avg(F.col("a") - F.col("b")).alias("delta"), F.coalesce(F.stddev_samp(F.col("a") - F.col("b")), F.lit(0.0)).alias("sd_delta")))


cte("query_effects", """
SELECT query_id, cluster_key, class, split, list_len, prior_rank, avg(d_top1) AS e_top1, avg(d_mrr) AS e_mrr, CAST(ceil(median(base_rank)) AS BIGINT) AS median_rank
FROM effects_historical GROUP BY ALL""")


def query_effects(t: Tables) -> DataFrame:
    """Seed means per query, written once for the several passes over them.

    The median is over the few seeds of one query.
    """
    return materialise(V.effects(t).groupBy("query_id", "cluster_key", "class", "split", "list_len", "prior_rank").agg(
        F.avg("d_top1").alias("e_top1"), F.avg("d_mrr").alias("e_mrr"), F.ceil(F.percentile("base_rank", 0.5)).alias("median_rank")))


_LEN_BIN = """CASE WHEN list_len = 1 THEN '1' WHEN list_len <= 3 THEN '2-3' WHEN list_len <= 6 THEN '4-6' WHEN list_len <= 9 THEN '7-9' ELSE '10' END"""
_RANK_BIN = """CASE WHEN median_rank <= 3 THEN CAST(median_rank AS VARCHAR) WHEN median_rank <= 5 THEN '4-5' ELSE '6-10' END"""


@query("g10_length_strata", f"""
SELECT {_LEN_BIN} AS bin, count(*) AS n, count(DISTINCT cluster_key) AS n_clusters, round(avg(e_top1), 6) AS top1, round(avg(e_mrr), 6) AS mrr,
  {_LEN_BIN} <> '1' OR max(abs(e_mrr)) = 0 AS gate FROM query_effects GROUP BY 1""")
def g10(t: Tables):
    """Effects by list length; lists of one must show exactly none."""
    rows = query_effects(t).withColumn("bin", S.length_bin(F.col("list_len")))
    return V.rounded(rows.groupBy("bin").agg(
        rows_().alias("n"), F.count_distinct("cluster_key").alias("n_clusters"), F.avg("e_top1").alias("top1"), F.avg("e_mrr").alias("mrr"),
        F.max(F.abs("e_mrr")).alias("_m")).withColumn("gate", (F.col("bin") != "1") | (F.col("_m") == 0)).drop("_m"))


@query("g10_rank_strata", f"""
SELECT {_RANK_BIN} AS bin, count(*) AS n, count(*) FILTER (WHERE e_mrr > 1e-12) AS promoted, count(*) FILTER (WHERE e_mrr < -1e-12) AS degraded,
  count(*) FILTER (WHERE abs(e_mrr) <= 1e-12) AS unchanged, round(CASE WHEN {_RANK_BIN} = '1' THEN avg(CASE WHEN e_mrr < -1e-12 THEN 1.0 ELSE 0 END) END, 6) AS harm_rate
FROM query_effects GROUP BY 1""")
def g10_rank(t: Tables):
    """Effects by the rounded-up median baseline rank; harm only where rank was 1."""
    rows = query_effects(t).withColumn("bin", S.rank_bin(F.col("median_rank")))
    out = rows.groupBy("bin").agg(
        rows_().alias("n"), F.count_if(F.col("e_mrr") > 1e-12).alias("promoted"), F.count_if(F.col("e_mrr") < -1e-12).alias("degraded"),
        F.count_if(F.abs("e_mrr") <= 1e-12).alias("unchanged"))
    return V.rounded(out.withColumn("harm_rate", F.when(F.col("bin") == "1", F.col("degraded") / F.col("n"))))


@query("g11_headroom", """
SELECT pool, round(p, 6) AS prior_top1, round(b, 6) AS baseline_top1, round(a - b, 6) AS effect, round(CASE WHEN b < 1 THEN (a - b) / (1 - b) END, 6) AS captured,
  round(CASE WHEN p < 1 THEN (a - p) / (1 - p) END, 6) AS captured_from_prior
FROM (SELECT pool, avg(CASE WHEN prior_rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(CASE WHEN base_rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS b,
  avg(CASE WHEN aug_rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS a FROM all_effects GROUP BY pool)""")
def g11(t: Tables):
    """Share of the remaining room captured, with two denominators."""
    rate = {c: F.avg(S.rank_hit(F.col(c), 1)) for c in ("prior_rank", "base_rank", "aug_rank")}
    rows = V.effects(t, V.POOLS).groupBy("pool").agg(
        rate["prior_rank"].alias("prior_top1"), rate["base_rank"].alias("baseline_top1"), rate["aug_rank"].alias("_a"))
    rows = rows.withColumns({"effect": F.col("_a") - F.col("baseline_top1"), "_gain": F.col("_a") - F.col("prior_top1")})
    return V.rounded(rows.withColumns({
        "captured": M.headroom(rows, "baseline_top1", "effect"), "captured_from_prior": M.headroom(rows, "prior_top1", "_gain")}).drop("_a", "_gain"))


@query("g12_distribution", """
SELECT class, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(quantile_cont(o_totalprice, 0.25), 6) AS q250, round(quantile_cont(o_totalprice, 0.5), 6) AS q500, round(quantile_cont(o_totalprice, 0.75), 6) AS q750
FROM (SELECT *, o_orderpriority AS class FROM orders) GROUP BY class""")
def g12(t: Tables):
    """Moments and exact quantiles per group."""
    return V.rounded(D.distribution(t.orders.withColumnRenamed("o_orderpriority", "class"), ["class"], "o_totalprice"))


@query("g12_sample_distribution", """
SELECT count(*) AS n, round(avg(e_mrr), 6) AS mean, round(stddev_samp(e_mrr), 6) AS sd, round(min(e_mrr), 6) AS min, round(max(e_mrr), 6) AS max,
  round(quantile_cont(e_mrr, 0.05), 6) AS q050, round(quantile_cont(e_mrr, 0.95), 6) AS q950 FROM query_effects""")
def g12_sample(t: Tables):
    """The same with the sample deviation, over all rows."""
    return V.rounded(D.distribution(query_effects(t), [], "e_mrr", True, (0.05, 0.95)))


@query("g13_pearson", """
SELECT class, count(*) AS n, round(corr(list_len, e_mrr), 6) AS correlation FROM query_effects GROUP BY class""")
def g13(t: Tables):
    """Pearson correlation of list length and effect."""
    return V.rounded(D.correlation(query_effects(t), ["class"], "list_len", "e_mrr"))


@query("g13_spearman", """
SELECT class, count(*) AS n, round(corr(rx, ry), 6) AS correlation FROM (SELECT class,
  rank() OVER (PARTITION BY class ORDER BY prior_rank) + (count(*) OVER (PARTITION BY class, prior_rank) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY class ORDER BY list_len) + (count(*) OVER (PARTITION BY class, list_len) - 1) / 2.0 AS ry FROM query_effects) GROUP BY class""")
def g13_spearman(t: Tables):
    """Average-rank correlation of prior rank and list length."""
    return V.rounded(D.correlation(query_effects(t), ["class"], "prior_rank", "list_len", True))


@query("g13_constant_is_null", """
SELECT class, count(*) AS n, CAST(NULL AS DOUBLE) AS correlation FROM query_effects GROUP BY class""")
def g13_constant(t: Tables):
    """A constant side leaves the correlation undefined."""
    return D.correlation(query_effects(t).withColumn("one", F.lit(1.0)), ["class"], "one", "e_mrr")


@query("g14_between_group", """
SELECT split, round(sum(n * (m - g) * (m - g)), 6) AS statistic FROM (SELECT split, class, count(*) AS n, avg(e_mrr) AS m FROM query_effects GROUP BY ALL)
JOIN (SELECT split, avg(e_mrr) AS g FROM query_effects GROUP BY split) USING (split) GROUP BY split""")
def g14(t: Tables):
    """Between-class sum of squares of the effect."""
    sums = query_effects(t).groupBy("split", "class").agg(F.sum("e_mrr").alias("total"), rows_().alias("n"))
    return V.rounded(RS.between_group(sums, ["split"]))


@query("g15_mean_contrast", """
SELECT round(avg(e_mrr) FILTER (WHERE class IN ('1-URGENT')) - avg(e_mrr) FILTER (WHERE class IN ('4-NOT SPECIFIED', '5-LOW')), 6) AS contrast FROM query_effects""")
def g15(t: Tables):
    """Mean effect of one class minus the pooled mean of two others."""
    return V.rounded(RS.mean_contrast(query_effects(t), "e_mrr", "class", ["1-URGENT"], ["4-NOT SPECIFIED", "5-LOW"]))


@query("g16_quartile_effects", """
SELECT split, CAST(least(greatest(ceil(4 * r / n), 1), 4) AS BIGINT) AS quartile, count(*) AS n, min(list_len) AS feature_min, max(list_len) AS feature_max, round(avg(e_mrr), 6) AS mean_effect
FROM (SELECT *, rank() OVER (PARTITION BY split ORDER BY list_len) + (count(*) OVER (PARTITION BY split, list_len) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY split) AS n
  FROM query_effects) GROUP BY ALL""")
def g16(t: Tables):
    """Mean effect by average-rank quartile of list length."""
    return V.rounded(D.quartile_effects(query_effects(t).select("split", "list_len", "e_mrr"), ["split"], "list_len", "e_mrr"))


def descriptors(t: Tables, names: tuple[str, ...] = V.POOLS) -> DataFrame:
    """List descriptors per (pool, query) against the historical lists, for covered queries."""
    if len(names) > 2:
        V.share(t, V.again(names))
    truth, reference, out = V.queries(t), V.kept_lists(t, "historical"), None
    for name in names:
        part = D.list_descriptors(
            reference if name == "historical" else V.lists(t, name), reference, truth, lambda a, b: 1 - F.abs(a - b) * 10, lambda a, b: F.abs(a - b), "feat")
        part = part.withColumn("pool", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


for _name in V.POOLS:
    cte(f"desc_{_name}", f"""
SELECT '{_name}' AS pool, l.query_id, count(*) AS length, coalesce(max(r.rn), 0) AS reference_length, count(h.rank) AS shared,
  round(count(h.rank) / (count(*) + coalesce(max(r.rn), 0) - count(h.rank)), 12) AS jaccard, max(k.tau) AS kendall, max(e.ent) AS entropy, max(pd.d) AS pair_distance,
  max(CASE WHEN l.cand_key <> q.truth_key THEN 1 - abs(l.feat - tr.feat) * 10 END) AS near_miss
FROM top_{_name} l JOIN qs q ON q.query_id = l.query_id JOIN top_{_name} tr ON tr.query_id = l.query_id AND tr.cand_key = q.truth_key
LEFT JOIN top_historical h ON h.query_id = l.query_id AND h.cand_key = l.cand_key
LEFT JOIN (SELECT query_id, max(n) AS rn FROM top_historical GROUP BY query_id) r ON r.query_id = l.query_id
LEFT JOIN (SELECT a.query_id, sum(sign(a.rank - b.rank) * sign(ha.rank - hb.rank)) / count(*) AS tau FROM top_{_name} a JOIN top_{_name} b ON a.query_id = b.query_id AND a.rank < b.rank
  JOIN top_historical ha ON ha.query_id = a.query_id AND ha.cand_key = a.cand_key JOIN top_historical hb ON hb.query_id = b.query_id AND hb.cand_key = b.cand_key GROUP BY a.query_id) k ON k.query_id = l.query_id
LEFT JOIN (SELECT query_id, CASE WHEN count(*) > 1 AND sum(greatest(prior, 0)) > 0 THEN (ln(sum(greatest(prior, 0))) - sum(CASE WHEN prior > 0 THEN prior * ln(prior) ELSE 0 END) / sum(greatest(prior, 0))) / ln(count(*)) END AS ent
  FROM top_{_name} GROUP BY query_id) e ON e.query_id = l.query_id
LEFT JOIN (SELECT a.query_id, avg(abs(a.feat - b.feat)) AS d FROM top_{_name} a JOIN top_{_name} b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id) pd ON pd.query_id = l.query_id
GROUP BY l.query_id""")
cte("descs", " UNION ALL ".join(f"SELECT * FROM desc_{n}" for n in V.POOLS))
DESCRIPTORS = ("length", "shared", "jaccard", "kendall", "entropy", "pair_distance", "near_miss")
_LONG = " UNION ALL ".join(f"SELECT pool, query_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM descs" for c in DESCRIPTORS)
cte("desc_long", _LONG)


def descriptor_rows(t: Tables, names: tuple[str, ...] = V.POOLS) -> DataFrame:
    wide = descriptors(t, names).select("pool", "query_id", *[F.col(c).cast("double").alias(c) for c in DESCRIPTORS])
    return materialise(wide).unpivot(["pool", "query_id"], list(DESCRIPTORS), "feature", "value")


@query("g17_descriptor_summary", """
SELECT pool, feature, count(value) AS n_defined, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM desc_long GROUP BY pool, feature""")
def g17(t: Tables):
    """Defined count, mean and median per pool and descriptor."""
    rows = descriptor_rows(t)
    means = rows.groupBy("pool", "feature").agg(F.count("value").alias("n_defined"), F.avg("value").alias("mean"))
    medians = quantiles(rows, ["pool", "feature"], "value", [0.5], "_q").select("pool", "feature", F.col("_q")[0].alias("median"))
    return V.rounded(means.join(medians, ["pool", "feature"], "left"))


@query("g17_coverage_selection", """
SELECT pool, count(*) AS n_covered, round(count(*) / (SELECT count(*) FROM plain_qs), 6) AS coverage, count(c.query_id) AS in_common, round(count(c.query_id) / count(*), 6) AS common_share
FROM covered_in LEFT JOIN common_ids c USING (query_id) GROUP BY pool""")
def g17_coverage(t: Tables):
    """Coverage of each pool and the part of it in the common cohort."""
    V.share(t, V.again(V.POOLS))
    covered = None
    for name in V.POOLS:
        part = covered_ids(t, name).withColumn("pool", F.lit(name))
        covered = part if covered is None else covered.unionByName(part)
    total = V.plain_queries(t).agg(rows_().alias("_total"))
    # One row per query with its rows in each pool; a query is common that has one in all.
    per = covered.groupBy("query_id").agg(*[F.count_if(F.col("pool") == name).alias(name) for name in V.POOLS])
    common = reduce(lambda a, b: a & b, [F.col(name) > 0 for name in V.POOLS])
    counts = per.groupBy(common.alias("_common")).agg(*[F.sum(name).alias(name) for name in V.POOLS])
    out = counts.unpivot(["_common"], list(V.POOLS), "pool", "k").filter("k > 0").groupBy("pool").agg(
        F.sum("k").alias("n_covered"), F.sum(F.when(F.col("_common"), F.col("k")).otherwise(0)).alias("in_common"))
    return V.rounded(with_row(out, total).select(
        "pool", "n_covered", (F.col("n_covered") / F.col("_total")).alias("coverage"), "in_common",
        (F.col("in_common") / F.col("n_covered")).alias("common_share")))


cte("stacked", """
SELECT l.norm, l.feat FROM train_pairs p JOIN labelled l ON l.query_id = p.query_id AND l.cand_key = p.pos_key
UNION ALL SELECT l.norm, l.feat FROM train_pairs p JOIN labelled l ON l.query_id = p.query_id AND l.cand_key = p.neg_key""")


@query("g18_clipping_audit", """
SELECT round(avg(CASE WHEN (norm - mn) / sn < -1.5 THEN 1.0 ELSE 0 END), 6) AS norm_below, round(avg(CASE WHEN (norm - mn) / sn > 1.5 THEN 1.0 ELSE 0 END), 6) AS norm_above,
  round(avg(CASE WHEN (feat - mf) / sf < -1.5 THEN 1.0 ELSE 0 END), 6) AS feat_below, round(avg(CASE WHEN (feat - mf) / sf > 1.5 THEN 1.0 ELSE 0 END), 6) AS feat_above,
  round(avg(CASE WHEN abs((norm - mn) / sn) > 1.5 OR abs((feat - mf) / sf) > 1.5 THEN 1.0 ELSE 0 END), 6) AS any_clipped,
  avg(CASE WHEN abs((norm - mn) / sn) > 1.5 OR abs((feat - mf) / sf) > 1.5 THEN 1.0 ELSE 0 END) > 0.1 AS flagged
FROM labelled, (SELECT avg(norm) AS mn, greatest(stddev_pop(norm), 1e-6) AS sn, avg(feat) AS mf, greatest(stddev_pop(feat), 1e-6) AS sf FROM stacked) WHERE split = 'test'""")
def g18(t: Tables):
    """Share of test candidates beyond the clip of the training normaliser."""
    fitted = D.fit_normaliser(train_pairs(t), ["norm", "feat"])
    return V.rounded(D.clipping(labelled_lists(t).filter(F.col("split") == "test"), fitted, ["norm", "feat"], 1.5))


@query("g19_prior_summary", """
SELECT pool, count(*) AS n_lists, round(avg(sk), 6) AS mean_skew, count(sk) AS skew_defined, round(quantile_cont(gap, 0.5), 6) AS median_gap, count(gap) AS gap_defined,
  round(avg(CASE WHEN d < n THEN 1.0 ELSE 0 END), 6) AS tie_fraction FROM (
  SELECT pool, query_id, count(*) AS n, count(DISTINCT prior) AS d, CASE WHEN count(*) > 2 AND min(prior) <> max(prior) THEN skewness(prior) END AS sk,
    max(prior) FILTER (WHERE rank = 1) - max(prior) FILTER (WHERE rank = 2) AS gap FROM (SELECT * FROM top_historical UNION ALL SELECT * FROM top_beta) GROUP BY ALL) GROUP BY pool""")
def g19(t: Tables):
    """Skewness, top gap and ties of the priors within lists."""
    return V.rounded(D.prior_summary(V.all_lists(t, ("historical", "beta")), ["pool"]))


REPLICATES = (1, 2, 3)


def replicate_rows(t: Tables) -> DataFrame:
    """Three noisy replicates of a value per part, with its stratum."""
    rows = t.part.select("p_partkey", (F.col("p_retailprice") / 100).alias("v"),
                         S.larger_stratum(F.col("p_size") % 4, F.col("p_size") % 7).alias("stratum"))
    for r in REPLICATES:
        rows = with_random(rows, "_u", 100 + r, "p_partkey")
        rows = rows.withColumn(f"v_{r}", F.col("v") + F.col("_u") / SPAN).drop("_u")
    return rows


cte("replicas", "SELECT p_partkey, p_retailprice / 100 AS v, CASE WHEN greatest(p_size % 4, p_size % 7) = 0 THEN '0' WHEN greatest(p_size % 4, p_size % 7) <= 4 THEN '1-4' ELSE '>=5' END AS stratum, "
    + ", ".join(f"{random_sql(f'u{r}', 100 + r, 'p_partkey')}, v + u{r} / {SPAN}::DOUBLE AS v_{r}" for r in REPLICATES) + " FROM part")


@query("g20_replicate_stability", " UNION ALL ".join(f"""
SELECT {a} AS replicate_a, {b} AS replicate_b, stratum, count(*) AS n, round(avg(abs(v_{a} - v_{b})), 6) AS mean, round(stddev_pop(abs(v_{a} - v_{b})), 6) AS sd,
  round(min(abs(v_{a} - v_{b})), 6) AS min, round(max(abs(v_{a} - v_{b})), 6) AS max, round(quantile_cont(abs(v_{a} - v_{b}), 0.25), 6) AS q250,
  round(quantile_cont(abs(v_{a} - v_{b}), 0.5), 6) AS q500, round(quantile_cont(abs(v_{a} - v_{b}), 0.75), 6) AS q750, round(corr(v_{a}, v_{b}), 6) AS pearson, round(corr(ra, rb), 6) AS spearman
FROM (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY v_{a}) + (count(*) OVER (PARTITION BY stratum, v_{a}) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY stratum ORDER BY v_{b}) + (count(*) OVER (PARTITION BY stratum, v_{b}) - 1) / 2.0 AS rb FROM replicas) GROUP BY stratum"""
    for a, b in ((1, 2), (1, 3), (2, 3))))
def g20(t: Tables):
    """Agreement of every pair of replicates by stratum."""
    return V.rounded(D.replicate_stability(replicate_rows(t), REPLICATES, ["stratum"]))


@query("g20_variation", """
SELECT s AS stratum, count(*) AS n, count(cv) AS defined, round(avg(cv), 6) AS mean_cv, round(quantile_cont(cv, 0.5), 6) AS median_cv FROM (
  SELECT unnest(CASE WHEN stratum = '>=5' THEN ['all', '>=5'] ELSE ['all', '0-4', stratum] END) AS s,
    sqrt(((v_1 - m) * (v_1 - m) + (v_2 - m) * (v_2 - m) + (v_3 - m) * (v_3 - m)) / 2) / abs(m) AS cv
  FROM (SELECT *, (v_1 + v_2 + v_3) / 3 AS m FROM replicas)) GROUP BY s""")
def g20_variation(t: Tables):
    """Coefficient of variation in overlapping strata."""
    from rankweave.operators.features import overlapping_strata
    rows = replicate_rows(t).withColumn("cv", D.variation(None, REPLICATES)).withColumnRenamed("stratum", "leaf")
    rows = overlapping_strata(rows, "leaf")
    out = rows.groupBy("stratum").agg(rows_().alias("n"), F.count("cv").alias("defined"), F.avg("cv").alias("mean_cv"))
    median = quantiles(rows, ["stratum"], "cv", [0.5], "_q").select("stratum", F.col("_q")[0].alias("median_cv"))
    return V.rounded(out.join(median, "stratum"))


@query("g21_replicate_average", """
SELECT p_partkey, round((v_1 + v_2 + v_3) / 3, 6) AS value, v AS fixed FROM replicas""")
def g21(t: Tables):
    """Mean over replicates; other columns must not vary."""
    long = replicate_rows(t).select("p_partkey", F.col("v").alias("fixed"), F.explode(F.array(*[F.col(f"v_{r}") for r in REPLICATES])).alias("value"))
    return V.rounded(D.average_replicates(long, ["p_partkey"], ["value"], ["fixed"]))


@query("g22_normaliser_fit", """
SELECT round(avg(norm), 6) AS m_norm, round(avg(feat), 6) AS m_feat, round(greatest(stddev_pop(norm), 1e-6), 6) AS s_norm, round(greatest(stddev_pop(feat), 1e-6), 6) AS s_feat FROM stacked""")
def g22(t: Tables):
    """Mean and deviation per feature over stacked pairs."""
    return V.rounded(D.fit_normaliser(train_pairs(t), ["norm", "feat"]))


cte("gaps", "SELECT query_id, max(prior) FILTER (WHERE rank = 1) - max(prior) FILTER (WHERE rank = 2) AS gap FROM top_historical GROUP BY query_id")
cte("gap_groups", """
SELECT query_id, gap, CASE WHEN gap IS NULL THEN -1 WHEN gap <= c[1] THEN 0 WHEN gap <= c[2] THEN 1 WHEN gap <= c[3] THEN 2 ELSE 3 END AS gap_group
FROM gaps, (SELECT quantile_cont(gap, [0.25, 0.5, 0.75]) AS c FROM gaps)""")


@query("g23_gap_groups", "SELECT query_id, round(gap, 6) AS gap, gap_group FROM gap_groups")
def g23(t: Tables):
    """Quartile group of the top-1 minus top-2 prior gap."""
    return V.rounded(D.gap_groups(V.lists(t, "historical")))


@query("g24_config_selection", """
WITH c AS (SELECT prior_rank % 4 AS config, avg(d_mrr) AS mean, count(DISTINCT seed) AS s FROM effects_historical GROUP BY 1)
SELECT min(config) AS config, round(arg_min(mean, config), 6) AS mean FROM c WHERE s = 5 AND (SELECT max(mean) FROM c) - mean <= 1e-12""")
def g24(t: Tables):
    """Best mean validation score over a complete grid; ties to the lowest index."""
    trials = V.effects(t).groupBy((F.col("prior_rank") % 4).alias("config")).agg(
        F.avg("d_mrr").alias("mean"), F.count_distinct("seed").alias("s")).filter(F.col("s") == len(V.SEEDS)).drop("s")
    return V.rounded(X.convergence_choice(trials))


@query("g25_variant_deltas", """
WITH v AS (SELECT seed % 3 AS variant, avg(1.0::DOUBLE / aug_rank) AS mean, stddev_samp(1.0::DOUBLE / aug_rank) AS sd FROM effects_historical GROUP BY 1)
SELECT variant, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - (SELECT mean FROM v WHERE variant = 0), 6) AS delta FROM v""")
def g25(t: Tables):
    """Variant means and their difference from the base variant."""
    rr = S.reciprocal_rank(F.col("aug_rank"))
    v = V.effects(t).groupBy((F.col("seed") % 3).alias("variant")).agg(F.avg(rr).alias("mean"), F.stddev_samp(rr).alias("sd"))
    base = v.filter(F.col("variant") == 0).select(F.col("mean").alias("_base"))
    return V.rounded(with_row(v, base).withColumn("delta", F.col("mean") - F.col("_base")).drop("_base"))


@query("g26_round_trip_rates", """
SELECT pool, count(*) AS n, round(avg(CASE WHEN b1 = truth_key THEN 1.0 ELSE 0 END), 6) AS beam1, round(avg(CASE WHEN list_contains(beams, truth_key) THEN 1.0 ELSE 0 END), 6) AS beam5,
  count(*) FILTER (WHERE truth_key = -1) AS invalid FROM (
  SELECT l.pool, q.truth_key, list(l.cand_key ORDER BY l.rank)[1:5] AS beams, beams[1] AS b1 FROM (SELECT * FROM top_historical UNION ALL SELECT * FROM top_beta) l JOIN qs q USING (query_id)
  GROUP BY l.pool, q.query_id, q.truth_key) GROUP BY pool""")
def g26(t: Tables):
    """Exact recovery in the first and in any of five beams."""
    lists = V.all_lists(t, ("historical", "beta")).filter(F.col("rank") <= 5)
    beams = lists.groupBy("pool", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_key"))).alias("b"))
    rows = beams.join(V.queries(t).select("query_id", "truth_key"), "query_id")
    any_ = F.exists("b", lambda x: x["cand_key"] == F.col("truth_key"))
    return V.rounded(rows.groupBy("pool").agg(
        rows_().alias("n"), F.avg((F.col("b")[0]["cand_key"] == F.col("truth_key")).cast("double")).alias("beam1"),
        F.avg(any_.cast("double")).alias("beam5"), F.count_if(F.col("truth_key") == -1).alias("invalid")))


@query("g27_prior_agreement", """
SELECT round(avg(CASE WHEN top_score = top_prior THEN 1.0 ELSE 0 END), 6) AS agreement, round(avg(tau), 6) AS mean_tau, count(tau) AS tau_defined, count(*) - count(tau) AS tau_undefined
FROM (SELECT query_id, arg_max(rank, {'s': augmented_42, 'r': -rank}) AS top_score, arg_max(rank, {'s': prior, 'r': -rank}) AS top_prior FROM scored_beta GROUP BY query_id)
LEFT JOIN (SELECT a.query_id, sum(sign(a.prior - b.prior) * sign(a.augmented_42 - b.augmented_42)) / nullif(sqrt(sum(CASE WHEN a.prior <> b.prior THEN 1 ELSE 0 END) * sum(CASE WHEN a.augmented_42 <> b.augmented_42 THEN 1 ELSE 0 END)::DOUBLE), 0) AS tau
  FROM scored_beta a JOIN scored_beta b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id) USING (query_id)""")
def g27(t: Tables):
    """How often score and prior choose the same first item, and their order concordance."""
    scored = V.scored_lists(t, "beta", (42,))
    packed = scored.groupBy("query_id").agg(
        F.max_by("rank", F.struct("augmented_42", -F.col("rank"))).alias("a"), F.max_by("rank", F.struct("prior", -F.col("rank"))).alias("b"),
        F.array_sort(F.collect_list(F.struct("rank", "prior", "augmented_42"))).alias("items"))
    tau = D.concordance(F.col("items"), lambda v: v["prior"], lambda v: v["augmented_42"])
    rows = packed.select((F.col("a") == F.col("b")).cast("double").alias("same"), tau.alias("tau"))
    return V.rounded(rows.agg(F.avg("same").alias("agreement"), F.avg("tau").alias("mean_tau"), F.count("tau").alias("tau_defined"),
                              (rows_() - F.count("tau")).alias("tau_undefined")))


@query("g29_grid_gate", """
SELECT count(*) FILTER (WHERE g > 0) AS positive, count(*) FILTER (WHERE g = 0) AS zero, count(*) FILTER (WHERE g < 0) AS negative, count(*) FILTER (WHERE g > 0) >= 20 AS gate
FROM (SELECT class, seed, avg(d_mrr) AS g FROM effects_historical GROUP BY class, seed)""")
def g29(t: Tables):
    """Signs over the cells of a grid, with the gate on positive cells."""
    cells = V.effects(t).groupBy("class", "seed").agg(F.avg("d_mrr").alias("g"))
    return M.sign_counts(cells, [], "g").withColumn("gate", F.col("positive") >= 20)


@query("g30_seed_signs", """
SELECT class, count(*) FILTER (WHERE g > 0) AS positive, count(*) FILTER (WHERE g = 0) AS zero, count(*) FILTER (WHERE g < 0) AS negative
FROM (SELECT class, seed, avg(d_top1) AS g FROM effects_historical GROUP BY class, seed) GROUP BY class""")
def g30(t: Tables):
    """Seeds with positive, zero and negative mean effect."""
    return M.sign_counts(V.effects(t).groupBy("class", "seed").agg(F.avg("d_top1").alias("g")), ["class"], "g")


_DIGEST_FIELDS = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c} || ';', 'n;')" for c in ("query_id", "cand_key", "rank"))


@query("g31_content_digest", "SELECT pool, count(*) AS n_rows, " + ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS digest_{i}" for i in range(4))
    + f" FROM (SELECT pool, md5({_DIGEST_FIELDS}) AS h FROM all_tops) GROUP BY pool")
def g31(t: Tables):
    """Order-aware digest of every pool's lists."""
    return A.text_digest(V.all_lists(t), ["query_id", "cand_key", "rank"], ["pool"])


_SCORE_LONG = " UNION ALL ".join(f"SELECT query_id, {s} AS seed, augmented_{s} AS score, -rank AS prior FROM scored_historical" for s in (42, 43))


@query("g32_score_diagnostics", f"""
WITH s AS ({_SCORE_LONG}), r AS (SELECT *, rank() OVER (PARTITION BY query_id, seed ORDER BY score) + (count(*) OVER (PARTITION BY query_id, seed, score) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY query_id, seed ORDER BY prior) AS rp FROM s),
l AS (SELECT query_id, seed, count(*) AS n, stddev_pop(score) AS sd, max(score) - min(score) AS rg, CASE WHEN count(*) > 1 AND min(score) <> max(score) THEN corr(rs, rp) END AS rho FROM r GROUP BY query_id, seed)
SELECT CASE WHEN grouping(seed) = 1 THEN 'pooled' ELSE CAST(seed AS VARCHAR) END AS seed, count(*) AS n_lists, count(*) FILTER (WHERE n = 1) AS singletons, count(rho) AS defined,
  count(*) FILTER (WHERE rho > 1e-12) AS positive, count(*) FILTER (WHERE abs(rho) <= 1e-12) AS zero, count(*) FILTER (WHERE rho < -1e-12) AS negative,
  round(avg(sd), 6) AS mean_sd, round(avg(rg), 6) AS mean_range, round(avg(rho), 6) AS mean_rho FROM l GROUP BY GROUPING SETS ((), (seed))""")
def g32(t: Tables):
    """Spread of scores within lists and their rank correlation with the prior."""
    scored = V.scored_lists(t, "historical", (42, 43))
    long = scored.select("query_id", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"augmented_{s}").alias("score"), (-F.col("rank")).alias("prior"))
                                                         for s in (42, 43)])).alias("c")).select("query_id", "c.*")
    out = D.diagnostic_summary(D.score_diagnostics(long, ["query_id", "seed"], "score", "prior"), "seed")
    return V.rounded(out.withColumn("seed", F.when(F.col("pooled") == 1, "pooled").otherwise(F.col("seed").cast("string"))).drop("pooled"))


@query("g33_token_inventory", """
SELECT tok AS token, count(*) AS uses FROM (SELECT trim(unnest(string_split(text, '.')), ' ') AS tok FROM documents) WHERE tok <> '' GROUP BY tok""")
def g33(t: Tables):
    """Distinct trimmed tokens of all texts."""
    return D.token_inventory(t.documents, "text")[0]


@query("g33_token_audit", """
SELECT count(*) AS pieces, count(*) FILTER (WHERE tok = '') AS empty, count(DISTINCT CASE WHEN tok <> '' THEN tok END) AS distinct_tokens
FROM (SELECT trim(unnest(string_split(text, '.')), ' ') AS tok FROM documents)""")
def g33_audit(t: Tables):
    """Pieces, empty pieces and distinct tokens."""
    return D.token_inventory(t.documents, "text")[1]


@query("g34_stratified_expansion", """
SELECT p.stratum, p.population, coalesce(CAST(b.att AS BIGINT), 0) AS attempted, round(coalesce(p.population * b.cost / b.att, 0), 4) AS estimate,
  round(coalesce(p.population * b.lo, 0), 4) AS lower, round(coalesce(p.population * b.hi * 1.25, 0), 4) AS upper
FROM (SELECT o_orderpriority AS stratum, count(*) AS population FROM orders GROUP BY 1) p LEFT JOIN (
  SELECT stratum, sum(att) AS att, sum(cost) AS cost, min(cost / att) AS lo, max(cost / att) AS hi FROM (
    SELECT o_orderpriority AS stratum, o_custkey % 20 AS batch, count(*) AS att, sum(o_totalprice / 1000) AS cost FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) GROUP BY stratum) b
  ON b.stratum = p.stratum""")
def g34(t: Tables):
    """Post-stratified total cost with an engineering range."""
    rows = t.orders.select(F.col("o_orderpriority").alias("stratum"), "o_custkey", "o_totalprice", "o_orderstatus")
    batches = rows.filter(F.col("o_orderstatus") == "F").groupBy("stratum", (F.col("o_custkey") % 20).alias("batch")).agg(
        rows_().alias("attempted"), F.sum(F.col("o_totalprice") / 1000).alias("cost"))
    return V.rounded(D.expansion(batches, rows.groupBy("stratum").agg(rows_().alias("population")), "stratum"), 4)


@query("g35_system_comparison", """
SELECT k.k, round(avg(CASE WHEN prior_rank BETWEEN 1 AND k THEN 1.0 ELSE 0 END), 6) AS prior, round(avg(CASE WHEN baseline_42 BETWEEN 1 AND k THEN 1.0 ELSE 0 END), 6) AS baseline,
  round(avg(CASE WHEN augmented_42 BETWEEN 1 AND k THEN 1.0 ELSE 0 END), 6) AS augmented,
  round(avg(CASE WHEN augmented_42 BETWEEN 1 AND k THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN baseline_42 BETWEEN 1 AND k THEN 1.0::DOUBLE ELSE 0 END), 6) AS augmented_minus_baseline,
  round(avg(CASE WHEN augmented_42 BETWEEN 1 AND k THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN prior_rank BETWEEN 1 AND k THEN 1.0::DOUBLE ELSE 0 END), 6) AS augmented_minus_prior,
  max(list_len) <= k AS vacuous FROM wide_historical, (SELECT unnest([1, 3, 10]) AS k) k GROUP BY k.k""")
def g35(t: Tables):
    """Three systems on the same lists, with differences and a flag for a vacuous k."""
    wide = V.wide_ranks(t, "historical", (42,))
    systems = F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.col(c).alias("rank")) for n, c in (
        ("prior", "prior_rank"), ("baseline", "baseline_42"), ("augmented", "augmented_42"))]))
    rows = wide.select("list_len", systems.alias("s")).select("list_len", "s.*")
    rows = rows.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))))
    hit = F.avg(F.when((F.col("rank") >= 1) & (F.col("rank") <= F.col("k")), 1.0).otherwise(0.0))
    longest = wide.agg(F.max("list_len").alias("_longest"))
    out = rows.groupBy("k").pivot("system", ["prior", "baseline", "augmented"]).agg(hit)
    return V.rounded(with_row(out, longest).withColumns({
        "augmented_minus_baseline": F.col("augmented") - F.col("baseline"), "augmented_minus_prior": F.col("augmented") - F.col("prior"),
        "vacuous": F.col("_longest") <= F.col("k")}).drop("_longest"))


@query("g36_association_matrix", """
WITH d AS (SELECT x.pool, x.feature, x.value, e.m FROM desc_long x JOIN (SELECT pool, query_id, avg(d_mrr) AS m FROM all_effects GROUP BY ALL) e ON e.pool = x.pool AND e.query_id = x.query_id WHERE x.value IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY pool, feature ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY pool, feature, round(value, 9)) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY pool, feature ORDER BY round(m, 9)) + (count(*) OVER (PARTITION BY pool, feature, round(m, 9)) - 1) / 2.0 AS ry FROM d),
c AS (SELECT pool, feature, CASE WHEN min(rx) <> max(rx) AND min(ry) <> max(ry) AND count(*) >= 3 THEN round(corr(rx, ry), 4) END AS rho FROM r GROUP BY pool, feature)
SELECT feature, max(rho) FILTER (WHERE pool = 'alpha') AS alpha, max(rho) FILTER (WHERE pool = 'beta') AS beta FROM c WHERE pool IN ('alpha', 'beta') GROUP BY feature""")
def g36(t: Tables):
    """Rank correlation of descriptors and effects, one column per pool."""
    names = ("alpha", "beta")
    means = V.effects(t, names).groupBy("pool", "query_id").agg(F.round(F.avg("d_mrr"), 9).alias("m"))
    rows = materialise(descriptor_rows(t, names).withColumn("value", F.round("value", 9)).join(means, ["pool", "query_id"]))
    rho = D.correlation(rows, ["pool", "feature"], "value", "m", True)
    return V.rounded(rho.groupBy("feature").pivot("pool", list(names)).agg(F.max("correlation")), 4)
