"""Window operators (W01-W13) and the case selection (T04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import scores as S
from rankweave.operators import audits as A
from rankweave.operators import diagnostics as D
from rankweave.operators import pools as P
from rankweave.plans import views as V
from rankweave.plans.aggregations import query_effects
from rankweave.plans.registry import Tables, cte, query
from rankweave.scale import midranked, ranked
from rankweave.session import materialise


@query("w01_prior_order", "SELECT query_id, cand_key, rank, n FROM pool_historical")
def w01(t: Tables):
    """Whole lists by prior descending, ties by first line."""
    return V.ordered(t, "historical").select("query_id", "cand_key", "rank", "n")


@query("w02_normalised_rank", "SELECT query_id, cand_key, round(1.0::DOUBLE - (rank - 1) / greatest(n - 1, 1), 6) AS norm FROM pool_beta")
def w02(t: Tables):
    """Rank mapped to 1..0 within each list."""
    rows = V.ordered(t, "beta")
    return V.rounded(rows.select("query_id", "cand_key", S.normalised_rank(F.col("rank"), F.col("n")).alias("norm")))


_MID = """rank() OVER (PARTITION BY query_id ORDER BY prior) + (count(*) OVER (PARTITION BY query_id, prior) - 1) / 2.0"""


@query("w03_midrank_score", f"""
SELECT query_id, cand_key, round(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE (m - 1) / (n - 1) END, 6) AS score FROM (SELECT *, {_MID} AS m FROM pool_beta)""")
def w03(t: Tables):
    """Average rank of exact ties as a score from 0 to 1; a single item scores 1."""
    rows = midranked(V.pool(t, "beta"), ["query_id"], F.col("prior"), "m", "n")
    return V.rounded(rows.select("query_id", "cand_key", S.normalised_midrank(F.col("m"), F.col("n")).alias("score")))


@query("w04_average_rank", f"SELECT query_id, cand_key, round({_MID}, 6) AS average_rank FROM pool_beta")
def w04(t: Tables):
    """Ascending average ranks."""
    rows = midranked(V.pool(t, "beta"), ["query_id"], F.col("prior"), "average_rank")
    return V.rounded(rows.select("query_id", "cand_key", "average_rank"))


@query("w05_score_rank_of_truth", "SELECT query_id, list_len, prior_rank, baseline_42, augmented_42 FROM wide_beta")
def w05(t: Tables):
    """Place of the recorded answer under two scores; ties keep list order."""
    return V.wide_ranks(t, "beta", (42,)).select("query_id", "list_len", "prior_rank", "baseline_42", "augmented_42")


@query("w06_adjacent_inversions", """
SELECT query_id, count(*) AS inversions FROM (SELECT a.query_id, b.prior, lead(b.prior) OVER (PARTITION BY a.query_id ORDER BY a.rank) AS nxt
  FROM pool_historical a JOIN pool_beta b ON a.query_id = b.query_id AND a.cand_key = b.cand_key) WHERE prior < nxt GROUP BY query_id""")
def w06(t: Tables):
    """Adjacent increases of one pool's prior in the order of another."""
    aligned = A.aligned_priors(V.ordered(t, "historical"), V.pool(t, "beta"))
    placed = ranked(aligned.select("query_id", "cand_key", F.col("rank").alias("_r"), "other_prior"), ["query_id"], [F.col("_r")], "rank")
    return P.adjacent_inversions(placed, "other_prior").groupBy("query_id").agg(F.count(F.lit(1)).alias("inversions"))


@query("w07_top_gap", "SELECT query_id, round(gap, 6) AS gap FROM gaps")
def w07(t: Tables):
    """Top-1 minus top-2 prior, undefined for lists of one."""
    rows = D.list_moments(V.lists(t, "historical"), ["query_id"], "prior")
    return V.rounded(rows.select("query_id", "gap"))


cte("tests", """
SELECT split, class, seed, round(CAST(sum(CASE WHEN d_mrr < 0 THEN 1 ELSE 0 END) + 1 AS DOUBLE) / (count(*) + 1), 9) AS p_value FROM effects_historical GROUP BY ALL""")


def tests_table(t: Tables):
    """Family of p-values, written before it is ordered several times."""
    worse = F.count_if(F.col("d_mrr") < 0) + 1
    return materialise(V.effects(t).groupBy("split", "class", "seed").agg(
        F.round(worse.cast("double") / (F.count(F.lit(1)) + 1), 9).alias("p_value")))


@query("w08_benjamini_hochberg", """
SELECT split, class, seed, round(least(min(p_value * m / i) OVER (PARTITION BY split ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_bh FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY p_value, class, seed) AS i, count(*) OVER (PARTITION BY split) AS m FROM tests)""")
def w08_bh(t: Tables):
    """Step-up adjustment within each family."""
    return V.rounded(D.benjamini_hochberg(tests_table(t), ["split"], ["class", "seed"]).select("split", "class", "seed", "p_bh"))


@query("w08_holm", """
SELECT split, class, seed, round(least(max(p_value * (m - i + 1)) OVER (PARTITION BY split ORDER BY i ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_holm FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY p_value, class, seed) AS i, count(*) OVER (PARTITION BY split) AS m FROM tests)""")
def w08_holm(t: Tables):
    """Step-down adjustment within each family."""
    return V.rounded(D.holm(tests_table(t), ["split"], ["class", "seed"]).select("split", "class", "seed", "p_holm"))


@query("w09_rank_quartile", """
SELECT class, quartile, count(*) AS n FROM (SELECT class, CAST(least(greatest(ceil(4 * r / n), 1), 4) AS BIGINT) AS quartile FROM (
  SELECT class, rank() OVER (PARTITION BY class ORDER BY prior_rank) + (count(*) OVER (PARTITION BY class, prior_rank) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY class) AS n
  FROM query_effects)) GROUP BY ALL""")
def w09(t: Tables):
    """Quartiles that keep ties together, unlike ntile."""
    rows = query_effects(t).select("class", "prior_rank", "e_mrr")
    return D.quartile_effects(rows, ["class"], "prior_rank", "e_mrr").select("class", "quartile", "n")


_HASH = "sha256(concat('{seed}', chr(0), o_orderkey))"


@query("w10_hash_sample", f"""
SELECT o_orderkey, stratum FROM (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format(seed=5)}, o_orderkey) AS r FROM orders
  WHERE o_orderpriority <> '5-LOW') WHERE r <= 20 UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'""")
def w10(t: Tables):
    """Twenty rows per stratum in hash order; the last stratum whole."""
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    return D.hash_sample(rows, "o_orderkey", "stratum", 20, 5, ["5-LOW"])


@query("w10_disjoint_warmup", f"""
WITH s AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format(seed=5)}, o_orderkey) AS r FROM orders) WHERE r <= 20),
f AS (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format(seed=6)}, o_orderkey) AS turn FROM orders
  WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) AND o_orderpriority IN ('2-HIGH', '3-MEDIUM'))
SELECT o_orderkey, stratum FROM f ORDER BY turn, stratum LIMIT 15""")
def w10_warmup(t: Tables):
    """Fifteen rows in turn from two strata, disjoint from the sample."""
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    sample = D.hash_sample(rows, "o_orderkey", "stratum", 20, 5)
    return D.disjoint_warmup(rows, sample, "o_orderkey", "stratum", ["2-HIGH", "3-MEDIUM"], 15, 5)


@query("w11_first_occurrence", """
SELECT cluster_key, part, arg_min(query_id, line_no) AS query_id, min(line_no) AS line_no FROM (SELECT o_custkey AS cluster_key, l_partkey % 50 AS part, l_orderkey AS query_id,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS line_no FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL""")
def w11(t: Tables):
    """First use of each (cluster, item) pair."""
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 50).alias("part"), line.alias("line_no"))
    lines = lines.join(V.plain_queries(t).select("query_id", "cluster_key"), "query_id")
    return P.first_occurrences(lines, ["cluster_key", "part"]).select("cluster_key", "part", "query_id", "line_no")


@query("w12_rank_contiguity", """
SELECT query_id, count(*) AS n, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS contiguous FROM pool_beta WHERE cand_key % 31 <> 0 GROUP BY query_id""")
def w12(t: Tables):
    """Lists whose stored ranks are 1..n, after some rows are lost."""
    return A.contiguity(V.ordered(t, "beta").filter(F.col("cand_key") % 31 != 0))


@query("w12_key_runs", """
SELECT query_id, count(*) FILTER (WHERE nxt IS NULL OR nxt <> query_id) AS runs FROM (
  SELECT o_custkey % 40 AS query_id, lead(o_custkey % 40) OVER (ORDER BY o_orderkey) AS nxt FROM orders) GROUP BY query_id""")
def w12_runs(t: Tables):
    """How often each key starts a new run in line order."""
    return A.split_runs(t.orders.select((F.col("o_custkey") % 40).alias("query_id"), F.col("o_orderkey").alias("line_no")))


@query("w13_list_entropy", """
SELECT query_id, round(CASE WHEN count(*) > 1 AND sum(prior) > 0 THEN (ln(sum(prior)) - sum(CASE WHEN prior > 0 THEN prior * ln(prior) ELSE 0 END) / sum(prior)) / ln(count(*)) END, 6) AS entropy
FROM pool_beta GROUP BY query_id""")
def w13(t: Tables):
    """Normalised entropy of the priors of whole lists."""
    return V.rounded(D.normalised_entropy(V.pool(t, "beta"), ["query_id"]))


cte("paired_cases", """
SELECT query_id, count(*) FILTER (WHERE base_rank > 1 AND aug_rank = 1) AS promoted, count(*) FILTER (WHERE base_rank = 1 AND aug_rank > 1) AS lost,
  round(avg(base_rank - aug_rank), 6) AS gain, round(avg(base_rank), 6) AS before FROM effects_historical GROUP BY query_id""")


@query("t04_case_studies", """
WITH a AS (SELECT 'promoted_to_top1' AS category, query_id, promoted, lost, gain, before FROM paired_cases WHERE promoted > 0 ORDER BY promoted DESC, gain DESC, query_id LIMIT 2),
b AS (SELECT 'large_improvement', query_id, promoted, lost, gain, before FROM paired_cases WHERE gain > 0 AND promoted = 0 AND query_id NOT IN (SELECT query_id FROM a) ORDER BY gain DESC, query_id LIMIT 1),
c AS (SELECT 'unchanged', query_id, promoted, lost, gain, before FROM paired_cases WHERE gain = 0 AND before > 1 ORDER BY query_id LIMIT 1),
d AS (SELECT 'lost_top1', query_id, promoted, lost, gain, before FROM paired_cases WHERE lost > 0 AND query_id NOT IN (SELECT query_id FROM a) ORDER BY lost DESC, gain, query_id LIMIT 1),
e AS (SELECT 'degraded', query_id, promoted, lost, gain, before FROM paired_cases WHERE gain < 0 AND query_id NOT IN (SELECT query_id FROM d) ORDER BY gain, query_id LIMIT 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e),
f AS (SELECT 'additional', query_id, promoted, lost, gain, before FROM paired_cases WHERE query_id NOT IN (SELECT query_id FROM u) ORDER BY gain DESC, query_id LIMIT (SELECT 6 - count(*) FROM u))
SELECT * FROM u UNION ALL SELECT * FROM f""")
def t04(t: Tables):
    """Six example queries, picked category by category without reuse."""
    b, a = F.col("base_rank"), F.col("aug_rank")
    paired = V.effects(t).groupBy("query_id").agg(
        F.count_if((b > 1) & (a == 1)).alias("promoted"), F.count_if((b == 1) & (a > 1)).alias("lost"),
        F.round(F.avg(b - a), 6).alias("gain"), F.round(F.avg(b), 6).alias("before"))
    return D.case_studies(materialise(paired))
