"""Paired resampling inference (R01-R17) and the summaries built on it.

The oracle statements repeat the same counter-based draws in SQL, so even intervals and
p-values are compared exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import scores as S
from rankweave.operators import diagnostics as D
from rankweave.operators import metrics as M
from rankweave.operators import pools as P
from rankweave.operators import resample as RS
from rankweave.plans import views as V
from rankweave.plans.aggregations import query_effects
from rankweave.plans.joins import common_cohort
from rankweave.plans.registry import Tables, cte, query
from rankweave.rng import random_sql
from rankweave.session import materialise, materialise_by

# Draws of the registered queries: as many as their SQL can enumerate.  Every query function takes another
# count; published analyses draw 10,000 bootstrap samples and 100,000 signs or permutations (see bench.py).
DRAWS = 200
METRICS = ("top1", "mrr")
SEEDS = V.SEEDS


def totals_sql(name: str, source: str, values: Sequence[str], by: Sequence[str] = (), cluster: str = "cluster_key",
               per_seed: bool = False) -> None:
    """Cluster totals of per-(query, seed) effects as a named piece of SQL."""
    cells = [f"sum({v}) / {len(SEEDS)} AS s_{v}" for v in values]
    if per_seed:
        cells += [f"sum({v}) FILTER (WHERE seed = {s}) AS s_{v}_{s}" for v in values for s in SEEDS]
    keys = "".join(f"{c}, " for c in by)
    cte(name, f"SELECT {keys}{cluster} AS cluster, count(*) / {len(SEEDS)} AS n, {', '.join(cells)} FROM {source} GROUP BY {keys}{cluster}")


def draws_sql(name: str, totals: str, values: Sequence[str], draws: int, seed: int, strata: Sequence[str] = ()) -> None:
    """Sums per draw over clusters picked with replacement, as pieces of SQL."""
    keys = "".join(f"{c}, " for c in strata)
    part = f"PARTITION BY {', '.join(strata)} " if strata else ""
    cte(f"{name}_idx", f"SELECT *, row_number() OVER ({part}ORDER BY cluster) - 1 AS idx, count(*) OVER ({part}) AS size FROM {totals}")
    cte(f"{name}_slots", f"""
SELECT {keys}draw, r % size AS idx FROM (SELECT {keys}size, draw, {random_sql("r", seed, "1", "draw", "slot")}
  FROM (SELECT {keys}size, idx AS slot, unnest(range(0, {draws})) AS draw FROM {name}_idx))""")
    using = "".join(f"s.{c} = i.{c} AND " for c in strata)
    cte(name, f"""
SELECT {"".join(f"s.{c}, " for c in strata)}s.draw, {", ".join(f"sum(i.{v}) AS {v}" for v in values)} FROM {name}_slots s JOIN {name}_idx i ON {using}s.idx = i.idx
GROUP BY {"".join(f"s.{c}, " for c in strata)}s.draw""")


def weights_sql(name: str, seed: int, draws: int, labels: Sequence[int] = SEEDS) -> None:
    """How often each label is picked per draw."""
    n = len(labels)
    cte(name, f"SELECT draw, {', '.join(f'count(*) FILTER (WHERE r % {n} = {i}) AS w_{s}' for i, s in enumerate(labels))} FROM (SELECT draw, {random_sql('r', seed, 'slot', 'draw')} "
              f"FROM (SELECT draw, unnest(range(0, {n})) AS slot FROM (SELECT unnest(range(0, {draws})) AS draw))) GROUP BY draw")


def weighted_sql(value: str, draws: str = "d", weights: str = "w", count: str = "n") -> str:
    return "(" + " + ".join(f"{draws}.{value}_{s} * {weights}.w_{s}" for s in SEEDS) + f") / ({draws}.{count} * {len(SEEDS)})"


_CI = "round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high"
_PER_SEED = [f"s_{v}_{s}" for v in METRICS for s in SEEDS]

totals_sql("totals_hist", "effects_historical", ["d_top1", "d_mrr"], per_seed=True)
cte("totals_h", "SELECT cluster, n, s_d_top1 AS s_top1, s_d_mrr AS s_mrr, " + ", ".join(f"s_d_{v}_{s} AS s_{v}_{s}" for v in METRICS for s in SEEDS) + " FROM totals_hist")
draws_sql("boot_h", "totals_h", ["s_top1", "s_mrr", "n", *_PER_SEED], DRAWS, 17)


def renamed_effects(t: Tables, names: tuple[str, ...] = ("historical",)) -> DataFrame:
    return V.effects(t, names).withColumnsRenamed({"d_top1": "top1", "d_mrr": "mrr"})


def historical_totals(t: Tables, per_seed: bool = False) -> DataFrame:
    return RS.effect_totals(renamed_effects(t), METRICS, SEEDS, per_seed=per_seed)


@query("r01_cluster_bootstrap", "SELECT metric, round((SELECT CASE metric WHEN 'top1' THEN sum(s_top1) ELSE sum(s_mrr) END / sum(n) FROM totals_h), 6) AS effect, " + _CI.format("e") + """
FROM (SELECT unnest(['top1', 'mrr']) AS metric, unnest([s_top1 / n, s_mrr / n]) AS e FROM boot_h) GROUP BY metric""")
def r01(t: Tables, draws: int = DRAWS):
    """Cluster bootstrap of the mean effect."""
    return V.rounded(RS.cluster_bootstrap(historical_totals(t), METRICS, draws, 17))


weights_sql("w_18", 18, DRAWS)


@query("r02_crossed_bootstrap", f"""
SELECT metric, round((SELECT CASE metric WHEN 'top1' THEN sum(s_top1) ELSE sum(s_mrr) END / sum(n) FROM totals_h), 6) AS effect, {_CI.format("e")}
FROM (SELECT unnest(['top1', 'mrr']) AS metric, unnest([{weighted_sql("s_top1")}, {weighted_sql("s_mrr")}]) AS e FROM boot_h d JOIN w_18 w ON w.draw = d.draw) GROUP BY metric""")
def r02(t: Tables, draws: int = DRAWS):
    """Clusters and seeds resampled independently."""
    return V.rounded(RS.crossed_bootstrap(historical_totals(t, True), METRICS, SEEDS, draws, 17))


REPLICATES = (1, 2, 3)
weights_sql("w_19", 19, DRAWS, REPLICATES)


@query("r03_three_way_bootstrap", f"""
SELECT round((SELECT sum(s_mrr) / sum(n) FROM totals_h) * 2 / 3, 6) AS effect, {_CI.format("e")} FROM (
  SELECT {weighted_sql("s_mrr")} * (v.w_1 * 1 + v.w_2 * 2 + v.w_3 * 3) / 9 AS e FROM boot_h d JOIN w_18 w ON w.draw = d.draw JOIN w_19 v ON v.draw = d.draw)""")
def r03(t: Tables, draws: int = DRAWS):
    """Clusters, seeds and replicates resampled independently."""
    rows = renamed_effects(t).select("cluster_key", "seed", F.explode(F.array(*[F.struct(
        F.lit(r).alias("replicate"), (F.col("mrr") * r / 3).alias("value")) for r in REPLICATES])).alias("c")).select("cluster_key", "seed", "c.*")
    return V.rounded(RS.three_way_bootstrap(rows, "value", SEEDS, REPLICATES, draws, 17))


_OTHERS = ("alpha", "beta", "merged")
cte("joint_effects", """
SELECT e.*, h.d_top1 AS h_top1, h.d_mrr AS h_mrr FROM all_effects e JOIN common_ids USING (query_id) JOIN effects_historical h ON h.query_id = e.query_id AND h.seed = e.seed WHERE e.pool <> 'historical'""")
for _pool in _OTHERS:
    _alias = "SELECT cluster_key, seed, query_id, d_top1 AS new_top1, d_mrr AS new_mrr, h_top1 AS old_top1, h_mrr AS old_mrr, d_top1 - h_top1 AS loss_top1, d_mrr - h_mrr AS loss_mrr FROM joint_effects WHERE pool = '{}'"
    cte(f"joint_{_pool}", _alias.format(_pool))
    totals_sql(f"totals_{_pool}", f"joint_{_pool}", [f"{k}_{m}" for k in ("new", "old", "loss") for m in METRICS], per_seed=True)
    draws_sql(f"boot_{_pool}", f"totals_{_pool}", ["n", *[f"s_loss_{m}" for m in METRICS], *[f"s_{k}_{m}_{s}" for k in ("new", "old") for m in METRICS for s in SEEDS]], DRAWS, 23)
weights_sql("w_31", 31, DRAWS)
weights_sql("w_32", 32, DRAWS)


def joint_effects(t: Tables) -> DataFrame:
    """Effects of the other pools beside the historical ones, on the common cohort.

    Written once: three tables of totals are taken from it.
    """
    V.share(t)
    rows = renamed_effects(t, V.POOLS).join(common_cohort(t), "query_id").select("pool", "query_id", "cluster_key", "seed", *METRICS)
    rows = materialise_by(rows, "query_id")
    old = rows.filter(F.col("pool") == "historical").select("query_id", "seed", *[F.col(m).alias(f"old_{m}") for m in METRICS])
    new = rows.filter(F.col("pool") != "historical").withColumnsRenamed({m: f"new_{m}" for m in METRICS})
    joined = new.join(old, ["query_id", "seed"])
    return joined.withColumns({f"loss_{m}": F.col(f"new_{m}") - F.col(f"old_{m}") for m in METRICS})


_TRANSFER = " UNION ALL ".join(f"""
SELECT '{p}' AS pool, '{m}' AS metric, (SELECT CAST(sum(n) AS BIGINT) FROM totals_{p}) AS n, round((SELECT sum(s_old_{m}) / sum(n) FROM totals_{p}), 6) AS old_effect,
  round((SELECT sum(s_new_{m}) / sum(n) FROM totals_{p}), 6) AS new_effect, round((SELECT sum(s_loss_{m}) / sum(n) FROM totals_{p}), 6) AS loss,
  round(quantile_cont(d.s_loss_{m} / d.n, 0.025), 6) AS low, round(quantile_cont(d.s_loss_{m} / d.n, 0.975), 6) AS high,
  round(quantile_cont({weighted_sql(f's_new_{m}', weights='b')} - {weighted_sql(f's_old_{m}', weights='a')}, 0.025), 6) AS crossed_low,
  round(quantile_cont({weighted_sql(f's_new_{m}', weights='b')} - {weighted_sql(f's_old_{m}', weights='a')}, 0.975), 6) AS crossed_high
FROM boot_{p} d JOIN w_31 a ON a.draw = d.draw JOIN w_32 b ON b.draw = d.draw""" for p in _OTHERS for m in METRICS)


@query("r04_transfer_intervals", _TRANSFER)
def r04(t: Tables, draws: int = DRAWS):
    """Change of the effect between pools: shared clusters, separate seeds per pool."""
    out = RS.transfer_summary(joint_effects(t), METRICS, SEEDS, draws, 23, (31, 32))
    return V.rounded(out.withColumn("n", F.col("n").cast("long")))


@query("r05_pool_difference", f"""
SELECT term, {_CI.format("e")} FROM (SELECT unnest(['old', 'new', 'difference']) AS term, unnest([o, n, n - o]) AS e FROM (
  SELECT {weighted_sql("s_old_mrr", weights="a")} AS o, {weighted_sql("s_new_mrr", weights="b")} AS n FROM boot_beta d JOIN w_31 a ON a.draw = d.draw JOIN w_32 b ON b.draw = d.draw)) GROUP BY term""")
def r05(t: Tables, draws: int = DRAWS):
    """Two pools and their difference with shared cluster draws."""
    joint = joint_effects(t).filter(F.col("pool") == "beta")
    return V.rounded(RS.pool_difference(joint, "mrr", SEEDS, draws, 23, (31, 32)))


cte("gap_effects", "SELECT e.*, g.gap_group FROM effects_historical e JOIN gap_groups g USING (query_id) WHERE gap_group >= 0")
totals_sql("totals_gap", "gap_effects", ["d_mrr"], ["gap_group"], per_seed=True)
draws_sql("boot_gap", "totals_gap", ["n", "s_d_mrr", *[f"s_d_mrr_{s}" for s in SEEDS]], DRAWS, 41, ["gap_group"])
weights_sql("w_42", 42, DRAWS)


def gap_effects(t: Tables) -> DataFrame:
    # Answers, lists for the ranks and lists for the gaps all read the lines by order.
    V.share(t)
    groups = D.gap_groups(V.lists(t, "historical")).filter(F.col("gap_group") >= 0).select("query_id", "gap_group")
    return renamed_effects(t).join(groups, "query_id")


@query("r06_stratified_bootstrap", f"""
WITH g AS (SELECT d.gap_group, d.draw, {weighted_sql("s_d_mrr")} AS e FROM boot_gap d JOIN w_42 w ON w.draw = d.draw)
SELECT CAST(gap_group AS VARCHAR) AS term, {_CI.format("e")} FROM g GROUP BY gap_group
UNION ALL SELECT 'contrast', {_CI.format("e")} FROM (SELECT a.e - b.e AS e FROM g a JOIN g b ON a.draw = b.draw AND a.gap_group = 3 AND b.gap_group = 0)""")
def r06(t: Tables, draws: int = DRAWS):
    """Effects by gap group with a shared seed draw, and last minus first group."""
    return V.rounded(RS.stratified_bootstrap(gap_effects(t), "mrr", "gap_group", SEEDS, draws, 41, (3, 0)))


cte("contrast_totals", """
SELECT CASE WHEN class = '1-URGENT' THEN 'left' ELSE 'right' END AS side, cluster_key AS cluster, count(*)::DOUBLE AS n, sum(e_mrr) AS s_mrr FROM query_effects
WHERE class IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW') GROUP BY ALL""")
draws_sql("boot_contrast", "contrast_totals", ["n", "s_mrr"], DRAWS, 51, ["side"])


@query("r07_contrast_bootstrap", f"""
SELECT {_CI.format("l.s_mrr / l.n - r.s_mrr / r.n")} FROM boot_contrast l JOIN boot_contrast r ON l.draw = r.draw AND l.side = 'left' AND r.side = 'right'""")
def r07(t: Tables, draws: int = DRAWS):
    """Difference of means with both sides resampled independently."""
    return V.rounded(RS.contrast_bootstrap(query_effects(t), "e_mrr", "class", ["1-URGENT"], ["4-NOT SPECIFIED", "5-LOW"], draws, 51))


def flip_sql(totals: str, value: str, draws: int, seed: int) -> str:
    """Sign-flip p-value as a scalar subquery."""
    return f"""(SELECT CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (WHERE abs(s / nn) >= obs - 1e-15) + 1) / ({draws} + 1)::DOUBLE END FROM (
  SELECT draw, sum(CASE WHEN r % 2 = 0 THEN -v ELSE v END) AS s FROM (SELECT draw, v, {random_sql("r", seed, "draw", "cluster")} FROM (
    SELECT cluster, {value} AS v, unnest(range(0, {draws})) AS draw FROM {totals} WHERE {value} <> 0)) GROUP BY draw), (SELECT sum(n) AS nn, abs(sum({value}) / sum(n)) AS obs FROM {totals}))"""


@query("r08_sign_flip", f"SELECT 'top1' AS metric, round({flip_sql('totals_h', 's_top1', DRAWS, 61)}, 6) AS p_value UNION ALL SELECT 'mrr', round({flip_sql('totals_h', 's_mrr', DRAWS, 61)}, 6)")
def r08(t: Tables, draws: int = DRAWS):
    """Sign-flip test of the mean effect."""
    return V.rounded(RS.sign_flip(historical_totals(t), METRICS, draws, 61))


def shuffle_sql(source: str, sizes: str, draws: int, seed: int) -> str:
    """Sums per draw and label under random dealing of labels."""
    return f"""SELECT draw, label, sum(v) AS total, count(*) AS n FROM (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY u, id) AS place FROM (
    SELECT draw, v, id, {random_sql("u", seed, "draw", "id")} FROM (SELECT id, v, unnest(range(0, {draws})) AS draw FROM {source}))) p
  JOIN ({sizes}) z ON p.place > z.lo AND p.place <= z.hi GROUP BY draw, label"""


cte("perm_rows", "SELECT query_id AS id, e_mrr AS v, class AS label FROM query_effects")
_SIZES = "SELECT label, coalesce(sum(c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(c) OVER (ORDER BY label) AS hi FROM (SELECT label, count(*) AS c FROM {} GROUP BY label)"


@query("r09_omnibus_permutation", f"""
WITH sh AS ({shuffle_sql("perm_rows", _SIZES.format("perm_rows"), DRAWS, 71)}), st AS (SELECT draw, sum(total * total / n) - sum(total) * sum(total) / sum(n) AS s FROM sh GROUP BY draw),
o AS (SELECT sum(t * t / c) - sum(t) * sum(t) / sum(c) AS obs FROM (SELECT sum(v) AS t, count(*) AS c FROM perm_rows GROUP BY label))
SELECT round(obs, 6) AS statistic, round((count(*) FILTER (WHERE s >= obs - 1e-15 - 1e-12 * abs(obs)) + 1) / 201.0::DOUBLE, 6) AS p_value FROM st, o GROUP BY obs""")
def r09(t: Tables, draws: int = DRAWS):
    """Permutation test of equal class means."""
    rows = query_effects(t)
    return V.rounded(RS.omnibus_permutation(rows, "query_id", "e_mrr", "class", draws, 71))


cte("perm_two", "SELECT id, v, CASE WHEN label = '1-URGENT' THEN 'left' ELSE 'right' END AS label FROM perm_rows WHERE label IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW')")


@query("r10_contrast_permutation", f"""
WITH sh AS ({shuffle_sql("perm_two", _SIZES.format("perm_two"), DRAWS, 72)}), st AS (SELECT draw, max(CASE WHEN label = 'left' THEN total / n END) - max(CASE WHEN label = 'right' THEN total / n END) AS s FROM sh GROUP BY draw),
o AS (SELECT avg(v) FILTER (WHERE label = 'left') - avg(v) FILTER (WHERE label = 'right') AS obs FROM perm_two)
SELECT round(obs, 6) AS contrast, round((count(*) FILTER (WHERE abs(s) >= abs(obs) - 1e-15 - 1e-12 * abs(obs)) + 1) / 201.0::DOUBLE, 6) AS p_value FROM st, o GROUP BY obs""")
def r10(t: Tables, draws: int = DRAWS):
    """Two-sided permutation test of a contrast."""
    rows = query_effects(t)
    return V.rounded(RS.contrast_permutation(rows, "query_id", "e_mrr", "class", ["1-URGENT"], ["4-NOT SPECIFIED", "5-LOW"], draws, 72))


cte("mcnemar", """
SELECT seed, promoted, lost, CASE WHEN promoted + lost = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + 1) - lgamma(k + 1) - lgamma(b - k + 1) - b * ln(2.0::DOUBLE)))
  FROM (SELECT unnest(range(0, least(promoted, lost) + 1)) AS k, promoted + lost AS b))) END AS p FROM (
  SELECT seed, count(*) FILTER (WHERE d_top1 > 0) AS promoted, count(*) FILTER (WHERE d_top1 < 0) AS lost FROM effects_historical GROUP BY seed)""")


@query("r11_exact_mcnemar", "SELECT seed, promoted, lost, round(p, 6) AS p_value FROM mcnemar")
def r11(t: Tables):
    """Exact test of discordant top-1 counts per seed."""
    counts = V.effects(t).groupBy("seed").agg(
        F.count_if(F.col("d_top1") > 0).alias("promoted"), F.count_if(F.col("d_top1") < 0).alias("lost"))
    return V.rounded(counts.withColumn("p_value", RS.exact_mcnemar("promoted", "lost")))


cte("wil_rows", "SELECT seed, round(d_mrr, 9) AS d FROM effects_historical")
cte("wil", """
SELECT seed, least(wp, wm) AS statistic, (least(wp, wm) - (n * (n + 1) - z * (z + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - 0.5 * coalesce(tt, 0)) / 24) AS score
FROM (SELECT seed, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE d = 0))::DOUBLE AS z, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm FROM (
  SELECT seed, d, rank() OVER (PARTITION BY seed ORDER BY abs(d)) + (count(*) OVER (PARTITION BY seed, abs(d)) - 1) / 2.0::DOUBLE AS r FROM wil_rows) GROUP BY seed)
LEFT JOIN (SELECT seed, sum(c * (c * c - 1)) AS tt FROM (SELECT seed, count(*)::DOUBLE AS c FROM wil_rows WHERE d <> 0 GROUP BY seed, abs(d)) GROUP BY seed) USING (seed)""")


@query("r12_wilcoxon_pratt", """
SELECT seed, round(statistic, 6) AS statistic, round(score, 6) AS z, round(greatest(1 - 2 * (SELECT sum(exp(-x * x / 2)) * abs(score) / 4000 / sqrt(2 * pi()) FROM (SELECT (unnest(range(0, 4000)) + 0.5) * abs(score) / 4000 AS x)), 0), 4) AS p_value FROM wil""")
def r12(t: Tables):
    """Signed-rank test with zeros kept in the ranking."""
    out = RS.wilcoxon_pratt(V.effects(t).withColumn("d", F.round("d_mrr", 9)), "d", ["seed"])
    return out.select("seed", F.round("statistic", 6).alias("statistic"), F.round("z", 6).alias("z"), (F.round("p_value", 4)).alias("p_value"))


cte("pair_rows", """
SELECT c_nationkey AS nation, c_mktsegment AS segment, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END), 2) AS d
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment""")
cte("pair_ranks", """
SELECT *, rank() OVER (PARTITION BY nation, segment ORDER BY abs(d)) + (count(*) OVER (PARTITION BY nation, segment, abs(d)) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY nation, segment, abs(d)) AS c FROM pair_rows""")
cte("pair_sums", """
SELECT nation, segment, count(*) AS n, count(*) FILTER (WHERE d = 0) AS z, bool_or(c > 1) AS tied, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp,
  coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm, coalesce(sum(c * c - 1) FILTER (WHERE d <> 0), 0)::DOUBLE AS tt FROM pair_ranks GROUP BY nation, segment""")
cte("rank_sums", """
SELECT i AS n, s AS total, c AS ways FROM (WITH RECURSIVE w(i, s, c) AS (SELECT 0, 0, 1::DOUBLE UNION ALL
  SELECT i + 1, s + k * (i + 1), sum(c) FROM w, (SELECT unnest([0, 1]) AS k) WHERE i < 50 GROUP BY i + 1, s + k * (i + 1)) SELECT * FROM w)""")


@query("r12_exact_signed_rank", """
WITH e AS (SELECT *, least(wp, wm) AS w, n <= 50 AND z = 0 AND NOT tied AS exact FROM pair_sums),
p AS (SELECT e.nation, e.segment, sum(ways) / pow(2, max(e.n)) AS tail FROM e JOIN rank_sums s ON s.n = e.n AND s.total <= e.w WHERE exact GROUP BY e.nation, e.segment),
z AS (SELECT e.*, abs((w - (n * (n + 1) - z * (z + 1)) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - 0.5 * tt) / 24.0::DOUBLE)) AS score FROM e)
SELECT nation, segment, n, w AS statistic, exact, round(CASE WHEN exact THEN least(2 * tail, 1) ELSE
  greatest(1 - 2 * (SELECT sum(exp(-x * x / 2)) * score / 4000 / sqrt(2 * pi()) FROM (SELECT (unnest(range(0, 4000)) + 0.5) * score / 4000 AS x)), 0) END, 5) AS p_value
FROM z LEFT JOIN p USING (nation, segment)""")
def r12_exact(t: Tables):
    """Signed-rank test of customers' even against odd orders, per nation and segment: small groups without ties are exact."""
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum(signed), 2).alias("d"))
    out = RS.wilcoxon_pratt(pairs, "d", ["nation", "segment"])
    return out.select("nation", "segment", "n", "statistic", "exact", F.round("p_value", 5).alias("p_value"))


@query("r13_significance_bundle", f"""
SELECT metric, round(CASE metric WHEN 'top1' THEN (SELECT sum(s_top1) / sum(n) FROM totals_h) ELSE (SELECT sum(s_mrr) / sum(n) FROM totals_h) END, 6) AS effect, {_CI.format("e")},
  round(CASE metric WHEN 'top1' THEN {flip_sql('totals_h', 's_top1', DRAWS, 18)} ELSE {flip_sql('totals_h', 's_mrr', DRAWS, 18)} END, 6) AS p_value
FROM (SELECT unnest(['top1', 'mrr']) AS metric, unnest([s_top1 / n, s_mrr / n]) AS e FROM boot_h) GROUP BY metric""")
def r13(t: Tables, draws: int = DRAWS):
    """Effect, interval and sign-flip p-value together."""
    return V.rounded(RS.significance(historical_totals(t), METRICS, draws, 17))


_LOSS = " UNION ALL ".join(f"SELECT '{p}' AS pool, '{m}' AS metric, round((SELECT sum(s_loss_{m}) / sum(n) FROM totals_{p}), 6) AS loss, {flip_sql(f'totals_{p}', f's_loss_{m}', DRAWS, 81)} AS p FROM (SELECT 1)" for p in _OTHERS for m in METRICS)


@query("r14_transfer_loss", f"""
SELECT pool, metric, loss, round(p, 6) AS p_value, round(least(max(p * (m - i + 1)) OVER (PARTITION BY metric ORDER BY i ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_holm FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, pool) AS i, count(*) OVER (PARTITION BY metric) AS m FROM ({_LOSS}))""")
def r14(t: Tables, draws: int = DRAWS):
    """Transfer loss with sign-flip p-values, adjusted within each metric."""
    values = [f"loss_{m}" for m in METRICS]
    totals = RS.effect_totals(joint_effects(t), values, SEEDS, by=["pool"])
    effect = totals.groupBy("pool").agg(*[(F.sum(f"s_{v}") / F.sum("n")).alias(v) for v in values]).unpivot(["pool"], values, "metric", "loss")
    tests = effect.join(RS.sign_flip(totals, values, draws, 81, ["pool"]), ["pool", "metric"])
    out = D.holm(materialise(tests), ["metric"], ["pool"])
    return V.rounded(out.withColumn("metric", F.substring("metric", 6, 10)))


cte("scope_effects", "SELECT 'within' AS scope, cluster_key, seed, d_mrr FROM effects_historical UNION ALL SELECT 'end_to_end', cluster_key, seed, d_mrr FROM effects_historical "
    "UNION ALL SELECT 'end_to_end', cluster_key, s, 0.0 FROM (SELECT q.cluster_key, unnest([42, 43, 44, 45, 46]) AS s FROM qs q LEFT JOIN wide_historical w USING (query_id) WHERE coalesce(w.prior_rank, 0) = 0)")
totals_sql("totals_scope", "scope_effects", ["d_mrr"], ["scope"])
draws_sql("boot_scope", "totals_scope", ["n", "s_d_mrr"], DRAWS, 91, ["scope"])


@query("r15_scope_analysis", f"""
SELECT b.scope, max(t.c) AS n, round(max(t.e), 6) AS delta, {_CI.format("b.s_d_mrr / b.n")} FROM boot_scope b
JOIN (SELECT scope, CAST(sum(n) AS BIGINT) AS c, sum(s_d_mrr) / sum(n) AS e FROM totals_scope GROUP BY scope) t ON t.scope = b.scope GROUP BY b.scope""")
def r15(t: Tables, draws: int = DRAWS):
    """Within-pool and end-to-end effect; uncovered queries count as zero."""
    covered = V.effects(t).select("query_id", "cluster_key", "seed", "d_mrr")
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    rest = V.plain_queries(t).join(covered.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", "cluster_key", seeds, F.lit(0.0).alias("d_mrr"))
    rows = covered.withColumn("scope", F.lit("within")).unionByName(covered.unionByName(rest).withColumn("scope", F.lit("end_to_end")))
    totals = RS.effect_totals(rows, ["d_mrr"], SEEDS, by=["scope"])
    draws = RS.resampled_sums(totals, ["n", "s_d_mrr"], draws, 91, ["scope"]).withColumn("e", F.col("s_d_mrr") / F.col("n"))
    effect = totals.groupBy("scope").agg(F.sum("n").cast("long").alias("n"), (F.sum("s_d_mrr") / F.sum("n")).alias("delta"))
    return V.rounded(effect.join(RS.interval(draws, "e", ["scope"]), "scope"))


cte("cohorts", """
SELECT query_id, CASE WHEN length = reference_length AND shared = length AND jaccard = 1 AND (kendall = 1 OR length = 1) THEN 'matched' ELSE 'changed' END AS cohort FROM desc_alpha""")
cte("cohort_effects", "SELECT c.cohort, e.cluster_key, e.seed, e.d_mrr FROM effects_alpha e JOIN cohorts c USING (query_id)")
totals_sql("totals_cohort", "cohort_effects", ["d_mrr"], ["cohort"])
draws_sql("boot_cohort", "totals_cohort", ["n", "s_d_mrr"], DRAWS, 92, ["cohort"])


def cohort_totals(t: Tables) -> DataFrame:
    from rankweave.operators.audits import matched_cohort
    from rankweave.plans.aggregations import descriptors
    cohort = matched_cohort(descriptors(t, ("alpha",))).select("query_id", "cohort")
    return RS.effect_totals(V.effects(t, ("alpha",)).join(cohort, "query_id"), ["d_mrr"], SEEDS, by=["cohort"])


@query("r16_cohort_sensitivity", f"""
SELECT b.cohort, max(t.c) AS n, round(max(t.e), 6) AS effect, {_CI.format("b.s_d_mrr / b.n")} FROM boot_cohort b
JOIN (SELECT cohort, CAST(sum(n) AS BIGINT) AS c, sum(s_d_mrr) / sum(n) AS e FROM totals_cohort GROUP BY cohort) t ON t.cohort = b.cohort GROUP BY b.cohort
UNION ALL SELECT 'contrast', NULL, NULL, {_CI.format("a.s_d_mrr / a.n - b.s_d_mrr / b.n")} FROM boot_cohort a JOIN boot_cohort b ON a.draw = b.draw AND a.cohort = 'changed' AND b.cohort = 'matched'""")
def r16(t: Tables, draws: int = DRAWS):
    """Effect in queries whose list is unchanged between pools, in the others, and their contrast."""
    totals = cohort_totals(t)
    draws = RS.resampled_sums(totals, ["n", "s_d_mrr"], draws, 92, ["cohort"]).withColumn("e", F.col("s_d_mrr") / F.col("n"))
    effect = totals.groupBy("cohort").agg(F.sum("n").cast("long").alias("n"), (F.sum("s_d_mrr") / F.sum("n")).alias("effect"))
    sides = draws.groupBy("draw").pivot("cohort", ["matched", "changed"]).agg(F.max("e"))
    contrast = RS.interval(sides.withColumn("e", F.col("changed") - F.col("matched")), "e").withColumn("cohort", F.lit("contrast"))
    return V.rounded(effect.join(RS.interval(draws, "e", ["cohort"]), "cohort").unionByName(contrast, allowMissingColumns=True))


cte("agree", """
SELECT a.query_id, CASE WHEN a.items = b.items THEN 'same_order' WHEN list_sort(a.items) = list_sort(b.items) THEN 'same_set' ELSE 'different' END AS agreement
FROM (SELECT query_id, list(cand_key ORDER BY rank) AS items FROM top_historical GROUP BY query_id) a JOIN (SELECT query_id, list(cand_key ORDER BY rank) AS items FROM top_alpha GROUP BY query_id) b USING (query_id)""")
cte("agree_effects", "SELECT g.agreement, e.cluster_key, e.seed, e.d_mrr FROM effects_alpha e JOIN agree g USING (query_id)")
totals_sql("totals_agree", "agree_effects", ["d_mrr"], ["agreement"])
draws_sql("boot_agree", "totals_agree", ["n", "s_d_mrr"], DRAWS, 93, ["agreement"])


@query("r17_order_groups", """
SELECT t.agreement, CAST(sum(t.n) AS BIGINT) AS n, round(sum(t.s_d_mrr) / sum(t.n), 6) AS effect,
  round(CASE WHEN t.agreement = 'same_order' THEN max(b.low) END, 6) AS low, round(CASE WHEN t.agreement = 'same_order' THEN max(b.high) END, 6) AS high FROM totals_agree t
LEFT JOIN (SELECT agreement, quantile_cont(s_d_mrr / n, 0.025) AS low, quantile_cont(s_d_mrr / n, 0.975) AS high FROM boot_agree GROUP BY agreement) b ON b.agreement = t.agreement GROUP BY t.agreement""")
def r17(t: Tables, draws: int = DRAWS):
    """Effect by list agreement, with an interval for unchanged lists only."""
    groups = P.list_agreement(V.lists(t, "historical"), V.lists(t, "alpha"))
    totals = RS.effect_totals(V.effects(t, ("alpha",)).join(groups, "query_id"), ["d_mrr"], SEEDS, by=["agreement"])
    draws = RS.resampled_sums(totals, ["n", "s_d_mrr"], draws, 93, ["agreement"]).withColumn("e", F.col("s_d_mrr") / F.col("n"))
    interval = RS.interval(draws, "e", ["agreement"]).filter(F.col("agreement") == "same_order")
    effect = totals.groupBy("agreement").agg(F.sum("n").cast("long").alias("n"), (F.sum("s_d_mrr") / F.sum("n")).alias("effect"))
    return V.rounded(effect.join(interval, "agreement", "left"))


def truncated_effects(t: Tables, cap: int) -> DataFrame:
    """Effects when lists are cut to their first ``cap`` rows."""
    base = V.queries(t).select("query_id", "cluster_key", F.col("truth_key").alias("_truth"))
    rows = V.scored_lists(t, "historical").filter(F.col("rank") <= cap).withColumn("n", F.least(F.col("n"), F.lit(cap)))
    marked = rows.join(base, "query_id").withColumn("is_truth", F.col("cand_key") == F.col("_truth"))
    placed = M.truth_ranks(marked, [f"{a}_{s}" for a in V.ARMS for s in SEEDS]).filter(F.col("prior_rank") > 0)
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), (S.reciprocal_rank(F.col(f"augmented_{s}")) - S.reciprocal_rank(F.col(f"baseline_{s}"))).alias("d_mrr")) for s in SEEDS]))
    return placed.select("query_id", cells.alias("c")).select("query_id", "c.*").join(base.select("query_id", "cluster_key"), "query_id")


_CUT = ", ".join(f"count(*) FILTER (WHERE {c} > t_{c} OR ({c} = t_{c} AND rank <= tr)) AS {c}" for c in (f"{a}_{s}" for a in V.ARMS for s in SEEDS))
_CUT_T = ", ".join(f"max(CASE WHEN s.cand_key = q.truth_key THEN {c} END) OVER (PARTITION BY s.query_id) AS t_{c}" for c in (f"{a}_{s}" for a in V.ARMS for s in SEEDS))
cte("cut_wide", f"""SELECT query_id, max(cluster_key) AS cluster_key, {_CUT} FROM (SELECT s.*, q.cluster_key, max(CASE WHEN s.cand_key = q.truth_key THEN rank END) OVER (PARTITION BY s.query_id) AS tr, {_CUT_T}
  FROM scored_historical s JOIN qs q USING (query_id) WHERE rank <= 3) WHERE tr IS NOT NULL GROUP BY query_id""")
cte("cut_effects", " UNION ALL ".join(f"SELECT cluster_key, {s} AS seed, 1.0::DOUBLE / augmented_{s} - 1.0::DOUBLE / baseline_{s} AS d_mrr FROM cut_wide" for s in SEEDS))
totals_sql("totals_cut", "cut_effects", ["d_mrr"])
draws_sql("boot_cut", "totals_cut", ["n", "s_d_mrr"], DRAWS, 94)


@query("r17_truncated_lists", f"""SELECT 'd_mrr' AS metric, round((SELECT sum(s_d_mrr) / sum(n) FROM totals_cut), 6) AS effect, {_CI.format("s_d_mrr / n")} FROM boot_cut""")
def r17_cut(t: Tables, draws: int = DRAWS):
    """Effect and interval when lists are cut to three."""
    totals = RS.effect_totals(truncated_effects(t, 3), ["d_mrr"], SEEDS)
    return V.rounded(RS.cluster_bootstrap(totals, ["d_mrr"], draws, 94))


totals_sql("totals_class", "effects_historical", ["d_mrr"], ["class"])
draws_sql("boot_class", "totals_class", ["n", "s_d_mrr"], DRAWS, 95, ["class"])


@query("g09_class_tests", f"""
SELECT t.class, round(t.e, 6) AS effect, b.low, b.high, round(t.p, 6) AS p_value, round(least(min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_bh FROM (
  SELECT *, row_number() OVER (ORDER BY p, class) AS i, count(*) OVER () AS m FROM (SELECT class, e, (ex + 1) / 201.0::DOUBLE AS p FROM (
    SELECT o.class, max(o.e) AS e, count(*) FILTER (WHERE abs(f.s / o.n) >= abs(o.e) - 1e-15) AS ex FROM (SELECT class, sum(n) AS n, sum(s_d_mrr) / sum(n) AS e FROM totals_class GROUP BY class) o
    JOIN (SELECT class, draw, sum(CASE WHEN r % 2 = 0 THEN -v ELSE v END) AS s FROM (SELECT class, draw, v, {random_sql("r", 96, "draw", "cluster")} FROM (
      SELECT class, cluster, s_d_mrr AS v, unnest(range(0, {DRAWS})) AS draw FROM totals_class WHERE s_d_mrr <> 0)) GROUP BY class, draw) f ON f.class = o.class GROUP BY o.class))) t
JOIN (SELECT class, {_CI.format("s_d_mrr / n")} FROM boot_class GROUP BY class) b ON b.class = t.class""")
def g09_tests(t: Tables, draws: int = DRAWS):
    """Interval, sign-flip p-value and step-up adjustment per class."""
    totals = RS.effect_totals(V.effects(t), ["d_mrr"], SEEDS, by=["class"])
    sums = RS.resampled_sums(totals, ["n", "s_d_mrr"], draws, 95, ["class"]).withColumn("e", F.col("s_d_mrr") / F.col("n"))
    effect = totals.groupBy("class").agg((F.sum("s_d_mrr") / F.sum("n")).alias("effect"))
    tests = effect.join(RS.interval(sums, "e", ["class"]), "class").join(RS.sign_flip(totals, ["d_mrr"], draws, 96, ["class"]).drop("metric"), "class")
    return V.rounded(D.benjamini_hochberg(materialise(tests), [], ["class"]))


_SYSTEMS = {"prior": "prior_rank", "baseline": "baseline_{s}", "augmented": "augmented_{s}"}
_PAIRS = (("baseline", "prior"), ("augmented", "prior"), ("augmented", "baseline"))
cte("system_diffs", " UNION ALL ".join(f"""SELECT query_id, cluster_key, {s} AS seed, """ + ", ".join(
    f"(CASE WHEN {_SYSTEMS[a].format(s=s)} = 1 THEN 1.0::DOUBLE ELSE 0 END) - (CASE WHEN {_SYSTEMS[b].format(s=s)} = 1 THEN 1.0::DOUBLE ELSE 0 END) AS {a}_{b}_top1, "
    f"1.0::DOUBLE / {_SYSTEMS[a].format(s=s)} - 1.0::DOUBLE / {_SYSTEMS[b].format(s=s)} AS {a}_{b}_mrr" for a, b in _PAIRS) + " FROM wide_historical WHERE prior_rank > 0" for s in SEEDS))
_DIFFS = [f"{a}_{b}_{m}" for a, b in _PAIRS for m in METRICS]
totals_sql("totals_systems", "system_diffs", _DIFFS)
draws_sql("boot_systems", "totals_systems", ["n", *[f"s_{v}" for v in _DIFFS]], DRAWS, 97)
MARGINS = {"top1": 0.0025, "mrr": 0.0020}


@query("g28_equivalence", f"""
WITH l AS ({" UNION ALL ".join(f"SELECT '{a}_minus_{b}' AS comparison, '{m}' AS metric, s_{a}_{b}_{m} / n AS e FROM boot_systems" for a, b in _PAIRS for m in METRICS)}),
i AS (SELECT comparison, metric, quantile_cont(e, 0.025) AS low, quantile_cont(e, 0.975) AS high, quantile_cont(e, 0.05) AS low90, quantile_cont(e, 0.95) AS high90, CASE metric WHEN 'top1' THEN 0.0025 ELSE 0.0020 END AS mg FROM l GROUP BY ALL)
SELECT comparison, metric, round(low, 6) AS low, round(high, 6) AS high, round(low90, 6) AS low90, round(high90, 6) AS high90, low90 > -mg AND high90 < mg AS equivalent, low > 0 AS superior, high < 0 AS inferior,
  CASE WHEN bool_and(low90 > -mg AND high90 < mg) OVER (PARTITION BY comparison) THEN 'equivalent' WHEN bool_and(low > 0) OVER (PARTITION BY comparison) THEN 'superior'
    WHEN bool_and(high < 0) OVER (PARTITION BY comparison) THEN 'inferior' ELSE 'inconclusive' END AS verdict FROM i""")
def g28(t: Tables, draws: int = DRAWS):
    """Pairwise system contrasts with 90 and 95 % intervals and an equivalence verdict."""
    wide = V.wide_ranks(t, "historical").filter(F.col("prior_rank") > 0)
    cells = []
    for s in SEEDS:
        rank = {k: F.col(c.format(s=s)) for k, c in _SYSTEMS.items()}
        cells.append(F.struct(F.lit(s).alias("seed"), *[
            (S.rank_metric(rank[a], m) - S.rank_metric(rank[b], m)).alias(f"{a}_{b}_{m}") for a, b in _PAIRS for m in METRICS]))
    rows = wide.select("query_id", "cluster_key", F.explode(F.array(*cells)).alias("c")).select("query_id", "cluster_key", "c.*")
    totals = RS.effect_totals(rows, _DIFFS, SEEDS)
    intervals = RS.cluster_bootstrap(totals, _DIFFS, draws, 97, (0.025, 0.05, 0.95, 0.975))
    named = intervals.withColumns({
        "comparison": F.regexp_replace(F.regexp_extract("metric", "^(.*)_(top1|mrr)$", 1), "_", "_minus_"),
        "metric": F.regexp_extract("metric", "^(.*)_(top1|mrr)$", 2)})
    return V.rounded(D.equivalence(named, MARGINS).drop("effect"))
