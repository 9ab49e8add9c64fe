"""Draws and tests against brute force and hand values."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave import rng
from rankweave.operators import resample as RS


def uniform(seed, *counters):
    state = np.int64(rng.mix(seed))
    for counter in counters:
        state = rng.absorb_array(state, counter)
    return state


def totals_frame(n=23, seed=0):
    g = np.random.default_rng(seed)
    return pd.DataFrame({"cluster": np.arange(n) * 3, "n": g.integers(1, 5, n).astype(float), "s_a": g.normal(size=n)})


def test_generator_agrees_everywhere(spark):
    counters = [0, 1, 7, 2**31, 2**40 + 5]
    frame = pd.DataFrame({"a": counters, "b": counters[::-1]})
    ours = [int(uniform(9, a, b)) for a, b in zip(frame["a"], frame["b"])]
    got = rng.with_random(spark.createDataFrame(frame), "u", 9, "a", F.col("b")).orderBy("a").toPandas()["u"].tolist()
    sql = duckdb.sql(f"SELECT u FROM (SELECT a, {rng.random_sql('u', 9, 'a', 'b')} FROM frame) ORDER BY a").fetchall()
    assert got == ours == [r[0] for r in sql]


def test_generator_is_spread_evenly():
    u = uniform(3, np.arange(100_000)) % 10
    counts = np.bincount(u, minlength=10)
    assert abs(counts - 10_000).max() < 500


def brute_sums(frame, draws, seed):
    size, out = len(frame), []
    for d in range(draws):
        picked = np.array([int(uniform(seed, 1, d, s)) % size for s in range(size)])
        out.append(frame.iloc[picked][["s_a", "n"]].sum().to_numpy())
    return np.array(out)


def test_bootstrap_sums_equal_brute_force(spark):
    frame = totals_frame()
    got = RS.resampled_sums(spark.createDataFrame(frame), ["s_a", "n"], 11, 5).toPandas().sort_values("draw")
    assert np.allclose(got[["s_a", "n"]].to_numpy(), brute_sums(frame, 11, 5))


def test_blocked_bootstrap_equals_brute_force(spark):
    frame, draws, block, seed = totals_frame(), 9, 5, 5
    got = RS.resampled_sums(spark.createDataFrame(frame), ["s_a", "n"], draws, seed, block=block).toPandas().sort_values("draw")
    want = []
    for d in range(draws):
        first = np.array([int(uniform(seed, 0, d, s)) % len(frame) for s in range(len(frame))])
        total = np.zeros(2)
        for b in range(math.ceil(len(frame) / block)):
            part = frame.iloc[b * block:(b + 1) * block]
            count = int((first // block == b).sum())
            local = [int(uniform(seed, b + 1, d, k)) % len(part) for k in range(count)]
            total += part.iloc[local][["s_a", "n"]].sum().to_numpy()
        want.append(total)
    assert np.allclose(got[["s_a", "n"]].to_numpy(), np.array(want))


def test_blocked_and_plain_draws_agree_in_distribution(spark):
    totals = spark.createDataFrame(totals_frame(200))
    spreads = []
    for block in (1000, 16):
        got = RS.resampled_sums(totals, ["s_a", "n"], 400, 8, block=block).toPandas()
        spreads.append((got["s_a"] / got["n"]).std())
        assert len(got) == 400
    assert abs(spreads[0] / spreads[1] - 1) < 0.25


def test_strata_are_resampled_apart(spark):
    frame = pd.concat([totals_frame(10).assign(g="x"), totals_frame(10, 1).assign(g="y")])
    got = RS.resampled_sums(spark.createDataFrame(frame), ["n"], 50, 3, ["g"]).toPandas()
    assert len(got) == 100
    for g, part in frame.groupby("g"):
        draws = got.loc[got["g"] == g, "n"]
        assert draws.between(part["n"].min() * 10, part["n"].max() * 10).all()


@pytest.fixture(scope="module")
def effects(spark):
    rows = [(0, 1, "A", 1.0), (0, 2, "A", 0.0), (0, 3, "B", -0.5), (1, 1, "A", 0.5), (1, 2, "A", 0.0), (1, 3, "B", -0.5)]
    return spark.createDataFrame(rows, "seed INT, query_id LONG, cluster_key STRING, d DOUBLE")


def test_effect_and_repeatability(spark, effects):
    totals = RS.effect_totals(effects, ["d"], [0, 1], per_seed=True)
    first = RS.cluster_bootstrap(totals, ["d"], 100, 1).first()
    assert first["effect"] == pytest.approx(0.5 / 6)
    assert first["low"] <= first["effect"] <= first["high"]
    assert RS.cluster_bootstrap(totals, ["d"], 100, 1).first() == first
    crossed = RS.crossed_bootstrap(totals, ["d"], [0, 1], 100, 1).first()
    assert crossed["effect"] == pytest.approx(0.5 / 6)
    p = RS.sign_flip(totals, ["d"], 99, 4).first()["p_value"]
    assert 0 < p <= 1


def test_constant_effect_has_a_point_interval(spark):
    rows = [(s, q, q % 4, 0.25) for s in (0, 1) for q in range(12)]
    totals = RS.effect_totals(spark.createDataFrame(rows, "seed INT, query_id LONG, cluster_key LONG, d DOUBLE"), ["d"], [0, 1], per_seed=True)
    for row in (RS.cluster_bootstrap(totals, ["d"], 50, 1).first(), RS.crossed_bootstrap(totals, ["d"], [0, 1], 50, 1).first()):
        assert (row["low"], row["effect"], row["high"]) == pytest.approx((0.25, 0.25, 0.25))


def test_all_zero_flip_is_one(spark):
    totals = spark.createDataFrame([(1, 2.0, 0.0), (2, 1.0, 0.0)], "cluster LONG, n DOUBLE, s_d DOUBLE")
    assert RS.sign_flip(totals, ["d"], 50, 1).first()["p_value"] == 1.0


def test_sign_flip_equals_brute_force(spark):
    frame = totals_frame(15)
    got = RS.sign_flip(spark.createDataFrame(frame), ["a"], 60, 2).first()["p_value"]
    observed, extreme = abs(frame["s_a"].sum() / frame["n"].sum()), 0
    for d in range(60):
        sign = np.array([1 if int(uniform(2, d, c)) % 2 else -1 for c in frame["cluster"]])
        extreme += abs((sign * frame["s_a"]).sum() / frame["n"].sum()) >= observed - 1e-15
    assert got == pytest.approx((extreme + 1) / 61)


@pytest.mark.parametrize("block", [10_000, 12])
def test_permuted_sums_equal_brute_force(spark, block):
    g = np.random.default_rng(4)
    frame = pd.DataFrame({"id": np.arange(97) * 2, "v": g.normal(size=97)})
    sizes = [("a", 20), ("b", 50), ("c", 27)]
    got = RS.permuted_sums(spark.createDataFrame(frame), "id", "v", sizes, 6, 3, block).toPandas()
    labels = np.repeat(["a", "b", "c"], [20, 50, 27])
    for d in range(6):
        order = sorted(range(97), key=lambda i: (int(uniform(3, d, frame["id"][i])), frame["id"][i]))
        for label, n in sizes:
            want = frame["v"].to_numpy()[np.array(order)[labels == label]].sum()
            row = got[(got["draw"] == d) & (got["label"] == label)].iloc[0]
            assert row["total"] == pytest.approx(want) and row["n"] == n


def test_contrast_of_separated_groups(spark):
    rows = spark.createDataFrame([(i, i, 1.0 if i < 10 else 0.0, "l" if i < 10 else "r") for i in range(20)],
                                 "id LONG, cluster_key LONG, v DOUBLE, g STRING")
    row = RS.contrast_bootstrap(rows, "v", "g", ["l"], ["r"], 50, 1).first()
    assert (row["low"], row["high"]) == (1.0, 1.0)
    test = RS.contrast_permutation(rows, "id", "v", "g", ["l"], ["r"], 199, 1).first()
    assert test["contrast"] == 1.0 and test["p_value"] <= 0.02
    assert RS.omnibus_permutation(rows, "id", "v", "g", 199, 1).first()["p_value"] <= 0.02


def test_between_group_statistic(spark):
    rows = spark.createDataFrame([("x", "a", 0.0), ("x", "a", 2.0), ("x", "b", 0.0), ("x", "b", 2.0), ("y", "a", 0.0),
                                  ("y", "a", 0.0), ("y", "b", 2.0), ("y", "b", 2.0)], "s STRING, label STRING, v DOUBLE")
    sums = rows.groupBy("s", "label").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    got = {r["s"]: r["statistic"] for r in RS.between_group(sums, ["s"]).collect()}
    assert got == {"x": 0.0, "y": 4.0}


def test_empty_contrast_is_an_error(spark):
    rows = spark.createDataFrame([(1.0, "a")], "v DOUBLE, g STRING")
    with pytest.raises(Exception, match="empty contrast"):
        RS.mean_contrast(rows, "v", "g", ["a"], ["b"]).collect()


@pytest.mark.parametrize("b,c", [(0, 0), (1, 0), (5, 5), (3, 12), (40, 25), (700, 640), (200_000, 199_000)])
def test_exact_mcnemar(spark, b, c):
    got = spark.createDataFrame([(b, c)], "b LONG, c LONG").select(RS.exact_mcnemar("b", "c")).first()[0]
    n, k = b + c, min(b, c)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    want = min(1.0, 2 * math.fsum(math.exp(v) for v in logs)) if n else 1.0
    assert got == pytest.approx(want, rel=1e-6)


def test_wilcoxon_with_zeros_and_ties(spark):
    d = [0.0, 0.0, 1.0, -1.0, 2.0, 3.0, 3.0, -0.5]
    row = RS.wilcoxon_pratt(spark.createDataFrame([(v,) for v in d], "d DOUBLE"), "d").first()
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    signs = np.sign(d)
    w = min(ranks[signs > 0].sum(), ranks[signs < 0].sum())
    n, z = len(d), 2
    ties = sum(t * (t * t - 1) for t in (2, 2, 1, 1))
    mean = (n * (n + 1) - z * (z + 1)) / 4
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - 0.5 * ties) / 24)
    assert row["statistic"] == w and row["z"] == pytest.approx((w - mean) / sd)
    assert row["p_value"] == pytest.approx(math.erfc(abs(w - mean) / sd / math.sqrt(2)))
    flat = RS.wilcoxon_pratt(spark.createDataFrame([(0.0,), (0.0,)], "d DOUBLE"), "d").first()
    assert flat["p_value"] == 1.0


def test_signed_rank_equals_enumeration(spark):
    rng = np.random.default_rng(5)
    for n in [*range(1, 13), 20]:
        signs = np.array(np.meshgrid(*[[0, 1]] * min(n, 12))).reshape(min(n, 12), -1) if n <= 12 else None
        d = rng.permutation(np.arange(1, n + 1)) * rng.choice([-1.0, 1.0], n) * 1.5
        row = RS.wilcoxon_pratt(spark.createDataFrame([(float(v),) for v in d], "d DOUBLE"), "d").first()
        w = min(sum(abs(v) for v in d if v > 0), sum(abs(v) for v in d if v < 0)) / 1.5
        assert row["exact"] and row["n"] == n and row["statistic"] == w
        if signs is not None:
            sums = np.arange(1, n + 1) @ signs
            assert row["p_value"] == pytest.approx(min(1.0, 2 * np.mean(sums <= w)), abs=1e-15)
        else:
            import itertools
            reach = {0: 1}
            for k in range(1, n + 1):
                reach = {s: reach.get(s, 0) + reach.get(s - k, 0) for s in {*reach, *(s + k for s in reach)}}
            assert row["p_value"] == pytest.approx(min(1.0, 2 * sum(c for s, c in reach.items() if s <= w) / 2**n), abs=1e-15)
            assert sum(itertools.chain(reach.values())) == 2**n


def test_signed_rank_known_value_and_rule(spark):
    rows = [("five", float(v)) for v in (1, 2, 3, 4, 5)] + [("tied", v) for v in (1.0, 1.0, 2.0)] + [("zero", v) for v in (0.0, 1.0, 2.0)]
    rows += [("many", float(v)) for v in range(1, 52)] + [("fifty", float(v)) for v in range(1, 51)] + [(None, 1.0), ("five", None)]
    got = {r["g"]: r for r in RS.wilcoxon_pratt(spark.createDataFrame(rows, "g STRING, d DOUBLE"), "d", ["g"]).collect()}
    assert got["five"]["p_value"] == 0.0625 and got["five"]["n"] == 5
    assert {g: r["exact"] for g, r in got.items()} == {"five": True, "tied": False, "zero": False, "many": False, "fifty": True, None: True}
    assert got["fifty"]["p_value"] == 2.0**-49 and got[None]["p_value"] == 1.0
    assert RS.wilcoxon_pratt(spark.createDataFrame([], "g STRING, d DOUBLE"), "d", ["g"]).count() == 0


def test_string_clusters_have_their_own_counters(spark):
    keys = spark.range(400_000).select(F.concat(F.lit("cluster "), "id").alias("k"))
    assert keys.select(RS.key_number("k", "string").alias("n")).distinct().count() == 400_000


def test_pick_counts_equal_the_picks(spark):
    clusters = spark.range(40_000).select((F.col("id") * 3).alias("c"))
    want = RS.picks(clusters, "c", 3, 11).groupBy("draw").agg(F.count(F.lit(1)), F.count_distinct("idx")).collect()
    assert sorted(tuple(r) for r in RS.pick_counts(clusters, 3, 11).collect()) == sorted(tuple(r) for r in want)
    assert RS.pick_counts(clusters.limit(0), 3, 11).count() == 0


def test_permutation_counts_few_rows_per_draw(spark, monkeypatch):
    """Rows of counts per task and draw have a bound that rows of the table do not raise; sums are the same for any buckets."""
    rows = spark.range(3_000).select("id", (F.col("id") % 17).cast("double").alias("v"))
    sums = lambda: sorted((r["draw"], r["label"], round(r["total"], 6), r["n"]) for r in RS.permuted_sums(
        rows, "id", "v", [("a", 900), ("b", 1_300), ("c", 800)], 5, 3).collect())
    want = sums()
    monkeypatch.setattr(RS, "_BUCKET_BITS", 1)
    assert sums() == want and RS.PERMUTED_BLOCK > 2 ** 10


def test_signed_ranks_are_of_counted_sizes(hot):
    """Differences of few sizes are counted before they are ordered: one row per group and size, not one per difference."""
    rows = hot.range(0, 4_000, 1, 4).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(7)) - 3.0).alias("d"))
    out = RS.wilcoxon_pratt(rows, "d", ["g"])
    got = {r["g"]: r for r in out.collect()}
    for g, part in rows.toPandas().groupby("g"):
        rank = part["d"].abs().rank()
        want = min(rank[part["d"] > 0].sum(), rank[part["d"] < 0].sum())
        assert got[g]["n"] == len(part) and got[g]["statistic"] == want and not got[g]["exact"]
    # With every group above the limit, what is written and ordered are the 2 x 4 sizes.
    files = {name for name in out.inputFiles()}
    assert files and hot.read.parquet(*files).count() <= 2 * 4
